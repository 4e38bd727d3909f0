"""Quality classifier: perplexity under an interpolated modified Kneser-Ney model of trusted text.

The model is of characters, mapped to ``SYMBOLS`` symbols, in n-grams of ``ORDER``: an
n-gram is one packed number, its context is that number shifted, its suffix that number
masked. Counts, continuation counts, discounts, back-off weights and interpolated
probabilities are tables of n-grams, each made by a grouped sum or a join on n-grams, and
so sharded by them.

Scoring shuffles no occurrence. The distinct n-grams of a unit of text (``UNIT``
characters, about) are collected while it is read; the distinct n-grams of all units get
their log-probabilities by joins with the model's tables; these go back to the units by a
join on n-grams; and each unit, packed, meets its own n-grams and is scored there. What
travels grows with the input, while frequent n-grams travel once per unit.

A unit is a few neighbouring input partitions, or a part of one. Its two readings must
agree, as they do for a table; each unit carries a digest of its ids, and a difference
raises an error rather than giving wrong scores.

Trusted text are the rows of ``labels`` with quality 1. One in ``APART`` of them, by a hash
of the id, is set apart; the model is fitted on all others. A language's threshold is the
exact ``QUANTILE`` quantile of the perplexities of all trusted documents of that language
that are set apart; a language with fewer than ``LEAST`` of them gets that of all.

Edge cases: a null or blank text has no perplexity and is rejected; a null language is one
of its own; without trusted rows nothing is rejected but blank texts; texts are scored
whole; equal texts of one language share their decision, and so do rows that share id and
language (by their highest perplexity); columns beyond those used are ignored.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .collocations import Bitmap, bitmap
from .common import crc32_of_id, table, written

ORDER = 4
BITS = 12
SYMBOLS = 1 << BITS
QUANTILE = 0.99
#: Parts of a doubling of the perplexity in which values are counted.
BANDS = 4096
#: One in so many trusted documents is never learned from.
APART = 5
LEAST = 50
UNIT = 16 << 20
CHUNK = 4 << 20
#: Discounts where counts of counts are missing.
DEFAULT_DISCOUNTS = (0.5, 1.0, 1.5)


# In tasks


def symbols(text: str) -> np.ndarray:
    """Symbols of a text: code points below 2048 are their own, others share the upper half; 0 stands before and after."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
    half = SYMBOLS // 2
    return np.where(points < half, points, half + points % (half - 1))


def ngrams(text: str, order: int = ORDER) -> np.ndarray:
    """One packed n-gram per character and one for the end."""
    flat = np.concatenate([np.zeros(order - 1, np.int64), symbols(text), np.zeros(1, np.int64)])
    n = len(flat) - order + 1
    packed = flat[:n].copy()
    for i in range(1, order):
        packed <<= BITS
        packed |= flat[i : i + n]
    return packed


def _blank(text: str | None) -> bool:
    return not text or not text.strip()


class Distinct:
    """Distinct numbers and their counts, merged as they come."""

    def __init__(self, limit: int = 4_000_000) -> None:
        self.limit, self.waiting, self.size, self.keys, self.counts = limit, [], 0, np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, keys: np.ndarray) -> None:
        self.waiting.append(keys)
        self.size += len(keys)
        if self.size > self.limit:
            self.merge()

    def merge(self) -> None:
        if self.waiting:
            keys, counts = np.unique(np.concatenate(self.waiting), return_counts=True)
            both, place = np.unique(np.concatenate([self.keys, keys]), return_inverse=True)
            self.counts = np.bincount(place, np.concatenate([self.counts, counts]), len(both)).astype(np.int64)
            self.keys, self.waiting, self.size = both, [], 0


def _counts(batches: Iterator[pa.RecordBatch], order: int) -> Iterator[pa.RecordBatch]:
    found = Distinct()
    for batch in batches:
        for text in batch.column(0):
            if not _blank(text.as_py()):
                found.add(ngrams(text.as_py(), order))
        if len(found.keys) > 4_000_000:
            found.merge()
            yield pa.RecordBatch.from_arrays([pa.array(found.keys), pa.array(found.counts)], ["g", "c"])
            found = Distinct()
    found.merge()
    yield pa.RecordBatch.from_arrays([pa.array(found.keys), pa.array(found.counts)], ["g", "c"])


def _units(batches: Iterator[pa.RecordBatch], together: int, unit: int) -> Iterator[tuple[int, list[tuple[int, str | None]]]]:
    """(unit, rows) in pieces of up to a batch: the unit's number follows from partition and characters read so far."""
    part, read = TaskContext.get().partitionId(), 0
    for batch in batches:
        rows: list[tuple[int, str | None]] = []
        now = read // unit
        for row in zip(batch.column(0), batch.column(1), strict=True):
            key, text = row[0].as_py(), row[1].as_py()
            if read // unit != now:
                yield (part // together) << 24 | now, rows
                rows, now = [], read // unit
            rows.append((key, text))
            read += len(text or "")
        if rows:
            yield (part // together) << 24 | now, rows


def _digest(keys: list) -> int:
    """The same for any order of the keys."""
    return sum(xxhash.xxh64_intdigest(repr(k), 7) for k in keys) & ((1 << 62) - 1)


def _seen(batches: Iterator[pa.RecordBatch], order: int, together: int, unit: int) -> Iterator[pa.RecordBatch]:
    """(unit, g): a unit's distinct n-grams; with g of -1 - digest, what its keys add up to."""
    now, found, digest = None, Distinct(), 0

    def done() -> pa.RecordBatch:
        found.merge()
        own = np.append(found.keys, -1 - digest)
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(own), now, np.int64)), pa.array(own)], ["unit", "g"])

    for number, rows in _units(batches, together, unit):
        if number != now and now is not None:
            yield done()
            found, digest = Distinct(), 0
        now = number
        digest = (digest + _digest([k for k, _ in rows])) & ((1 << 62) - 1)
        for _, text in rows:
            if not _blank(text):
                found.add(ngrams(text, order))
    if now is not None:
        yield done()


def _packed(batches: Iterator[pa.RecordBatch], together: int, unit: int) -> Iterator[pa.RecordBatch]:
    """(unit, docs): rows of a unit, compressed in chunks."""
    squeeze = zstandard.ZstdCompressor(level=3).compress

    def row(number: int, keys: list, texts: list) -> pa.RecordBatch:
        raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        head = struct.pack(f"<I{3 * len(keys)}q", len(keys), *[-1 if k is None else k for k in keys], *[k is None for k in keys], *[-1 if t is None else len(r) for t, r in zip(texts, raw, strict=True)])
        return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([squeeze(head + b"".join(raw))], pa.binary())], ["unit", "docs"])

    now, keys, texts, size = None, [], [], 0
    for number, rows in _units(batches, together, unit):
        for key, text in rows:
            if keys and (number != now or size >= CHUNK):
                yield row(now, keys, texts)
                keys, texts, size = [], [], 0
            now = number
            keys.append(key)
            texts.append(text)
            size += len(text or "")
    if keys:
        yield row(now, keys, texts)


def _unpacked(data: bytes) -> Iterator[tuple[int | None, str | None]]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    n, = struct.unpack_from("<I", raw)
    fields = struct.unpack_from(f"<{3 * n}q", raw, 4)
    at = 4 + 24 * n
    for key, none, size in zip(fields[:n], fields[n : 2 * n], fields[2 * n :], strict=True):
        yield (None if none else key), (None if size < 0 else raw[at : at + size].decode("utf-8", "surrogatepass"))
        at += max(size, 0)


def _score(order: int):
    def run(docs: pa.Table, scores: pa.Table) -> pa.Table:
        keys, values = scores.column("g").to_numpy(), scores.column("lp").to_numpy()
        digest = sum(int(-1 - k) for k in keys[keys < 0]) & ((1 << 62) - 1)
        values, keys = values[keys >= 0], keys[keys >= 0]
        in_order = np.argsort(keys)
        keys, values = keys[in_order], values[in_order]
        ids, sizes, sums = [], [], []
        for data in docs.column("docs"):
            for key, text in _unpacked(data.as_py()):
                ids.append(key)
                if _blank(text):
                    sizes.append(0)
                    sums.append(None)
                    continue
                own = ngrams(text, order)
                at = np.searchsorted(keys, own)
                if len(keys) == 0 or not (keys[np.minimum(at, len(keys) - 1)] == own).all():
                    raise ValueError("a unit's text changed between two readings of the table")
                sizes.append(len(own))
                sums.append(float(values[at].sum()))
        if digest != _digest(ids):
            raise ValueError("a unit's rows changed between two readings of the table")
        return pa.table({"id": pa.array(ids, pa.int64()), "n": pa.array(sizes, pa.int64()), "lp": pa.array(sums, pa.float64())})

    return run


# Tables


def _suffix(g: Column, order: int) -> Column:
    return g.bitwiseAND(F.lit((1 << BITS * order) - 1))


class Model:
    """By order k: ``p[k]`` (g, p) and ``weight[k]`` (ctx, w), as written tables."""

    def __init__(self, order: int, p: dict[int, DataFrame], weight: dict[int, DataFrame], none: float) -> None:
        self.order, self.p, self.weight, self.none = order, p, weight, none


def _discounts(counted: DataFrame) -> tuple[float, float, float]:
    """Of counts 1, 2 and over 2, from the numbers of n-grams that occur 1 to 4 times."""
    n1, n2, n3, n4 = counted.agg(*[F.coalesce(F.sum((F.col("c") == i).cast("long")), F.lit(0)) for i in (1, 2, 3, 4)]).first()
    if not (n1 and n2 and n3 and n4):
        return DEFAULT_DISCOUNTS
    y = n1 / (n1 + 2 * n2)
    found = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return tuple(min(max(d, 0.05), i - 0.05) for i, d in enumerate(found, 1))


def fit(texts: DataFrame, order: int = ORDER) -> Model:
    """The model of the column ``text``."""
    counted = texts.select("text").mapInArrow(lambda b: _counts(b, order), "g long, c long").groupBy("g").agg(F.sum("c").alias("c"))
    counts = {order: written(counted, "ngrams")}
    for k in range(order - 1, 0, -1):  # continuation counts: in how many n-grams one longer is this the suffix
        counts[k] = written(counts[k + 1].groupBy(_suffix(F.col("g"), k).alias("g")).agg(F.count(F.lit(1)).alias("c")), "ngrams")
    p: dict[int, DataFrame] = {}
    weight: dict[int, DataFrame] = {}
    for k in range(1, order + 1):
        d1, d2, d3 = _discounts(counts[k])
        c = F.col("c")
        discount = F.when(c == 1, d1).when(c == 2, d2).otherwise(d3)
        ctx = F.shiftright("g", BITS)
        context = counts[k].groupBy(ctx.alias("ctx")).agg(F.sum("c").alias("total"), (F.sum(discount) / F.sum("c")).alias("w"))
        context = written(context, "contexts")
        joined = counts[k].withColumn("ctx", ctx).join(context, "ctx").select("g", ((c - discount) / F.col("total")).alias("own"), "w")
        if k == 1:
            found = joined.select("g", (F.col("own") + F.col("w") / SYMBOLS).alias("p"))
        else:
            lower = p[k - 1].select(F.col("g").alias("s"), F.col("p").alias("q"))
            found = joined.join(lower, _suffix(F.col("g"), k - 1) == F.col("s")).select("g", (F.col("own") + F.col("w") * F.col("q")).alias("p"))
        p[k], weight[k] = written(found, "probabilities"), context.select("ctx", "w")
    first = weight[1].first()
    return Model(order, p, weight, (first.w if first else 1.0) / SYMBOLS)


def log_probabilities(distinct: DataFrame, model: Model) -> DataFrame:
    """(g, lp) for a table of distinct n-grams ``g``, by joins with the model's tables from the lowest order up."""
    now = distinct.select("g").withColumn("q", F.lit(model.none))
    for k in range(1, model.order + 1):
        seen = model.p[k].select(F.col("g").alias("s"), "p")
        own = _suffix(F.col("g"), k)
        now = now.join(seen, own == F.col("s"), "left").drop("s")
        if k == 1:  # the one context's weight is in ``none`` already
            now = now.select("g", F.coalesce("p", "q").alias("q"))
            continue
        back = model.weight[k].select(F.col("ctx").alias("x"), "w")
        now = now.join(back, F.shiftright(own, BITS) == F.col("x"), "left").select("g", F.coalesce("p", F.coalesce("w", F.lit(1.0)) * F.col("q")).alias("q"))
    return now.select("g", F.log("q").cast("float").alias("lp"))


def perplexities(docs: DataFrame, model: Model, text: str = "text", key: str = "doc_id", unit: int = UNIT) -> DataFrame:
    """(id, n, perplexity) per row of ``docs``, a table that gives the same partitions whenever it is read."""
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    size = rows.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    parts = rows.rdd.getNumPartitions()
    together = max(1, min(parts, int(parts * unit / max(1, size))))
    order = model.order
    seen = written(rows.mapInArrow(lambda b: _seen(b, order, together, unit), "unit long, g long").distinct(), "seen")
    scores = log_probabilities(seen.where("g >= 0").select("g").distinct(), model)
    scores = seen.where("g >= 0").join(scores, "g").select("unit", "g", "lp").unionByName(seen.where("g < 0").withColumn("lp", F.lit(0).cast("float")))
    packed = rows.mapInArrow(lambda b: _packed(b, together, unit), "unit long, docs binary")
    found = packed.groupBy("unit").cogroup(scores.groupBy("unit")).applyInArrow(_score(order), "id long, n long, lp double")
    return found.select("id", "n", F.exp(-F.col("lp") / F.col("n")).alias("perplexity"))


def quantiles(rows: DataFrame, share: float) -> DataFrame:
    """(group, value, m): the least value of each group of (group, x) that a share of its m rows does not exceed.

    Exact, and no task holds a group: rows are counted by band, and only the band of that rank is read again, by value."""
    banded = rows.withColumn("band", F.floor(F.log2("x") * BANDS))
    upto, whole = Window.partitionBy("group").orderBy("band").rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy("group")
    counted = banded.groupBy("group", "band").agg(F.count(F.lit(1)).alias("n"))
    counted = counted.select("group", "band", "n", F.sum("n").over(upto).alias("upto"), F.sum("n").over(whole).alias("m"))
    nth = F.greatest(F.ceil(F.col("m") * F.lit(share)), F.lit(1)) - (F.col("upto") - F.col("n"))
    at = counted.select("group", "band", "m", nth.alias("nth"), "n").where(F.col("nth").between(1, F.col("n"))).drop("n")
    held = banded.groupBy("group", "band", "x").agg(F.count(F.lit(1)).alias("n")).join(at, ["group", "band"])
    held = held.withColumn("upto", F.sum("n").over(Window.partitionBy("group").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)))
    return held.where(F.col("upto") >= F.col("nth")).groupBy("group").agg(F.min("x").alias("value"), F.first("m").alias("m"))


def learned(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows (id, text) of ``docs`` whose id is one of ``ids``. A bitmap of fixed size spares most others the shuffle."""
    sent = bitmap(ids)

    @F.pandas_udf("boolean")
    def marked(own: pd.Series) -> pd.Series:
        return pd.Series(Bitmap(sent.value).holds(own.to_numpy(np.int64).view(np.uint64)))

    return docs.where(F.col("id").isNotNull()).where(marked("id")).join(ids, "id", "left_semi")


def judged(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", lang: str = "lang", order: int = ORDER, quantile: float = QUANTILE, unit: int = UNIT) -> DataFrame:
    """(key, lang, n, perplexity, threshold, kept) per row of ``docs``."""
    trusted = labels.where("quality = 1 AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("id")).distinct()
    apart = F.pmod(crc32_of_id(F.col("id")), F.lit(APART)) == 0
    ids = written(trusted.where(~apart), "trusted")
    model = fit(learned(docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")), ids), order)
    found = written(perplexities(docs, model, text, key, unit), "perplexities")
    # Equal (id, lang) rows are one: joined back by id, each row of docs with its own language.
    langs = docs.select(F.col(key).cast("long").alias("id"), F.col(lang).alias("lang"))
    own = found.groupBy("id").agg(F.max("n").alias("n"), F.max("perplexity").alias("perplexity"))
    rows = langs.join(own, langs["id"].eqNullSafe(own["id"])).select(langs["id"].alias("id"), "lang", "n", "perplexity")
    known = rows.where(F.col("perplexity").isNotNull()).join(trusted.where(apart), "id", "left_semi")
    known = written(known.select("lang", F.col("perplexity").alias("x")), "apart")
    named = quantiles(known.select(F.struct("lang").alias("group"), "x"), quantile)  # a null language is a group as well
    limits = named.where(F.col("m") >= LEAST).select(F.col("group.lang").alias("l"), F.col("value").alias("own"))
    every = quantiles(known.select(F.lit(0).alias("group"), "x"), quantile).agg(F.max("value").alias("of_all"))
    out = rows.join(limits, F.col("lang").eqNullSafe(F.col("l")), "left").crossJoin(F.broadcast(every))
    threshold = F.coalesce("own", "of_all")
    kept = F.col("perplexity").isNotNull() & F.coalesce(F.col("perplexity") <= threshold, F.lit(True))
    return out.select(F.col("id").alias(key), F.col("lang").alias(lang), "n", "perplexity", threshold.alias("threshold"), kept.alias("kept"))


def accepted(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` that are kept."""
    kept = judged(docs, labels, **how).where("kept").select(F.col("doc_id").alias("__id"), F.col("lang").alias("__lang")).distinct()
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["__id"]) & docs["lang"].eqNullSafe(kept["__lang"]), "left_semi")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))

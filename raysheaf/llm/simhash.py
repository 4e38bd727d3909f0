"""SimHash fingerprints and their links by pigeonring filtering.

``near_duplicates`` links all fingerprints within a few bits, exactly. ``similar`` links
texts by the similarity of their shingles.

A fingerprint's 64 bits are cut into ``m`` segments that stand in a ring. If two
fingerprints differ in at most ``d`` bits, then from some segment on, every run of ``l``
consecutive segments differs in at most ``l * d / m`` bits. With ``m`` of 9 and ``d`` of 2
these budgets are 0 for up to four segments, 1 for up to eight, 2 for all. So

* candidates agree exactly in four consecutive segments: an equi-join on (start, bits);
* of these, only those stay whose chain of eight segments differs in at most one bit;
* what is left is checked in full.

All three conditions belong to the join, which emits true links only. Equal fingerprints
are one node: links are sought between distinct fingerprints, and copies add none.

A bucket with more than ``bucket`` fingerprints is not joined with itself. Its members
are linked exactly in linear work instead: each emits itself and all its variants with
one bit flipped outside the shared segments. Two members within two bits of each other
have a variant in common, and members that have one in common are within two bits, so
each is linked to the least of them.

At the distance that texts with four fifths of their shingles in common may have, about a
quarter of the bits, no run of segments need be equal, and no index on segments of a
fingerprint is selective. ``similar`` therefore takes its segments from the shingle set
itself (see ``ringsets``), with the same chains and budgets, and is exact.

Edge cases: a null or wordless text has fingerprint zero and links like any other; a text
shorter than a shingle is one shingle; repeated rows and equal texts share a component;
a null doc_id gets its component, and is no component's id unless all are null; texts of any
length are read whole; an empty table gives an empty result; ties of ids share a component's
id; further columns have no effect, and may have any name but one beginning with ``__ring_``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ringsets
from .common import table, written
from .components import stars

BITS = 64
SHINGLE = 3
MAX_DISTANCE = 2
SEGMENTS = 9
BUCKET = 256
SEED = 42


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The fingerprint as an unsigned number. bytes.lower() lowers A-Z only, bytes.split() splits at the contract's white space."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    flat = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    n = max(1, len(words) - shingle + 1)
    starts = [0, *(ends[: n - 1] + 1).tolist()]
    stops = ends[min(shingle, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(flat[i:j], seed) for i, j in zip(starts, stops, strict=True)), dtype="<u8", count=n)
    counts = np.zeros(BITS, dtype=np.int64)
    for i in range(0, n, 4096):  # a block at a time: very long texts
        counts += np.unpackbits(hashes[i : i + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits((2 * counts > n).astype(np.uint8), bitorder="little").view("<u8")[0])


def _batches(batches: Iterator[pa.RecordBatch], shingle: int, seed: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = np.fromiter((fingerprint(t.as_py(), shingle, seed) for t in batch.column(1)), dtype=np.uint64, count=batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["id", "fp"])


def fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(id, fp) per row; fp holds the 64 bits as a signed long."""
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    return rows.mapInArrow(partial(_batches, shingle=shingle, seed=seed), f"id {rows.schema['id'].dataType.simpleString()}, fp long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _masks(segments: int) -> list[int]:
    cuts = [BITS * i // segments for i in range(segments + 1)]
    return [((1 << (j - i)) - 1) << i for i, j in zip(cuts, cuts[1:], strict=False)]


def _chain(masks: list[int], start: int, length: int) -> int:
    return sum(masks[(start + i) % len(masks)] for i in range(length))


def budgets(segments: int, distance: int) -> list[int]:
    """The most bits in which l = 1..segments consecutive segments of a chain may differ."""
    return [length * distance // segments for length in range(1, segments + 1)]


def _within(x: Column, mask: Column | int, most: int) -> Column:
    return F.bit_count(x.bitwiseAND(F.lit(_signed(mask)) if isinstance(mask, int) else mask)) <= most


def links(fps: DataFrame, distance: int = MAX_DISTANCE, segments: int = SEGMENTS, bucket: int = BUCKET) -> DataFrame:
    """Edges (a, b) whose components are those of all pairs of distinct ``fp`` within ``distance``; every edge is a link."""
    if segments <= distance or distance < 1:
        raise ValueError("takes more segments than differing bits, and one such bit at least")
    masks, most = _masks(segments), budgets(segments, distance)
    exact = most.count(0)
    shared = [_chain(masks, s, exact) for s in range(segments)]
    keys = F.array(*[F.struct(F.lit(s).alias("s"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("k")) for s, m in enumerate(shared)])
    rows = fps.select("fp").distinct().select("fp", F.explode(keys).alias("at")).select("fp", "at.s", "at.k")
    sizes = rows.groupBy("s", "k").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    rows = written(rows.join(sizes, ["s", "k"]), "buckets")
    small = rows.where(F.col("n") <= bucket).select("s", "k", "fp")
    # The last length of each budget is the sharpest; the shared segments need no check.
    checks = [(length, most[length - 1]) for length in range(exact + 1, segments + 1) if length == segments or most[length] > most[length - 1]]
    of = {length: F.element_at(F.array(*[F.lit(_signed(_chain(masks, s, length))) for s in range(segments)]), F.col("s") + 1) for length, _ in checks if length < segments}
    differ = F.col("fp").bitwiseXOR(F.col("fp_b"))
    chained = F.col("fp") < F.col("fp_b")
    for length, limit in checks:
        chained = chained & (_within(differ, of[length], limit) if length < segments else (F.bit_count(differ) <= limit))
    right = small.select(F.col("s").alias("s_b"), F.col("k").alias("k_b"), F.col("fp").alias("fp_b"))
    pairs = small.join(right, (F.col("s") == F.col("s_b")) & (F.col("k") == F.col("k_b")) & chained).select(F.col("fp").alias("a"), F.col("fp_b").alias("b"))
    hot = rows.where(F.col("n") > bucket).select("s", "k", "fp")
    if distance == 2:
        flips = F.element_at(F.array(*[F.array(*[F.lit(_signed(1 << i)) for i in range(BITS) if not m >> i & 1]) for m in shared]), F.col("s") + 1)
        near = F.concat(F.array(F.col("fp")), F.transform(flips, lambda f: F.col("fp").bitwiseXOR(f)))
        variants = hot.select("s", "fp", F.explode(near).alias("v"))
        least = variants.groupBy("s", "v").agg(F.min("fp").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1")
        starred = variants.join(least, ["s", "v"]).where("fp <> b").select(F.col("fp").alias("a"), "b")
        pairs = pairs.unionByName(starred)
    elif not hot.isEmpty():
        raise ValueError(f"buckets of over {bucket} fingerprints are linked exactly at a distance of 2 only: raise bucket or segments")
    return pairs


def components(found: DataFrame, distance: int = MAX_DISTANCE, segments: int = SEGMENTS, bucket: int = BUCKET) -> DataFrame:
    """(id, fp) rows with component_id, the smallest id that a row's fingerprint reaches."""
    classes = written(found.groupBy("fp").agg(F.min("id").alias("least")), "classes")
    roots = stars(links(classes.select("fp"), distance, segments, bucket)).select(F.col("node").alias("fp"), "root")
    rooted = classes.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return found.join(rooted.join(least, "root").select("fp", "component_id"), "fp")


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = SHINGLE, distance: int = MAX_DISTANCE, segments: int = SEGMENTS, bucket: int = BUCKET) -> DataFrame:
    """One row per row of ``docs``: the key, fingerprint (16 hexadecimal digits) and component_id."""
    found = written(fingerprints(docs, text, key, shingle), "fingerprints")
    rows = components(found, distance, segments, bucket)
    return rows.select(F.col("id").alias(key), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def similar(docs: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = ringsets.SHINGLE, similarity: float = ringsets.SIMILARITY) -> DataFrame:
    """(node, id, component_id): rows of ``docs`` with the smallest id that links of the given similarity reach, exactly; equal texts are one node."""
    roots = ringsets.classes(docs, text, shingle, similarity)
    nodes = written(docs.select(ringsets.node_of(F.col(text)).alias("node"), F.col(key).alias("id")), "nodes")  # texts are long, read them once
    rooted = nodes.join(roots, "node", "left").select("node", "id", F.coalesce("root", "node").alias("root"))
    return rooted.join(rooted.groupBy("root").agg(F.min("id").alias("component_id")), "root").select("node", "id", "component_id")


def _row(key: Column, node: Column) -> Column:
    return F.struct(F.xxhash64(key, node).alias("both"), node.alias("node"))


def one_of_each(docs: DataFrame, text: str = "text", key: str = "doc_id", **how) -> DataFrame:
    """The rows of ``docs`` that stay: of each group of similar texts, the one with the smallest id. Rows that repeat id and text stay or go together."""
    stay = similar(docs, text, key, **how).where(F.col("id").eqNullSafe(F.col("component_id"))).select(_row(F.col("id"), F.col("node")).alias("__ring_row")).distinct()
    return docs.withColumn("__ring_row", _row(F.col(key), ringsets.node_of(F.col(text)))).join(stay, "__ring_row", "left_semi").drop("__ring_row")


def op5_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))

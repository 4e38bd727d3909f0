"""Words one edit apart, and the spelling that each rare variant stands for.

Two words differ by exactly one inserted, deleted or replaced code point when their common
prefix and common suffix together reach the length of the longer less one. Candidates meet in
groups, each word twice: among words of its own length and one less, and of one more. For a
longer length of L such a pair has L - 1 characters in common around the edit, so by
where the edit is it shares one of ``PARTS`` keys of a prefix and a suffix that add up to some
two thirds of them. A group's words are rows of padded matrices of code points; blocks of
rows are set against each other whole, column by column from the left for the prefix and from
the right for the suffix. Groups of up to ``SMALL`` words are stacked to one tile; a larger one is
dealt to blocks of about ``BLOCK`` words, each pair of blocks being a tile of its own that any task
may take, so that no task holds a group. A pair that shares several keys counts at the first.

The form of a word is its near word of the largest count, if that is ``RATIO`` times its own;
counts grow along forms, so following them ends after a few steps (``roots``), each of which
doubles what the one before has reached.

Edge cases: a null text has no words; a null id is written as ``null`` where the misspelling of a
word is drawn; repeated rows count repeatedly; words and texts of any length are read whole;
ties of counts are by code points; a word without near words has 0 of them, no form and
itself as root; an empty table gives an empty result; further columns have no effect, whatever
their names.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

SHORTEST, OFTEN, RATIO = 7, 2, 10
#: One run in so many loses a code point.
DRAWN = 31
PARTS = 3
#: Words of a group that is stacked with others; words of a block of a larger one.
SMALL, BLOCK = 64, 1024
#: Pairs that a task compares at once; words that it counts before it passes them on.
CELLS, KNOWN = 1 << 21, 400_000
_UPPER = str.maketrans({c: chr(ord(c) + 32) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def drawn(run: str, seed: int, modulus: int = DRAWN) -> str:
    """A lower-cased run, without one code point if its checksum says so."""
    h = zlib.crc32(run.encode(), seed)
    if h % modulus:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def words(docs: DataFrame, text: str = "text", key: str = "doc_id", shortest: int = SHORTEST, often: int = OFTEN, modulus: int = DRAWN) -> DataFrame:
    """(word, n): the words of all texts that are long and frequent enough."""
    runs = re.compile(f"[A-Za-zÀ-ÿ]{{{shortest},}}").findall
    rows = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("null")).alias("id"), F.col(text).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], ["word", "n"])
            total.clear()
            return out

        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                seed = zlib.crc32(f"{i}:".encode())
                for run, n in Counter(runs((t.as_py() or "").translate(_UPPER))).items():
                    word = drawn(run, seed, modulus)
                    if len(word) >= shortest:
                        total[word] += n
                if len(total) >= KNOWN:
                    yield flush()
        if total:
            yield flush()

    return rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= often)


def shares(length: int, parts: int = PARTS) -> list[tuple[int, int]]:
    """(prefix, suffix) of the keys of pairs whose longer word has ``length`` characters: wherever the edit is, one of them is clear of it."""
    cuts = [(length - 1) * i // parts for i in range(parts + 1)]
    return [(cuts[i], length - 1 - cuts[i + 1]) for i in range(parts)]


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(length, part, key, word, n) for the two lengths and all parts."""
    for batch in batches:
        for i in range(0, batch.num_rows, 20_000):
            out = [[], [], [], [], []]
            for word, n in zip(*(c.to_pylist() for c in batch.slice(i, 20_000).columns), strict=True):
                for length in (len(word), len(word) + 1):
                    for part, (prefix, suffix) in enumerate(shares(length)):
                        for values, v in zip(out, (length, part, word[:prefix] + word[len(word) - suffix :], word, n), strict=True):
                            values.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, (pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int64()), strict=True)], ["length", "part", "key", "word", "n"])


def codes(words: list[str], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points from the left and from the right, padded with zeros, and the lengths."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    left = np.frombuffer("".join(w.ljust(width, "\0") for w in words).encode("utf-32-le"), np.uint32).reshape(len(words), width)
    right = np.frombuffer("".join(w[::-1].ljust(width, "\0") for w in words).encode("utf-32-le"), np.uint32).reshape(len(words), width)
    return left, right, sizes


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix of every row of a tile's first block with every row of its second: (tiles, rows of a, rows of b)."""
    alive = np.ones((a.shape[0], a.shape[1], b.shape[1]), bool)
    total = np.zeros(alive.shape, np.uint16)
    for k in range(a.shape[2]):
        alive &= (a[:, :, None, k] == b[:, None, :, k]) & (a[:, :, None, k] != 0)
        if not alive.any():
            break
        total += alive
    return total


def near_in_tiles(a: tuple, b: tuple, length: int, part: int) -> tuple[np.ndarray, ...]:
    """(tile, row of a, row of b) of pairs one edit apart whose longer word has ``length``, if ``part`` is the first key that they share. Blocks are (left, right, sizes)."""
    longer = np.maximum(a[2][:, :, None], b[2][:, None, :])
    some = np.minimum(a[2][:, :, None], b[2][:, None, :])
    prefix, suffix = _common(a[0], b[0]), _common(a[1], b[1])
    equal = (prefix == longer) & (some == longer)
    near = (prefix.astype(np.int64) + suffix >= length - 1) & (longer == length) & (some >= length - 1) & ~equal & (some > 0)
    for p, s in shares(length)[:part]:
        near &= (prefix < p) | (suffix < s)
    return np.nonzero(near)


def _summed(words: np.ndarray, other: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    """(word, n_near, form_n, form) over links from word to other, n being the count of other."""
    order = np.lexsort((other, -n, words))
    words, other, n = words[order], other[order], n[order]
    fresh = np.flatnonzero(np.r_[True, words[1:] != words[:-1]])
    return pa.RecordBatch.from_arrays([pa.array(words[fresh].tolist(), pa.string()), pa.array(np.diff(np.r_[fresh, len(words)])), pa.array(n[fresh]), pa.array(other[fresh].tolist(), pa.string())], ["word", "n_near", "form_n", "form"])


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (length, part, key, left, right, side, word, n), sorted: one tile per (length, part, key, left, right), its blocks by side. Gives partial sums of near words."""

    def compared(tiles: list[tuple], length: int, part: int) -> pa.RecordBatch | None:
        """Tiles of one length and part: lists of words and counts of both blocks; the second is None where the block meets itself."""
        blocks = []
        for side in (0, 1):
            if tiles[0][2 * side] is None:
                blocks.append(blocks[0])
                continue
            rows = max(len(t[2 * side]) for t in tiles)
            left, right, sizes = codes([w for t in tiles for w in [*t[2 * side], *[""] * (rows - len(t[2 * side]))]], length)
            words = np.array([w for t in tiles for w in [*t[2 * side], *[""] * (rows - len(t[2 * side]))]], object).reshape(len(tiles), rows)
            n = np.array([x for t in tiles for x in [*t[2 * side + 1], *[0] * (rows - len(t[2 * side]))]], np.int64).reshape(len(tiles), rows)
            blocks.append((left.reshape(len(tiles), rows, length), right.reshape(len(tiles), rows, length), sizes.reshape(len(tiles), rows), words, n))
        a, b = blocks
        step = max(1, CELLS // (len(tiles) * b[0].shape[1]))
        words, other, counts = [], [], []
        for i in range(0, a[0].shape[1], step):
            t, x, y = near_in_tiles(tuple(m[:, i : i + step] for m in a[:3]), b[:3], length, part)
            x = x + i
            words.append(a[3][t, x])
            other.append(b[3][t, y])
            counts.append(b[4][t, y])
            if a is not b:
                words.append(b[3][t, y])
                other.append(a[3][t, x])
                counts.append(a[4][t, x])
        words, other, counts = (np.concatenate(v) for v in (words, other, counts))
        return _summed(words, other, counts) if len(words) else None

    small: dict[tuple[int, int, int], list[tuple]] = {}
    tile, at = None, None

    def done() -> Iterator[pa.RecordBatch]:
        if tile is None:
            return
        a, na, b, nb = tile
        length, part, _, left, right = at
        if left != right:
            if a and b:
                yield compared([(a, na, b, nb)], length, part)
        elif len(a) > 1:
            rows = 1 << (len(a) - 1).bit_length()
            if rows > SMALL:
                yield compared([(a, na, None, None)], length, part)
            else:
                stack = small.setdefault((length, part, rows), [])
                stack.append((a, na, None, None))
                if len(stack) * rows * rows >= CELLS // 8:
                    yield compared(small.pop((length, part, rows)), length, part)

    for batch in batches:
        for length, part, key, left, right, side, word, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if at != (length, part, key, left, right):
                yield from (x for x in done() if x is not None)
                tile, at = ([], [], [], []), (length, part, key, left, right)
            tile[2 * side].append(word)
            tile[2 * side + 1].append(n)
    yield from (x for x in done() if x is not None)
    for (length, part, _), stack in small.items():
        if (found := compared(stack, length, part)) is not None:
            yield found


def near(counted: DataFrame, block: int = BLOCK) -> DataFrame:
    """(word, n_near, form_n, form) of every word (word, n) that has near words: how many, and the most frequent of them."""
    keyed = written(counted.mapInArrow(_keyed, "length int, part int, key string, word string, n long"), "keyed")
    sizes = keyed.groupBy("length", "part", "key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    rows = keyed.join(sizes, ["length", "part", "key"])
    blocks = F.ceil(F.col("size") / block).cast("int")
    dealt = rows.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int"))
    met = dealt.select("length", "part", "key", "word", "n", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    tiles = met.select("length", "part", "key", F.least("own", "other").alias("left"), F.greatest("own", "other").alias("right"), F.when(F.col("own") > F.col("other"), 1).otherwise(0).alias("side"), "word", "n")
    order = ["length", "part", "key", "left", "right"]
    sums = tiles.repartition(*order).sortWithinPartitions(*order).mapInArrow(_links, "word string, n_near long, form_n long, form string")
    best = F.min(F.struct((-F.col("form_n")).alias("less"), "form"))
    return sums.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best")).select("word", "n_near", (-F.col("best.less")).alias("form_n"), "best.form")


def roots(formed: DataFrame, rounds: int = 64) -> DataFrame:
    """(word, root) of rows (word, form) whose chains end: the last word of each, by doubling."""
    now = written(formed.select("word", F.col("form").alias("root")), "roots")
    for _ in range(rounds):
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = written(now.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        now = after.select("word", "root")
        if after.where("moved").isEmpty():
            return now
    raise ValueError("the forms are in a circle")


def variants(docs: DataFrame, text: str = "text", key: str = "doc_id", ratio: int = RATIO, block: int = BLOCK) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of every word."""
    counted = written(words(docs, text, key), "words")
    rows = counted.join(near(counted, block), "word", "left")
    large = F.col("form_n") >= ratio * F.col("n")
    rows = written(rows.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(large, F.col("form")).alias("form"), F.when(large, F.col("form_n")).alias("form_n")), "forms")
    ends = roots(rows.where("form IS NOT NULL"))
    return rows.join(ends, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents"))


SQL = r"""
WITH RECURSIVE bytes AS (
  SELECT list_transform(range(256), lambda b: list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b)) AS steps
), runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS run FROM documents
), each AS (
  SELECT doc_id, run, count(*) AS n, coalesce(doc_id::VARCHAR, 'null') || ':' || run AS said FROM runs WHERE length(run) >= 7 GROUP BY ALL
), hashed AS (
  SELECT run, n, xor(list_reduce(list_transform(range(octet_length(encode(said))), lambda i: ('0x' || substr(hex(encode(said)), 2 * i + 1, 2))::BIGINT), lambda c, b: xor(c >> 8, steps[1 + (xor(c, b) & 255)]), 4294967295), 4294967295) AS h FROM each, bytes
), written AS (
  SELECT CASE WHEN h % 31 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed
), words AS (
  SELECT word, sum(n)::BIGINT AS n FROM written WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2
), without AS (
  SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS rest FROM words, LATERAL (SELECT unnest(range(1, length(word) + 1)) AS i)
), links AS (
  SELECT a.word, b.word AS other, b.n AS m FROM without a JOIN without b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM without a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM without a JOIN words b ON a.rest = b.word
), best AS (
  SELECT word, count(*) AS n_near, first(other ORDER BY m DESC, other) AS form, max(m) AS form_n FROM links GROUP BY word
), forms AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 10 * w.n THEN form END AS form, CASE WHEN form_n >= 10 * w.n THEN form_n END AS form_n FROM words w LEFT JOIN best USING (word)
), chains AS (
  SELECT word, word AS root, form AS next FROM forms
  UNION ALL SELECT c.word, c.next, f.form FROM chains c JOIN forms f ON f.word = c.next
)
SELECT f.word, f.n, f.n_near, f.form, f.form_n, c.root FROM forms f JOIN chains c USING (word) WHERE c.next IS NULL
"""

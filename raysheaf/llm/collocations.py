"""Phrases of two to five words that occur together more often than their parts suggest.

Texts are split into pieces at punctuation and line ends and these into words; everything is
counted by language. The suffix of a piece at each word, cut to the longest phrase, is what is
sorted, and a phrase's frequency is the size of the partition of suffixes that begin with it:

* words are counted everywhere (``words``), then pairs of frequent words (``pairs``): partitions
  by leading words that stay below the least frequency are abandoned here, for all data;
* suffixes whose neighbouring words all are frequent pairs are routed by their three leading
  words, equal ones merged before; each task sorts pointers to its suffixes by multikey
  three-way quicksort, where the size of an equal partition is a phrase's count and partitions
  below the least frequency are not sorted further (``prefix_counts``);
* phrases' cuts, scores and what a longer phrase of the same frequency covers are joins.

Three leading words can hold a large share only if both pairs in them do. There are at most
``1 / HOT`` pairs with a share of ``HOT`` or more; suffixes that begin with two of these are routed
by all their words, nothing of them is abandoned, and their sizes are added up afterwards.

Frequent words and pairs are known to the tasks by bitmaps of a fixed size; what these let
through by chance is counted and found infrequent. Words are numbers of 64 bits; two words of
the same number are looked for, over all words, and the numbers drawn again if there are any.

Edge cases: a null or empty text has no words; a null language is ``und``; a piece shorter than a
phrase has none of it; repeated rows count repeatedly, overlapping occurrences as well; texts
of any length are read whole; an empty table gives an empty result; ties of score and frequency
are by phrase, in the order of UTF-8 bytes; null ids and further columns have no effect, whatever
their names.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written

LONGEST, LEAST, TOP = 5, 100, 2000
#: A pair's share of all pairs from which on it is hot.
HOT = 0.001
#: Bits of a bitmap: 8 MB, whatever the data.
BITS = 1 << 26
#: Words that a task works on at once, distinct rows that it holds back to merge more, rows that it sorts at once, and entries of its dictionaries.
BLOCK, HELD, ROWS, KNOWN = 1 << 20, 1 << 21, 1 << 20, 500_000
UNKNOWN_LANGUAGE = "und"
_BREAK = re.compile(rb"[.,;:!?\n-\r]+")
_MIX = np.random.default_rng(5).integers(0, 1 << 63, LONGEST, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def pieces(text: bytes | None) -> list[bytes]:
    """The words of a text in order, with b"\\n" between pieces and empty strings anywhere. bytes.lower() lowers A-Z only."""
    return _BREAK.sub(b" \n ", (text or b"").lower()).replace(b"\t", b" ").split(b" ")


class Numbers(dict):
    """What a word stands for, by ``make``; 0 for the break between pieces and -1 for no word. As many as memory allows."""

    def __init__(self, make: Callable[[bytes], int]) -> None:
        self.make = make
        self.clear()

    def clear(self) -> None:
        super().clear()
        self.update({b"\n": 0, b"": -1})

    def __missing__(self, word: bytes) -> int:
        found = self[word] = self.make(word)
        return found


def _texts(docs: DataFrame, text: str, lang: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(lang).cast("string"), F.lit(UNKNOWN_LANGUAGE)).alias("lang"), F.col(text).cast("binary").alias("text"))


def _number(words: DataFrame, salt: str) -> Column:
    return F.xxhash64(F.lit(salt), "lang", "word")


def _seed(salt: str, lang: str) -> int:
    return xxhash.xxh64_intdigest(lang.encode(), xxhash.xxh64_intdigest(salt.encode(), 42))


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, word, n), merged as far as a task's dictionary reaches."""
    known: dict[str, Numbers] = {}
    counts: dict[str, np.ndarray] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        for lang, numbers in known.items():
            words = [w for w, k in numbers.items() if k > 0]
            n = counts[lang][1 : len(words) + 1]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(words), pa.string()), pa.array(words, pa.binary()).cast(pa.string()), pa.array(n)], ["lang", "word", "n"])
        known.clear()
        counts.clear()

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if lang not in known:
                numbers = known[lang] = Numbers(lambda _: 0)
                numbers.make = lambda _, own=numbers: len(own) - 1
                counts[lang] = np.zeros(1 << 12, np.int64)
            numbers = known[lang]
            found = np.fromiter(map(numbers.__getitem__, pieces(text.as_py())), np.int64)
            found = found[found > 0]
            if len(numbers) > len(counts[lang]):
                counts[lang] = np.r_[counts[lang], np.zeros(len(numbers), np.int64)]
            if len(found):
                own = np.bincount(found)
                counts[lang][: len(own)] += own
            if sum(map(len, known.values())) > KNOWN:
                yield from flush()
    yield from flush()


def words(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, word, n, h): every word with its count and a number that no other word has."""
    counted = _texts(docs, text, lang).mapInArrow(_count_words, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    counted = written(counted, "words")
    for turn in range(16):
        numbered = counted.withColumn("h", _number(counted, f"{turn}"))
        if numbered.groupBy("h").count().where("count > 1 OR h IN (0, -1)").isEmpty():
            return numbered.withColumn("salt", F.lit(f"{turn}"))
    raise RuntimeError("words could not be told apart by numbers")


def mixed(columns: list[np.ndarray]) -> np.ndarray:
    """One number from several; only used to bring equal rows together and to choose bits."""
    x = np.zeros(len(columns[0]), np.uint64)
    for c, odd in zip(columns, _MIX, strict=False):
        x = (x ^ c.view(np.uint64)) * odd
        x ^= x >> np.uint64(29)
    return x


class Bitmap:
    """A set of numbers, with some more that are in it by chance."""

    def __init__(self, bits: np.ndarray) -> None:
        self.bits = bits

    def holds(self, x: np.ndarray) -> np.ndarray:
        at = x % np.uint64(BITS)
        return (self.bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def _slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(slot, bits) of rows of one or more numbers: the word of the bitmap and the bit in it."""
    for batch in batches:
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        at = (columns[0].view(np.uint64) if len(columns) == 1 else mixed(columns)) % np.uint64(BITS)
        bit = np.left_shift(np.uint64(1), at & np.uint64(63))
        yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(6)).astype(np.int64)), pa.array(bit.view(np.int64))], ["slot", "bits"])


def bitmap(rows: DataFrame) -> Broadcast:
    """A bitmap of the rows' numbers, or of their mixtures, for the tasks: BITS / 64 rows at most come to the driver."""
    found = rows.mapInArrow(_slots, "slot long, bits long").groupBy("slot").agg(F.bit_or("bits").alias("bits")).toArrow()
    bits = np.zeros(BITS // 64, np.uint64)
    bits[found["slot"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return rows.sparkSession.sparkContext.broadcast(bits)


def merged(columns: list[np.ndarray], n: np.ndarray | None = None) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows and the sum of their n, 1 each unless given. Rows may stay apart if others mix to the same number."""
    if n is None:
        n = np.ones(len(columns[0]), np.int64)
    if not len(n):
        return columns, n
    order = np.argsort(mixed(columns))
    columns = [c[order] for c in columns]
    fresh = np.r_[True, np.any([c[1:] != c[:-1] for c in columns], axis=0)]
    return [c[fresh] for c in columns], np.add.reduceat(n[order], np.flatnonzero(fresh))


def _merged_over(parts: Iterator[tuple[list[np.ndarray], np.ndarray]]) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    """Rows with their n, merged over as many parts as can be held back."""
    held, rows = [], 0

    def together() -> tuple[list[np.ndarray], np.ndarray]:
        return merged([np.concatenate(c) for c in zip(*(columns for columns, _ in held), strict=True)], np.concatenate([n for _, n in held]))

    for columns, n in parts:
        held.append((columns, n))
        rows += len(n)
        if rows >= HELD:
            held = [together()]
            rows = len(held[0][1])
            if rows >= HELD // 2:
                yield held.pop()
                rows = 0
    if held:
        yield together()


def _blocks(batches: Iterator[pa.RecordBatch], frequent: Bitmap, salt: str) -> Iterator[np.ndarray]:
    """The texts as numbers of frequent words, 0 for all else, in blocks of whole texts."""
    known: dict[str, Numbers] = {}
    held, size = [], 0
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if lang not in known:
                seed = _seed(salt, lang)

                def number(word: bytes, seed: int = seed) -> int:
                    h = np.uint64(xxhash.xxh64_intdigest(word, seed))
                    return int(h.view(np.int64)) if frequent.holds(h) else 0

                known[lang] = Numbers(number)
            if sum(map(len, known.values())) > KNOWN:
                for numbers in known.values():
                    numbers.clear()
            found = np.fromiter(map(known[lang].__getitem__, pieces(text.as_py())), np.int64)
            held += [found[found != -1], np.zeros(1, np.int64)]
            size += len(found)
            if size >= BLOCK:
                yield np.concatenate(held)
                held, size = [], 0
    if held:
        yield np.concatenate(held)


def pairs(docs: DataFrame, frequent: Broadcast, salt: str, text: str = "text", lang: str = "lang", least: int = LEAST) -> DataFrame:
    """(w1, w2, n): the frequent pairs of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def linked() -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
            for block in _blocks(batches, Bitmap(frequent.value), salt):
                both = np.flatnonzero((block[:-1] != 0) & (block[1:] != 0))
                yield merged([block[both], block[both + 1]])

        for (a, b), n in _merged_over(linked()):
            for i in range(0, len(n), ROWS):
                yield pa.RecordBatch.from_arrays([pa.array(x[i : i + ROWS]) for x in (a, b, n)], ["w1", "w2", "n"])

    counted = _texts(docs, text, lang).mapInArrow(run, "w1 long, w2 long, n long")
    return counted.groupBy("w1", "w2").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def _suffixes(block: np.ndarray, joined: Bitmap, longest: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The distinct suffixes of three words or more whose neighbours all are frequent pairs, 0 beyond their end, with their numbers."""
    block = np.r_[block, np.zeros(longest, np.int64)]
    linked = (block[:-1] != 0) & (block[1:] != 0)
    at = np.flatnonzero(linked)
    linked[at] = joined.holds(mixed([block[at], block[at + 1]]))
    start = np.flatnonzero(linked[:-1] & linked[1:])
    columns, alive = [block[start], block[start + 1], block[start + 2]], np.ones(len(start), bool)
    for k in range(3, longest):
        alive = alive & linked[start + k - 1]
        columns.append(np.where(alive, block[start + k], 0))
    return merged(columns)


def prefix_counts(rows: np.ndarray, n: np.ndarray, least: int, first: int = 3) -> Iterator[tuple[int, int, int]]:
    """Multikey three-way quicksort of pointers to ``rows``: (a row, length, count) of every prefix of ``first`` numbers or more whose count reaches ``least``.

    A partition is split by the value of one column into lesser, equal and greater; the equal part goes on with the next column. Parts that do not reach ``least`` hold no frequent prefix and are left."""
    todo = [(np.arange(len(rows)), 0)]
    while todo:
        at, depth = todo.pop()
        column = rows[at, depth]
        some = np.sort(column[:: len(column) // 64 + 1])
        pivot = some[len(some) // 2]
        for part in (at[column < pivot], at[column > pivot]):
            if len(part) and n[part].sum() >= least:
                todo.append((part, depth))
        equal = at[column == pivot]
        count = int(n[equal].sum())
        if pivot and count >= least:
            if depth + 1 >= first:
                yield int(equal[0]), depth + 1, count
            if depth + 1 < rows.shape[1]:
                todo.append((equal, depth + 1))


def phrases(docs: DataFrame, frequent: Broadcast, two: DataFrame, salt: str, text: str = "text", lang: str = "lang", longest: int = LONGEST, least: int = LEAST) -> DataFrame:
    """(words, n): frequent phrases of three words or more, as arrays of numbers."""
    names = [f"w{k + 1}" for k in range(longest)]
    joined = bitmap(two.select("w1", "w2"))
    total = two.agg(F.sum("n")).first()[0] or 0
    hot = {(r.w1, r.w2) for r in two.where(F.col("n") >= max(least, HOT * total)).select("w1", "w2").collect()}  # 1 / HOT at most
    warm = np.sort(mixed([np.array(c, np.int64) for c in zip(*hot, strict=True)])) if hot else np.zeros(0, np.uint64)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = _blocks(batches, Bitmap(frequent.value), salt)
        for columns, n in _merged_over(_suffixes(block, Bitmap(joined.value), longest) for block in blocks):
            both = np.isin(mixed(columns[:2]), warm) & np.isin(mixed(columns[1:3]), warm)
            route = np.where(both, mixed(columns), mixed(columns[:3])).view(np.int64)
            for i in range(0, len(n), ROWS):
                yield pa.RecordBatch.from_arrays([pa.array(x[i : i + ROWS]) for x in (both, route, *columns, n)], ["hot", "route", *names, "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush() -> Iterator[pa.RecordBatch]:
            whole = pa.Table.from_batches(held)
            held.clear()
            rows, n, hot = np.stack([whole[c].to_numpy() for c in names], 1), whole["n"].to_numpy(), whole["hot"].to_numpy()
            for part, floor in ((~hot, least), (hot, 1)):
                own, weight = rows[part], n[part]
                found = list(prefix_counts(own, weight, floor)) if len(own) else []
                if found:
                    at, depth, counted = map(np.array, zip(*found, strict=True))
                    columns = [np.where(k < depth, own[at, k], 0) for k in range(longest)]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (*columns, counted)], [*names, "n"])

        for batch in batches:
            if held and sum(b.num_rows for b in held) >= ROWS:
                route, before = batch.column(1).to_numpy(), held[-1].column(1)[-1].as_py()
                same = int((route != before).argmax()) if (route != before).any() else len(route)  # leading words are not torn apart
                held.append(batch.slice(0, same))
                batch = batch.slice(same)
                if batch.num_rows:
                    yield from flush()
            if batch.num_rows:
                held.append(batch)
        if held:
            yield from flush()

    kinds = ", ".join(f"{c} long" for c in names)
    rows = _texts(docs, text, lang).mapInArrow(spread, f"hot boolean, route long, {kinds}, n long")
    sizes = rows.repartition("route").sortWithinPartitions("route").mapInArrow(count, f"{kinds}, n long")
    summed = sizes.groupBy(*names).agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    return summed.select(F.filter(F.array(*names), lambda w: w != 0).alias("words"), "n")


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", longest: int = LONGEST, least: int = LEAST, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of each language."""
    if not 2 <= longest <= LONGEST:
        raise ValueError(f"phrases of 2 to {LONGEST} words")
    every = words(docs, text, lang)
    salt = (every.select("salt").first() or ["0"])[0]
    common = written(every.where(F.col("n") >= least).select("lang", "word", "n", "h"), "frequent")
    frequent = bitmap(common.select("h"))
    two = written(pairs(docs, frequent, salt, text, lang, least), "pairs")
    candidates = two.select(F.array("w1", "w2").alias("words"), "n")
    if longest > 2:
        candidates = written(candidates.unionByName(phrases(docs, frequent, two, salt, text, lang, longest, least)), "phrases")
    counts = candidates.unionByName(common.select(F.array("h").alias("words"), "n"))
    left, right = (counts.select(F.col("words").alias(side), F.col("n").alias(name)) for side, name in (("first", "l"), ("rest", "r")))
    cut = candidates.select("words", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k"))
    cut = cut.select("words", "a", "k", F.slice("words", F.lit(1), F.col("k")).alias("first"), F.slice("words", F.col("k") + 1, F.size("words") - F.col("k")).alias("rest"))
    cut = cut.join(left, "first").join(right, "rest")
    totals = every.groupBy("lang").agg(F.sum("n").alias("total"))
    spelled = candidates.select("words", F.posexplode("words").alias("at", "h")).join(common.select("lang", "word", "h"), "h")
    spelled = spelled.groupBy("words").agg(F.min("lang").alias("lang"), F.concat_ws(" ", F.transform(F.sort_array(F.collect_list(F.struct("at", "word"))), lambda x: x.word)).alias("phrase"))
    known = spelled.join(totals, "lang")
    number = "CAST({} AS DECIMAL(17, 0))".format
    score = F.expr(f"(CAST(1000 AS DECIMAL(4, 0)) * {number('a')} * {number('total')}) div ({number('l')} * {number('r')})")
    scored = cut.join(known, "words").withColumn("score", score)
    scored = scored.groupBy("words", "lang", "phrase", "a", "total").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    inner = candidates.where(F.size("words") > 2).select("n", "words", F.explode(F.sequence(F.lit(2), F.size("words") - 1)).alias("size"))
    inner = inner.select("n", "words", "size", F.explode(F.sequence(F.lit(1), F.size("words") - F.col("size") + 1)).alias("at"))
    covered = inner.groupBy(F.slice("words", F.col("at"), F.col("size")).alias("words")).agg(F.max("n").alias("longer"))
    kept = scored.join(covered, "words", "left").where("longer IS NULL OR 100 * longer < 100 * a")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase"))
    ranked = kept.select("lang", "phrase", "a", "cut", "total", rank.alias("rank")).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long"), "phrase", "a", "cut.l", "cut.r", F.col("total").alias("n"), "cut.score")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


SQL = r"""
WITH texts AS (
  SELECT coalesce(lang, 'und') AS lang, doc_id, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), pieces AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda w: w <> '') AS words FROM texts
), places AS (
  SELECT lang, words, unnest(range(1, len(words) + 1)) AS i FROM pieces WHERE len(words) > 0
), counts AS (
  SELECT lang, k, array_to_string(words[i : i + k - 1], ' ') AS phrase, count(*) AS f
  FROM places, (SELECT unnest([1, 2, 3, 4, 5]) AS k) WHERE i + k - 1 <= len(words) GROUP BY ALL HAVING count(*) >= 100
), totals AS (
  SELECT lang, count(*) AS n FROM places GROUP BY lang
), cuts AS (
  SELECT c.lang, c.phrase, c.k AS size, c.f AS a, j, string_split(c.phrase, ' ') AS words
  FROM counts c, (SELECT unnest([1, 2, 3, 4]) AS j) WHERE j < c.k
), scored AS (
  SELECT c.lang, c.phrase, c.size, c.a, c.j, l.f AS l, r.f AS r, t.n, (1000::HUGEINT * c.a * t.n) // (l.f::HUGEINT * r.f) AS score
  FROM cuts c
  JOIN counts l ON l.lang = c.lang AND l.phrase = array_to_string(c.words[1 : c.j], ' ')
  JOIN counts r ON r.lang = c.lang AND r.phrase = array_to_string(c.words[c.j + 1 : c.size], ' ')
  JOIN totals t ON t.lang = c.lang
), lowest AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1
), kept AS (
  SELECT * FROM lowest s WHERE NOT EXISTS (
    SELECT 1 FROM counts x WHERE x.lang = s.lang AND x.k > s.size AND 100 * x.f >= 100 * s.a AND contains(' ' || x.phrase || ' ', ' ' || s.phrase || ' '))
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::BIGINT AS score
FROM kept QUALIFY rank <= 2000
"""

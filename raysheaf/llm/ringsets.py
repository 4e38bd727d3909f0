"""Texts with at least four fifths of their shingles in common, exactly, by pigeonring filtering.

At that similarity the 64 bits of two SimHash fingerprints may differ in a quarter, where no
index on segments is selective and no bound is certain. Here the segments are those of the
shingle set itself: hashing deals a set's shingles to ``m`` segments that stand in a ring. Sets
that are similar enough differ in at most ``h < m`` shingles, so by the cycle lemma exactly
``m`` minus the true difference segments start a chain in which every run of ``l``
consecutive segments differs in at most ``l - 1`` shingles, the share of ``h`` that is
proportional to ``l``. In particular the first segment agrees. So

* candidates share a segment as a whole: rows (digest of the segment) that meet;
* of these only those stay whose next ``CHAIN`` segments keep within the budgets, by
  parities of 6 bits each, which never differ in more places than the segments do;
* what is left is decided by the shingles themselves.

Sizes are cut into classes of ratio 4 : 5, so partners lie in one class or in two adjacent
ones, and each pair of classes has its own ``m``. Empty segments are not emitted: there are so
few more segments than ``h`` that some segment with shingles agrees all the same, and a
text with more empty ones than that emits them too.

Classes instead of all pairs: the members of a bucket are first compared with one of them, each
with the partner that it meets most often. Buckets whose members are then in one class are
done. In others with many pairs of different classes whole classes are merged in turns, each
with the class that it meets most often, which is linear work; then members of different classes of
a bucket are compared pair by pair. Every similar pair either is in one class by then or is compared, so no
link between classes is lost. Rows of buckets that hold several classes are told apart by the ring itself:
the ``BLOCKS`` times ``EIGHT`` segments behind the one that agrees, by 64 parities for every ``EIGHT``, however
long the text (sketches, parities of all shingles of a set, fill up where texts are long). Budgets there are
those of the two sizes: if two sets may differ in ``g`` of the ``h`` shingles that their class may,
``l`` segments have less than ``l * g / h``. At least ``m - h`` segments start such a chain (the
least sum of ``g / h`` minus differences from there on rises only at these, by ``g / h`` each at most
and ``m * g / h - g`` in a round), more than there are empty ones. A bucket is read as a stream of sorted rows,
whatever its length; for pairs a large one is cut into tiles, each two parts of its members. Equal texts are one node.

Edge cases: a null text is empty; wordless texts are similar to each other; a text shorter than a
shingle is one shingle; repeated rows and equal texts share a class; texts of any length are
read whole; empty tables give none; ties of ids give one class id.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written
from .components import stars

SHINGLE, SIMILARITY = 5, 0.8
CHAIN, PARITY = 10, 6
UPPER = CHAIN * PARITY
ROWS = 1 << 16
KNOWN = 200_000
#: Most turns of merging whole classes before the rest is compared pair by pair; they change the work, not the result.
TURNS = 3
#: Bits of a sketch.
SKETCH = 1024
#: Pairs of different classes for each member beyond which a bucket takes part in turns; and members of a part, to which those of large buckets are dealt.
EACH, TILE = 4, 1024
#: Pairs for each class and turn.
TRIES = 8
#: Segments whose parities are 64 bits together, and how many such blocks follow a segment, for pairs that are compared one by one.
EIGHT, BLOCKS = 8, 16
_BLOCKED = [f"block_{i}" for i in range(BLOCKS)]
SEED = 42
_ODD = np.random.default_rng(SEED).integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit over all."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words(dict):
    """Hashes of words, kept as far as memory allows."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KNOWN:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word, SEED)
        return found


def shingles(text: str | None, size: int, known: Words) -> np.ndarray:
    """Hashes of the distinct shingles, in order."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    each = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    n = max(1, len(words) - size + 1)
    total = np.full(n, min(size, len(words)), np.uint64)
    for j in range(min(size, len(words))):
        total += each[j : j + n] * _ODD[j % len(_ODD)]
    return np.unique(mixed(total))


class Scheme:
    """Size classes and, for each class with the next, the number of segments."""

    def __init__(self, similarity: float) -> None:
        self.t = Fraction(similarity).limit_denominator(1000)
        if not Fraction(1, 2) <= self.t <= 1:
            raise ValueError("a similarity from 0.5 to 1")
        self.first, self.last = [1], [int(1 / self.t)]

    def of(self, size: int) -> int:
        while self.last[-1] < size:
            self.first.append(self.last[-1] + 1)
            self.last.append(int(self.first[-1] / self.t))
        return bisect_right(self.first, size) - 1

    def segments(self, c: int) -> tuple[int, int]:
        """(segments, most differing shingles) of class c with itself and the next."""
        h = int((1 - self.t) / (1 + self.t) * (self.last[c] + int(self.last[c] / self.t)))
        return h + 3 + h // 16, h


def blocks_of(parity: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """For each segment of ``at`` the parities of the ring's next segments, ``EIGHT`` together, up to itself."""
    m = len(parity)
    steps = np.minimum(np.arange(BLOCKS + 1) * EIGHT, m - 1)
    so_far = np.r_[np.int64(0), np.bitwise_xor.accumulate(np.resize(parity, m + 1 + steps[-1]))]
    edges = [so_far[at + 1 + step] for step in steps]
    return [x ^ y for x, y in zip(edges, edges[1:], strict=False)]


def rows_of(hashes: np.ndarray, scheme: Scheme, wide: bool = False, wanted: np.ndarray | None = None) -> list[tuple[np.ndarray, ...]]:
    """(keys, words, befores) of a set under its two pairs of classes. A word holds the parities of the next segments and whether the set is in the upper class; a before is the key of the segment before if it has a row too, else 0, as at the first. If ``wide``, also the set's size, the most shingles that similar sets of the class differ in, and the blocks behind each segment, all of the rows with a ``wanted`` key only, if these are given."""
    if not len(hashes):
        return [tuple(np.zeros(1, np.int64) for _ in range(5 + BLOCKS if wide else 3))]
    own, out = scheme.of(len(hashes)), []
    spread = mixed(hashes * _ODD[40])
    bit = np.left_shift(np.int64(1), ((spread >> np.uint64(20)) % np.uint64(PARITY)).astype(np.int64))
    for c in (own - 1, own):
        if c < 0:
            continue
        m, h = scheme.segments(c)
        part = (hashes % np.uint64(m)).astype(np.uint16 if m <= 1 << 16 else np.int64)  # short numbers are sorted by digits
        order = np.argsort(part, kind="stable")
        part = part[order]
        starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
        there = part[starts].astype(np.int64)
        digest, parity = np.zeros(m, np.uint64), np.zeros(m, np.int64)
        digest[there] = np.bitwise_xor.reduceat(spread[order], starts)
        parity[there] = np.bitwise_xor.reduceat(bit[order], starts)
        at = there if m - len(there) < m - h else np.arange(m)
        keys = mixed(digest[at] + mixed(np.array([c], np.uint64) * _ODD[41] + at.astype(np.uint64) * _ODD[42])).view(np.int64)
        chain = min(CHAIN, m - 1)
        ring, words = np.r_[parity, parity[:chain]], np.full(m, (c < own) << UPPER, np.int64)
        for j in range(chain):
            words |= ring[j + 1 : j + 1 + m] << (PARITY * j)
        words = words[at]
        before = np.zeros(len(at), np.int64)
        before[1:][at[1:] - at[:-1] == 1] = keys[:-1][at[1:] - at[:-1] == 1]
        if wide:
            bits = np.zeros(m, np.int64)
            bits[there] = np.bitwise_xor.reduceat(np.left_shift(np.uint64(1), (spread[order] >> np.uint64(40)) & np.uint64(63)), starts).view(np.int64)
            there = np.arange(len(at)) if wanted is None else np.flatnonzero(np.isin(keys, wanted))
            out.append((keys[there], words[there], before[there], np.full(len(there), len(hashes), np.int64), np.full(len(there), h, np.int64), *blocks_of(bits, at[there])))
        else:
            out.append((keys, words, before))
    return out


def sketch(hashes: np.ndarray) -> np.ndarray:
    """Parities of a set's shingles in ``SKETCH`` bits: two sets differ in as many shingles at least as their sketches do in bits."""
    bits = np.bincount((mixed(hashes * _ODD[43]) % np.uint64(SKETCH)).astype(np.int64), minlength=SKETCH) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").view(np.int64)


def _emit(shingle: int, similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, scheme, seen = Words(), Scheme(similarity), set()
        keys, nodes, words, n = [], [], [], 0

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (keys, nodes, words)], ["key", "node", "word"])
            for x in (keys, nodes, words):
                x.clear()
            return out

        for batch in batches:
            for node, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if node in seen:  # copies add nothing; most are met here, before anything is shuffled
                    continue
                if len(seen) >= KNOWN:
                    seen.clear()
                seen.add(node)
                for k, w, _ in rows_of(shingles(text.as_py(), shingle, known), scheme):
                    keys.append(k)
                    words.append(w)
                    nodes.append(np.full(len(k), node, np.int64))
                    n += len(k)
                if n >= ROWS:
                    yield flush()
                    n = 0
        if n:
            yield flush()

    return run


_WIDE = ["key", "word", "before", "size", "most", *_BLOCKED]
_MET = [*_WIDE, "node", "root"]


def _emit_wide(shingle: int, similarity: float):
    """From (node, text, keys): those rows of each text that have one of the keys, with what tells single pairs apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, scheme, found, n = Words(), Scheme(similarity), [], 0

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found, strict=True)], [*_WIDE, "node"])
            found.clear()
            return out

        for batch in batches:
            for node, text, keys in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                for rows in rows_of(shingles(text.as_py(), shingle, known), scheme, wide=True, wanted=keys.values.to_numpy(zero_copy_only=False)):
                    found.append([*rows, np.full(len(rows[0]), node, np.int64)])
                    n += len(rows[0])
                if n >= ROWS // 8:
                    yield flush()
                    n = 0
        if n:
            yield flush()

    return run


def within(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the chains behind two equal segments keep within the budgets."""
    differ, total, ok = a ^ b, np.zeros(len(a), np.uint8), np.ones(len(a), bool)
    for j in range(CHAIN):
        total = total + np.bitwise_count((differ >> np.int64(PARITY * j)) & np.int64((1 << PARITY) - 1))
        ok &= total <= j + 1
    return ok


class Met:
    """Rows of _MET as arrays, and which pairs of them, given by places, are not told apart."""

    def __init__(self, similarity: float, batches: list[pa.RecordBatch] | None = None) -> None:
        self.t = Scheme(similarity).t
        self.of = {n: np.concatenate([b.column(n).to_numpy(zero_copy_only=False) for b in batches]) for n in batches[0].schema.names} if batches else {}

    def part(self, start: int, stop: int | None = None) -> Met:
        """Some of the rows, as a copy."""
        out = Met(self.t)
        out.of = {n: x[start:stop].copy() for n, x in self.of.items()}
        return out

    def then(self, other: Met) -> Met:
        out = Met(self.t)
        out.of = {n: np.r_[x, other.of[n]] for n, x in self.of.items()} if self.of else other.of
        return out

    def fits(self, i: np.ndarray, j: np.ndarray, begins: bool) -> tuple[np.ndarray, np.ndarray]:
        """Those pairs of places in one bucket whose classes differ, of which one is in the lower size class at least, and whose chains and blocks keep within the budgets. If ``begins``, where a run of equal segments begins only."""
        of = self.of
        ok = of["root"][i] != of["root"][j]
        if begins:
            ok &= (of["before"][i] != of["before"][j]) | (of["before"][i] == 0)
        i, j = i[ok], j[ok]
        ok = (np.minimum(of["word"][i], of["word"][j]) >> np.int64(UPPER) == 0) & within(of["word"][i], of["word"][j])
        i, j = i[ok], j[ok]
        most = (of["size"][i] + of["size"][j]) * (self.t.denominator - self.t.numerator) // (self.t.denominator + self.t.numerator)
        h, differ = of["most"][i], np.zeros(len(i), np.int64)
        for k, n in enumerate(_BLOCKED):  # what l segments have is less than l * most / h
            differ = differ + np.bitwise_count((of[n][i] ^ of[n][j]).view(np.uint64))  # of signed ones it takes the magnitude
            ok = (differ <= most) & (differ * h < np.maximum(most, 1) * (EIGHT * (k + 1) + 1))
            i, j, most, h, differ = (x[ok] for x in (i, j, most, h, differ))
        return i, j


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by key, those of buckets with two members or more, of which one is in the lower class: with the first member, and whether its chain fits."""
    carry, shown, last = None, False, None
    for batch in batches:
        if not batch.num_rows:
            continue
        key, node, word = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        if carry is not None:
            key, node, word = (np.r_[c, x] for c, x in zip(carry, (key, node, word), strict=True))
        fresh = np.r_[True, (key[1:] != key[:-1]) | (node[1:] != node[:-1])]
        if carry is not None and (key[1], node[1]) == last:
            fresh[1] = False
        last = (key[-1], node[-1])
        key, node, word = key[fresh], node[fresh], word[fresh]
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        sizes = np.diff(np.r_[starts, len(key)])
        first = np.repeat(starts, sizes)
        out = np.repeat((sizes > 1) & (word[starts] >> np.int64(UPPER) == 0), sizes)
        if carry is not None and shown:
            out[0] = False
        shown = bool(sizes[-1] > 1) or (len(starts) == 1 and shown)
        carry = (key[starts[-1]], node[starts[-1]], word[starts[-1]])
        at, of = np.flatnonzero(out), first[out]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key[at], node[at], word[at], node[of], within(word[at], word[of]) & (at != of))], ["key", "node", "word", "pivot", "fits"])


def _decide(shingle: int, similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, last, own = Words(), None, None
        for batch in batches:
            linked = []
            for b, left, right in zip(batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                if b != last:
                    last, own = b, shingles(right.as_py(), shingle, known)
                other = shingles(left.as_py(), shingle, known)
                both = len(np.intersect1d(own, other, assume_unique=True))
                linked.append(both >= similarity * (len(own) + len(other) - both))
            yield batch.select(["a", "b"]).filter(pa.array(linked, pa.bool_()))

    return run


def _linked(pairs: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Those of the pairs (a, b) of nodes whose texts are similar."""
    left, right = (texts.select(F.col("node").alias(n), F.col("text").alias(t)) for n, t in (("a", "left"), ("b", "right")))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "left", "right")
    return written(both.mapInArrow(_decide(shingle, similarity), "a long, b long"), "links")


def _pair(x: str, y: str) -> list[Column]:
    return [F.greatest(x, y).alias("a"), F.least(x, y).alias("b")]


def node_of(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _open(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """rows with their root and their bucket's number of members and of pairs of different classes: those of buckets that hold more than one class still."""
    rooted = rows.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    by_class = rooted.groupBy("key", "root").agg(F.count(F.lit(1)).alias("own"))
    several = by_class.groupBy("key").agg(F.sum("own").alias("members"), ((F.sum("own") * F.sum("own") - F.sum(F.col("own") * F.col("own"))) / 2).alias("pairs")).where("pairs > 0")
    return written(rooted.join(several, "key"), "open")


def _with_first(similarity: float):
    """From rows sorted by key: (root, to, x, y) for each row that is not told apart from its bucket's first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry = Met(similarity)
        for batch in batches:
            if not batch.num_rows:
                continue
            met = carry.then(Met(similarity, [batch]))
            key = met.of["key"]
            starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            i, j = met.fits(np.arange(len(key)), np.repeat(starts, np.diff(np.r_[starts, len(key)])), begins=False)
            carry = met.part(starts[-1], starts[-1] + 1)
            yield pa.RecordBatch.from_arrays([pa.array(met.of[n][x]) for n, x in (("root", i), ("root", j), ("node", i), ("node", j))], ["root", "to", "x", "y"])

    return run


def _between_classes(rows: DataFrame, similarity: float, turn: int) -> DataFrame:
    """``TRIES`` pairs (a, b) at most for each class, as near the threshold some fail: of each part of the others with the class that it meets in most buckets, each bucket setting its members against one of them."""
    upper, lots = F.call_function("shiftright", F.col("word"), F.lit(UPPER)), [F.xxhash64(n, F.lit(turn)) for n in ("root", "node")]
    dealt = rows.select(*_MET).repartition("key").sortWithinPartitions("key", upper, *lots)
    met = dealt.mapInArrow(_with_first(similarity), "root long, to long, x long, y long")
    counted = met.groupBy("root", "to", "x", "y").agg(F.count(F.lit(1)).alias("n"))
    best = counted.groupBy("root", F.pmod(F.xxhash64("to", F.lit(turn)), F.lit(TRIES)).alias("try")).agg(F.max_by(F.struct("x", "y"), F.struct("n", "to", "x", "y")).alias("xy"))
    return best.select(*_pair("xy.x", "xy.y")).distinct()


def _each_with_each(similarity: float):
    """From rows sorted by tile: the pairs (a, b) of nodes in one tile that are not told apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def pairs(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            met = Met(similarity, batches)
            key, left, right, side = (met.of[n] for n in ("key", "tile", "against", "side"))
            starts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (left[1:] != left[:-1]) | (right[1:] != right[:-1])])
            stop = np.repeat(np.r_[starts[1:], len(key)], np.diff(np.r_[starts, len(key)]))
            found, i, step = [], np.arange(len(key)), 1
            while len(i := i[i + step < stop[i]]):
                ok = (left[i] == right[i]) | (side[i] != side[i + step])
                found.append(met.fits(i[ok], i[ok] + step, begins=True))
                step += 1
            if found:
                x, y = (met.of["node"][np.concatenate(z)] for z in zip(*found, strict=True))
                a, b = np.unique(np.stack([np.maximum(x, y), np.minimum(x, y)]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            tile = [batch.column(n).to_numpy(zero_copy_only=False) for n in ("key", "tile", "against")]
            ends = np.flatnonzero(np.any([x[1:] != x[:-1] for x in tile], axis=0)) + 1
            if held and any(h.column(n)[-1].as_py() != x[0] for h in held[-1:] for n, x in zip(("key", "tile", "against"), tile, strict=True)):
                yield from pairs(held)
                held.clear()
            if len(ends):
                yield from pairs([*held, batch.slice(0, ends[-1])])
                held[:] = [batch.slice(ends[-1])]
            else:
                held.append(batch)
        if held:
            yield from pairs(held)

    return run


def _across(rows: DataFrame, similarity: float, tile: int = TILE) -> DataFrame:
    """The pairs (a, b) of nodes of different classes that are not told apart before their texts are compared.

    A pair meets in every segment that agrees. It counts where a run of equal segments begins, so where the keys before differ, or have no row, or the ring begins: from there the chain fits if it does so from a later segment of the run. The members of a large bucket are dealt to parts, and each two parts are a tile of their own."""
    parts = F.ceil(F.col("members") / tile)
    side = F.pmod(F.xxhash64("node", F.lit(SEED)), parts)
    tiles = F.transform(F.sequence(F.lit(0).cast("long"), parts - 1), lambda p: F.struct(F.least(p, "side").alias("tile"), F.greatest(p, "side").alias("against")))
    dealt = rows.withColumn("side", side).select(*_MET, "side", F.explode(tiles).alias("at")).select(*_MET, "side", "at.tile", "at.against")
    dealt = dealt.repartition("key", "tile", "against").sortWithinPartitions("key", "tile", "against")
    return dealt.mapInArrow(_each_with_each(similarity), "a long, b long").distinct()


def classes(docs: DataFrame, text: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY, turns: int = TURNS) -> DataFrame:
    """(node, root) of every text, by ``node_of``, that has a similar one: the classes of all links."""
    rows = docs.select(node_of(F.col(text)).alias("node"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    emitted = rows.mapInArrow(_emit(shingle, similarity), "key long, node long, word long")
    met = emitted.repartition("key").sortWithinPartitions("key", "word", "node").mapInArrow(_runs, "key long, node long, word long, pivot long, fits boolean")
    met = written(met, "buckets")
    often = met.where("fits").groupBy("node", "pivot").agg(F.count(F.lit(1)).alias("n")).groupBy("node").agg(F.max_by("pivot", F.struct("n", "pivot")).alias("pivot"))
    texts = _texts(rows, met.select("node").distinct())
    links = _linked(often.select(*_pair("node", "pivot")).distinct(), texts, shingle, similarity)
    left = _open(met.select("key", "node"), stars(links))
    keys = left.groupBy("node").agg(F.collect_list("key").alias("keys"))  # as many as a text has segments
    wide = texts.join(keys, "node").select("node", "text", "keys").mapInArrow(_emit_wide(shingle, similarity), ", ".join(f"{n} long" for n in (*_WIDE, "node")))
    wide = written(wide, "wide")
    made = 0
    for turn in range(turns):
        more = _linked(_between_classes(wide.join(left.where(F.col("pairs") > EACH * F.col("members")), ["key", "node"]), similarity, turn), texts, shingle, similarity)
        before, made = made, more.count()
        if not made:
            break
        links = links.unionByName(more)
        left = _open(left.select("key", "node"), stars(links))
        if 4 * made < before:
            break
    return stars(links.unionByName(_linked(_across(wide.join(left, ["key", "node"]), similarity), texts, shingle, similarity)))


def _texts(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, text) of the nodes, each once."""
    return written(rows.join(nodes, "node", "left_semi").dropDuplicates(["node"]), "texts")

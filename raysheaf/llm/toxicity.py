"""Toxicity by nearest labelled examples: exact cosine of TF-IDF vectors over a block-max inverted index.

Terms are lower-cased words. All terms of the labelled examples count, whichever label
they lean to and however rare they are; their document frequencies come from all
documents. A text is the vector of its terms' TF-IDF weights, each times the root of 1 plus
the term's likelihood-ratio statistic over the examples, of length 1: a term weighs more the
more it tells of the label, and none is left out. Terms that no example has would shorten
all similarities of a text by one factor, so they change neither its neighbours nor their
vote.

Examples stand in blocks of similar ones. A term's postings are cut by block, and each piece
has its greatest weight. Query terms times these maxima bound a block's cosines from above;
the blocks of the highest bounds are scored first, and the others only if their bound
reaches the worst neighbour found so far. The nearest examples are exact.

Neighbours vote by similarity and by how many labelled rows an example stands for. Votes
become probabilities by isotonic regression over the examples: these are dealt to
``FOLDS`` folds, equal ones to the same, and an example's vote is taken from the others'
folds with weights that these alone decide, so that neither its own vote nor its own part
in the weights tells its label. Between the regression's levels scores are interpolated.
The neighbours are the evidence.

Learning takes a bounded sample, at most ``PER_LABEL`` examples of each label, the first
in order of a hash of the id. Index and vocabulary are thereby bounded, and nothing else is
broadcast or collected. All texts are read whole.

Edge cases: texts that are null, empty or share no term with any example have no
neighbours and share the calibrated score of such examples; without examples of a label
all scores are the share of label 1 among examples, or 0 without any; an empty table gives
an empty result; a doc_id labelled twice is toxic if one label says so, null labels count
as none; a null doc_id is scored, never learned from and not held out; rows with equal
texts get equal scores; ties go to the smaller id; texts of any length are read whole;
further columns of the tables have no effect.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc32_of_id, shipped, table, unshipped, written

PER_LABEL = 1000
NEAREST = 15
BLOCK = 32
FOLDS = 5
WORDS = re.compile(r"[^\W_]+")
#: Terms of at least this share of the entries decide which entries are put into a block together.
SHARED = 0.02


def spread(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one range behind the other."""
    n = ends - starts
    at = np.cumsum(n)
    return np.arange(at[-1] if len(at) else 0) + np.repeat(starts - at + n, n)


def arranged(vectors: list[tuple[np.ndarray, np.ndarray]], terms: int, block: int) -> np.ndarray:
    """An order of the vectors in which runs of ``block`` are alike: halves along the direction of most variance, again and again."""
    df = np.bincount(np.concatenate([np.zeros(0, np.int32), *(t for t, _ in vectors)]), minlength=terms)
    column = np.full(terms, -1)
    common = np.flatnonzero(df >= max(2, SHARED * len(vectors)))
    column[common] = np.arange(len(common))
    rows = np.zeros((len(vectors), len(common)), np.float32)
    for i, (t, w) in enumerate(vectors):
        at = column[t]
        rows[i, at[at >= 0]] = w[at >= 0]

    def halves(which: np.ndarray) -> list[int]:
        if len(which) <= block or not len(common):
            return which.tolist()
        x = rows[which] - rows[which].mean(axis=0)
        v = x[np.argmax((x * x).sum(axis=1))]
        for _ in range(8):
            v = x.T @ (x @ v)
            size = np.sqrt((v * v).sum())
            if size < 1e-12:
                return which.tolist()
            v = v / size
        cut = -(-len(which) // (2 * block)) * block
        order = which[np.argsort(np.round(x @ v, 5), kind="stable")]
        return halves(order[:cut]) + halves(order[cut:])

    return np.array(halves(np.arange(len(vectors))), np.int64)


class Index:
    """Labelled examples as TF-IDF vectors. Examples with one vector are one entry, which holds their number and weight by label."""

    def __init__(self, ids: list[int], labels: list[int], stands_for: list[float], vectors: list, terms: int, block: int = BLOCK) -> None:
        pairs = [_arrays(v) for v in vectors]
        keys = [_key(v) if len(v[0]) else None for v in pairs]
        entries: dict[bytes, list[int]] = {}
        for i, k in enumerate(keys):
            if k is not None:
                entries.setdefault(k, []).append(i)
        order = sorted(entries, key=lambda k: (min(ids[i] for i in entries[k]), k))
        order = [order[i] for i in arranged([pairs[entries[k][0]] for k in order], terms, block)]
        self.examples = [sorted((ids[i], labels[i]) for i in entries[k])[:NEAREST] for k in order]
        self.least = np.array([min(ids[i] for i in entries[k]) for k in order], np.int64)
        self.number = np.array([len(entries[k]) for k in order], np.int64)
        self.weight = np.array([[sum(stands_for[i] for i in entries[k] if labels[i] == label) for label in (0, 1)] for k in order]).reshape(-1, 2)
        self.block = block
        self.blocks = -(-len(order) // block)
        own = [pairs[entries[k][0]] for k in order]
        flat = np.concatenate([np.zeros(0, np.int32), *(t for t, _ in own)])
        by_term = np.argsort(flat, kind="stable")
        term = flat[by_term]
        self.posted = np.repeat(np.arange(len(own), dtype=np.int32), [len(t) for t, _ in own])[by_term]
        self.weights = np.concatenate([np.zeros(0), *(w for _, w in own)])[by_term]
        of_block = self.posted // block
        cuts = np.flatnonzero(np.r_[True, (term[1:] != term[:-1]) | (of_block[1:] != of_block[:-1])]) if len(term) else np.zeros(0, np.int64)
        self.piece_at = np.r_[cuts, len(term)].astype(np.int64)
        self.piece_block = of_block[cuts].astype(np.int32)
        self.piece_most = np.maximum.reduceat(self.weights, cuts) if len(cuts) else np.zeros(0)
        self.term_at = np.searchsorted(term[cuts], np.arange(terms + 1))

    def nearest(self, query, k: int = NEAREST) -> list[tuple[int, float]]:
        """(place, cosine) of the nearest entries with a cosine over 0, as many as it takes for k examples, by cosine, then least id."""
        terms, weights = _arrays(query)
        starts, ends = self.term_at[terms], self.term_at[terms + 1]
        pieces = spread(starts, ends)
        if not len(pieces):
            return []
        of, at = np.repeat(weights, ends - starts), self.piece_block[pieces]
        bounds = np.bincount(at, of * self.piece_most[pieces], self.blocks)
        scores = np.zeros(len(self.number))
        todo = np.argsort(-bounds, kind="stable")
        todo = todo[bounds[todo] > 0]
        first, rest = todo[: max(1, -(-k // self.block))], todo[max(1, -(-k // self.block)) :]
        self._score(first, pieces, at, of, scores)
        if len(rest):
            worst = np.partition(scores, len(scores) - min(k, len(scores)))[len(scores) - min(k, len(scores))]
            rest = rest[bounds[rest] >= worst - 1e-9]
            if len(rest):
                self._score(rest, pieces, at, of, scores)
        return self._first(scores, k)

    def _score(self, blocks: np.ndarray, pieces: np.ndarray, at: np.ndarray, of: np.ndarray, scores: np.ndarray) -> None:
        """Adds the cosines of the entries in ``blocks``."""
        wanted = np.zeros(self.blocks, bool)
        wanted[blocks] = True
        chosen = wanted[at]
        own = pieces[chosen]
        starts, ends = self.piece_at[own], self.piece_at[own + 1]
        where = spread(starts, ends)
        scores += np.bincount(self.posted[where], np.repeat(of[chosen], ends - starts) * self.weights[where], len(scores))

    def _first(self, cosines: np.ndarray, k: int) -> list[tuple[int, float]]:
        n = min(k, len(cosines))
        worst = np.partition(cosines, len(cosines) - n)[len(cosines) - n]
        at = np.flatnonzero(cosines >= max(worst - 1e-11, 1e-12))
        scores = np.round(cosines[at], 12)
        found, have = [], 0
        for j in np.lexsort((self.least[at], -scores)):
            if have >= k:
                break
            have += int(self.number[at[j]])
            found.append((int(at[j]), float(scores[j])))
        return found

    def vote(self, neighbours: list[tuple[int, float]]) -> float:
        """Share of label 1 in similarity times weight."""
        sums = sum((s * self.weight[place] for place, s in neighbours), np.zeros(2))
        return round(float(sums[1] / sums.sum()), 9) if sums.sum() > 0 else 0.0

    def evidence(self, neighbours: list[tuple[int, float]], k: int = NEAREST) -> list[dict]:
        return [{"id": i, "label": label, "similarity": s} for place, s in neighbours for i, label in self.examples[place]][:k]


def _arrays(vector) -> tuple[np.ndarray, np.ndarray]:
    """(terms, weights) by term, of a dict or of such a pair."""
    if isinstance(vector, dict):
        vector = (np.array(sorted(vector), np.int32), np.array([vector[t] for t in sorted(vector)], float))
    return vector


def _key(vector: tuple[np.ndarray, np.ndarray]) -> bytes:
    return hashlib.sha256(vector[0].tobytes() + np.round(vector[1], 9).tobytes()).digest()


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Non-decreasing means of y over x by pooling adjacent violators: (mean x of each pool, mean y)."""
    pools: list[list[float]] = []
    for i in np.argsort(x, kind="stable"):
        if pools and pools[-1][0] == x[i]:
            pools[-1][1] += w[i] * y[i]
            pools[-1][2] += w[i]
        else:
            pools.append([x[i], w[i] * y[i], w[i], 0.0])
        pools[-1][3] += w[i] * x[i]
    merged: list[list[float]] = []
    for p in pools:
        merged.append(p)
        while len(merged) > 1 and merged[-2][1] * merged[-1][2] >= merged[-1][1] * merged[-2][2]:
            top = merged.pop()
            merged[-1] = [top[0], *(a + b for a, b in zip(merged[-1][1:], top[1:], strict=True))]
    return np.array([p[3] / p[2] for p in merged]), np.array([p[1] / p[2] for p in merged])


class Scorer:
    """Index, calibration and the score of texts without neighbours."""

    def __init__(self, index: Index | None, prior: float, votes: np.ndarray, means: np.ndarray, none: float) -> None:
        self.index, self.prior, self.votes, self.means, self.none = index, prior, votes, means, none

    def score(self, query: tuple[np.ndarray, np.ndarray]) -> tuple[float, list[tuple[int, float]]]:
        """(score, nearest entries)."""
        if self.index is None:
            return self.prior, []
        near = self.index.nearest(query)
        if not near:
            return self.none, []
        return round(float(np.interp(self.index.vote(near), self.votes, self.means)), 9), near


def unit(counts: dict[int, int], idf: np.ndarray) -> dict[int, float]:
    terms = np.array(sorted(counts), np.int32)
    return dict(zip(terms.tolist(), unit_arrays(terms, np.array([counts[t] for t in terms.tolist()]), idf)[1].tolist(), strict=True))


def unit_arrays(terms: np.ndarray, counts: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    weights = (1 + np.log(counts)) * weight[terms]
    return terms, weights / np.sqrt((weights * weights).sum()) if len(terms) else weights


def association(examples: list[tuple[int, int, np.ndarray, np.ndarray]], terms: int) -> np.ndarray:
    """How strongly each term goes with the label: the likelihood-ratio statistic of having the term; 0 unless there are both labels."""
    n = Counter(e[1] for e in examples)
    seen = [np.bincount(np.concatenate([np.zeros(0, np.int32), *(t for _, label, t, _ in examples if label == k)]), minlength=terms).astype(float) for k in (0, 1)]
    if len(n) < 2:
        return np.zeros(terms)
    total, both = float(n[0] + n[1]), seen[0] + seen[1]
    found = np.zeros(terms)
    for k in (0, 1):
        for cell, whole in ((seen[k], both), (n[k] - seen[k], total - both)):
            some = cell > 0
            found[some] += 2 * cell[some] * np.log(cell[some] * total / (whole[some] * n[k]))
    return np.maximum(np.round(found, 6), 0.0)


def fold_of(terms: np.ndarray, counts: np.ndarray) -> int:
    """By a hash of the terms and counts: equal texts share a fold."""
    return int.from_bytes(hashlib.sha256(terms.astype("<i4").tobytes() + counts.astype("<i4").tobytes()).digest()[:8]) % FOLDS


def fit(examples: list[tuple[int, int, np.ndarray, np.ndarray]], totals: dict[int, int], idf: np.ndarray) -> tuple[Scorer, np.ndarray]:
    """(scorer, terms' weights) from (id, label, terms, counts), the number of labelled rows of each label and the terms' inverse document frequencies."""
    sampled = Counter(e[1] for e in examples)
    stands_for = {label: totals[label] / n for label, n in sampled.items()}
    prior = totals.get(1, 0) / max(1, sum(totals.values()))

    def indexed(of: list) -> tuple[Index, np.ndarray]:
        weight = idf * np.sqrt(1 + association(of, len(idf)))
        vectors = [unit_arrays(t, n, weight) for _, _, t, n in of]
        return Index([e[0] for e in of], [e[1] for e in of], [stands_for[e[1]] for e in of], vectors, len(idf)), weight

    if len(sampled) < 2:
        return Scorer(None, prior, np.zeros(0), np.zeros(0), prior), idf
    folds = [fold_of(t, n) for _, _, t, n in examples]
    votes, labels, weights = [], [], []
    bare = [1.0, prior]  # of those without neighbours: one pseudo-example at the prior
    for fold in sorted(set(folds)):
        index, weight = indexed([e for e, f in zip(examples, folds, strict=True) if f != fold])
        for (_, label, terms, counts), f in zip(examples, folds, strict=True):
            if f != fold:
                continue
            near = index.nearest(unit_arrays(terms, counts, weight))
            if near:
                votes.append(index.vote(near))
                labels.append(label)
                weights.append(stands_for[label])
            else:
                bare[0] += stands_for[label]
                bare[1] += stands_for[label] * label
    at, means = isotonic(np.array(votes), np.array(labels, float), np.array(weights)) if votes else (np.zeros(1), np.array([prior]))
    index, weight = indexed(examples)
    return Scorer(index, prior, at, np.clip(means, 0.001, 0.999), bare[1] / bare[0]), weight


# Spark


def examples_of(docs: DataFrame, labels: DataFrame, learn: Column, per_label: int = PER_LABEL) -> tuple[DataFrame, dict[int, int]]:
    """(id, label, text) of the sample, and the number of labelled rows of each label. Ids are chosen before texts are moved."""
    marked = labels.where(F.col("toxic").isNotNull() & learn).groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("label"))
    totals = {r.label: r.n for r in marked.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    parts = [marked.where(F.col("label") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_label) for label in (0, 1)]
    chosen = parts[0].unionByName(parts[1]).select(F.col("doc_id").alias("id"), "label")
    rows = docs.select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "id")
    return rows.select("id", "label", "text"), totals


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Terms, each once in a task as far as memory allows."""
    found: set[str] = set()
    for batch in batches:
        for text in batch.column(0):
            found.update(WORDS.findall(text.as_py().lower()))
            if len(found) > 1_000_000:
                yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string())], ["term"])
                found.clear()
    yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string())], ["term"])


def vocabulary_of(examples: DataFrame) -> pa.Array:
    """All terms of the examples in order; none unless there are examples of both labels."""
    if examples.select("label").distinct().count() < 2:
        return pa.array([], pa.string())
    found = examples.select("text").mapInArrow(_terms, "term string").distinct().toArrow().sort_by("term")
    return found.column("term").combine_chunks()


class Reader:
    """Counts the vocabulary's terms in whole texts."""

    def __init__(self, vocabulary: pa.Array) -> None:
        self.place = {t: i for i, t in enumerate(vocabulary.to_pylist())}

    def read(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """(terms, counts) in order of the terms."""
        place, found = self.place, {}
        for w, n in Counter(WORDS.findall((text or "").lower())).items():
            at = place.get(w)
            if at is not None:
                found[at] = n
        terms, counts = np.fromiter(found, np.int32, len(found)), np.fromiter(found.values(), np.int32, len(found))
        order = np.argsort(terms)
        return terms[order], counts[order]

    def present(self, text: str | None) -> list[int]:
        place = self.place
        return [place[w] for w in set(WORDS.findall((text or "").lower())) if w in place]


def _document_frequencies(docs: DataFrame, sent, terms: int) -> tuple[int, np.ndarray]:
    """The number of rows of ``docs`` (doc_id, text), and of those that have each term of the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, df, seen = Reader(unshipped(sent)), np.zeros(terms, np.int64), 0
        for batch in batches:
            seen += batch.num_rows
            for value in batch.column(0):
                df[reader.present(value.as_py())] += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, at].astype(np.int32)), pa.array(np.r_[seen, df[at]])], ["t", "n"])

    found = docs.select("text").mapInArrow(run, "t int, n long").groupBy("t").agg(F.sum("n").alias("n")).toArrow()
    t, n = found.column("t").to_numpy(), found.column("n").to_numpy()
    df = np.zeros(terms)
    df[t[t >= 0]] = n[t >= 0]
    return int(n[t < 0].sum()), df


def _read_examples(examples: DataFrame, sent) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
    """(id, label, terms, counts) of the sample, by id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(unshipped(sent))
        for batch in batches:
            own = [reader.read(value.as_py()) for value in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([t for t, _ in own], pa.list_(pa.int32())), pa.array([n for _, n in own], pa.list_(pa.int32()))], ["id", "label", "terms", "counts"])

    found = examples.mapInArrow(run, f"id {examples.schema['id'].dataType.simpleString()}, label int, terms array<int>, counts array<int>").toArrow()
    rows = [(i.as_py(), label.as_py(), t.values.to_numpy(), n.values.to_numpy()) for i, label, t, n in zip(*found.columns, strict=True)]
    return sorted(rows, key=lambda r: (r[0], r[2].tobytes(), r[3].tobytes()))


def scored(docs: DataFrame, labels: DataFrame, learn: Column, text: str = "text", key: str = "doc_id", per_label: int = PER_LABEL) -> DataFrame:
    """(key, score, evidence) per row of ``docs``: evidence lists the nearest examples' id, label and similarity. ``learn`` selects rows of ``labels``."""
    named = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    examples, totals = examples_of(named, labels, learn, per_label)
    examples = written(examples, "examples")
    vocabulary = vocabulary_of(examples)
    spark = docs.sparkSession
    sent_terms = shipped(spark, vocabulary)
    seen, df = _document_frequencies(named, sent_terms, len(vocabulary))
    scorer, weight = fit(_read_examples(examples, sent_terms), totals, np.log((seen + 1) / (df + 1)) + 1)
    sent = shipped(spark, (scorer, weight))
    kind = pa.list_(pa.struct([("id", pa.int64()), ("label", pa.int32()), ("similarity", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, (scorer, weight) = Reader(unshipped(sent_terms)), unshipped(sent)
        for batch in batches:
            scores, evidence = [], []
            for value in batch.column(1):
                score, near = scorer.score(unit_arrays(*reader.read(value.as_py()), weight))
                scores.append(score)
                evidence.append(scorer.index.evidence(near) if near else [])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array(evidence, kind)], ["id", "score", "evidence"])

    out = f"id {named.schema['doc_id'].dataType.simpleString()}, score double, evidence array<struct<id:long,label:int,similarity:double>>"
    return named.mapInArrow(run, out).withColumnRenamed("id", key)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    remainder = F.pmod(crc32_of_id(F.col("doc_id")), F.lit(5))
    rows = scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), remainder != 0)
    return rows.select("doc_id", F.coalesce(remainder == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.col("evidence.id").alias("nearest"))

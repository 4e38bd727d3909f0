"""Language of words and texts by a linear-chain conditional random field.

Every word (a run of letters) has hashed features: affixes, character n-grams, itself, and
whether a lexicon of typical words of a language holds it. Weights for (feature, language)
and for transitions between languages are learned together by maximum likelihood from
windows of labelled texts, half of them spliced from several languages, so that the
transitions learn how long one language lasts in code-switched text. Forward-backward
gives each word's probabilities; a text's language has the largest share of its letters.

Learning takes a bounded sample: at most ``PER_LANGUAGE`` texts of up to ``SAMPLE_CHARS``
characters for each language, the first in order of a hash of the id, and at most ``WINDOWS`` windows of each. The
model is a table of ``BUCKETS`` rows and one column per language, bounded thereby, and the
only thing that is broadcast. Labelling takes every text whole: forward-backward runs over
blocks of ``BLOCK`` words, all blocks of a batch at once, joined exactly by the blocks'
transfer matrices, so that a very long text costs no more per word than a short one.

Edge cases: a null text, and one without a letter, is ``und`` with score 0; without any
labelled text all are ``und``; with one language all others are that; ties go to the
first language by name; repeated rows repeat their results; a null id is labelled, never
learned from and not held out; an empty table gives an empty result; further columns have
no effect.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import crc32_of_id, shipped, table, unshipped

UNKNOWN = "und"
BUCKETS = 1 << 16
PER_LANGUAGE = 150
SAMPLE_CHARS = 20_000
WINDOWS = 3
SPAN = 40
LEXICON = 1000
STEPS = 40
BLOCK = 64
SEED = 9
CACHE = 400_000
#: Longer runs of letters are consecutive words of 40.
WORDS = regex.compile(r"\p{L}{1,40}")


def word_features(word: str, lexicon: dict[str, str]) -> list[int]:
    """Bucket numbers of a lower-cased word."""
    padded = f"^{word}$"
    found = [f"w{word}"]
    for n in (1, 2, 3, 4):
        found += [f"p{padded[: n + 1]}", f"s{padded[-n - 1 :]}"]
    for n in (2, 3):
        found += [padded[i : i + n] for i in range(len(padded) - n + 1)]
    if word in lexicon:
        found.append(f"l{lexicon[word]}")
    return [zlib.crc32(f.encode("utf-8", "surrogatepass")) % BUCKETS for f in found]


class Model:
    """languages, weights (BUCKETS, L), transitions (L, L), start (L) and the lexicon (word: language)."""

    def __init__(self, languages: list[str], weights: np.ndarray, transitions: np.ndarray, start: np.ndarray, lexicon: dict[str, str]) -> None:
        self.languages, self.weights, self.transitions, self.start, self.lexicon = languages, weights, transitions, start, lexicon

    def emissions(self, words: list[str]) -> np.ndarray:
        found = [word_features(w, self.lexicon) for w in words]
        flat = np.fromiter((i for f in found for i in f), dtype=np.int64)
        ends = np.cumsum([len(f) for f in found])
        return np.add.reduceat(self.weights[flat], np.r_[0, ends[:-1]], axis=0) if found else np.zeros((0, len(self.languages)), np.float32)


def marginals(emissions: np.ndarray, lengths: np.ndarray, transitions: np.ndarray, start: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """Posterior (words, L) of texts laid end to end, by blocks that transfer matrices join exactly."""
    words, n_lang = emissions.shape
    lengths = lengths[lengths > 0]
    if not len(lengths):
        return np.zeros((0, n_lang))
    e = np.exp(emissions - emissions.max(axis=1, keepdims=True)).astype(np.float64)
    step, first = np.exp(transitions - transitions.max()), np.exp(start - start.max())
    blocks = -(-lengths // block)
    of_text = np.repeat(np.arange(len(lengths)), blocks)
    number = np.arange(len(of_text)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    begin = np.repeat(np.cumsum(lengths) - lengths, blocks) + number * block
    size = np.minimum(block, np.repeat(lengths, blocks) - number * block)
    order = np.argsort(-size, kind="stable")  # of the blocks, so that those still running stand first
    begin, size, number, of_text = begin[order], size[order], number[order], of_text[order]
    running = [int(np.searchsorted(-size, -t, side="left")) for t in range(block)]  # blocks longer than t
    n = len(size)

    def scaled(x: np.ndarray, axes: tuple[int, ...]) -> np.ndarray:
        return x / x.max(axis=axes, keepdims=True)

    whole = np.broadcast_to(np.eye(n_lang), (n, n_lang, n_lang)).copy()
    for t in range(block):
        k = running[t]
        if k:
            whole[:k] = scaled((whole[:k].reshape(-1, n_lang) @ step).reshape(k, n_lang, n_lang) * e[begin[:k] + t, None, :], (1, 2))
    at = np.empty((len(lengths), int(blocks.max())), np.int64)
    at[of_text, number] = np.arange(n)
    before, after = np.empty((n, n_lang)), np.empty((n, n_lang))
    # What enters the first word is such that one transition gives the start weights.
    now = np.tile(np.linalg.solve(step.T, first) if np.linalg.cond(step) < 1e8 else np.ones(n_lang), (len(lengths), 1))
    for k in range(int(blocks.max())):
        texts = np.flatnonzero(blocks > k)
        b = at[texts, k]
        before[b] = now[texts]
        moved = np.einsum("bi,bij->bj", now[texts], whole[b])
        now[texts] = moved / np.abs(moved).max(axis=1, keepdims=True)
    now = np.ones((len(lengths), n_lang))
    for k in range(int(blocks.max()) - 1, -1, -1):
        texts = np.flatnonzero(blocks > k)
        b = at[texts, k]
        after[b] = now[texts]
        now[texts] = scaled(np.einsum("bij,bj->bi", whole[b], now[texts]), (1,))
    found = np.empty((words, n_lang))
    for t in range(block):
        k = running[t]
        if k:
            x = np.maximum(before[:k] @ step, 0) * e[begin[:k] + t]
            before[:k] = x / x.sum(axis=1, keepdims=True)
            found[begin[:k] + t] = before[:k]
    for t in range(block - 1, -1, -1):
        k = running[t]
        if k:
            at_t = begin[:k] + t
            found[at_t] *= after[:k]
            after[:k] = scaled((after[:k] * e[at_t]) @ step.T, (1,))
    return found / found.sum(axis=1, keepdims=True)


def _lexicon(texts: list[tuple[str, list[str]]], size: int) -> dict[str, str]:
    """Words that occur five times at least, nine tenths of them in one language: the most frequent of each."""
    by: dict[str, Counter] = {}
    for lang, words in texts:
        by.setdefault(lang, Counter()).update(words)
    every = sum(by.values(), Counter())
    return {w: lang for lang in sorted(by) for w, n in sorted(by[lang].items(), key=lambda x: (-x[1], x[0]))[: 4 * size] if n >= 5 and n >= 0.9 * every[w]}


def _sequences(texts: list[tuple[str, list[str]]], languages: list[str], seed: int) -> tuple[list[list[str]], list[np.ndarray]]:
    """Windows of one language each, and as many spliced from pieces of windows."""
    rng = np.random.default_rng(seed)
    windows = []
    for lang, words in texts:
        starts = np.unique(np.linspace(0, max(0, len(words) - SPAN), WINDOWS).astype(int))
        windows += [(languages.index(lang), words[i : i + SPAN]) for i in starts if words]
    seqs, labels = [w for _, w in windows], [np.full(len(w), y) for y, w in windows]
    by = [[w for y, w in windows if y == i] for i in range(len(languages))]
    for _ in range(len(windows) if len(languages) > 1 else 0):
        words: list[str] = []
        marks: list[int] = []
        while len(words) < SPAN:
            y = int(rng.integers(len(languages)))
            if by[y]:
                piece = by[y][int(rng.integers(len(by[y])))]
                i, n = int(rng.integers(len(piece))), int(rng.integers(4, 25))
                words, marks = words + piece[i : i + n], marks + [y] * len(piece[i : i + n])
        seqs.append(words[:SPAN])
        labels.append(np.array(marks[:SPAN]))
    return seqs, labels


def fit(sample: list[tuple[str, str]], steps: int = STEPS, seed: int = SEED) -> Model | None:
    """The model from (language, text) pairs; None if there is none with a letter. Adam on the whole sample's likelihood."""
    texts = sorted((lang, WORDS.findall(text.lower())) for lang, text in sample)
    texts = [t for t in texts if t[1]]
    languages = sorted({lang for lang, _ in texts})
    if not languages:
        return None
    lexicon = _lexicon(texts, LEXICON)
    seqs, labels = _sequences(texts, languages, seed)
    vocabulary = sorted({w for s in seqs for w in s})
    place = {w: i for i, w in enumerate(vocabulary)}
    features = [word_features(w, lexicon) for w in vocabulary]
    flat = np.fromiter((i for f in features for i in f), dtype=np.int64)
    counts = np.array([len(f) for f in features])
    heads = np.cumsum(counts) - counts
    words = np.fromiter((place[w] for s in seqs for w in s), dtype=np.int64)
    truth, lengths = np.concatenate(labels), np.array([len(s) for s in seqs])
    n_lang, n = len(languages), len(words)
    firsts = np.cumsum(lengths) - lengths
    inner = np.ones(n, bool)
    inner[firsts] = False
    to = np.flatnonzero(inner)
    hot = np.zeros((n, n_lang))
    hot[np.arange(n), truth] = 1
    used, place_of = np.unique(flat, return_inverse=True)
    params = [np.zeros((len(used), n_lang)), np.eye(n_lang), np.zeros(n_lang)]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for t in range(1, steps + 1):
        weights, transitions, start = params
        e = np.add.reduceat(weights[place_of], heads, axis=0)[words]
        post = marginals(e, lengths, transitions, start)
        # Expected transitions: the posterior of neighbours, from the filtered product of both ends.
        pair = _pairs(e, lengths, transitions, start, firsts)
        miss = hot - post
        by_word = np.stack([np.bincount(words, miss[:, j], len(vocabulary)) for j in range(n_lang)], axis=1)
        spread = np.repeat(by_word, counts, axis=0)
        g = [
            np.stack([np.bincount(place_of, spread[:, j], len(used)) for j in range(n_lang)], axis=1) / n - 1e-6 * weights,
            (hot[to - 1].T @ hot[to] - pair) / n - 1e-6 * transitions,
            miss[firsts].sum(axis=0) / len(firsts),
        ]
        for i in range(3):
            first[i] = 0.9 * first[i] + 0.1 * g[i]
            second[i] = 0.99 * second[i] + 0.01 * g[i] ** 2
            params[i] = params[i] + 0.1 * (first[i] / (1 - 0.9**t)) / (np.sqrt(second[i] / (1 - 0.99**t)) + 1e-9)
    weights = np.zeros((BUCKETS, n_lang), np.float32)
    weights[used] = params[0]
    return Model(languages, weights, params[1], params[2], lexicon)


def _pairs(e: np.ndarray, lengths: np.ndarray, transitions: np.ndarray, start: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Expected number of transitions (L, L), all sequences in step."""
    f, step = np.exp(e - e.max(axis=1, keepdims=True)), np.exp(transitions)
    order = np.argsort(-lengths, kind="stable")
    begin, size = firsts[order], lengths[order]
    alpha, beta, longest = np.empty_like(f), np.ones_like(f), int(size[0])
    running = [int(np.searchsorted(-size, -t, side="left")) for t in range(longest + 1)]
    x = np.exp(start - start.max()) * f[begin]
    alpha[begin] = x / x.sum(axis=1, keepdims=True)
    for t in range(1, longest):
        at = begin[: running[t]] + t
        x = (alpha[at - 1] @ step) * f[at]
        alpha[at] = x / x.sum(axis=1, keepdims=True)
    total = np.zeros_like(step)
    for t in range(longest - 1, 0, -1):
        at = begin[: running[t]] + t
        ahead = f[at] * beta[at]
        x = ahead @ step.T
        beta[at - 1] = x / x.sum(axis=1, keepdims=True)
        joint = alpha[at - 1][:, :, None] * step * ahead[:, None, :]
        total += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
    return total


class Labeller:
    """A model with a bounded cache of words' emissions."""

    def __init__(self, model: Model, cache: int = CACHE) -> None:
        self.model, self.cache = model, cache
        self.place: dict[str, int] = {}
        self.rows = np.zeros((0, len(model.languages)), np.float32)

    def posterior(self, texts: list[list[str]]) -> np.ndarray:
        """Probabilities (words, L) of lower-cased words, text after text."""
        place = self.place
        fresh = list(dict.fromkeys(w for t in texts for w in t if w not in place))
        if len(place) + len(fresh) > self.cache:
            place.clear()
            self.rows = self.rows[:0]
            fresh = list(dict.fromkeys(w for t in texts for w in t))
        if fresh:
            place.update(zip(fresh, range(len(place), len(place) + len(fresh)), strict=True))
            self.rows = np.concatenate([self.rows, *[self.model.emissions(fresh[i : i + 20_000]) for i in range(0, len(fresh), 20_000)]])
        at = np.fromiter((place[w] for t in texts for w in t), dtype=np.int64)
        return marginals(self.rows[at], np.array([len(t) for t in texts], np.int64), self.model.transitions, self.model.start)

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        words = [WORDS.findall((t or "").lower()) for t in texts]
        found, at = [], 0
        post = self.posterior(words) if any(words) else None
        for w in words:
            if not w:
                found.append((UNKNOWN, 0.0))
                continue
            letters = np.fromiter(map(len, w), dtype=np.float64, count=len(w))
            mass = letters @ post[at : at + len(w)]
            at += len(w)
            best = int(mass.argmax())
            found.append((self.model.languages[best], min(1.0, float(mass[best] / mass.sum()))))
        return found


def _runs(texts: pa.Array, words: int = 300_000) -> Iterator[tuple[int, int]]:
    """Row ranges with about so many words each: a very long text is a range of its own."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t.as_py() or "") // 5
        if size >= words:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def sample_of(docs: DataFrame, learn: Column, per_language: int = PER_LANGUAGE, chars: int = SAMPLE_CHARS, text: str = "text", lang: str = "lang", key: str = "doc_id") -> list[tuple[str, str]]:
    """(language, text) of the sample: bounded, and chosen by ids alone before any text is moved."""
    able = docs.where(learn & F.col(lang).isNotNull() & (F.length(text) <= chars)).select(F.col(lang).alias("lang"), F.col(key).alias("id"), F.col(text).alias("text"))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id")
    chosen = able.select("lang", "id").withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= per_language)
    rows = able.join(F.broadcast(chosen.select("lang", "id").distinct()), ["lang", "id"]).select("lang", "id", "text")
    return [(r.lang, r.text) for r in rows.orderBy("lang", "id").collect()]


def label(docs: DataFrame, model: Model | None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, lang_pred, score) per row of ``docs``."""
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    sent = shipped(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = unshipped(sent)
        labeller = Labeller(own) if own is not None else None
        for batch in batches:
            for i, j in _runs(batch.column(1)):
                part = batch.slice(i, j - i)
                texts = part.column(1).to_pylist()
                found = labeller.predict(texts) if labeller else [(UNKNOWN, 0.0)] * len(texts)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], ["id", "lang_pred", "score"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, lang_pred string, score double").withColumnRenamed("id", key)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    learn = F.coalesce(F.pmod(crc32_of_id(F.col("doc_id")), F.lit(4)), F.lit(2)) != 2
    model = fit(sample_of(docs.select("doc_id", "text", "lang"), learn))
    return label(docs, model).select("doc_id", F.coalesce(F.pmod(crc32_of_id(F.col("doc_id")), F.lit(4)) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")

"""BPE encoding and decoding with a public vocabulary, split at forced boundaries.

A merge makes a token, so a byte pair that occurs inside no vocabulary token is never
merged across: between its bytes every encoding has a cut. A word is therefore split at
all such pairs, the fragments are encoded independently, each once per task, and their
ids concatenated. Fragments recur far more often than words do. No word or normalisation goes
across ASCII white space, so what stands between is normalised, cut and encoded once per task.

The tokenizer file is in the public JSON format of the ``tokenizers`` library, with a
normaliser of NFC, white space to one space and lower case, a split by pattern, byte-level
symbols and a word-end suffix. Its path is a parameter; executors read it from their own
installation.

Edge cases: a null text is empty and has no tokens, and the digests of the empty string;
the strings of the special tokens in a text are those tokens, as in the library; texts are
encoded whole, however long; characters that the pattern leaves out (white space) are
dropped by the tokenizer itself; repeated rows repeat their results; pairs of equal rank
merge from the left; an empty table gives an empty result; further columns have no effect.
"""

from __future__ import annotations

import gc
import hashlib
import heapq
import json
import unicodedata
import weakref
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import table

VOCABULARY = "word_bpe_49k.json"
#: Entries of a task's caches; a full cache is emptied.
CACHE = 400_000
#: Symbols up to which a list of ranks is merged faster than a heap; and a rank beyond all.
SHORT, LAST = 64, 1 << 60


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself where printable, else the next free one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Bpe:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str, cache: int = CACHE) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        pairs = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ", 1)) for m in model["merges"]]
        self.rank = {p: i for i, p in reversed(list(enumerate(pairs)))}
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.known_words = regex.compile(split).findall
        self.space = regex.compile(r"\s+")
        self.rare = regex.compile(r"[^\x00-\u024F\u0391-\u03A9\u03B1-\u03C9\u0400-\u045F\u2010-\u2027\u3041-\u3094\u4E00-\u9FA5]")
        self.library = Tokenizer.from_file(path)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.specials = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.symbols = byte_symbols()
        self.bytes = {s: b for b, s in enumerate(self.symbols)}
        self.tokens = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self.inside = self._pairs_inside()
        self.cache, self.fragments, self.shown, self.known = cache, {}, {}, Known(self)
        self.special_bytes = [s.encode() for s in self.special]

    def _parts(self, token: str) -> list[str]:
        """The base symbols of a token; the word end belongs to the last."""
        if self.suffix and token.endswith(self.suffix) and len(token) > len(self.suffix):
            body = token[: -len(self.suffix)]
            return [*body[:-1], body[-1] + self.suffix]
        return list(token)

    def _pairs_inside(self) -> set[tuple[str, str]]:
        return {p for t in self.vocab for parts in (self._parts(t),) for p in zip(parts, parts[1:], strict=False)}

    def split(self, word: str) -> list[tuple[str, ...]]:
        """A word's base symbols, cut wherever no token holds both neighbours."""
        base = [self.symbols[b] for b in word.encode("utf-8", "surrogatepass")]
        if self.suffix:
            base[-1] += self.suffix
        cuts = [0, *(i for i in range(1, len(base)) if (base[i - 1], base[i]) not in self.inside), len(base)]
        return [tuple(base[i:j]) for i, j in zip(cuts, cuts[1:], strict=False)]

    def merge(self, base: Sequence[str]) -> list[str]:
        """Merges by rank, leftmost first among equals, by a heap over a linked list: n log n for long fragments."""
        n, rank = len(base), self.rank
        if n <= SHORT:
            return self._merge_short(list(base))
        part: list[str | None] = list(base)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, base[i], base[i + 1]) for i in range(n - 1) if (r := rank.get((base[i], base[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, left, right = heapq.heappop(heap)
            j = after[i]
            if part[i] != left or j >= n or part[j] != right:
                continue
            part[i], part[j] = left + right, None
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] < n and (r := rank.get((part[k], part[after[k]]))) is not None:
                    heapq.heappush(heap, (r, k, part[k], part[after[k]]))
        return [p for p in part if p is not None]

    def _merge_short(self, parts: list[str]) -> list[str]:
        """The same, by the least of a list of ranks."""
        rank = self.rank.get
        ranks = [rank(p, LAST) for p in zip(parts, parts[1:], strict=False)]
        while ranks and (least := min(ranks)) < LAST:
            i = ranks.index(least)
            parts[i] += parts.pop(i + 1)
            ranks.pop(i)
            if i < len(ranks):
                ranks[i] = rank((parts[i], parts[i + 1]), LAST)
            if i:
                ranks[i - 1] = rank((parts[i - 1], parts[i]), LAST)
        return parts

    def fragment(self, base: tuple[str, ...]) -> list[int]:
        found = self.fragments.get(base)
        if found is None:
            found = [self.vocab[t] for t in self.merge(base) if t in self.vocab]
            if len(self.fragments) >= self.cache:
                self.fragments.clear()
            if len(base) <= 64:
                self.fragments[base] = found
        return found

    def word(self, word: str) -> list[int]:
        return [i for f in self.split(word) for i in self.fragment(f)]

    def words(self, text: str) -> list[str]:
        """Normalised words. Texts with letters outside long-settled ranges are cut by the library, whose Unicode tables differ from Python's."""
        if text.isascii() and text.isalpha():
            return [text.lower()]
        if not self.rare.search(text):
            return self.known_words(lower(self.space.sub(" ", unicodedata.normalize("NFC", text))))
        normal = self.library.normalizer.normalize_str(text)
        return [bytes(self.bytes[c] for c in w).decode("utf-8") for w, _ in self.library.pre_tokenizer.pre_tokenize_str(normal)]

    def pieces(self, text: str) -> Iterator[tuple[str | None, int]]:
        """(word, -1) and (None, id of a special token), in order."""
        at = 0
        for m in self.specials.finditer(text) if self.specials else ():
            yield from ((w, -1) for w in self.words(text[at : m.start()]))
            yield None, self.special[m.group()]
            at = m.end()
        yield from ((w, -1) for w in self.words(text[at:]))

    def encode(self, text: str | None) -> list[int]:
        return [i for w, special in self.pieces(text or "") for i in (self.word(w) if w is not None else [special])]

    def decode(self, ids: list[int]) -> str:
        """As the library does without a decoder: the tokens, joined by single spaces."""
        return " ".join(self.tokens[i] for i in ids if i in self.tokens)

    def rendered(self, word: str | None, special: int) -> tuple[int, bytes, bytes]:
        """A word's number of tokens, its ids and its decoded text, each id and token with a space before: those of its fragments, cut as in ``split``."""
        if word is None:
            return self._shown([special])
        base = word if word.isascii() and word.isprintable() else "".join([self.symbols[b] for b in word.encode("utf-8", "surrogatepass")])
        last = len(base) - 1
        pairs = list(zip(base, base[1:last], strict=False))
        cuts = [] if self.inside.issuperset(pairs) else [i for i, p in enumerate(pairs, 1) if p not in self.inside]
        if last and (base[last - 1], base[last] + self.suffix) not in self.inside:
            cuts.append(last)
        if not cuts:
            return self._fragment(base, True)
        parts = [self._fragment(base[i:j], False) for i, j in zip([0, *cuts], cuts, strict=False)]
        parts.append(self._fragment(base[cuts[-1] :], True))
        return sum([p[0] for p in parts]), b"".join([p[1] for p in parts]), b"".join([p[2] for p in parts])

    def _fragment(self, base: str, ends: bool) -> tuple[int, bytes, bytes]:
        """The same for a fragment's base symbols, the last with the word end if it ``ends`` the word."""
        found = self.shown.get((base, ends))
        if found is None:
            symbols = list(base)
            if ends:
                symbols[-1] += self.suffix
            found = self._shown([self.vocab[t] for t in self.merge(symbols) if t in self.vocab])
            if len(base) <= 64:
                if len(self.shown) >= self.cache:
                    self.shown.clear()
                self.shown[base, ends] = found
        return found

    def _shown(self, ids: list[int]) -> tuple[int, bytes, bytes]:
        return len(ids), "".join([f" {i}" for i in ids]).encode(), "".join([f" {self.tokens[i]}" for i in ids]).encode()

    def digests(self, text: str | bytes | None) -> tuple[int, str, str]:
        """Number of tokens, and SHA-256 of the ids and of the decoded text. Bytes are the text in UTF-8."""
        raw = text if isinstance(text, bytes) else (text or "").encode("utf-8", "surrogatepass")
        if any(s in raw for s in self.special_bytes):
            parts = [self.rendered(w, s) for w, s in self.pieces(raw.decode("utf-8", "surrogatepass"))]
        else:
            parts = list(map(self.known.__getitem__, raw.split()))  # of bytes: at ASCII white space only
        ids, decoded = b"".join([p[1] for p in parts])[1:], b"".join([p[2] for p in parts])[1:]
        return sum([p[0] for p in parts]), hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded).hexdigest()


class Known(dict):
    """What ``Bpe.rendered`` gives for words, and for all words of a stretch without ASCII white space, given as bytes; what is long is not kept."""

    def __init__(self, bpe: Bpe) -> None:
        self.bpe = weakref.proxy(bpe)  # no cycle: a task's caches go with it

    def __missing__(self, key: str | bytes) -> tuple[int, bytes, bytes]:
        if isinstance(key, str):
            found = self.bpe.rendered(key, -1)
        else:
            words = self.bpe.words(key.decode("utf-8", "surrogatepass"))
            if len(words) == 1:
                found = self.bpe.rendered(words[0], -1)
            else:
                parts = [self[w] for w in words]
                found = sum([p[0] for p in parts]), b"".join([p[1] for p in parts]), b"".join([p[2] for p in parts])
        if len(key) <= 64:
            if len(self) >= self.bpe.cache:
                self.clear()
            self[key] = found
        return found


def lower(text: str) -> str:
    """Lower case letter by letter: a final sigma is like any other, as in the library."""
    found = text.lower()
    if "ς" in found or "Σ" in text:
        return "".join(c.lower() for c in text)
    return found


def _map(docs: DataFrame, text: str, key: str, path: str, columns: str, make: Callable, cache: int = CACHE) -> DataFrame:
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    names = [c.split()[0] for c in columns.split(", ")]
    types = {"long": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}
    arrow = [types[c.split()[1]] for c in columns.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = Bpe(path, cache)
        gc.disable()  # it would walk over the caches again and again; nothing here makes cycles
        try:
            for batch in batches:
                for i in range(0, batch.num_rows, 256):
                    part = batch.slice(i, 256)
                    found = [make(bpe, t.as_py()) for t in part.column(1)]
                    yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array([f[k] for f in found], t) for k, t in enumerate(arrow)]], ["id", *names])
        finally:
            gc.enable()

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, {columns}").withColumnRenamed("id", key)


def encoded(docs: DataFrame, text: str = "text", key: str = "doc_id", path: str | None = None) -> DataFrame:
    """(key, ids) per row of ``docs``."""
    return _map(docs, text, key, path or public_tokenizers.path(VOCABULARY), "ids array<int>", lambda bpe, t: (bpe.encode(t),))


def token_digests(docs: DataFrame, text: str = "text", key: str = "doc_id", path: str | None = None, cache: int = CACHE) -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256) per row of ``docs``; ``cache`` bounds each of a task's two caches and changes no result."""
    return _map(docs, text, key, path or public_tokenizers.path(VOCABULARY), "n_tokens long, ids_sha256 string, decoded_sha256 string", lambda bpe, t: bpe.digests(t), cache)


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(table(spark, sf_dir, "documents"))

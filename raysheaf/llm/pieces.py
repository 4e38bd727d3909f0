"""SentencePiece encoding and decoding of merge-type (BPE) models by backtracking.

A sequence of pieces is the model's encoding of a text exactly when every two neighbours are
the encoding of the text they cover together, since merges on one side of a boundary never
depend on the other side until one crosses it. So no merge has to be replayed over a text:

* an Aho-Corasick automaton over all pieces gives the longest piece at every place;
* from left to right the longest piece is taken that goes with the piece before it; two pieces
  go together if merging their joint text anew gives the two again, which is kept by pair;
* where none goes, the piece before is taken back, the place is marked in a bitfield as one
  from which the text cannot be continued, and the next shorter piece is tried. The encoding
  of each prefix being unique, no place is left twice.

A text is read as runs of the space symbol and what follows, if no piece has that symbol
after another one, and a run as parts between neighbours that no piece holds side by side;
what a run or part gives is kept and serves for its repeats. Characters that belong to no
piece are given as the pieces of their bytes.

The model file is one of the ``sentencepiece`` library; its path is a parameter and executors
read it from their own installation. Models that normalise, or that hold pieces defined by the
user, are refused.

Edge cases: a null text is empty and has no ids, and the digests of the empty string; strings
such as ``<s>`` or ``<0x41>`` in a text are ordinary text; the space symbol itself reads back as
a space, as in the library; texts are encoded whole, however long, and with or without spaces;
repeated rows repeat their results; a null key stays null; an empty table gives an empty result;
further columns have no effect, whatever their names; there are no ties.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from operator import add

import ahocorasick
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

from .common import table

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
#: Entries of a worker's caches, twice as many with those of the generation before.
RUNS, PAIRS = 200_000, 1 << 19
#: Kinds of pieces in a model file (fixed values of the format).
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
MERGES = 2
#: Stands before the first token: no character's number. The rank of pairs that make no piece.
START, NEVER = -(1 << 21), float("inf")


class Cache(dict):
    """Values of ``make`` by key: the last ``most`` that were new or met again, and what was kept before these."""

    def __init__(self, make: Callable, most: int) -> None:
        self.make, self.most, self.before = make, most, {}

    def __missing__(self, key):
        if len(self) >= self.most:
            self.before = dict(self)
            self.clear()
        found = self.before.get(key)
        if found is None:
            found = self.make(key)
        self[key] = found
        return found


class Pieces:
    """Encoder and decoder of one model file."""

    def __init__(self, path: str, runs: int = RUNS) -> None:
        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        rules, trained = model.normalizer_spec, model.trainer_spec
        plain = not rules.precompiled_charsmap and not rules.remove_extra_whitespaces and rules.add_dummy_prefix
        if trained.model_type != MERGES or not trained.byte_fallback or not plain or trained.treat_whitespace_as_suffix:
            raise ValueError("a model of merges with bytes for unknown characters, and without normalisation, is needed")
        kinds = {NORMAL, UNKNOWN, CONTROL, BYTE}
        if any(p.type not in kinds for p in model.pieces):
            raise ValueError("pieces that are unused or defined by the user are not supported")
        self.piece = [p.piece for p in model.pieces]
        self.kind = [p.type for p in model.pieces]
        self.normal_id = [k == NORMAL for k in self.kind]
        self.id = {p.piece: i for i, p in enumerate(model.pieces) if p.type == NORMAL}
        self.rank = {p.piece: -p.score for p in model.pieces if p.type == NORMAL}
        self.byte_id = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == BYTE}
        self.byte_of = {i: b for b, i in self.byte_id.items()}
        self.automaton = ahocorasick.Automaton()
        for piece, i in self.id.items():
            self.automaton.add_word(piece, i)
        self.automaton.make_automaton()
        self.length = [len(p) for p in self.piece]
        self.shorter = {i: self._shorter(piece) for piece, i in self.id.items()}
        inner = any(SPACE in p.lstrip(SPACE) for p in self.id)
        self.runs = (lambda text: [text]) if inner else re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+").findall
        self.inside = {a + b for p in self.id for a, b in zip(p, p[1:], strict=False)}
        self.listed = [f",{i}" for i in range(len(self.piece))]
        self.together: dict[tuple[int, int], bool] = Cache(self._together, PAIRS)
        self.parts: dict[str, tuple[int, str, str]] = Cache(self._rendered, runs)
        self.rendered: dict[str, tuple[int, str, str]] = Cache(self._joined, runs)

    def _shorter(self, piece: str) -> int | None:
        """The longest piece that a piece begins with; its first character, unknown, if there is none."""
        for n in range(len(piece) - 1, 0, -1):
            if (found := self.id.get(piece[:n])) is not None:
                return found
        return -1 - ord(piece[0]) if len(piece) > 1 else None

    def text_of(self, token: int) -> str:
        """A token is a piece's id, or, below zero, a character that is no piece."""
        return self.piece[token] if token >= 0 else chr(-1 - token)

    def _together(self, pair: tuple[int, int]) -> bool:
        """Whether two tokens are the encoding of their joint text; whether one is its own, if the first is the mark of the start.

        The merges of the joint text are replayed, best pair first and leftmost among equals, until one crosses the boundary."""
        left, right = ("" if t == START else self.text_of(t) for t in pair)
        parts, rank, boundary = [*left, *right], self.rank, len(left)
        ranks = [rank.get(a + b, NEVER) for a, b in zip(parts, parts[1:], strict=False)]
        while ranks and (best := min(ranks)) < NEVER:
            i = ranks.index(best)
            if i + 1 == boundary:
                return False
            boundary -= i < boundary
            parts[i] += parts.pop(i + 1)
            ranks.pop(i)
            if i:
                ranks[i - 1] = rank.get(parts[i - 1] + parts[i], NEVER)
            if i < len(ranks):
                ranks[i] = rank.get(parts[i] + parts[i + 1], NEVER)
        return len(parts) == 1 + bool(left)

    def tokens(self, text: str) -> list[int]:
        """The encoding of a text in tokens."""
        n, length, shorter, together = len(text), self.length, self.shorter, self.together
        longest = [-1 - ord(c) for c in text]
        for end, i in self.automaton.iter(text):  # ends ascend, so the longest of each start comes last
            longest[end - length[i] + 1] = i
        longest.append(0)
        found, last, at, failed = [], START, 0, bytearray(n + 1)
        token = longest[0]
        while at < n:
            end = at + (length[token] if token >= 0 else 1)
            if not failed[end] and together[last, token]:
                found.append(token)
                last, at, token = token, end, longest[end]
                continue
            token = shorter[token] if token >= 0 else None
            while token is None:
                failed[at] = 1
                last = found.pop()
                at -= length[last] if last >= 0 else 1
                token = shorter[last] if last >= 0 else None
                last = found[-1] if found else START
        return found

    def cut(self, run: str) -> list[str]:
        """A run's parts: no piece holds the characters on the two sides of a cut."""
        inside, out, start = self.inside, [], 0
        for at, pair in enumerate(map(add, run, run[1:]), 1):
            if pair not in inside:
                out.append(run[start:at])
                start = at
        out.append(run[start:])
        return out

    def _ids(self, part: str) -> list[int]:
        tokens = self.tokens(part)
        if min(tokens) >= 0:
            return tokens
        return [i for t in tokens for i in ([t] if t >= 0 else [self.byte_id[b] for b in chr(-1 - t).encode()])]

    def normal(self, text: str | None) -> str:
        return SPACE + text.replace(" ", SPACE) if text else ""

    def encode(self, text: str | None) -> list[int]:
        return [i for run in self.runs(self.normal(text)) for part in self.cut(run) for i in self._ids(part)]

    def _spelled(self, ids: list[int]) -> str:
        if all(self.normal_id[i] for i in ids):
            return "".join([self.piece[i] for i in ids]).replace(SPACE, " ")
        out, raw = [], bytearray()
        for i in [*ids, None]:
            if i is not None and self.kind[i] == BYTE:
                raw.append(self.byte_of[i])
                continue
            if raw:
                out.append(raw.decode("utf-8", "replace"))
                raw.clear()
            if i is not None and self.kind[i] == NORMAL:
                out.append(self.piece[i])
        return "".join(out).replace(SPACE, " ")

    def decode(self, ids: list[int]) -> str:
        """The text of the ids, without the space that encoding puts before it. For ids that ``encode`` gives: control ids have no text."""
        return self._spelled(ids).removeprefix(" ")

    def _rendered(self, part: str) -> tuple[int, str, str]:
        """A part's number of ids, its ids, each with a comma before, and its decoded text."""
        ids = self._ids(part)
        return len(ids), "".join([self.listed[i] for i in ids]), self._spelled(ids)

    def _joined(self, run: str) -> tuple[int, str, str]:
        found = [self.parts[part] for part in self.cut(run)]
        return found[0] if len(found) == 1 else (sum([f[0] for f in found]), "".join([f[1] for f in found]), "".join([f[2] for f in found]))

    def digests(self, text: str | None) -> tuple[int, str, str]:
        """Number of ids, and SHA-256 of the ids and of the decoded text."""
        rendered = self.rendered
        parts = [rendered[run] for run in self.runs(self.normal(text))]
        ids, decoded = "".join([p[1] for p in parts])[1:], "".join([p[2] for p in parts])[1:]
        return sum([p[0] for p in parts]), hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


_READY: dict[str, Pieces] = {}


def ready(path: str) -> Pieces:
    """A worker's encoder of a file, with what it has kept from earlier tasks."""
    if path not in _READY:
        _READY.clear()
        _READY[path] = Pieces(path)
    return _READY[path]


def _map(docs: DataFrame, text: str, key: str, path: str, columns: dict[str, tuple[str, pa.DataType]], make: str) -> DataFrame:
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = getattr(ready(path), make)
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                found = [of(t.as_py()) for t in part.column(1)]
                values = zip(*found, strict=True) if len(columns) > 1 else [found]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(v, kind) for v, (_, kind) in zip(values, columns.values(), strict=True))], ["id", *columns])

    kinds = ", ".join(f"{name} {kind}" for name, (kind, _) in columns.items())
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, {kinds}").withColumnRenamed("id", key)


def encoded(docs: DataFrame, text: str = "text", key: str = "doc_id", path: str | None = None) -> DataFrame:
    """(key, ids) per row of ``docs``."""
    return _map(docs, text, key, path or public_tokenizers.path(MODEL), {"ids": ("array<int>", pa.list_(pa.int32()))}, "encode")


def decoded(rows: DataFrame, ids: str = "ids", key: str = "doc_id", path: str | None = None) -> DataFrame:
    """(key, text) per row of ``rows``, from the ids of ``encoded``."""
    listed = rows.select(F.col(key), F.coalesce(F.col(ids), F.array().cast("array<int>")).alias("ids"))
    return _map(listed, "ids", key, path or public_tokenizers.path(MODEL), {"text": ("string", pa.string())}, "decode")


def token_digests(docs: DataFrame, text: str = "text", key: str = "doc_id", path: str | None = None) -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256) per row of ``docs``."""
    columns = {"n_tokens": ("long", pa.int64()), "ids_sha256": ("string", pa.string()), "decoded_sha256": ("string", pa.string())}
    return _map(docs, text, key, path or public_tokenizers.path(MODEL), columns, "digests")


def op11_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(table(spark, sf_dir, "documents"))

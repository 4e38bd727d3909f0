"""Pieces, collocations and spelling variants against the library or brute force, with nulls, empty and very long texts, ties, repeats and clashing columns."""

import collections
import itertools
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from raysheaf.llm import collocations, pieces, variants

COLUMNS = "doc_id long, text string, lang string, word string, n long, h long, key string, words string, size long, root string, form string, route long"
TEXTS = [None, "", "  \n\t", "a", " a", "▁x ▁", "<s></s><0x41>", "x  y   z", "The quick brown fox.", "Ünïcödé ß 日本 🙂\x00ﬁ①", "a" * 30_000, "日本 " * 5_000, "hello world " * 9_000]


@pytest.fixture
def docs(spark):
    rows = [(i, t, ["en", "fr", None][i % 3], "w", 1, 2, "k", "ws", 3, "r", "f", 4) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame([*rows, rows[8], (None, "a b c", None, *rows[0][3:])], COLUMNS)


@pytest.fixture
def none(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(pieces.MODEL))


# Pieces


def test_pieces_like_the_library(library):
    rng = random.Random(3)
    own = pieces.Pieces(public_tokenizers.path(pieces.MODEL), runs=500)
    letters = "ab ▁  \n\t<>0x41éèß日本🙂\x00ﬁ①aeiotsnr"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    texts += ["".join(chr(rng.choice([rng.randint(1, 0xD7FF), rng.randint(0xE000, 0x10FFFF)])) for _ in range(rng.randint(0, 20))) for _ in range(3000)]
    texts += [t for t in TEXTS if t is not None]
    for text, ids in zip(texts, library.encode(texts), strict=True):
        assert own.encode(text) == ids
        assert own.decode(ids) == library.decode(ids)
        assert own.digests(text)[0] == len(ids)


def test_backtracking_finds_what_merging_finds(library):
    """Texts without a space are one run: longest matches alone are wrong in many of them."""
    own, rng = pieces.Pieces(public_tokenizers.path(pieces.MODEL)), random.Random(4)
    wrong = 0
    for _ in range(500):
        text = "".join(rng.choice("estrandioh") for _ in range(40))
        found = own.tokens(pieces.SPACE + text)
        assert found == library.encode(text)
        wrong += own.length[found[0]] != max(n for n in range(1, 17) if (pieces.SPACE + text)[:n] in own.id)
    assert wrong


def test_pieces_of_rows(spark, docs, none, library, tmp_path):
    got = {r.doc_id: r.ids for r in pieces.encoded(docs).collect()}
    assert {i: got[i] for i in range(len(TEXTS))} == {i: library.encode(t or "") for i, t in enumerate(TEXTS)}
    back = {r.doc_id: r.text for r in pieces.decoded(pieces.encoded(docs)).collect()}
    assert {i: back[i] for i in range(len(TEXTS))} == {i: (t or "").replace("▁", " ") for i, t in enumerate(TEXTS)}
    assert pieces.token_digests(docs).count() == docs.count()
    assert pieces.token_digests(none).count() == pieces.encoded(none).count() == 0
    broken = tmp_path / "broken.model"
    with open(public_tokenizers.path(pieces.MODEL), "rb") as f:
        model = pieces.sentencepiece_model_pb2.ModelProto.FromString(f.read())
    model.normalizer_spec.remove_extra_whitespaces = True
    broken.write_bytes(model.SerializeToString())
    with pytest.raises(ValueError, match="normalisation"):
        pieces.Pieces(str(broken))


# Collocations


def phrases_by_definition(rows, least, top, longest=5):
    by_lang = collections.defaultdict(list)
    for text, lang in rows:
        lowered = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        by_lang[lang or "und"] += [re.findall(r"[^ \t]+", p) for p in re.split(r"[.,;:!?\n-\r]", lowered)]
    out = []
    for lang, parts in by_lang.items():
        f = collections.Counter(tuple(p[i : i + k]) for p in parts for k in range(1, longest + 1) for i in range(len(p) - k + 1))
        n = sum(map(len, parts))
        kept = []
        for phrase, a in f.items():
            if len(phrase) < 2 or a < least:
                continue
            score, k = min((1000 * a * n // (f[phrase[:k]] * f[phrase[k:]]), k) for k in range(1, len(phrase)))
            longer = (q for q, b in f.items() if len(q) > len(phrase) and b >= a and any(q[i : i + len(phrase)] == phrase for i in range(len(q))))
            if next(longer, None) is None:
                kept.append((-score, -a, " ".join(phrase).encode(), f[phrase[:k]], f[phrase[k:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, n, -s) for i, (s, a, p, left, right) in enumerate(sorted(kept)[:top])]
    return sorted(out)


@pytest.mark.parametrize("hot", [0.001, 0.02, 2.0])
def test_collocations_by_definition(spark, monkeypatch, hot):
    monkeypatch.setattr(collocations, "HOT", hot)
    monkeypatch.setattr(collocations, "BLOCK", 500)
    monkeypatch.setattr(collocations, "ROWS", 50)
    monkeypatch.setattr(collocations, "HELD", 800)
    rng = np.random.default_rng(1)
    vocabulary = ["the", "of", "The", "é", "É", "Über", "big", "data", "x\ty", "a-b", "日本", *(f"w{i}" for i in range(40))]
    weights = 1 / np.arange(1, len(vocabulary) + 1)
    rows = [("".join(w + str(rng.choice([" ", "  ", " ", ". ", ",", "\n", "\t"])) for w in rng.choice(vocabulary, int(rng.integers(0, 80)), p=weights / weights.sum())), ["en", "fr", None, "und"][int(rng.integers(0, 4))]) for _ in range(300)]
    rows += [("New York City is big; of the people by the people", "en")] * 15 + [("a a a a a a a a", "en")] * 3 + [(None, "en"), ("", None), ("...", "fr")]
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(3)
    got = collocations.collocations(docs, least=5, top=60).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()
    assert sorted(map(tuple, got)) == phrases_by_definition(rows, 5, 60)


def test_sorted_partitions_are_counts():
    rng = np.random.default_rng(2)
    rows, n = rng.integers(1, 4, (400, 5)), rng.integers(1, 5, 400)
    rows[rng.random(400) < 0.3, 3:] = 0
    want = collections.Counter()
    for row, weight in zip(rows.tolist(), n.tolist(), strict=True):
        for k in range(3, 6):
            if 0 not in row[:k]:
                want[tuple(row[:k])] += weight
    for least in (1, 12, 10**6):
        got = {tuple(rows[at, :k].tolist()): c for at, k, c in collocations.prefix_counts(rows, n, least)}
        assert got == {p: c for p, c in want.items() if c >= least}


def test_collocation_edges(docs, none):
    got = [tuple(r) for r in collocations.collocations(docs, least=2).select("lang", "phrase", "a").collect()]
    assert ("und", "日本 日本 日本 日本 日本", 4996) in got
    assert collocations.collocations(none).count() == 0
    with pytest.raises(ValueError):
        collocations.collocations(docs, longest=6)


# Spelling variants


def variants_by_definition(rows, ratio=10):
    n = collections.Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m.group().lower(), run)
            h = zlib.crc32(f"{'null' if key is None else key}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    links = {w: sorted((-n[v], v) for v in n if near(v, w)) for w in n}
    form = {w: v[0][1] if v and -v[0][0] >= ratio * n[w] else None for w, v in links.items()}

    def root(w):
        return w if form[w] is None else root(form[w])

    return sorted((w, n[w], len(links[w]), form[w] or "", n[form[w]] if form[w] else -1, root(w)) for w in n)


def found_variants(docs, **how):
    return sorted((r.word, r.n, r.n_near, r.form or "", -1 if r.form_n is None else r.form_n, r.root) for r in variants.variants(docs, **how).collect())


@pytest.mark.parametrize("block", [variants.BLOCK, 5])
def test_variants_by_definition(spark, block, monkeypatch):
    if block == 5:
        monkeypatch.setattr(variants, "SMALL", 2)
        monkeypatch.setattr(variants, "CELLS", 40)
    rng = random.Random(5)
    base = ["aaaaaaa", "aaaaaaaa", "aaaaaaaaa", "Banana", "bananas", "éléphant", "Öffnung", "straße×÷", "running", "cunning"]
    base += ["".join(rng.choice("abé") for _ in range(rng.randint(7, 9))) for _ in range(60)]
    words = []
    for w in base:
        words += [w] * rng.choice([2, 3, 30, 400])
        at = rng.randrange(len(w))
        words += [w[:at] + rng.choice("abz") + w[at + rng.choice([0, 1]) :]] * rng.choice([2, 5, 40])
    rng.shuffle(words)
    rows = [(i, " ".join(words[i::150]) + "!") for i in range(150)] + [(None, "éléphant éléphant"), (7, None), (7, ""), (8, "x" * 40_000 + " " + "x" * 40_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert found_variants(docs, block=block) == variants_by_definition(rows)


def test_keys_are_clear_of_every_edit():
    for length in range(7, 40):
        for at in range(length):
            assert any(p <= at and s <= length - 1 - at for p, s in variants.shares(length))
        assert all(p + s >= (length - 1) // 2 for p, s in variants.shares(length))


def test_near_words_of_tiles():
    words = ["abcdefg", "abcdefgh", "abcdxfg", "bcdefgh", "abcdefg"[::-1], "aaaaaaaa", "aaaaaaa"]
    block = tuple(x[None] for x in variants.codes(words, 8))
    found = {(words[x], words[y]) for part in range(3) for _, x, y in zip(*variants.near_in_tiles(block, block, 8, part), strict=True)}
    assert found == {p for a, b in [("abcdefg", "abcdefgh"), ("bcdefgh", "abcdefgh"), ("aaaaaaaa", "aaaaaaa")] for p in itertools.permutations((a, b))}


def test_roots_follow_chains(spark):
    chain = [(f"w{i:03}", f"w{i + 1:03}") for i in range(37)]
    assert {r.root for r in variants.roots(spark.createDataFrame(chain, "word string, form string")).collect()} == {"w037"}
    with pytest.raises(ValueError):
        variants.roots(spark.createDataFrame([("a", "b"), ("b", "a")], "word string, form string"), rounds=3)


def test_variant_edges(docs, none):
    assert variants.variants(none).count() == 0
    assert found_variants(docs) == variants_by_definition([(r.doc_id, r.text) for r in docs.collect()])

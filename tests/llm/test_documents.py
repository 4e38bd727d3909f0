"""Operators on documents against brute force, with nulls, empty and very long texts, ties, repeats and clashing columns."""

import collections
import hashlib
import itertools
import math
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

from raysheaf.llm import bpe, exact_dedup, langid, media, mixing, quality, ringsets, simhash, toxicity

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, size long, target double, digest string, fp long, id long"
LONG = " ".join(f"word{i % 977}" for i in range(30_000))
TEXTS = [None, "", "  \n\t", "a", "A", "a b", "ab", "a  b\n", "The quick brown fox jumps over the dog.", "The quick brown fox jumps over the dog .", LONG, LONG + " tail", "Ünïcödé ß 日本 🙂", "x<|endoftext|>y"]


def rows_of(texts):
    return [(i, t, ["en", "fr", None][i % 3], [None, "b", "a", "c"][i % 4], 0, 1, 2.0, "d", 3, 4) for i, t in enumerate(texts)]


@pytest.fixture
def docs(spark):
    rows = rows_of(TEXTS)
    return spark.createDataFrame([*rows, rows[8], rows[8], (None, "a b c", None, None, *rows[0][4:])], COLUMNS)


@pytest.fixture
def none(spark):
    return spark.createDataFrame([], COLUMNS)


def everything(df):
    return [r.asDict() for r in df.collect()]


# Mixing


def filled(sizes, weights, most):
    """Water filling by its definition: fix what is above its cap, share the rest again."""
    total, fixed = sum(sizes), {}
    while True:
        free = [i for i in range(len(sizes)) if i not in fixed]
        w = sum(weights[i] for i in free)
        share = {i: (total - sum(fixed.values())) * weights[i] / w for i in free} if free else {}
        over = [i for i in free if share[i] > most * sizes[i] + 1e-9]
        if not over:
            return [fixed.get(i, share.get(i)) for i in range(len(sizes))]
        fixed |= {i: most * sizes[i] for i in over}


def test_targets_are_water_filled(spark):
    sizes = {"a": 10, "b": 1000, "c": 500, "d": 30, "é": 7, None: 400, "z": 0}
    got = {r.source: r for r in mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, size long")).collect()}
    names = ["a", "b", "c", "d", "z", "é", None]
    want = filled([sizes[n] for n in names], [(5, 2, 1)[i % 3] for i in range(7)], 3)
    assert [got[n].target for n in names] == pytest.approx(want)


def test_mix(spark):
    rng = np.random.default_rng(0)
    data = [(i, "w " * int(rng.integers(0, 60)), "hot" if i % 3 else f"s{i % 7}") for i in range(3000)]
    d = spark.createDataFrame(data, "doc_id long, text string, source string")
    got = everything(mixing.mix(d, keep=["doc_id", "source"]))
    assert got and all(r["taken"] <= 3 * r["size"] for r in got)
    taken = collections.Counter()
    for r in got:
        taken[r["source"]] += r["taken"]
    for r in got:
        assert abs(taken[r["source"]] - r["target"]) < 300
    again = everything(mixing.mix(d.repartition(7), keep=["doc_id", "source"]))
    key = lambda rs: sorted((r["doc_id"], r["taken"]) for r in rs)
    assert key(got) == key(again)
    out = collections.Counter(r["doc_id"] for r in everything(mixing.mixed_documents(d)))
    assert out == collections.Counter({r["doc_id"]: r["copies"] for r in got if r["copies"]})


def test_mix_edges(docs, none):
    got = everything(mixing.mix(docs))
    assert len(got) == docs.count() and {"mix_size", "mix_target", "taken", "size"} <= set(got[0])
    assert mixing.mix(none).count() == 0 and mixing.mixed_documents(none).columns == none.columns
    assert mixing.mixed_documents(docs).columns == docs.columns


# Exact duplicates


def stripped(t):
    return re.sub(r"[\x20\x09-\x0D]", "", t or "")


def test_exact_duplicates(docs, none):
    rows = docs.collect()
    groups = collections.defaultdict(list)
    for r in rows:
        groups[stripped(r.text)].append((-len(r.text or ""), math.inf if r.doc_id is None else r.doc_id))
    want = []
    for r in rows:
        g = groups[stripped(r.text)]
        keep = min(g)[1]
        keep = None if keep == math.inf else keep
        want.append((r.doc_id, keep, len(g), r.doc_id == keep, hashlib.sha256(stripped(r.text).encode()).hexdigest()))
    got = [(r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.exact_duplicates(docs).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert exact_dedup.exact_duplicates(none).count() == 0
    left = exact_dedup.deduplicated(docs)
    assert left.columns == docs.columns and sorted(stripped(r.text) for r in left.collect()) == sorted(groups)


# SimHash


def test_fingerprint_by_definition():
    for t in TEXTS:
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        assert simhash.fingerprint(t) == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("bucket", [256, 1])
def test_links_find_all_pairs(spark, bucket):
    rng = np.random.default_rng(5)
    base = [int(x) for x in rng.integers(0, 1 << 63, 25)]
    fps = {b for b in base}
    for b in base:
        for _ in range(6):
            for n in (1, 2, 3):
                fps.add(b ^ sum(1 << int(i) for i in rng.choice(64, n, replace=False)))
    fps = sorted(fps | {0, 1, 3, 7})
    d = spark.createDataFrame([(i, simhash._signed(f)) for i, f in enumerate(fps)], "id long, fp long")
    got = {r.id: r.component_id for r in simhash.components(d, bucket=bucket).collect()}
    least = list(range(len(fps)))
    changed = True
    pairs = [(i, j) for i, j in itertools.combinations(range(len(fps)), 2) if (fps[i] ^ fps[j]).bit_count() <= 2]
    while changed:
        changed = False
        for i, j in pairs:
            m = min(least[i], least[j])
            changed |= least[i] != m or least[j] != m
            least[i] = least[j] = m
    assert got == dict(enumerate(least))


def test_near_duplicate_edges(docs, none):
    got = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    assert got[0].fingerprint == "0" * 16 and got[1].component_id == got[2].component_id == 0
    assert got[3].component_id == got[4].component_id == 3
    assert simhash.near_duplicates(docs).count() == docs.count() and simhash.near_duplicates(none).count() == 0


def test_similar_texts_may_repeat_lines(spark):
    rows = []
    for g in range(20):
        body, line = " ".join(f"w{g}x{i}" for i in range(300)), " ".join(f"v{g}x{i}" for i in range(14))
        rows += [(2 * g, f"{body} {line} {line}"), (2 * g + 1, f"{body} " + " ".join([line] * 40))]
    kept = simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.doc_id for r in kept) == list(range(0, 40, 2))


def test_similar_texts(spark, docs, none):
    words = [f"w{i}" for i in range(200)]
    texts = [" ".join(words), " ".join([*words[:100], "new", *words[101:]]), " ".join(words[:100] + [f"v{i}" for i in range(100)]), "something else entirely is here"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.one_of_each(d).collect()) == [0, 2, 3]
    assert simhash.one_of_each(none).count() == 0
    assert simhash.one_of_each(docs).columns == docs.columns


def jaccard_classes(texts):
    """Component ids over all pairs, by the definition."""
    sets = [set(zip(*[w[i:] for i in range(5)], strict=False)) or {tuple(w)} if (w := (t or "").lower().split()) else set() for t in texts]
    least = list(range(len(texts)))
    pairs = [(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    changed = True
    while changed:
        changed = False
        for i, j in pairs:
            m = min(least[i], least[j])
            changed |= least[i] != m or least[j] != m
            least[i] = least[j] = m
    return least


def test_chains_miss_no_similar_sets():
    rng, scheme, found = np.random.default_rng(3), ringsets.Scheme(0.8), 0
    for _ in range(600):
        a = np.unique(rng.integers(1, 1 << 62, int(rng.integers(1, 300))).astype(np.uint64))
        kept = a[: len(a) - int(rng.integers(0, len(a) // 5 + 1))]
        b = np.unique(np.r_[kept, rng.integers(1, 1 << 62, int(rng.integers(0, len(a) // 5 + 1))).astype(np.uint64)])
        both = len(np.intersect1d(a, b))
        if len(b) and both >= 0.8 * (len(a) + len(b) - both):
            found += 1
            left, right = ({int(k): (int(w), int(p)) for rows in ringsets.rows_of(x, scheme) for k, w, p in zip(*rows, strict=True)} for x in (a, b))
            fit = [k for k in left.keys() & right.keys() if ringsets.within(np.array([left[k][0]]), np.array([right[k][0]]))[0] and min(left[k][0], right[k][0]) < 1 << ringsets.UPPER]
            assert fit and any(left[k][1] != right[k][1] or not left[k][1] for k in fit)  # where a run of equal segments begins, too
            differ = int(np.bitwise_count(ringsets.sketch(a).view(np.uint64) ^ ringsets.sketch(b).view(np.uint64)).sum())
            assert differ <= len(a) + len(b) - 2 * both and 9 * differ <= len(a) + len(b)
    assert found > 200


def test_blocks_miss_no_similar_sets_and_tell_long_ones_apart():
    """Sets of some thousand shingles that are well short of similar fill sketches up, and pass these; they do not pass the blocks."""
    rng, scheme, similar, told, passed = np.random.default_rng(4), ringsets.Scheme(0.8), 0, 0, 0
    for turn in range(60):
        size = (6, 40, 300, 3000)[turn % 4]
        a = np.unique(rng.integers(1, 1 << 62, size).astype(np.uint64))
        share = 0.111 if turn % 8 < 4 else 0.2
        b = np.unique(np.r_[a[int(len(a) * share) :], rng.integers(1, 1 << 62, int(len(a) * share)).astype(np.uint64)])
        both = len(np.intersect1d(a, b))
        alike = both >= 0.8 * (len(a) + len(b) - both)
        left, right = ({int(r[0]): r[1:] for rows in ringsets.rows_of(x, scheme, wide=True) for r in zip(*rows, strict=True)} for x in (a, b))
        fits = 0
        for k in left.keys() & right.keys():
            (w, before, m, h, *x), (v, other, n, _, *y) = left[k], right[k]
            differ = np.cumsum(np.bitwise_count(np.array(x).view(np.uint64) ^ np.array(y).view(np.uint64)).astype(int))
            begins = before != other or not before
            fits += begins and min(w, v) < 1 << ringsets.UPPER and ringsets.within(np.array([w]), np.array([v]))[0] and differ[-1] <= (m + n) // 9 and all(differ[i] * h < max(1, (m + n) // 9) * (ringsets.EIGHT * (i + 1) + 1) for i in range(ringsets.BLOCKS))
        assert fits or not alike
        similar += alike
        if size == 3000 and not alike:
            sketched = int(np.bitwise_count(ringsets.sketch(a).view(np.uint64) ^ ringsets.sketch(b).view(np.uint64)).sum())
            told, passed = told + (not fits), passed + (9 * sketched <= len(a) + len(b))
    assert similar > 20 and told == passed > 5


def test_similar_by_brute_force_in_groups_at_the_threshold(spark):
    """Groups of edited copies around four fifths, where many a copy is similar to some of its group only; families that share a passage; short and equal texts."""
    rng, texts = np.random.default_rng(12), ["", " ", None, "one", "One", "a b c d", "a b c d e", "a b c d e f"]
    for g, (size, edits, copies) in enumerate([(200, 3, 120), (200, 2, 40), (60, 1, 30), (12, 1, 20), (900, 14, 25)]):
        base = [f"g{g}x{i}" for i in range(size)]
        for c in range(copies):
            own = list(base)
            for at in rng.choice(size, edits, replace=False):
                own[at] = f"e{g}y{c}z{at}"
            texts.append(" ".join(own[: size - int(rng.integers(0, size // 20 + 1))]))
    passage = [f"p{i}" for i in range(60)]
    texts += [" ".join([*passage, *(f"q{c}r{i}" for i in range(15 if c % 2 else 40))]) for c in range(60)]
    texts += [texts[20], texts[20], texts[150]]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r.id: r.component_id for r in simhash.similar(d).collect()}
    want = jaccard_classes(texts)
    least = {n: min(i for i, t in enumerate(texts) if (t or "") == x) for n, x in ((r.node, r.text or "") for r in d.select(ringsets.node_of(d.text).alias("node"), "text").collect())}
    plain = {}
    for r in ringsets.classes(d, turns=0).collect():
        plain.setdefault(r.root, {r.root}).add(r.node)
    assert {min(least[n] for n in g): len(g) for g in plain.values()} == {c: k for c, k in collections.Counter(want[i] for i in set(least.values())).items() if k > 1}
    assert got == dict(enumerate(want)) and 20 < len(set(want)) < len(texts) - 100
    assert sorted(r.doc_id for r in simhash.one_of_each(d).collect()) == sorted(set(want))


def test_buckets_are_streamed(spark):
    """A bucket that goes over many batches gives the same rows as one that does not."""
    import pyarrow as pa

    keys, nodes = [1, 1, 1, 1, 2, 3, 3, 3, 4, 4], [5, 6, 6, 7, 8, 9, 9, 9, 1, 2]
    words = [0] * 8 + [1 << ringsets.UPPER] * 2
    whole = pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (keys, nodes, words)], ["key", "node", "word"])
    want = [(1, 5, 5, False), (1, 6, 5, True), (1, 7, 5, True)]
    for size in (1, 2, 3, 10):
        got = [r for b in ringsets._runs(whole.slice(i, size) for i in range(0, 10, size)) for r in b.to_pylist()]
        assert [(r["key"], r["node"], r["pivot"], r["fits"]) for r in got] == want


def test_similar_by_tiles_of_large_buckets(spark, monkeypatch):
    """Members of a bucket that is dealt to parts meet all the same, with parities in the sign bit, too; and no turn or job is spent where pairs are few."""
    import pyarrow as pa

    rng, scheme = np.random.default_rng(5), ringsets.Scheme(0.8)
    base = np.unique(rng.integers(1, 1 << 62, 300).astype(np.uint64))
    rows = []
    for node in range(40):
        own = np.unique(np.r_[base[rng.permutation(len(base))[: len(base) - 12]], rng.integers(1, 1 << 62, 12).astype(np.uint64)])
        for r in ringsets.rows_of(own, scheme, wide=True):
            rows += [(*map(int, x), node, node) for x in zip(*r, strict=True)]
    wide = spark.createDataFrame(rows, ", ".join(f"{n} long" for n in ringsets._MET))
    dealt = wide.join(wide.groupBy("key").count().withColumnRenamed("count", "members"), "key")
    whole = {tuple(r) for r in ringsets._across(dealt, 0.8).collect()}
    assert {tuple(r) for r in ringsets._across(dealt, 0.8, tile=7).collect()} == whole == {(a, b) for a in range(40) for b in range(a)}
    signed = {n: pa.array([-1, 0] if n in ringsets._BLOCKED else [0, 0], pa.int64()) for n in ringsets._WIDE} | {"size": pa.array([100, 100]), "most": pa.array([25, 25]), "node": pa.array([1, 2]), "root": pa.array([1, 2])}
    met = ringsets.Met(0.8, [pa.RecordBatch.from_pydict(signed)])
    assert not len(met.fits(np.array([0]), np.array([1]), begins=True)[0])


def test_near_duplicates_take_few_jobs(spark):
    words = np.random.default_rng(6).integers(0, 10**6, (30, 80)).astype(str)
    texts = [" ".join(w) for w in words] + [" ".join([*w[:-1], "other"]) for w in words[:10]]
    d = simhash.written(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "few")
    spark.sparkContext.setJobGroup("near", "near")
    kept = simhash.one_of_each(d).count()
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("near"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert kept == 30 and jobs < 70


# BPE


def test_bpe_like_the_library(spark, docs, none):
    library = Tokenizer.from_file(public_tokenizers.path(bpe.VOCABULARY))
    rng = np.random.default_rng(2)
    texts = [*TEXTS, "ΣΑΣ ΟΔΟΣ. İstanbul ﬁ ½", "it's I'LL 'RE don't", "<|startoftext|><|endoftext|>", *("".join(map(chr, rng.integers(32, 0x2FFF, 40))) for _ in range(50))]
    own = bpe.Bpe(public_tokenizers.path(bpe.VOCABULARY))
    for t in texts:
        ids = library.encode(t or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        assert own.encode(t) == ids and own.decode(ids) == decoded
        assert own.digests(t) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
    assert bpe.token_digests(docs).count() == docs.count() and bpe.token_digests(none).count() == 0
    assert {r.doc_id: list(r.ids) for r in bpe.encoded(docs.where("doc_id = 13")).collect()} == {13: own.encode(TEXTS[13])}


def test_words_are_normalised_and_cut_once(monkeypatch):
    """However often they stand in the texts; and what stands between ASCII white space gives what the whole text gives, for all other white space, marks and controls behind it."""
    own, library, seen = bpe.Bpe(public_tokenizers.path(bpe.VOCABULARY)), Tokenizer.from_file(public_tokenizers.path(bpe.VOCABULARY)), []
    cut = own.words
    monkeypatch.setattr(own, "words", lambda text: seen.append(text) or cut(text))
    for _ in range(20):
        own.digests("It's a word, it's\tanother\nword.")
    assert sum(map(len, seen)) < 40
    for space in " \t\n\x0b\x0c\r\x1c\x1f\x85\xa0\u2003\u3000\u200b":
        for text in (f"It's{space}\u0301Caf\u0301e{space}{space}'s Σ{space}ΣΑΣ{space}", space, f"{'日本' * 40}{space}x1\u1100\u1161{space}\u11a8"):
            ids = library.encode(text, add_special_tokens=False).ids
            decoded = library.decode(ids, skip_special_tokens=False)
            assert own.digests(text) == own.digests(text.encode()) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())


def test_cuts_are_certain():
    own = bpe.Bpe(public_tokenizers.path(bpe.VOCABULARY))
    for word in ("thntblere", "zqxjkvbp", "日本語"):
        fragments = own.split(word)
        whole = tuple(s for f in fragments for s in f)
        assert own.word(word) == [own.vocab[t] for t in own.merge(whole)]


# Media


def test_codecs_and_features(docs, none):
    rng = np.random.default_rng(1)
    for kind, channels in (("P5", 1), ("P6", 3), ("BMP", 3)):
        image = rng.integers(0, 256, (5, 7, channels), dtype=np.uint8)
        assert (media.decode(media.encode(image, kind)) == image).all()
    assert media.decode(b"P2 # c\n2 1\n15\n0 15\n").ravel().tolist() == [0, 255]
    assert media.decode(b"P1\n3 1\n101").ravel().tolist() == [0, 255, 0]
    assert media.decode(b"P4\n9 1\n\x80\x80").ravel().tolist() == [0, *[255] * 7, 0]
    for broken in (b"", b"P5\n9 9\n255\nxx", b"BM", b"GIF89a"):
        with pytest.raises(ValueError):
            media.decode(broken)
    image = rng.integers(0, 256, (12, 8, 1), dtype=np.uint8)
    assert np.allclose(media.area_resize(image, 3, 2)[:, :, 0], image[:, :, 0].reshape(3, 4, 2, 4).mean(axis=(1, 3)))
    assert np.isclose(media.area_resize(image, 5, 3).mean(), image.mean())
    got = media.image_features(media.to_media(docs)).collect()
    assert len(got) == docs.count() and media.image_features(media.to_media(none)).count() == 0
    for r in got:
        text = "a b c" if r.id is None else TEXTS[r.id]
        n, payload = media.payload_of(text)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (n, len(payload), hashlib.sha256(payload).hexdigest())
        stored = media.store(payload)
        assert (r.tail_crc32, r.media_bytes, r.media_sha256) == (media.zlib.crc32(payload[-16:]), len(stored), hashlib.sha256(stored).hexdigest())
        kind, samples = media.FORMATS[media.zlib.crc32(payload) % 3], np.frombuffer(payload, np.uint8).astype(float)
        plane = samples.reshape(-1, 192) if kind == "P5" else samples.reshape(-1, 64, 3) @ np.array([0.299, 0.587, 0.114])
        h, w = plane.shape
        share = lambda n, cells: np.array([[max(0.0, min((c + 1) * n / cells, p + 1) - max(c * n / cells, p)) for p in range(n)] for c in range(cells)])
        if h < 500:
            cells = np.round(share(h, 8) @ plane @ share(w, 9).T / (h / 8 * w / 9), 6)
            assert r.feature == np.packbits(cells[:, 1:] > cells[:, :-1]).tobytes().hex()
        tile = np.load(__import__("io").BytesIO(bytes(r.tile)))
        assert r.tile_sha256 == hashlib.sha256(bytes(r.tile)).hexdigest() and r.tile_mean == round(float(tile.mean()), 6)
        assert len(payload) % 192 == 0 and np.load(__import__("io").BytesIO(bytes(r.tile))).shape[:2] == media.TILE


# Quality


def kneser_ney(texts, order):
    """The model by its definition, on dictionaries."""
    grams = collections.Counter(int(g) for t in texts for g in quality.ngrams(t, order))
    counts = {order: grams}
    for k in range(order - 1, 0, -1):
        counts[k] = collections.Counter(g & ((1 << 12 * k) - 1) for g in counts[k + 1])

    def discounts(c):
        n = [sum(v == i for v in c.values()) for i in (1, 2, 3, 4)]
        if not all(n):
            return quality.DEFAULT_DISCOUNTS
        y = n[0] / (n[0] + 2 * n[1])
        return [min(max(i - (i + 1) * y * n[i] / n[i - 1], 0.05), i - 0.05) for i in (1, 2, 3)]

    d = {k: discounts(c) for k, c in counts.items()}
    by = {k: collections.defaultdict(list) for k in counts}
    for k, c in counts.items():
        for g, v in c.items():
            by[k][g >> 12].append(v)

    def p(g, k):
        if k == 0:
            return 1 / quality.SYMBOLS
        g &= (1 << 12 * k) - 1
        seen = by[k].get(g >> 12)
        if not seen:
            return p(g, k - 1)
        off = lambda v: d[k][min(v, 3) - 1]
        c = counts[k].get(g, 0)
        return ((c - off(c)) if c else 0) / sum(seen) + sum(map(off, seen)) / sum(seen) * p(g, k - 1)

    return lambda t: math.exp(-sum(math.log(p(int(g), order)) for g in quality.ngrams(t, order)) / (len(t) + 1))


def test_perplexity_by_definition(spark):
    train = ["the cat sat on the mat", "a dog sat on a log", "the end of the day", "cats and dogs", "日本 日本"] * 2 + ["one more, then"]
    texts = ["the dog", "zzz", "日本", "the cat sat on the mat", "x" * 50, None, "  "]
    model = quality.fit(spark.createDataFrame([(t,) for t in train], "text string"), 3)
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2, "doc_id")
    path = f"{quality.written(d, 'texts').inputFiles()[0].rsplit('/', 1)[0]}"
    for unit in (1 << 20, 4):
        got = {r.id: r.perplexity for r in quality.perplexities(spark.read.parquet(path), model, unit=unit).collect()}
        brute = kneser_ney(train, 3)
        assert set(got) == set(range(7)) and got[5] is None and got[6] is None
        for i in range(5):
            assert got[i] == pytest.approx(brute(texts[i]), rel=1e-4)


def test_judged(spark, docs, none):
    good = ["the house is near the old river and the trees are green", "we walk along the river to the old house in the morning"]
    data = [(i, f"{good[i % 2]} {good[i // 2 % 2]}", "en") for i in range(150)] + [(200 + i, "#### %%% @@@@ ~~~~ ^^^^ " * 3, "en") for i in range(5)]
    d = spark.createDataFrame(data, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i in range(120)] + [(200, 0)], "doc_id long, quality int")
    got = {r.doc_id: r.kept for r in quality.judged(quality.written(d, "d"), labels).collect()}
    assert not any(got[200 + i] for i in range(5)) and sum(got[i] for i in range(150)) > 135
    edge = quality.written(docs, "d")
    found = quality.judged(edge, labels).collect()
    assert len(found) == docs.count() and not any(r.kept for r in found if r.doc_id in (0, 1, 2))
    assert quality.judged(quality.written(none, "d"), labels).count() == 0
    assert quality.accepted(edge, labels).columns == docs.columns
    assert all(r.kept == (r.perplexity is not None) for r in quality.judged(edge, labels.limit(0)).collect())


# Language


def test_marginals_by_enumeration():
    rng = np.random.default_rng(0)
    for n_lang in (1, 2, 3):
        lengths = rng.integers(1, 6, 5)
        e, a, s = rng.normal(size=(lengths.sum(), n_lang)), rng.normal(size=(n_lang, n_lang)), rng.normal(size=n_lang)
        got, at = langid.marginals(e, lengths, a, s, block=2), 0
        for n in lengths:
            want = np.zeros((n, n_lang))
            for path in itertools.product(range(n_lang), repeat=int(n)):
                w = math.exp(s[path[0]] + sum(e[at + i, path[i]] for i in range(n)) + sum(a[path[i - 1], path[i]] for i in range(1, n)))
                for i in range(n):
                    want[i, path[i]] += w
            assert np.allclose(got[at : at + n], want / want.sum(axis=1, keepdims=True))
            at += n


def test_long_runs_of_letters_are_read_whole():
    ends = "a" * 40
    run = ends + "bcd" * 20 + ends
    words = langid.WORDS.findall(run)
    assert "".join(words) == run and max(map(len, words)) <= 40
    read = {f for w in words for f in langid.word_features(w, {})}
    assert langid.zlib.crc32(b"bcd") % langid.BUCKETS in read


def test_labels_words_and_texts(spark, docs, none):
    en, fr = "the house and the river with other things in this place".split(), "la maison et le fleuve avec une autre chose dans cette ville".split()
    rng = np.random.default_rng(4)
    sample = [(lang, " ".join(rng.choice(words, 40))) for lang, words in (("en", en), ("fr", fr)) for _ in range(20)]
    model = langid.fit(sample, steps=15)
    post = langid.Labeller(model).posterior([["the", "river", "with", "maison", "et", "le", "fleuve"]])
    assert post.argmax(axis=1).tolist() == [0, 0, 0, 1, 1, 1, 1]
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.label(spark.createDataFrame([(1, "the house"), (2, "la maison 5"), (3, "12 !"), (4, None)], "doc_id long, text string"), model).collect()}
    assert got[1][0] == "en" and got[2][0] == "fr" and got[3] == got[4] == ("und", 0.0) and 0.5 < got[1][1] <= 1
    assert langid.label(docs, model).count() == docs.count() and langid.label(none, model).count() == 0
    assert langid.fit([]) is None and {r.lang_pred for r in langid.label(docs, None).collect()} == {"und"}


# Toxicity


def test_index_is_exact():
    rng = np.random.default_rng(6)
    idf = rng.uniform(1, 4, 30)
    vectors = [toxicity.unit({int(t): int(rng.integers(1, 4)) for t in rng.choice(30, int(rng.integers(0, 6)), replace=False)}, idf) if i % 9 else {} for i in range(400)]
    index = toxicity.Index(list(range(400)), [i % 2 for i in range(400)], [1.0] * 400, vectors, 30, block=8)
    for _ in range(100):
        q = toxicity.unit({int(t): 1 for t in rng.choice(30, 4, replace=False)}, idf)
        sims = sorted((round(sum(q.get(t, 0) * w for t, w in v.items()), 9) for v in vectors if v), reverse=True)
        near = index.nearest(q, 5)
        got = [round(s, 9) for p, s in near for _ in range(index.number[p])]
        assert got[:5] == pytest.approx([s for s in sims if s > 0][:5]) and len(got) >= min(5, sum(s > 0 for s in sims))


def test_toxicity_compares_all_terms_of_the_examples(spark):
    rng = np.random.default_rng(18)
    calm = [f"calm{i}" for i in range(60)]
    data = [(i, " ".join([*rng.choice(calm, 12), *(["vilest"] if i % 4 == 0 else [])])) for i in range(200)]
    data += [(200, " ".join([*calm[:30], "vilest"])), (201, " ".join(calm[:12])), (202, "vilest"), (203, "quixotry"), (204, "quixotry")]
    d = spark.createDataFrame(data, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(200)] + [(203, 1)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.scored(d, labels, labels["doc_id"] >= 0).collect()}
    # A long text with one toxic word is not the same as that word alone, a clean text has neighbours, and so has a word of a single example.
    assert max(e.similarity for e in got[200].evidence) < 0.999
    assert len(got[201].evidence) >= 15 and {e.label for e in got[201].evidence} == {0}
    assert [e.id for e in got[204].evidence] == [203] and got[204].evidence[0].similarity == pytest.approx(1)


def test_toxic_words_are_found(spark, docs, none):
    rng = np.random.default_rng(8)
    calm = [f"calm{i}" for i in range(60)]
    data = []
    for i in range(300):
        words = list(rng.choice(calm, 12))
        if i % 4 == 0:
            words[3:5] = ["vilest", "awful"]
        data.append((i, " ".join(words)))
    d = spark.createDataFrame(data, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(200)] + [(3, None)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.scored(d, labels, labels["doc_id"] < 200).collect()}
    assert all((got[i].score >= 0.5) == (i % 4 == 0) for i in range(200, 300))
    assert {e.label for e in got[200].evidence} == {1}
    assert toxicity.scored(docs, labels, labels["doc_id"] < 200).count() == docs.count()
    assert toxicity.scored(none, labels, labels["doc_id"] < 200).count() == 0
    assert {r.score for r in toxicity.scored(d, labels.where("toxic = 0"), labels["doc_id"] < 200).collect()} == {0.0}


def test_toxicity_by_brute_force(spark):
    """Terms, document frequencies, weights, neighbours, votes and calibration by their definitions."""
    rng = np.random.default_rng(21)
    calm, vile = [f"calm{i}" for i in range(80)], ["vilest", "awful", "nasty"]
    texts = [" ".join([*rng.choice(calm, int(rng.integers(0, 25))), *(rng.choice(vile, 2) if i % 5 == 0 else [])]) for i in range(300)]
    label = {i: int(i % 5 == 0) for i in range(180)}
    got = {r.doc_id: r for r in toxicity.scored(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame(list(label.items()), "doc_id long, toxic int"), toxicity.F.lit(True)).collect()}
    bags = [collections.Counter(t.split()) for t in texts]
    vocabulary = {w for i in label for w in bags[i]}
    places = {w: i for i, w in enumerate(sorted(vocabulary))}

    def fold(i):
        known = sorted((places[w], c) for w, c in bags[i].items())
        return toxicity.fold_of(np.array([p for p, _ in known], np.int32), np.array([c for _, c in known], np.int32))

    def weight(w, learned):
        n = [sum(label[i] == k for i in learned) for k in (0, 1)]
        seen = [sum(w in bags[i] for i in learned if label[i] == k) for k in (0, 1)]
        cells = [(seen[k] if there else n[k] - seen[k], n[k], sum(seen) if there else sum(n) - sum(seen)) for k in (0, 1) for there in (0, 1)]
        g2 = 2 * sum(o * math.log(o * sum(n) / (a * b)) for o, a, b in cells if o)
        df = sum(w in b for b in bags)
        return (math.log((len(texts) + 1) / (df + 1)) + 1) * math.sqrt(1 + max(0.0, round(g2, 6)))

    def model(learned):
        weights = {w: weight(w, learned) for w in vocabulary}

        def vector(i):
            v = {w: (1 + math.log(c)) * weights[w] for w, c in bags[i].items() if w in vocabulary}
            size = math.sqrt(sum(x * x for x in v.values()))
            return {w: x / size for w, x in v.items()}

        vectors = [vector(i) for i in range(300)]

        def nearest(i):
            sims = sorted(((-round(sum(x * vectors[j].get(w, 0) for w, x in vectors[i].items()), 12), j) for j in learned))
            return [(j, -s) for s, j in sims if s < 0][: toxicity.NEAREST]

        return nearest

    def vote(near):
        return round(sum(s for j, s in near if label[j]) / sum(s for _, s in near), 9)

    folds = {i: fold(i) for i in label}
    votes = []
    for f in range(toxicity.FOLDS):
        near = model([i for i in label if folds[i] != f])
        votes += [(vote(n), label[i]) for i in label if folds[i] == f and (n := near(i))]
    at, means = toxicity.isotonic(np.array([v for v, _ in votes]), np.array([y for _, y in votes], float), np.ones(len(votes)))
    nearest = model(list(label))
    for i in range(300):
        near = nearest(i)
        if near:
            assert got[i].score == pytest.approx(float(np.interp(vote(near), at, np.clip(means, 0.001, 0.999))), abs=1e-6)
            assert [e.similarity for e in got[i].evidence] == pytest.approx([s for _, s in near], abs=1e-9)
        else:
            assert not got[i].evidence
    assert len({r.score for r in got.values()}) > 2


def test_judged_learns_from_all_trusted(spark):
    """The model is of every trusted document that is not set apart, and thresholds are exact."""
    texts = ["the house is near the old river", "we walk along the river", "green trees stand in the morning", "an old house"]
    data = [(i, texts[i % 4] + f" {i}", "en" if i % 3 else None) for i in range(400)]
    d = quality.written(spark.createDataFrame(data, "doc_id long, text string, lang string"), "d")
    labels = spark.createDataFrame([(i, 1) for i in range(300)], "doc_id long, quality int")
    apart = {i for i in range(300) if zlib.crc32(str(i).encode()) % quality.APART == 0}
    brute = kneser_ney([t for i, t, _ in data if i < 300 and i not in apart], 3)
    assert not hasattr(quality, "TRAIN")
    got = {r.doc_id: r for r in quality.judged(d, labels, order=3).collect()}
    assert all(got[i].perplexity == pytest.approx(brute(t), rel=1e-4) for i, t, _ in data[:40])
    own = sorted(got[i].perplexity for i in apart)
    assert {r.threshold for r in got.values()} == {own[math.ceil(len(own) * 0.99) - 1]}  # no language has enough of its own


def test_learned_keeps_all_of_many(spark):
    """More trusted documents than the former sample of 20,000."""
    d = spark.range(50_000).selectExpr("id", "'x' AS text")
    assert quality.learned(d, spark.range(0, 50_000, 2)).count() == 25_000


def test_quantiles_exact(spark):
    data = [(g, float(x)) for g in (0, 1) for x in np.random.default_rng(g).integers(1, 50, 333)] + [(2, 7.5)]
    got = {r.group: (r.value, r.m) for r in quality.quantiles(spark.createDataFrame(data, "group int, x double"), 0.9).collect()}
    for g in (0, 1, 2):
        own = sorted(x for h, x in data if h == g)
        assert got[g] == (own[math.ceil(0.9 * len(own)) - 1], len(own))

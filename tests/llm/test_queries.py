"""Every numbered query on the smallest tables: against its SQL where it has one, else by its rows."""

import glob
import hashlib
import os
import zlib

import duckdb
import pytest

from raysheaf import llm
from raysheaf.llm.common import table

SF = "/root/testdata/sf0.001"
ROWS = {"op4_warc": "pages"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path).removesuffix('.parquet')} AS SELECT * FROM '{path}'")
    return con


def text(v):
    return f"{v:.6f}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_like_sql(spark, duck, name):
    found = llm.queries()[name](spark, SF)
    want = duck.execute(llm.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    assert sorted(found.columns) == sorted(columns)
    assert sorted(tuple(text(r[c]) for c in columns) for r in found.collect()) == sorted(tuple(map(text, r)) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(set(llm.queries()) - set(llm.oracle_sql())))
def test_a_row_for_each_document(spark, name):
    found = llm.queries()[name](spark, SF)
    assert sorted(r[0] for r in found.select("doc_id").collect()) == sorted(r[0] for r in table(spark, SF, "documents").select("doc_id").collect())


def by_id(spark, name):
    """Rows of a query by id, and the texts, null ones empty."""
    texts = {r.doc_id: r.text or "" for r in table(spark, SF, "documents").select("doc_id", "text").collect()}
    return {r.doc_id: r for r in llm.queries()[name](spark, SF).collect()}, texts


def sha256(data):
    return hashlib.sha256(data).hexdigest()


def test_toxicity_columns(spark):
    rows, texts = by_id(spark, "op3_toxicity")
    for i, r in rows.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
    assert len({(texts[i], r.score) for i, r in rows.items()}) == len(set(texts.values()))


def test_language_columns(spark):
    rows, texts = by_id(spark, "op9_language_id")
    known = {r.lang for r in table(spark, SF, "documents").select("lang").distinct().collect()}
    for i, r in rows.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1
        assert r.lang_pred in known | {"und"} and (r.lang_pred == "und") == (not any(c.isalpha() for c in texts[i]))


def test_tokens_equal_the_library(spark):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(str(path("word_bpe_49k.json")))
    whole.no_truncation()
    whole.no_padding()
    rows, texts = by_id(spark, "op6_bpe")
    for i, r in rows.items():
        ids = whole.encode(texts[i], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), sha256(" ".join(map(str, ids)).encode()))
        assert r.decoded_sha256 == sha256(whole.decode(ids, skip_special_tokens=False).encode())


def test_media_payloads(spark):
    rows, texts = by_id(spark, "op8_media")
    for i, r in rows.items():
        data = texts[i].encode()
        padded = data.ljust(max(192, -(-len(data) // 192) * 192))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(padded), sha256(padded), zlib.crc32(padded[-16:]))

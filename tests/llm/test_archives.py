"""WARC archives and chat logs: round trips, interoperation and edge cases."""

import base64
import gzip
import hashlib
import io
import zipfile

import pytest

from raysheaf.llm import chat, common, warc


@pytest.fixture
def pages(spark):
    html = ["<p>one</p>", "", None, "<p>one</p>", "ünï\r\n\r\nWARC/1.1", "x" * 300_000, "<p>one</p>", ""]
    return spark.createDataFrame([(i, [None, "http://a/?q=é\r\nX: y"][i % 2], h, "extra") for i, h in enumerate(html)], "page_id long, url string, html string, payload string")


@pytest.mark.parametrize("zip64", [False, True])
def test_archives_round_trip(spark, pages, zip64):
    folder = common.scratch(spark, "warc")
    archives = warc.write_archives(pages, folder, roll=2000, member=500, zip64=zip64)
    found = {r.record: r for r in warc.read_archives(archives, block=700).collect()}
    rows = pages.collect()
    first = {}
    for r in rows:
        first.setdefault(r.html or "", r.page_id)
    assert archives.count() > 1 and len(found) == len(rows)
    for r in rows:
        payload = (r.html or "").encode()
        got = found[str(r.page_id)]
        again = first[r.html or ""] != r.page_id
        assert got.record_type == ("revisit" if again else "response") and got.refers_to == (str(first[r.html or ""]) if again else None)
        assert got.payload_digest == base64.b32encode(hashlib.sha1(payload).digest()).decode()
        assert again or bytes(got.payload) == payload
        assert got.payload_bytes == len(payload)
    system, path = warc.filesystem(archives.first().archive)
    with system.open_input_file(path) as f, zipfile.ZipFile(io.BytesIO(f.read())) as z:
        assert z.testzip() is None
        member = next(n for n in z.namelist() if n.endswith(".warc.gz"))
        assert gzip.decompress(z.read(member)).startswith(b"WARC/1.1\r\n")


def test_smaller_payloads_are_responses(spark, pages):
    archives = warc.write_archives(pages, common.scratch(spark, "warc"), min_revisit=1)
    kinds = {r.record: r.record_type for r in warc.read_archives(archives).collect()}
    assert kinds["1"] == kinds["2"] == kinds["7"] == "response" and kinds["3"] == kinds["6"] == "revisit"
    assert warc.read_archives(warc.write_archives(pages.limit(0), common.scratch(spark, "warc"))).count() == 0


def test_pages_without_ids(spark):
    d = spark.createDataFrame([(3, None, "a"), (None, None, "a"), (None, None, "b"), (None, None, "b"), (3, None, "a")], "page_id long, url string, html string")
    got = sorted((r.record, r.record_type, r.refers_to or "", r.payload_bytes) for r in warc.read_archives(warc.write_archives(d, common.scratch(spark, "warc"))).collect())
    assert got == [("3", "response", "", 1)] * 2 + [("None", "response", "", 1)] * 2 + [("None", "revisit", "3", 1)]


def test_records_are_read_by_many_tasks(spark, pages):
    many = pages.unionByName(pages.selectExpr("page_id + 100 as page_id", "url", "cast(page_id as string) as html", "payload")).repartition(1)
    archives = warc.write_archives(many, common.scratch(spark, "warc"))
    rows = warc.read_archives(archives, block=200)
    assert rows.rdd.getNumPartitions() > 5 and rows.count() == many.count()


def test_foreign_archives_are_refused(tmp_path):
    (tmp_path / "x.zip").write_bytes(b"PK not an archive")
    with pytest.raises(ValueError):
        warc.directory(warc.Ranges(str(tmp_path / "x.zip")))


TURNS = [(1, 0, "user", "</s>[INST] ok [/INST]"), (1, 1, "assistant", "~1 <b> [x] ~~0 \n"), (1, 2, None, None), (1, 3, "to]ol[", "~3"), (1, 4, "assistant", ""), (1, 5, "~3]~", "a~3b"), (1, 6, "a~3b", "]"), (2, 0, "system", "hi"), (None, 0, "assistant", "ok")]


def test_chat_reads_back(spark):
    d = spark.createDataFrame(TURNS, "conv_id long, message long, role string, text string")
    log = chat.events_of(d).orderBy("seq", ascending=False).repartition(3)
    folded = chat.fold_messages(log, chunk=2)
    out = chat.render(folded)
    got = {r.conv_id: r for r in out.select("conv_id", "formatted", "loss_spans", chat.read_turns(out["formatted"]).alias("turns"), chat.read_loss(out["formatted"], out["loss_spans"]).alias("loss")).collect()}
    for conv in (1, 2, None):
        want = [(r or "", t or "") for c, _, r, t in TURNS if c == conv]
        assert [(t.role, t.text) for t in got[conv].turns] == want
        assert got[conv].loss == "".join(t for r, t in want if r == "assistant")
        assert got[conv].formatted.count("[INST]") == sum(r == "user" for r, _ in want)
    digest = {r.conv_id: r for r in chat.digests(out).collect()}
    assert digest[2].turns_sha256 == hashlib.sha256(b"system\nhi\n").hexdigest() and digest[2].loss_chars == 0
    assert chat.render(chat.fold_messages(log.limit(0))).count() == 0


def test_events_fold_in_order(spark):
    log = [(1, 1, 0, "start", "assistant", None), (1, 1, 1, "delta", None, "He"), (1, 1, 2, "delta", None, "llo"), (1, 2, None, None, None, "bare"), (1, 3, 0, "delta", "user", "old"), (1, 3, 5, "edit", None, "new"), (1, 3, 9, "delta", None, "!"), (1, 3, 7, "regenerate", None, "ignored")]
    d = spark.createDataFrame(log, "conv_id long, message long, seq long, event string, role string, text string")
    for chunk in (1, 2, 256):
        got = sorted((r.message, r.role, r.text) for r in chat.fold_messages(d, chunk).collect())
        assert got == [(1, "assistant", "Hello"), (2, "", "bare"), (3, "user", "!")]


def test_a_conversation_is_folded_by_many_tasks(spark):
    """The partitioning of the turns' numbers does not reach the fold: chunks are dealt anew."""
    d = spark.createDataFrame([(1, i, "user", "x") for i in range(50)], "conv_id long, message long, role string, text string").repartition("conv_id")
    plan = chat.fold_messages(chat.events_of(d.withColumn("message", chat.F.struct("message"))))._jdf.queryExecution().optimizedPlan().toString()
    shuffles = chat.fold_messages(chat.events_of(d.withColumn("message", chat.F.struct("message"))))._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(conv_id")
    assert plan and shuffles >= 3

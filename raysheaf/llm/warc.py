"""WARC records in ZIP archives: written by executors, located through directories, range-read.

Writing: one archive per task and ``roll`` bytes. Each record is a gzip member of its own
within a ``.warc.gz`` file, that file is a stored (not deflated) ZIP member, and an index
member lists offset and length of each record. A payload that occurs again is written
once, as a response; the other records revisit it.

Reading: the end of an archive leads to the central directory (by the ZIP64 locator where
there is one), the directory to the index members, these to the records. Each of the three
steps and each record is a read of one byte range; nothing is unpacked to disk and no
archive is read whole. Locating is one row per archive, reading one row per record, spread
by blocks of archives over all executors, in as many tasks as the archives have blocks. What a
revisit leaves out, its length, stands in the HTTP header that it has kept.

Archives lie in the shared folder, which executors reach through ``pyarrow.fs`` by the
scheme of its address. A task writes under a name of its own and renames at the end, so a
task that is run again leaves one whole archive.

Edge cases: a null html is an empty payload; equal empty payloads are revisits too at a
bound of 0; a null url leaves its header out; a page without an id revisits the response of
its payload, and is a response itself where no page of that payload has an id; a repeated row
of the response is a response as well, and so are ties; payloads of any length are one
record; an empty table gives no archive and no rows; further columns are not read, whatever
their names; a cut-off or foreign archive raises ``ValueError``.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote, urlsplit

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch, table, written

ROLL = 1 << 30
MEMBER = 32 << 20
BLOCK = 8 << 20
#: Reading tasks per core of the cluster at most; blocks are larger then.
PER_CORE = 32
MIN_REVISIT = 0
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2020-01-01T00:00:00Z"
HIGH32, HIGH16 = 0xFFFFFFFF, 0xFFFF


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode("ascii")


def filesystem(address: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a folder's or file's address."""
    parts = urlsplit(address)
    if parts.scheme in ("", "file"):
        return pafs.LocalFileSystem(), unquote(parts.path)
    return pafs.FileSystem.from_uri(address)


# Records


def record(kind: str, record_id: str, payload: bytes, digest: str, url: str | None = None, refers_to: str | None = None) -> bytes:
    """One WARC/1.1 record; a revisit has the response's HTTP header and no payload."""
    body = payload if kind == "response" else b""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    fields = [("WARC-Type", kind), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Date", DATE), ("WARC-Payload-Digest", f"sha1:{digest}")]
    if url is not None:
        fields.append(("WARC-Target-URI", quote(url, safe="!#$%&'()*+,/:;=?@[]~")))
    if kind == "revisit":
        fields += [("WARC-Refers-To", f"<{refers_to}>"), ("WARC-Profile", PROFILE)]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(http) + len(body)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + http + body + b"\r\n\r\n"


def fields_of(lines: list[str]) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}


def parse_record(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """Fields of the record and of the HTTP header (names in lower case), and the payload behind both."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not gap or not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = fields_of(lines[1:])
    n = int(fields["content-length"])
    if len(rest) < n + 4 or rest[n : n + 4] != b"\r\n\r\n":
        raise ValueError("the record ends early")
    http, _, payload = rest[:n].partition(b"\r\n\r\n")
    return fields, fields_of(http.decode("latin-1").split("\r\n")[1:]), payload


# Archives


class ZipWriter:
    """Stored members into a stream, then the directory; ZIP64 fields where a number needs them, or always if ``zip64``."""

    def __init__(self, out, zip64: bool = False) -> None:
        self.out, self.at, self.zip64, self.entries = out, 0, zip64, []

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def add(self, name: str, data: bytes) -> int:
        """The place of the member's data in the archive."""
        raw, start, crc = name.encode(), self.at, zlib.crc32(data)
        large = self.zip64 or len(data) >= HIGH32
        extra = struct.pack("<HHQQ", 1, 16, len(data), len(data)) if large else b""
        size = HIGH32 if large else len(data)
        self._write(struct.pack("<4sHHHHHIIIHH", b"PK\3\4", 45 if large else 20, 0x800, 0, 0, 33, crc, size, size, len(raw), len(extra)) + raw + extra)
        place = self.at
        self._write(data)
        self.entries.append((raw, start, crc, len(data)))
        return place

    def close(self) -> None:
        start = self.at
        for raw, at, crc, n in self.entries:
            large = self.zip64 or n >= HIGH32 or at >= HIGH32
            extra = struct.pack("<HHQQQ", 1, 24, n, n, at) if large else b""
            size = HIGH32 if large else n
            self._write(struct.pack("<4sHHHHHHIIIHHHHHII", b"PK\1\2", 45, 45 if large else 20, 0x800, 0, 0, 33, crc, size, size, len(raw), len(extra), 0, 0, 0, 0, HIGH32 if large else at) + raw + extra)
        end, count = self.at, len(self.entries)
        if self.zip64 or count >= HIGH16 or end >= HIGH32:
            self._write(struct.pack("<4sQHHIIQQQQ", b"PK\6\6", 44, 45, 45, 0, 0, count, count, end - start, start) + struct.pack("<4sIQI", b"PK\6\7", 0, end, 1))
            count, size, start = HIGH16, HIGH32, HIGH32
        else:
            size = end - start
        self._write(struct.pack("<4sHHHHIIH", b"PK\5\6", 0, 0, count, count, size, start, 0))


class Ranges:
    """Byte ranges of one file."""

    def __init__(self, address: str) -> None:
        system, path = filesystem(address)
        self.file = system.open_input_file(path)
        self.size = self.file.size()

    def read(self, at: int, n: int) -> bytes:
        if at < 0 or at + n > self.size:
            raise ValueError("a range beyond the archive")
        self.file.seek(at)
        return self.file.read(n)

    def close(self) -> None:
        self.file.close()


def directory(source: Ranges) -> list[tuple[str, int, int, int]]:
    """(name, place of the local header, size, method) of each member, from the central directory."""
    tail_at = max(0, source.size - 22 - HIGH16)
    tail = source.read(tail_at, source.size - tail_at)
    found = tail.rfind(b"PK\5\6")
    if found < 0 or len(tail) - found < 22:
        raise ValueError("no end of a central directory")
    _, _, _, count, size, start, _ = struct.unpack_from("<HHHHIIH", tail, found + 4)
    if HIGH16 in (count,) or HIGH32 in (size, start):
        locator = source.read(tail_at + found - 20, 20)
        if locator[:4] != b"PK\6\7":
            raise ValueError("no ZIP64 locator")
        end = source.read(struct.unpack_from("<Q", locator, 8)[0], 56)
        if end[:4] != b"PK\6\6":
            raise ValueError("no ZIP64 end of a central directory")
        count, size, start = struct.unpack_from("<QQQ", end, 32)
    data, at, members = source.read(start, size), 0, []
    for _ in range(count):
        if data[at : at + 4] != b"PK\1\2":
            raise ValueError("a broken central directory")
        method, = struct.unpack_from("<H", data, at + 10)
        packed, plain, n_name, n_extra, n_comment = struct.unpack_from("<IIHHH", data, at + 20)
        place, = struct.unpack_from("<I", data, at + 42)
        name = data[at + 46 : at + 46 + n_name].decode("utf-8")
        extra = data[at + 46 + n_name : at + 46 + n_name + n_extra]
        while len(extra) >= 4:
            tag, n = struct.unpack_from("<HH", extra)
            if tag == 1:
                wide = iter(struct.unpack_from(f"<{n // 8}Q", extra, 4))
                plain = next(wide) if plain == HIGH32 else plain
                packed = next(wide) if packed == HIGH32 else packed
                place = next(wide) if place == HIGH32 else place
            extra = extra[4 + n :]
        members.append((name, place, packed, method))
        at += 46 + n_name + n_extra + n_comment
    return members


def data_place(source: Ranges, local: int) -> int:
    """Where a member's data begin, from its local header."""
    head = source.read(local, 30)
    if head[:4] != b"PK\3\4":
        raise ValueError("no local header")
    n_name, n_extra = struct.unpack_from("<HH", head, 26)
    return local + 30 + n_name + n_extra


def _writer(folder: str, roll: int, member: int, zip64: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = filesystem(folder)
        part, number, archive = TaskContext.get().partitionId(), 0, None
        done: list[tuple[str, int, int]] = []

        def flush() -> None:
            nonlocal warc, index, members
            if warc:
                name = f"archive/data-{members:05d}.warc.gz"
                archive.add(name, bytes(warc))
                lines = "".join(json.dumps({"file": name, "offset": o, "length": n}) + "\n" for o, n in index)
                archive.add(f"indexes/data-{members:05d}.cdxj", lines.encode())
                warc, index, members = bytearray(), [], members + 1

        def finish() -> None:
            nonlocal archive, number, records
            if archive is not None:
                flush()
                archive.close()
                archive.out.close()
                final = f"part-{part:06d}-{number:04d}.zip"
                system.move(temporary, f"{base}/{final}")
                done.append((f"{folder}/{final}", records, archive.at))
                archive, number, records = None, number + 1, 0

        warc, index, members, records, temporary = bytearray(), [], 0, 0, ""
        for batch in batches:
            for row in batch.to_pylist():
                if archive is None:
                    system.create_dir(base, recursive=True)
                    temporary, members = f"{base}/_writing-{uuid.uuid4().hex}", 0
                    archive = ZipWriter(system.open_output_stream(temporary), zip64)
                payload = (row["html"] or "").encode("utf-8", "surrogatepass")
                again = row["first"] is not None and row["id"] != row["first"]
                data = record("revisit" if again else "response", f"urn:page:{row['id']}", payload, base32_sha1(payload), row["url"], f"urn:page:{row['first']}")
                packed = gzip.compress(data, 6, mtime=0)
                index.append((len(warc), len(packed)))
                warc += packed
                records += 1
                if len(warc) >= member:
                    flush()
                if archive.at + len(warc) >= roll:
                    finish()
        finish()
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64()), pa.array([d[2] for d in done], pa.int64())], ["archive", "records", "bytes"])

    return run


def write_archives(pages: DataFrame, folder: str, min_revisit: int = MIN_REVISIT, roll: int = ROLL, member: int = MEMBER, zip64: bool = False) -> DataFrame:
    """(archive, records, bytes) of the archives written from (page_id, url, html)."""
    rows = pages.select(F.col("page_id").alias("id"), "url", "html", F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    rows = rows.select("id", "url", "html", F.octet_length("payload").alias("n"), F.sha2("payload", 256).alias("digest"))
    firsts = rows.where(F.col("n") >= min_revisit).groupBy("digest", "n").agg(F.min("id").alias("first"))
    rows = rows.join(firsts, ["digest", "n"], "left").select("id", "url", "html", "first")
    return written(rows.mapInArrow(_writer(folder, roll, member, zip64), "archive string, records long, bytes long"), "archives")


def _locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for address in (x.as_py() for x in batch.column(0)):
            source = Ranges(address)
            members = directory(source)
            if any(method for *_, method in members):
                raise ValueError("a member is not stored")
            places = {name: (data_place(source, local), n) for name, local, n, _ in members}
            for name, (at, n) in places.items():
                if name.startswith("indexes/"):
                    lines = [json.loads(x) for x in source.read(at, n).decode().splitlines()]
                    offsets = [places[x["file"]][0] + x["offset"] for x in lines]
                    yield pa.RecordBatch.from_arrays([pa.array([address] * len(lines), pa.string()), pa.array(offsets, pa.int64()), pa.array([x["length"] for x in lines], pa.int64())], ["archive", "offset", "length"])
            source.close()


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    source, opened = None, None
    types = (pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary())
    names = ("record", "record_type", "payload_digest", "refers_to", "url", "payload_bytes", "payload")
    for batch in batches:
        for low in range(0, batch.num_rows, 256):
            out = []
            for address, at, n in zip(*(batch.column(i).slice(low, 256).to_pylist() for i in range(3)), strict=True):
                if address != opened:
                    if source is not None:
                        source.close()
                    source, opened = Ranges(address), address
                fields, http, payload = parse_record(gzip.decompress(source.read(at, n)))
                kind, digest = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha1:")
                length = int(http["content-length"])
                if kind == "response" and (base32_sha1(payload) != digest or len(payload) != length):
                    raise ValueError("a payload differs from its digest or length")
                refers = fields.get("warc-refers-to", "").strip("<>").removeprefix("urn:page:")
                url = fields.get("warc-target-uri")
                out.append((fields["warc-record-id"].strip("<>").removeprefix("urn:page:"), kind, digest, refers or None, url, length, payload if kind == "response" else None))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], list(names))


def read_archives(archives: DataFrame, block: int = BLOCK) -> DataFrame:
    """(record, record_type, payload_digest, refers_to, url, payload_bytes, payload) of every record in the archives (archive, bytes); payload_bytes is that of the payload which a revisit leaves out."""
    spark = archives.sparkSession
    size = archives.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.count(F.lit(1))).first()
    most = PER_CORE * spark.sparkContext.defaultParallelism
    places = archives.select("archive").repartition(max(1, min(size[1], most)), "archive").mapInArrow(_locate, "archive string, offset long, length long")
    spread = places.repartition(max(1, min(-(-size[0] // block), most)), "archive", F.floor(F.col("offset") / block)).sortWithinPartitions("archive", "offset")
    return spread.mapInArrow(_read, "record string, record_type string, payload_digest string, refers_to string, url string, payload_bytes long, payload binary")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = write_archives(table(spark, sf_dir, "pages"), scratch(spark, "warc"))
    rows = read_archives(archives)
    return rows.select(F.when(F.col("record") != "None", F.col("record")).cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"))


#: Base32 of 20 bytes given as 40 hexadecimal digits: 32 groups of 5 of its 160 bits.
_BITS = "list_reduce(list_transform(range(1, 41), lambda i: right(bin(16 + (instr('0123456789abcdef', substr(h, i, 1)) - 1)), 4)), lambda a, b: a || b)"

SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
d AS (SELECT *, {_BITS} AS bits, CASE WHEN payload_bytes >= {MIN_REVISIT} THEN min(page_id) OVER (PARTITION BY html) END AS first FROM p),
r AS (SELECT *, page_id IS DISTINCT FROM first AND first IS NOT NULL AS again FROM d)
SELECT page_id, payload_bytes,
  list_reduce(list_transform(range(0, 32), lambda g: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + list_reduce(list_transform(range(1, 6), lambda k: substr(bits, g * 5 + k, 1)::INT), lambda a, b: a * 2 + b)::INT, 1)), lambda a, b: a || b) AS payload_digest,
  CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN again THEN first END AS refers_to
FROM r
"""

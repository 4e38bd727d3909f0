"""Binary influence matrices of compressed rows: one file, written and read by many tasks at their own places."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, IsNotNull, LessThan, LessThanOrEqual, WriterCommitMessage

from ..functions.lineage import cut

#: Fixed values of the format: four letters, the version, three counts; then row pointers, bixels and values of eight bytes each, little-endian.
MAGIC, VERSION = b"ODIJ", 2
HEAD = np.dtype([("magic", "S4"), ("version", "<u4"), ("voxels", "<u8"), ("bixels", "<u8"), ("entries", "<u8")])
WORD = 8
#: Row pointers or entries held by a task at once.
PIECE = 100_000


@dataclass
class Layout:
    """Where the parts of a file lie."""

    voxels: int
    bixels: int
    entries: int

    def pointer(self, i: int) -> int:
        return HEAD.itemsize + WORD * i

    def bixel(self, i: int) -> int:
        return self.pointer(self.voxels + 1) + WORD * i

    def value(self, i: int) -> int:
        return self.bixel(self.entries) + WORD * i


class _File:
    """Reads numbers at places of a file on any file system that Arrow knows."""

    def __init__(self, path: str) -> None:
        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
        self.file, self.size = system.open_input_file(path), system.get_file_info(path).size

    def read(self, at: int, count: int, kind: str) -> np.ndarray:
        self.file.seek(at)
        return np.frombuffer(self.file.read(WORD * count), kind)

    def layout(self) -> Layout:
        """``ValueError`` unless the file is whole and of this format and version."""
        self.file.seek(0)
        head = self.file.read(HEAD.itemsize)
        if len(head) < HEAD.itemsize or head[:4] != MAGIC:
            raise ValueError("not an influence matrix")
        head = np.frombuffer(head, HEAD)[0]
        if head["version"] != VERSION:
            raise ValueError(f"influence matrix of version {head['version']}, not {VERSION}")
        found = Layout(int(head["voxels"]), int(head["bixels"]), int(head["entries"]))
        if self.size != found.value(found.entries):
            raise ValueError("influence matrix is cut off")
        return found


class _Entries(InputPartition):
    def __init__(self, first: int, end: int) -> None:
        self.first, self.end = first, end


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.rows = options["path"], int(options.get("rows_per_partition", 1_000_000))
        self.low, self.high = 0, None
        self.at = _File(self.path).layout()

    def partitions(self) -> list[InputPartition]:
        """Equal numbers of entries, whatever a voxel has; the ends of a voxel range are two row pointers."""
        low = max(self.low, 0)
        high = self.at.voxels if self.high is None else min(self.high + 1, self.at.voxels)
        if low >= high:
            return []
        file = _File(self.path)
        first, end = (int(file.read(self.at.pointer(i), 1, "<u8")[0]) for i in (low, high))
        return [_Entries(i, min(i + self.rows, end)) for i in range(first, end, self.rows)]

    def _voxel(self, file: _File, entry: int) -> int:
        """The voxel that holds an entry: the last one whose pointer does not exceed it, by halving."""
        low, high = 0, self.at.voxels
        while high - low > 1:
            middle = (low + high) // 2
            low, high = (middle, high) if int(file.read(self.at.pointer(middle), 1, "<u8")[0]) <= entry else (low, middle)
        return low

    def read(self, partition: _Entries | None) -> Iterator[pa.RecordBatch]:
        """IO-29: one range of entries with the row pointers around it. Spark asks for None where there are no partitions."""
        if partition is None:
            return
        file = _File(self.path)
        entry, voxel = partition.first, self._voxel(file, partition.first)
        while entry < partition.end:
            pointers = file.read(self.at.pointer(voxel), min(PIECE, self.at.voxels - voxel) + 1, "<u8").astype(np.int64)
            end = min(int(pointers[-1]), partition.end)
            for i in range(entry, end, PIECE):
                n = min(PIECE, end - i)
                voxels = voxel + np.searchsorted(pointers, np.arange(i, i + n), "right") - 1
                bixels, values = file.read(self.at.bixel(i), n, "<u8").astype(np.int64), file.read(self.at.value(i), n, "<f8")
                yield pa.RecordBatch.from_arrays([pa.array(voxels), pa.array(bixels), pa.array(values)], ["voxel", "bixel", "value"])
            entry, voxel = end, voxel + len(pointers) - 1


class _FilteredReader(_Reader):
    """Takes over what a filter says of the voxel; Spark applies the others."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            if getattr(f, "attribute", ()) != ("voxel",) or not isinstance(f, IsNotNull | EqualTo | GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual):
                yield f
                continue
            if isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual):
                self.low = max(self.low, f.value + isinstance(f, GreaterThan))
            if isinstance(f, EqualTo | LessThan | LessThanOrEqual):
                high = f.value - isinstance(f, LessThan)
                self.high = high if self.high is None else min(self.high, high)


@dataclass
class _Written(WriterCommitMessage):
    entries: int


class _Writer(DataSourceArrowWriter):
    """Tasks write to a file of full length beside the target, which takes the target's name when all are done. A repeated task writes the same bytes to the same places."""

    def __init__(self, options: dict) -> None:
        self.path = options["path"].removeprefix("file://")
        self.layout = Layout(*(int(options[n]) for n in ("voxels", "bixels", "entries")))
        self.parts = {p: (first, voxel) for p, first, voxel in json.loads(options["parts"])}
        self.partial = self.path + ".partial"
        os.makedirs(os.path.dirname(self.path) or ".", exist_ok=True)
        head = np.array([(MAGIC, VERSION, self.layout.voxels, self.layout.bixels, self.layout.entries)], HEAD)
        with open(self.partial, "wb") as f:
            f.write(head.tobytes())
            f.truncate(self.layout.value(self.layout.entries))
            self._pointers(f, int(options["last_voxel"]) + 1, self.layout.voxels + 1, np.array([], np.int64), self.layout.entries)

    def _pointers(self, f, first: int, end: int, voxels: np.ndarray, before: int) -> None:
        """Row pointers ``first`` to ``end``: the entries before, and those of ``voxels``, sorted, that are lower."""
        for i in range(first, end, PIECE):
            at = np.arange(i, min(i + PIECE, end))
            f.seek(self.layout.pointer(i))
            f.write((before + np.searchsorted(voxels, at, "left")).astype("<u8").tobytes())

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        n, place = 0, None
        with open(self.partial, "r+b") as f:
            for batch in iterator:
                if not batch.num_rows:
                    continue
                voxels, bixels, values, part = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("voxel", "bixel", "value", "part"))
                if place is None:
                    place, following = self.parts[int(part[0])]
                self._pointers(f, following, int(voxels[-1]) + 1, voxels, place)
                following = int(voxels[-1]) + 1
                for at, column, kind in ((self.layout.bixel, bixels, "<u8"), (self.layout.value, values, "<f8")):
                    f.seek(at(place))
                    f.write(column.astype(kind).tobytes())
                place, n = place + len(voxels), n + len(voxels)
            f.flush()
            os.fsync(f.fileno())
        return _Written(n)

    def commit(self, messages: list[WriterCommitMessage]) -> None:
        found = sum(m.entries for m in messages if m)
        if found != self.layout.entries:
            raise ValueError(f"{found} entries written, {self.layout.entries} expected")
        os.replace(self.partial, self.path)

    def abort(self, messages: list[WriterCommitMessage]) -> None:
        if os.path.exists(self.partial):
            os.remove(self.partial)


class InfluenceFile(DataSource):
    """IO-28, IO-29: ``save_binary`` and ``load_binary``. Options when reading: ``rows_per_partition``; ``push``, to take filters on the voxel."""

    @classmethod
    def name(cls) -> str:
        return "influence_file"

    def schema(self) -> str:
        return "voxel long, bixel long, value double"

    def reader(self, schema) -> DataSourceReader:
        return (_FilteredReader if self.options.get("push", "").lower() == "true" else _Reader)(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options)


def save_binary(dij: DataFrame, path: str, voxels: int, bixels: int, parts: int = 64) -> None:
    """IO-28: entries with voxel and bixel below the given numbers to one file, in order of both. Every (voxel, bixel) must occur once.

    ``path`` lies in a folder that all machines mount: tasks write at their own places, which object stores do not allow.
    An empty matrix has pointers only. Entries outside are an error, as are null voxels and bixels; null values are zero.
    """
    if "://" in path and not path.startswith("file://"):
        raise ValueError("a binary matrix is written to a mounted folder")
    spark = dij.sparkSession
    rows = dij.select(F.col("voxel").cast("long"), F.col("bixel").cast("long"), F.coalesce(F.col("value").cast("double"), F.lit(0.0)).alias("value"))
    rows = cut(rows.repartitionByRange(parts, "voxel").sortWithinPartitions("voxel", "bixel").withColumn("part", F.spark_partition_id()))
    outside = F.coalesce((F.col("voxel") >= 0) & (F.col("voxel") < voxels) & (F.col("bixel") >= 0) & (F.col("bixel") < bixels), F.lit(False))
    ends = rows.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.max("voxel").alias("last"), F.count_if(~outside).alias("outside")).orderBy("part").collect()  # a row per part
    if any(e.outside for e in ends):
        raise ValueError("entries outside the matrix")
    places, entries, following = [], 0, 0
    for e in ends:
        places.append((e.part, entries, following))
        entries, following = entries + e.n, e.last + 1
    spark.dataSource.register(InfluenceFile)
    options = {"voxels": voxels, "bixels": bixels, "entries": entries, "parts": json.dumps(places), "last_voxel": following - 1}
    rows.write.format("influence_file").options(**options).mode("append").save(path)


def load_binary(spark: SparkSession, path: str, rows_per_partition: int = 1_000_000) -> DataFrame:
    """IO-29: the entries of a file; another format or version, or a file cut off, is an error. Where spark.sql.python.filterPushdown.enabled is set, a range of voxels reads its own bytes only."""
    spark.dataSource.register(InfluenceFile)
    push = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    return spark.read.format("influence_file").options(push=push, rows_per_partition=rows_per_partition).load(path)


def shape(path: str) -> tuple[int, int, int]:
    """Voxels, bixels and entries by the file's head."""
    at = _File(path).layout()
    return at.voxels, at.bixels, at.entries

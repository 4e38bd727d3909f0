"""DICOM files as tables: headers, image slices, dose grids and structure sets.

Files are read by Spark's binary source on any file system it reaches, a row per file, and parsed
in Arrow tasks: a slice or a dose grid is one row's work, and only its samples become rows. The
parser knows little-endian data with explicit and implicit value representations, nested
and undefined lengths; compressed pixel data count as unreadable.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import electron_density, priority, type_from_name
from ..operators import catalog as ca
from ..operators.grids import Grid
from ..operators.morphology import filled_body, rasterized

#: Service classes.
CT, STRUCTURES, PLAN, DOSE = "1.2.840.10008.5.1.4.1.1.2", "1.2.840.10008.5.1.4.1.1.481.3", "1.2.840.10008.5.1.4.1.1.481.5", "1.2.840.10008.5.1.4.1.1.481.2"
IMPLICIT = "1.2.840.10008.1.2"
LITTLE = (IMPLICIT, "1.2.840.10008.1.2.1")
SYNTAX, SOP_CLASS, PIXELS = 0x00020010, 0x00080016, 0x7FE00010
#: Sequences met here, for files that do not say what an element is.
SEQUENCES = {0x30060020, 0x30060039, 0x30060040, 0x30060080, 0x30060016, 0x30060010}
LONG = {b"OB", b"OD", b"OF", b"OL", b"OV", b"OW", b"SQ", b"SV", b"UC", b"UN", b"UR", b"UT", b"UV"}
ITEM, ITEM_END, SEQUENCE_END, OPEN = 0xFFFEE000, 0xFFFEE00D, 0xFFFEE0DD, 0xFFFFFFFF
SKIPPED = r"(?i)(/|^)(\.[^/]*|DICOMDIR|[^/]*\.(txt|log|xml|json))$"

Dataset = dict[int, "bytes | list[Dataset]"]


class Parser:
    """Elements of one data set, by tag."""

    def __init__(self, data: bytes, implicit: bool, locate: bool = False) -> None:
        self.data, self.implicit, self.locate = data, implicit, locate
        self.pixels: tuple[int, int] | None = None

    def _tag(self, at: int) -> int:
        group, element = struct.unpack_from("<HH", self.data, at)
        return group << 16 | element

    def read(self, at: int, end: int, nested: bool = False) -> tuple[Dataset, int]:
        """Elements from ``at`` to ``end``, or to the end of an item of open length."""
        found: Dataset = {}
        while at + 8 <= end:
            tag = self._tag(at)
            if tag == ITEM_END:
                return found, at + 8
            kind = b""
            if self.implicit:
                n, at = struct.unpack_from("<I", self.data, at + 4)[0], at + 8
            else:
                kind = self.data[at + 4 : at + 6]
                if kind in LONG:
                    n, at = struct.unpack_from("<I", self.data, at + 8)[0], at + 12
                else:
                    n, at = struct.unpack_from("<H", self.data, at + 6)[0], at + 8
            if tag == PIXELS and n == OPEN:
                self.pixels = self.pixels if nested else (0, 0)
                return found, end
            if kind == b"SQ" or tag in SEQUENCES or n == OPEN:
                found[tag], at = self._items(at, n, end)
            else:
                if tag == PIXELS and self.locate and not nested:
                    self.pixels = (at, n)
                    return found, at
                if at + n > end:
                    raise ValueError("an element beyond the end")
                found[tag] = self.data[at : at + n]
                at += n
        return found, at

    def _items(self, at: int, n: int, end: int) -> tuple[list[Dataset], int]:
        stop, items = end if n == OPEN else min(end, at + n), []
        while at + 8 <= stop:
            tag, length = self._tag(at), struct.unpack_from("<I", self.data, at + 4)[0]
            at += 8
            if tag == SEQUENCE_END:
                break
            if tag != ITEM:
                raise ValueError("not an item")
            item, at = self.read(at, stop if length == OPEN else at + length, True)
            items.append(item)
        return items, at


def parse(data: bytes) -> Dataset:
    """The data set of a file; ``ValueError`` if it is none."""
    if data[128:132] != b"DICM":
        raise ValueError("not a DICOM file")
    try:
        length = struct.unpack_from("<I", data, 140)[0]  # group length comes first
        meta, _ = Parser(data, False).read(132, 144 + length)
        syntax = text(meta, SYNTAX)
        if syntax not in LITTLE:
            found, _ = Parser(data, False).read(144 + length, len(data))
            found.pop(PIXELS, None)
            return found
        return Parser(data, syntax == IMPLICIT).read(144 + length, len(data))[0]
    except struct.error as e:
        raise ValueError("the file ends early") from e


def located(data: bytes) -> tuple[Dataset, tuple[int, int] | None]:
    """The data set before its pixel data, and their offset and length: none where they were not met, as in a file's first bytes, and 0 where they are compressed."""
    if data[128:132] != b"DICM":
        raise ValueError("not a DICOM file")
    try:
        length = struct.unpack_from("<I", data, 140)[0]
        syntax = text(Parser(data, False).read(132, 144 + length)[0], SYNTAX)
        parser = Parser(data, syntax == IMPLICIT, locate=True)
        found, _ = parser.read(144 + length, len(data))
    except struct.error as e:
        raise ValueError("the file ends early") from e
    return found, (0, 0) if parser.pixels and syntax not in LITTLE else parser.pixels


def text(ds: Dataset, tag: int, default: str = "") -> str:
    value = ds.get(tag)
    return value.decode("latin-1").strip(" \0") if isinstance(value, bytes) else default


def numbers(ds: Dataset, tag: int) -> list[float]:
    """A decimal string's values; words that are no numbers count as none."""
    out = []
    for w in text(ds, tag).split("\\"):
        try:
            out.append(float(w))
        except ValueError:
            out.append(float("nan"))
    return out if text(ds, tag) else []


def number(ds: Dataset, tag: int, at: int = 0, default: float = 0.0) -> float:
    found = numbers(ds, tag)
    return found[at] if at < len(found) and found[at] == found[at] else default


def short(ds: Dataset, tag: int, default: int = 0) -> int:
    value = ds.get(tag)
    return struct.unpack_from("<H", value)[0] if isinstance(value, bytes) and len(value) >= 2 else default


# Files


def files(spark: SparkSession, folder: str) -> DataFrame:
    """IO-02: (path, content) of all files below a folder that may be DICOM."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return found.where(~F.col("path").rlike(SKIPPED)).select("path", "content")


HEADER = "path string, sop_class string, series string, patient_id string, patient_name string, x double, y double, z double, rows int, cols int, spacing_y double, spacing_x double, position string, orientation array<double>, thickness double"


def _headers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in HEADER.split(", ")]
    for batch in batches:
        out = []
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            try:
                ds = parse(content.as_py())
            except ValueError:
                continue
            orientation = numbers(ds, 0x00200037) or [1.0, 0.0, 0.0, 0.0, 1.0, 0.0]
            place = [number(ds, 0x00200032, i) for i in range(3)]
            out.append((path, text(ds, SOP_CLASS), text(ds, 0x0020000E), text(ds, 0x00100020), text(ds, 0x00100010), *place, short(ds, 0x00280010), short(ds, 0x00280011), number(ds, 0x00280030, 0, 1.0), number(ds, 0x00280030, 1, 1.0), text(ds, 0x00185100) or "HFS", orientation, number(ds, 0x00180050)))
        types = [pa.string()] * 5 + [pa.float64()] * 3 + [pa.int32()] * 2 + [pa.float64()] * 2 + [pa.string(), pa.list_(pa.float64()), pa.float64()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names)


def headers(found: DataFrame) -> DataFrame:
    """IO-02, IO-03: a row per readable file, with its class and place; unreadable files drop out."""
    return found.mapInArrow(_headers, HEADER).where("sop_class <> ''")


def last_of(heads: DataFrame) -> DataFrame:
    """IO-02: (sop_class, path) of the structure set, plan and dose that count: of several the last by path."""
    return heads.where(F.col("sop_class").isin(STRUCTURES, PLAN, DOSE)).groupBy("sop_class").agg(F.max("path").alias("path"))


def ct_slices(heads: DataFrame) -> DataFrame:
    """IO-04: CT headers with their slice number k, by (z, path). A series has some hundred slices."""
    return heads.where(F.col("sop_class") == CT).withColumn("k", F.row_number().over(Window.partitionBy("patient_id").orderBy("z", "path")) - 1)


def patient(slices: DataFrame) -> DataFrame:
    """IO-07: (patient_id, patient_name) from the first slice."""
    return slices.where("k = 0").select("patient_id", "patient_name")


def ct_grid(slices: DataFrame) -> Grid:
    """IO-05: the grid of one patient's slices: everything of slice 0, the spacing of slices between the first two."""
    first = slices.where("k < 2").orderBy("k").collect()  # two headers
    if not first:
        raise ValueError("no CT slices")
    a = first[0]
    dz = abs(first[1].z - a.z) if len(first) > 1 else 1.0
    return Grid((a.rows, a.cols, slices.count()), (a.spacing_y, a.spacing_x, dz), (a.y, a.x, a.z))


def ct_voxels(found: DataFrame, slices: DataFrame, grid: Grid) -> DataFrame:
    """IO-05: (k, i, j, hu) of all slices. Values are slope times sample plus intercept, held to 16 bits and cut off; a slice without readable samples is 0, and so is what it lacks."""
    rows, cols = grid.dims[:2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        i, j = np.repeat(np.arange(rows, dtype=np.int32), cols), np.tile(np.arange(cols, dtype=np.int32), rows)
        for batch in batches:
            for k, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                hu = np.zeros(rows * cols, np.int16)
                try:
                    ds = parse(content.as_py())
                    raw = ds.get(PIXELS, b"")
                    samples = np.frombuffer(raw, "<i2" if short(ds, 0x00280103) else "<u2", min(len(raw) // 2, rows * cols))
                    hu[: len(samples)] = np.clip(samples * number(ds, 0x00281053, 0, 1.0) + number(ds, 0x00281052), -32768, 32767).astype(np.int16)
                except ValueError:
                    pass
                yield pa.RecordBatch.from_arrays([pa.array(np.full(rows * cols, k, np.int64)), pa.array(i), pa.array(j), pa.array(hu.astype(np.int32))], ["k", "i", "j", "hu"])

    return found.join(slices.select("path", F.col("k").cast("long").alias("k")), "path").select("k", "content").mapInArrow(run, "k long, i int, j int, hu int")


def dose_grid(content: bytes) -> tuple[Grid, bool]:
    """IO-06: the grid of a dose file, and whether its frames descend; the origin is then that of the last frame."""
    ds = parse(content)
    frames = max(1, int(number(ds, 0x00280008, 0, 1.0)))
    offsets = numbers(ds, 0x3004000C)
    step = offsets[1] - offsets[0] if frames > 1 and len(offsets) > 1 else 0.0
    dz, down = (abs(step), step < 0) if abs(step) > 0.001 else (1.0, False)
    x, y, z = (number(ds, 0x00200032, i) for i in range(3))
    return Grid((short(ds, 0x00280010), short(ds, 0x00280011), frames), (number(ds, 0x00280030, 0, 1.0), number(ds, 0x00280030, 1, 1.0), dz), (y, x, z - (frames - 1) * dz if down else z)), down


def dose_voxels(found: DataFrame) -> DataFrame:
    """IO-06: (path, i, j, k, dose) of dose files, a frame at a time: samples of 16 or 32 bits times the grid's scaling, descending frames turned."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = content.as_py()
                ds, (grid, down) = parse(data), dose_grid(data)
                rows, cols, frames = grid.dims
                size = rows * cols
                kind = "<u4" if short(ds, 0x00280100, 32) == 32 else "<u2"
                samples = np.frombuffer(ds.get(PIXELS, b""), kind, size * frames)
                i, j = np.repeat(np.arange(rows, dtype=np.int32), cols), np.tile(np.arange(cols, dtype=np.int32), rows)
                for f in range(frames):
                    k = frames - 1 - f if down else f
                    dose = samples[f * size : (f + 1) * size] * number(ds, 0x3004000E, 0, 1.0)
                    yield pa.RecordBatch.from_arrays([pa.array([path] * size), pa.array(i), pa.array(j), pa.array(np.full(size, k, np.int32)), pa.array(dose)], ["path", "i", "j", "k", "dose"])

    return found.select("path", "content").mapInArrow(run, "path string, i int, j int, k int, dose double")


CONTOURS = "path string, ordinal int, roi int, red int, green int, blue int, contour_id int, values array<double>"
NAMES = "path string, roi int, name string, ordinal int"


def _contours(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for path, content in zip(pdf["path"], pdf["content"], strict=True):
            for n, item in enumerate(parse(content).get(0x30060039, [])):
                colour = numbers(item, 0x3006002A)
                rgb = [int(c) for c in colour] if len(colour) == 3 and all(c == c for c in colour) else [None] * 3
                roi = int(number(item, 0x30060084))
                out.append((path, n, roi, *rgb, -1, []))  # the structure itself, whether or not it has contours
                out += [(path, n, roi, *rgb, c, numbers(contour, 0x30060050)) for c, contour in enumerate(item.get(0x30060040, []))]
        yield pd.DataFrame(out, columns=[c.split()[0] for c in CONTOURS.split(", ")]).astype({c: "Int32" for c in ("red", "green", "blue")})


def _names(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = [(path, int(number(item, 0x30060022)), text(item, 0x30060026), n) for path, content in zip(pdf["path"], pdf["content"], strict=True) for n, item in enumerate(parse(content).get(0x30060020, []))]
        yield pd.DataFrame(out, columns=["path", "roi", "name", "ordinal"])


def structure_set(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """IO-10 to IO-14: (structures, contours): (ordinal, roi, name, kind, priority, red, green, blue), and (ordinal, contour_id, z, points) of the contours with whole points."""
    items = found.mapInPandas(_contours, CONTOURS)
    names = ca.roi_names(found.mapInPandas(_names, NAMES))
    kinds = ca.named(items.where("contour_id = -1"), names).withColumn("kind", type_from_name(F.col("name")))
    structures = ca.coloured(kinds.select("ordinal", "roi", "name", "kind", priority(F.col("kind")).alias("priority"), "red", "green", "blue"))
    return structures, ca.contour_points(items.where("contour_id >= 0")).select("ordinal", "contour_id", "z", "points")


def structure_voxels(contours: DataFrame, grid: Grid) -> DataFrame:
    """(ordinal, i, j, k): contours put on the slice nearest to them and rasterized."""
    k = F.round(grid.index(2, F.col("z"))).cast("int")
    placed = contours.select(F.col("ordinal").alias("struct_id"), "contour_id", k.alias("k"), "points").where(F.col("k").between(0, grid.dims[2] - 1))
    found = rasterized(placed, grid.origin[1], grid.spacing[1], grid.dims[1], grid.origin[0], grid.spacing[0], grid.dims[0])
    return found.select(F.col("struct_id").alias("ordinal"), "i", "j", F.col("k").cast("long").alias("k"))


def imported(spark: SparkSession, folder: str) -> dict[str, DataFrame | Grid | None]:
    """IO-08: one patient's folder as tables: patient, ct (with density), structures, voxels, dose, and their grids.

    A body is made from the CT where no structure is of the external kind.
    """
    found = files(spark, folder)
    heads = headers(found).persist()
    slices = ct_slices(heads)
    grid = ct_grid(slices)
    ct = ct_voxels(found, slices, grid).withColumn("rho", electron_density(F.col("hu")))
    of = lambda kind: found.join(last_of(heads).where(F.col("sop_class") == kind).select("path"), "path", "left_semi")
    structures, contours = structure_set(of(STRUCTURES))
    voxels = structure_voxels(contours, grid)
    if not structures.where("kind = 'EXTERNAL'").limit(1).count():
        body = filled_body(ct.where("hu > -300").select("k", "i", "j"), grid.dims[0], grid.dims[1])
        number_ = structures.agg((F.coalesce(F.max("ordinal"), F.lit(-1)) + 1).cast("int").alias("ordinal"))
        voxels = voxels.unionByName(body.crossJoin(F.broadcast(number_)).select("ordinal", "i", "j", "k"))
        row = number_.select("ordinal", F.lit(-1).alias("roi"), F.lit("BODY").alias("name"), F.lit("EXTERNAL").alias("kind"), F.lit(5).alias("priority"), F.lit(139).alias("red"), F.lit(90).alias("green"), F.lit(43).alias("blue"))
        structures = structures.unionByName(row)
    doses = of(DOSE)
    first = doses.select("content").first()  # one file at most
    return {"patient": patient(slices), "grid": grid, "ct": ct, "structures": structures, "voxels": voxels, "dose": dose_voxels(doses).drop("path") if first else None, "dose_grid": dose_grid(first.content)[0] if first else None}

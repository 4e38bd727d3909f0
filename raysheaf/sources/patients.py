"""DICOM folders of many patients as tables in one plan: grids are columns, pixels are read by slice and frame.

Headers are parsed from a file's first bytes, which say where its pixel data lie. A slice of an
image and a frame of a dose is a row with its place in the file, and a task reads only the bytes
of its rows: a dose of many frames is many rows' work. Nothing about a patient is on the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import electron_density, priority, type_from_name
from ..functions.lineage import cut
from ..operators import catalog as ca
from ..operators.morphology import body_mask, rasterized
from . import dicom as dc

FIRST = 1 << 16
PLACES = "path string, sop_class string, patient_id string, patient_name string, x double, y double, z double, rows int, cols int, spacing_y double, spacing_x double, bits int, signed boolean, slope double, intercept double, scaling double, frames int, step double, offset long, size long"
TYPES = {"string": pa.string(), "double": pa.float64(), "int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_()}


def opened(path: str):
    """A file of Spark's listing, for reading at any place."""
    from pyarrow import fs

    system, name = (fs.LocalFileSystem(), "/" + path[5:].lstrip("/")) if path.startswith("file:") else fs.FileSystem.from_uri(path)
    return system.open_input_file(name)


def read_at(path: str, offset: int, size: int) -> bytes:
    with opened(path) as f:
        return f.read_at(size, offset)


def _header(path: str) -> tuple[dc.Dataset, tuple[int, int]]:
    """The data set before the pixel data and their place, from as many first bytes as it takes."""
    with opened(path) as f:
        total, n = f.size(), FIRST
        while True:
            data = f.read_at(min(n, total), 0)
            try:
                ds, place = dc.located(data)
                if place or n >= total:
                    return ds, place or (0, 0)
            except ValueError:
                if n >= total or data[128:132] != b"DICM":
                    raise
            n *= 8


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [c.split() for c in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], TYPES[t]) for i, (_, t) in enumerate(fields)], [n for n, _ in fields])


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for path in batch.column(0).to_pylist():
            try:
                ds, (offset, size) = _header(path)
            except ValueError:
                continue
            place = [dc.number(ds, 0x00200032, i) for i in range(3)]
            frames, heights = max(1, int(dc.number(ds, 0x00280008, 0, 1.0))), dc.numbers(ds, 0x3004000C)
            step = heights[1] - heights[0] if frames > 1 and len(heights) > 1 else 0.0
            shape = (dc.short(ds, 0x00280010), dc.short(ds, 0x00280011), dc.number(ds, 0x00280030, 0, 1.0), dc.number(ds, 0x00280030, 1, 1.0))
            scale = (dc.number(ds, 0x00281053, 0, 1.0), dc.number(ds, 0x00281052), dc.number(ds, 0x3004000E, 0, 1.0))
            out.append((path, dc.text(ds, dc.SOP_CLASS), dc.text(ds, 0x00100020), dc.text(ds, 0x00100010), *place, *shape, dc.short(ds, 0x00280100, 32), bool(dc.short(ds, 0x00280103)), *scale, frames, step, offset, size))
        yield _batch(out, PLACES)


def places(spark: SparkSession, folder: str) -> DataFrame:
    """IO-02, IO-03: a row per readable file below a folder, with its class, patient, grid and the place of its pixel data (size 0: none that can be read). Contents are left out of the listing, so files are opened for their headers only."""
    return dc.files(spark, folder).select("path").mapInArrow(_places, PLACES).where("sop_class <> ''")


def last_of(heads: DataFrame, kind: str) -> DataFrame:
    """IO-02: each patient's file of a class, of several the last by path."""
    return heads.where(F.col("sop_class") == kind).groupBy("patient_id").agg(F.max_by(F.struct(*[c for c in heads.columns if c != "patient_id"]), "path").alias("f")).select("patient_id", "f.*")


def ct_slices(heads: DataFrame) -> DataFrame:
    """IO-04: images with their number k within the patient, by (z, path); a patient has some hundred."""
    order = Window.partitionBy("patient_id").orderBy("z", "path")
    return heads.where(F.col("sop_class") == dc.CT).withColumn("k", F.row_number().over(order).cast("long") - 1)


def patients(slices: DataFrame) -> DataFrame:
    """IO-05, IO-07: a row per patient: name and grid (ni, nj, nk, si, sj, sk, oi, oj, ok) of slice 0, sk the distance between the first two, or 1."""
    at = lambda k, c: F.max(F.when(F.col("k") == k, F.col(c)))
    first = {"patient_name": "patient_name", "ni": "rows", "nj": "cols", "si": "spacing_y", "sj": "spacing_x", "oi": "y", "oj": "x", "ok": "z"}
    found = slices.groupBy("patient_id").agg(*[at(0, c).alias(n) for n, c in first.items()], F.count("*").alias("nk"), at(1, "z").alias("next"))
    sk = F.coalesce(F.abs(F.col("next") - F.col("ok")), F.lit(1.0))
    return found.select("patient_id", "patient_name", "ni", "nj", "nk", "si", "sj", sk.alias("sk"), "oi", "oj", "ok")


def dealt(rows: DataFrame, part_bytes: int) -> DataFrame:
    """Rows with a size, over tasks of about ``part_bytes`` each whatever files they lie in. The sum is a job of its own."""
    total = rows.agg(F.sum("size")).first()[0] or 0
    return rows.repartition(max(1, -(-total // part_bytes)), "path", "offset")


def _planes(slices: DataFrame, grids: DataFrame, part_bytes: int) -> DataFrame:
    shape = grids.select("patient_id", "ni", "nj")
    columns = ["patient_id", "k", "path", "offset", "signed", "slope", "intercept", "ni", "nj", "size"]
    return dealt(slices.join(shape, "patient_id").select(*columns), part_bytes)


def _units(row: dict) -> np.ndarray:
    """One slice's values; samples that are not there are 0."""
    n = row["ni"] * row["nj"]
    hu = np.zeros(n, np.int16)
    size = min(row["size"], 2 * n) // 2 * 2
    raw = read_at(row["path"], row["offset"], size) if size else b""
    samples = np.frombuffer(raw, "<i2" if row["signed"] else "<u2", len(raw) // 2)
    hu[: len(samples)] = np.clip(samples * row["slope"] + row["intercept"], -32768, 32767).astype(np.int16)
    return hu.reshape(row["ni"], row["nj"])


def _cells(row: dict, i: np.ndarray, j: np.ndarray, **values: np.ndarray) -> pa.RecordBatch:
    lead = [pa.array([row["patient_id"]] * len(i), pa.string()), pa.array(np.full(len(i), row["k"], np.int64))]
    return pa.RecordBatch.from_arrays([*lead, pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), *map(pa.array, values.values())], ["patient_id", "k", "i", "j", *values])


def ct_voxels(slices: DataFrame, grids: DataFrame, part_bytes: int = 64 << 20) -> DataFrame:
    """IO-05: (patient_id, k, i, j, hu): slope times sample plus intercept, held to 16 bits and cut off; what a slice lacks is 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                hu = _units(row)
                i, j = np.indices(hu.shape)
                yield _cells(row, i.ravel(), j.ravel(), hu=hu.ravel().astype(np.int32))

    return _planes(slices, grids, part_bytes).mapInArrow(run, "patient_id string, k long, i int, j int, hu int")


def bodies(slices: DataFrame, grids: DataFrame, part_bytes: int = 64 << 20) -> DataFrame:
    """AK-17 to AK-20: (patient_id, k, i, j) of the body, made where a slice is read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield _cells(row, *np.nonzero(body_mask(_units(row) > -300)))

    return _planes(slices, grids, part_bytes).mapInArrow(run, "patient_id string, k long, i int, j int")


def dose_grids(doses: DataFrame) -> DataFrame:
    """IO-06: grid columns of dose files, and whether frames descend (``down``); the origin is then the last frame's."""
    step = F.abs("step")
    spaced, sk = step > 0.001, F.when(step > 0.001, step).otherwise(1.0)
    down = spaced & (F.col("step") < 0)
    ok = F.when(down, F.col("z") - (F.col("frames") - 1) * sk).otherwise(F.col("z"))
    return doses.select("patient_id", "path", F.col("rows").alias("ni"), F.col("cols").alias("nj"), F.col("frames").alias("nk"), F.col("spacing_y").alias("si"), F.col("spacing_x").alias("sj"), sk.alias("sk"), F.col("y").alias("oi"), F.col("x").alias("oj"), ok.alias("ok"), down.alias("down"))


def dose_frames(doses: DataFrame) -> DataFrame:
    """IO-06: a row per frame with its slice k and the place of its samples; filters on k choose what is read. Frames beyond the pixel data are left out."""
    width = F.when(F.col("bits") == 32, 4).otherwise(2)
    down = dose_grids(doses).select("path", "down")
    rows = doses.withColumn("bytes", F.col("rows").cast("long") * F.col("cols") * width).join(down, "path")
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("frames") - 1)).alias("f"))
    rows = rows.where((F.col("bytes") > 0) & ((F.col("f") + 1) * F.col("bytes") <= F.col("size")))
    k = F.when(F.col("down"), F.col("frames") - 1 - F.col("f")).otherwise(F.col("f")).cast("long")
    return rows.select("patient_id", k.alias("k"), "path", (F.col("offset") + F.col("f") * F.col("bytes")).alias("offset"), F.col("bytes").alias("size"), "rows", "cols", "bits", "scaling")


def _doses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            samples = np.frombuffer(read_at(row["path"], row["offset"], row["size"]), "<u4" if row["bits"] == 32 else "<u2")
            i, j = np.indices((row["rows"], row["cols"]))
            yield _cells(row, i.ravel(), j.ravel(), dose=samples * row["scaling"])


def dose_voxels(frames: DataFrame, part_bytes: int = 64 << 20) -> DataFrame:
    """IO-06: (patient_id, k, i, j, dose), samples of 16 or 32 bits times the grid's scaling; the frames of a file go to several tasks."""
    return dealt(frames, part_bytes).mapInArrow(_doses, "patient_id string, k long, i int, j int, dose double")


def structure_sets(found: DataFrame, sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """IO-10 to IO-14: (structures, contours) of all patients, from the files named in ``sets``."""
    owner = sets.select("path", "patient_id")
    content = found.join(owner.select("path"), "path", "left_semi")
    items = content.mapInPandas(dc._contours, dc.CONTOURS).join(owner, "path")
    names = ca.roi_names(content.mapInPandas(dc._names, dc.NAMES), "path")
    kinds = ca.named(items.where("contour_id = -1"), names, "path").withColumn("kind", type_from_name(F.col("name")))
    structures = ca.coloured(kinds.select("patient_id", "ordinal", "roi", "name", "kind", priority(F.col("kind")).alias("priority"), "red", "green", "blue"))
    return structures, ca.contour_points(items.where("contour_id >= 0")).select("patient_id", "ordinal", "contour_id", "z", "points")


def structure_voxels(contours: DataFrame, grids: DataFrame) -> DataFrame:
    """(patient_id, ordinal, i, j, k): contours put on the nearest slice of their patient's grid and rasterized there."""
    k = F.round((F.col("z") - F.col("ok")) / F.col("sk")).cast("long")
    placed = contours.join(grids, "patient_id").withColumn("k", k).where("k between 0 and nk - 1").withColumn("struct_id", F.struct("patient_id", "ordinal"))
    found = rasterized(placed, F.col("oj"), F.col("sj"), F.col("nj"), F.col("oi"), F.col("si"), F.col("ni"))
    return found.select("struct_id.patient_id", "struct_id.ordinal", "i", "j", "k")


def imported(spark: SparkSession, folder: str, part_bytes: int = 64 << 20) -> dict[str, DataFrame]:
    """IO-08: all patients below a folder: patients (with grids), ct (with density), structures, voxels, dose, dose_grids.

    Patients are told apart by their number; files without one are one patient's. A patient
    without structures of the external kind gets a body from the CT. A patient without CT has no grid and
    no structure voxels. Headers are kept in the shared folder.
    """
    heads = cut(places(spark, folder))
    slices = ct_slices(heads)
    grids = cut(patients(slices))
    structures, contours = structure_sets(dc.files(spark, folder), last_of(heads, dc.STRUCTURES))
    structures = cut(structures)
    bare = grids.join(structures.where("kind = 'EXTERNAL'").select("patient_id"), "patient_id", "left_anti").select("patient_id")
    made = bare.join(structures.groupBy("patient_id").agg(F.max("ordinal").alias("last")), "patient_id", "left").select("patient_id", (F.coalesce("last", F.lit(-1)) + 1).cast("int").alias("ordinal"))
    body = bodies(slices.join(bare, "patient_id", "left_semi"), grids, part_bytes).join(made, "patient_id")
    voxels = structure_voxels(contours, grids).unionByName(body.select("patient_id", "ordinal", "i", "j", "k"))
    # The made body's name, kind, priority and colour.
    row = made.selectExpr("patient_id", "ordinal", "-1 as roi", "'BODY' as name", "'EXTERNAL' as kind", "5 as priority", "139 as red", "90 as green", "43 as blue")
    ct = ct_voxels(slices, grids, part_bytes).withColumn("rho", electron_density(F.col("hu")))
    doses = last_of(heads, dc.DOSE)
    return {"patients": grids, "ct": ct, "structures": structures.unionByName(row), "voxels": voxels, "dose": dose_voxels(dose_frames(doses), part_bytes), "dose_grids": dose_grids(doses)}

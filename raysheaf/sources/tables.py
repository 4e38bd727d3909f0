"""Tables at the library's edges: influence matrices, machine files, file discovery."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lineage import cut


def cache_key(name: str, beams: int, width: float, resolution: float, **inputs) -> str:
    """IO-30: readable part as customary, and a digest of everything else that the matrix depends on."""
    digest = hashlib.sha256(json.dumps(inputs, sort_keys=True, default=str).encode()).hexdigest()[:16]
    return f"{name}_{beams}beams_bw{width:.1f}_res{resolution:.1f}mm_{digest}"


def interleaved(x: Column, y: Column, bits: int = 16) -> Column:
    """Place on a Morton curve: the bits of two numbers below 2 to the power of ``bits``, in turn."""
    bit = lambda c, i, to: F.shiftleft(F.shiftright(c, i).bitwiseAND(F.lit(1)), to)
    return sum((bit(x, i, 2 * i + 1) + bit(y, i, 2 * i) for i in range(bits)), F.lit(0).cast("long"))


def save_matrix(dij: DataFrame, path: str, buckets: int = 64) -> None:
    """IO-28: entries as Parquet, clustered along a Morton curve of voxel and bixel, so that a filter on either skips files: of n files each reads about the root of n."""
    dij = cut(dij.select("voxel", "bixel", "value"))  # computed once, for its ends, the ranges and the files
    ends = dij.agg(*[f(c).alias(f"{n}_{c}") for c in ("voxel", "bixel") for n, f in (("low", F.min), ("high", F.max))]).first()
    at = []
    for c in ("voxel", "bixel"):
        low, high = ends[f"low_{c}"] or 0, ends[f"high_{c}"] or 0
        at.append(F.floor((F.col(c) - low) / F.lit(float(high - low + 1)) * (1 << 16)).cast("long"))
    rows = dij.withColumn("__place", interleaved(*at)).repartitionByRange(buckets, "__place").sortWithinPartitions("__place", "voxel", "bixel")
    rows.drop("__place").write.mode("overwrite").parquet(path)


def load_matrix(spark: SparkSession, path: str) -> DataFrame:
    """IO-29."""
    found = spark.read.parquet(path)
    if not {"voxel", "bixel", "value"} <= set(found.columns):
        raise ValueError("not an influence matrix")
    return found.select("voxel", "bixel", "value")


def matrix_for(spark: SparkSession, folder: str, key: str, compute: Callable[[], DataFrame]) -> DataFrame:
    """IO-31: the matrix kept under ``key``, computed and kept first if there is none. A matrix that was not written whole counts as none."""
    path = f"{folder.rstrip('/')}/{key}"
    target = spark._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")
    if not target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        save_matrix(compute(), path)
    return load_matrix(spark, path)


def from_rows(rows: DataFrame) -> DataFrame:
    """IO-29 for compressed rows: (voxel, bixels array, values array) to entries."""
    return rows.select("voxel", F.explode(F.arrays_zip("bixels", "values")).alias("e")).select("voxel", F.col("e.bixels").alias("bixel"), F.col("e.values").alias("value"))


#: What a machine file may hold; every field is optional.
_MLC = "type string, num_leaves int, max_travel_mm double, interdigitation boolean, num_inner_pairs int, leaf_width_mm array<double>, leaf_position_resolution_mm double, tongue_and_groove_width_mm double, leaf_tip_radius_mm double, leaf_transmission double"
_JAWS = ", ".join(f"{j}_{end}_cm double" for j in ("X1", "X2", "Y1", "Y2") for end in ("min", "max"))
GENERIC = f"""struct<meta: struct<radiationMode: string, dataType: string, created_on: string, created_by: string, description: string, name: string, SAD: double, SCD: double>,
  data: struct<energy: double, m: double, penumbraFWHMatIso: double, betas: array<double>, primaryFluence: array<array<double>>, kernelPos: array<double>, kernel: array<struct<SSD: double, kernel1: array<double>, kernel2: array<double>, kernel3: array<double>>>>,
  constraints: struct<gantryRotationSpeed: array<double>, leafSpeed: array<double>, monitorUnitRate: array<double>>, MLC: struct<{_MLC.replace(" ", ": ").replace(",: ", ", ")}>>"""
PHASE_SPACE = f"""struct<machine: struct<name: string, type: string, source_to_isocenter_distance_cm: double, beam_energy_MV: double, dose_rate_MU_per_min: double, aperture_sampling_resolution_mm: double, max_field_size_cm: array<double>,
  jaws: struct<{_JAWS.replace(" ", ": ").replace(",: ", ", ")}, default_field_size_cm: array<double>>, collimator: struct<min_deg: double, max_deg: double, default_deg: double>, couch: struct<min_deg: double, max_deg: double, default_deg: double>, MLC: struct<{_MLC.replace(" ", ": ").replace(",: ", ", ")}>>>"""


def machine_file(spark: SparkSession, folder: str, mode: str, name: str) -> str:
    """IO-15: the address of a machine's file: in a folder of its name, else by mode and name; ``FileNotFoundError`` without either."""
    for path in (f"{folder.rstrip('/')}/machines/{name}/{name}.json", f"{folder.rstrip('/')}/machines/machine_{mode}_{name}.json"):
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
            return path
    raise FileNotFoundError(f"no machine {name} of mode {mode} in {folder}")


def machines(spark: SparkSession, path: str) -> DataFrame:
    """IO-16 to IO-18: machine files, one row each, of either dialect; absent fields get their defaults; centimetres become millimetres; a largest field replaces the default one."""
    rows = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("file"))
    rows = rows.select("file", F.get_json_object("value", "$.machine").isNotNull().alias("phase"), F.from_json("value", GENERIC).alias("g"), F.from_json("value", PHASE_SPACE).machine.alias("p"))
    phase, col = F.col("phase"), F.col

    def either(p, g, default):
        return F.coalesce(F.when(phase, p).otherwise(g), F.lit(default))

    def pair(values, scale: float = 1.0):
        return F.when(F.size(values) >= 2, F.array(values[0] * scale, values[1] * scale))

    none = F.lit(None).cast("double")
    numbers = F.array().cast("array<double>")
    kind = F.regexp_replace(col("p.type"), "^photon$", "photons")
    mlc = lambda f, default: F.coalesce(F.when(phase, col(f"p.MLC.{f}")).otherwise(col(f"g.MLC.{f}")), F.lit(default))
    span = lambda part: F.when(col(f"p.{part}.min_deg").isNotNull() & col(f"p.{part}.max_deg").isNotNull(), F.array(f"p.{part}.min_deg", f"p.{part}.max_deg"))
    betas = F.slice(F.coalesce("g.data.betas", numbers), 1, 3)
    return rows.select(
        "file",
        F.when(phase, "phase_space").otherwise("generic").alias("dialect"),
        either(col("p.name"), col("g.meta.name"), "").alias("name"),
        either(kind, col("g.meta.radiationMode"), "photons").alias("radiation_mode"),
        either(col("p.source_to_isocenter_distance_cm") * 10, col("g.meta.SAD"), 1000.0).alias("sad"),
        either(none, col("g.meta.SCD"), 500.0).alias("scd"),
        either(col("p.beam_energy_MV"), col("g.data.energy"), 6.0).alias("energy"),
        either(none, col("g.data.m"), 0.0051).alias("mu"),
        either(none, col("g.data.penumbraFWHMatIso"), 5.0).alias("fwhm"),
        betas.alias("betas"),
        F.coalesce("g.data.kernelPos", numbers).alias("kernel_positions"),
        col("g.data.kernel").alias("kernels"),
        F.filter(F.coalesce("g.data.primaryFluence", F.array().cast("array<array<double>>")), lambda e: F.size(e) >= 2).alias("primary_fluence"),
        *[pair(col(f"g.constraints.{f}")).alias(n) for f, n in (("gantryRotationSpeed", "gantry_speed"), ("leafSpeed", "leaf_speed"), ("monitorUnitRate", "monitor_unit_rate"))],
        mlc("type", "").alias("mlc_type"),
        mlc("num_leaves", 0).alias("leaves"),
        mlc("max_travel_mm", 0.0).alias("leaf_travel"),
        mlc("interdigitation", False).alias("interdigitation"),
        mlc("num_inner_pairs", 0).alias("inner_pairs"),
        F.coalesce(F.when(phase, col("p.MLC.leaf_width_mm")).otherwise(col("g.MLC.leaf_width_mm")), numbers).alias("leaf_widths"),
        mlc("leaf_position_resolution_mm", 0.5).alias("leaf_resolution"),
        mlc("leaf_transmission", 0.0).alias("leaf_transmission"),
        F.struct(*[F.coalesce(col(f"p.jaws.{j}_{end}_cm") * 10, F.lit(0.0 if end == "min" else 200.0)).alias(f"{j.lower()}_{end}") for j in ("X1", "X2", "Y1", "Y2") for end in ("min", "max")]).alias("jaws"),
        F.coalesce(pair(col("p.max_field_size_cm"), 10.0), pair(col("p.jaws.default_field_size_cm"), 10.0)).alias("field_size"),
        span("collimator").alias("collimator_range"),
        F.coalesce("p.collimator.default_deg", F.lit(0.0)).alias("collimator"),
        span("couch").alias("couch_range"),
        F.coalesce("p.couch.default_deg", F.lit(0.0)).alias("couch"),
        F.coalesce("p.dose_rate_MU_per_min", F.lit(600.0)).alias("dose_rate"),
        F.coalesce("p.aperture_sampling_resolution_mm", F.lit(2.0)).alias("aperture_resolution"),
    )


def phase_space_files(spark: SparkSession, folder: str) -> DataFrame:
    """IO-19: base paths that have both a header and a data file, sorted."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path")
    base = lambda end: files.where(F.lower("path").endswith(end.lower())).select(F.regexp_replace("path", r"\.[^./]*$", "").alias("base"))
    return base(".IAEAheader").join(base(".IAEAphsp"), "base", "left_semi").orderBy("base")

"""Dose calculation from structures, machine and plan to a kept matrix, beam by beam.

A store holds one Parquet partition per beam and digest of all that the beam's entries depend
on: its angles and rays, machine, kernels, voxels, density and thresholds. A plan's matrix is read
from the partitions of its beams' digests; those that are missing are computed in one plan and
written first. So a change of one beam computes that beam, a change of the density all, and a
plan that was there before nothing. A partition counts once its mark is written, which comes
after its entries: what a lost job leaves is computed anew and overwritten. Entries are kept by
ray; bixels are numbered when they are read, as a beam's rays shift the numbers of later ones.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import electron_density, is_target_steering
from ..functions.lineage import cut
from . import grids as gr
from . import pencil as pb
from . import raytrace as rt
from . import steering as st


@dataclass(frozen=True)
class Thresholds:
    """What is kept: entries of at least ``relative`` times their bixel's largest, and of at least ``absolute``."""

    relative: float = 0.0
    absolute: float = 0.0


def table_digest(rows: DataFrame) -> str:
    """A digest of a table as a set of rows, whatever their order: their number and two sums of hashes."""
    columns = [F.to_json(F.struct(c)) if t.startswith(("array", "struct", "map")) else F.col(c).cast("string") for c, t in sorted(rows.dtypes)]
    hashed = [F.sum(F.xxhash64(F.lit(seed), *columns).cast("decimal(38,0)")).alias(f"h{seed}") for seed in (1, 2)]
    found = rows.agg(F.count(F.lit(1)).alias("n"), *hashed).first()
    return ":".join(str(v) for v in found)


def beam_digests(plan: DataFrame, rays: DataFrame, common: str) -> DataFrame:
    """(beam, digest) from a beam's angles and its rays, and ``common``, a text of everything else."""
    per = rays.groupBy("beam").agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.xxhash64(F.lit(seed), "ray", "ix", "iz").cast("decimal(38,0)")).alias(f"h{seed}") for seed in (1, 2)])
    said = F.concat_ws(":", F.lit(common), F.col("gantry").cast("string"), F.col("couch").cast("string"), "n", "h1", "h2")
    return plan.join(per, "beam").select("beam", F.sha2(said, 256).alias("digest"))


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def kept_digests(spark: SparkSession, store: str) -> set[tuple[int, str]]:
    """(beam, digest) of what a store holds whole; a line per beam that was ever kept."""
    if not _exists(spark, f"{store}/marks"):
        return set()
    return {(r.beam, r.digest) for r in spark.read.schema("beam long, digest string").parquet(f"{store}/marks").collect()}


def kept_influence(store: str, voxels: DataFrame, plan: DataFrame, rays: DataFrame, grids: DataFrame, kernels: DataFrame, machine: pb.Machine, width: float, iso: tuple[float, float, float] = (0.0, 0.0, 0.0), density: DataFrame | None = None, box: rt.Box | None = None, keep: Thresholds = Thresholds()) -> tuple[DataFrame, list[int]]:
    """AK-09, IO-31: (voxel, bixel, value) as ``pencil.influence`` gives it, and the beams that were computed for it."""
    spark, store = voxels.sparkSession, store.rstrip("/")
    plan, rays = cut(plan.select(F.col("beam").cast("long").alias("beam"), "gantry", "couch")), cut(rays.select("beam", "ray", "ix", "iz", "bixel"))
    tables = [table_digest(t) for t in (voxels.select("voxel", "x", "y", "z"), grids, kernels)]
    common = repr((tables, machine, width, iso, box, keep, None if density is None else table_digest(density.select("i", "j", "k", "rho"))))
    wanted = {(r.beam, r.digest) for r in beam_digests(plan, rays, common).collect()}  # a line per beam
    missing = sorted(wanted - kept_digests(spark, store))
    if missing:
        few = spark.createDataFrame(missing, "beam long, digest string")
        own = F.broadcast(few.select("beam"))
        found = pb.influence(voxels, plan.join(own, "beam"), rays.join(own, "beam"), grids, kernels, machine, width, iso, density, box, keep.relative, keep.absolute)
        named = found.join(rays.select("bixel", "beam", "ray"), "bixel").join(F.broadcast(few), "beam")
        rows = named.select("voxel", "ray", "value", "beam", "digest")
        rows.repartitionByRange("beam", "voxel").sortWithinPartitions("voxel", "ray").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("beam", "digest").parquet(f"{store}/entries")
        few.coalesce(1).write.mode("append").parquet(f"{store}/marks")
    if not wanted:
        return spark.createDataFrame([], "voxel long, bixel long, value double"), []
    beams, digests = zip(*sorted(wanted), strict=True)
    schema = "voxel long, ray long, value double, beam long, digest string"
    entries = spark.read.schema(schema).parquet(f"{store}/entries").where(F.col("beam").isin(*beams) & F.col("digest").isin(*digests))
    numbers = rays.groupBy("beam").agg(F.min(F.col("bixel") - F.col("ray")).alias("first"))  # a beam's bixels follow each other
    return entries.join(F.broadcast(numbers), "beam").select("voxel", (F.col("first") + F.col("ray")).alias("bixel"), "value"), [b for b, _ in missing]


def dose_voxels(structures: DataFrame, ct: gr.Grid, dose: gr.Grid) -> DataFrame:
    """ST-01: (voxel, x, y, z) of the dose grid's voxels under any structure (structure, kind, i, j, k) of the image grid; all voxels of the dose grid where there is none."""
    found = gr.mapped(structures.select("i", "j", "k"), ct, dose)
    if not found.limit(1).count():
        n = F.col("id")
        i, j, k = dose.unflat_a(n)
        found = structures.sparkSession.range(dose.dims[0] * dose.dims[1] * dose.dims[2]).select(i.alias("i"), j.alias("j"), k.alias("k"))
    at = {c: dose.position(a, F.col(n)).alias(c) for a, n, c in ((1, "j", "x"), (0, "i", "y"), (2, "k", "z"))}
    return found.select(dose.flat_a(F.col("i"), F.col("j"), F.col("k")).cast("long").alias("voxel"), at["x"], at["y"], at["z"])


def machine_of(row, cutoff: float = 50.0) -> tuple[pb.Machine, list[tuple[int, float]], list[tuple]]:
    """(machine, kernels, profiles) from a row of ``sources.tables.machines``, which is one machine's."""
    betas = tuple(row.betas) if len(row.betas or []) == 3 else pb.Machine.betas
    kernels = sorted(row.kernels or [], key=lambda k: k.SSD)
    if not kernels:
        raise ValueError(f"machine {row.name} has no kernels")
    profiles = [(n, list(row.kernel_positions), list(k.kernel1), list(k.kernel2), list(k.kernel3)) for n, k in enumerate(kernels)]
    return pb.Machine(row.sad, row.mu, betas, row.fwhm, cutoff), [(n, float(k.SSD)) for n, k in enumerate(kernels)], profiles


def dose_pipeline(store: str, structures: DataFrame, image: DataFrame, ct: gr.Grid, plan: DataFrame, machine_row, width: float, resolution: tuple[float, float, float], keep: Thresholds = Thresholds(), cutoff: float = 50.0, field: tuple[float, float] = (100.0, 100.0), step: float = 0.5) -> tuple[DataFrame, gr.Grid, list[int]]:
    """AK-09: the kept matrix of a plan, its dose grid, and the beams that were computed.

    ``structures`` (structure, kind, i, j, k) and ``image`` (i, j, k, hu) stand on the grid ``ct``;
    ``plan`` is (beam, gantry, couch) and ``machine_row`` a row of ``sources.tables.machines``. The
    isocentre is the centroid of the targets; rays cover them, or a regular field without any.
    Kernels are convolved by FFT, one task each.
    """
    spark = structures.sparkSession
    machine, ssds, profiles = machine_of(machine_row, cutoff)
    dose = ct.resampled(resolution)
    targets = structures.where(is_target_steering(F.col("kind"))).select("i", "j", "k").distinct()
    centre = st.isocentre(targets, ct.spacing, ct.origin).first()
    iso = (centre.x, centre.y, centre.z)
    points = targets.select(*[ct.position(a, F.col(n)).alias(c) for a, n, c in ((1, "j", "x"), (0, "i", "y"), (2, "k", "z"))])
    rays = st.ray_set(points, plan, machine.sad, width, ct.spacing, field, iso)
    density = image.select(F.col("j").alias("i"), F.col("i").alias("j"), "k", electron_density(F.col("hu")).alias("rho"))  # along x, y, z
    box = rt.Box((ct.dims[1], ct.dims[0], ct.dims[2]), (ct.spacing[1], ct.spacing[0], ct.spacing[2]), (ct.origin[1], ct.origin[0], ct.origin[2]))
    kernels = spark.createDataFrame(ssds, "kernel int, ssd double")
    given = spark.createDataFrame(profiles, "kernel int, positions array<double>, k1 array<double>, k2 array<double>, k3 array<double>")
    grids = cut(pb.kernel_rows(given, width, machine.fwhm, cutoff, step))
    matrix, computed = kept_influence(store, dose_voxels(structures, ct, dose), plan, rays, grids, kernels, machine, width, iso, density, box, keep)
    return matrix, dose, computed

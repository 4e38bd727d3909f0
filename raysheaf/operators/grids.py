"""Regular grids: a grid is a few numbers, its voxels are (i, j, k) columns.

Axis i are rows (y), j columns (x), k slices. Layout A numbers voxels with i running
fastest, layout B with j.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import linear


@dataclass(frozen=True)
class Grid:
    """Identity orientation: (ni, nj, nk) voxels, spacing and origin of (i, j, k) in mm."""

    dims: tuple[int, int, int]
    spacing: tuple[float, float, float]
    origin: tuple[float, float, float] = (0.0, 0.0, 0.0)

    def flat_a(self, i: Column, j: Column, k: Column) -> Column:
        """SF-08, layout A."""
        return i + j * self.dims[0] + k * self.dims[0] * self.dims[1]

    def flat_b(self, i: Column, j: Column, k: Column) -> Column:
        """SF-08, layout B."""
        return i * self.dims[1] + j + k * self.dims[0] * self.dims[1]

    def unflat_a(self, v: Column) -> tuple[Column, Column, Column]:
        return v % self.dims[0], F.floor(v / self.dims[0]) % self.dims[1], F.floor(v / (self.dims[0] * self.dims[1]))

    def position(self, axis: int, index: Column) -> Column:
        """SF-04, SF-06: of a voxel's centre."""
        return self.origin[axis] + index * self.spacing[axis]

    def index(self, axis: int, position: Column) -> Column:
        """SF-04: fractional index of a position."""
        return (position - self.origin[axis]) / self.spacing[axis]

    def resampled(self, resolution: tuple[float, float, float]) -> Grid:
        """SF-07: same origin, at least one voxel per axis."""
        dims = tuple(max(1, math.floor((n - 1) * s / r) + 1) for n, s, r in zip(self.dims, self.spacing, resolution, strict=True))
        return Grid(dims, resolution, self.origin)


def mapped(voxels: DataFrame, source: Grid, target: Grid) -> DataFrame:
    """JN-04, PF-08: nearest voxels of another grid, halves away from zero, each once."""
    at = [F.round(target.index(a, source.position(a, F.col(n)))).cast("long") for a, n in enumerate("ijk")]
    inside = F.lit(True)
    for a, n in enumerate("ijk"):
        inside = inside & F.col(n).between(0, target.dims[a] - 1)
    return voxels.select(*[x.alias(n) for x, n in zip(at, "ijk", strict=True)]).where(inside).distinct()


def overlaid(pixels: DataFrame, source: Grid, target: Grid, values: DataFrame, value: str = "dose") -> DataFrame:
    """JN-22: (i, j, k, value) of the pixels (i, j, k) of one grid with that of the nearest voxel of another; pixels outside it are left out."""
    at = [F.round(target.index(a, source.position(a, F.col(n)))).cast("long").alias(f"t{n}") for a, n in enumerate("ijk")]
    held = values.select(*[F.col(n).alias(f"t{n}") for n in "ijk"], value)
    return pixels.select("i", "j", "k", *at).join(held, ["ti", "tj", "tk"]).select("i", "j", "k", value)


def sampled(voxels: DataFrame, source: Grid, target: Grid, dose: DataFrame) -> DataFrame:
    """AK-35, JN-06, PF-08: (structure, dose) of the voxels (structure, i, j, k) of one grid, interpolated in another; those more than half a voxel outside are left out, and structures without any left have no row."""
    at = {n: target.index(a, source.position(a, F.col(n))) for a, n in enumerate("ijk")}
    inside = F.lit(True)
    for a, n in enumerate("ijk"):
        inside = inside & at[n].between(-0.5, target.dims[a] - 0.5)
    rows = voxels.where(inside).select(F.struct("structure", "i", "j", "k").alias("id"), *[x.alias(f"f{n}") for n, x in at.items()])
    return trilinear(rows, dose, target.dims).select("id.structure", "dose")


def resampled_mask(mask: DataFrame, source: Grid, target: Grid) -> DataFrame:
    """JN-05: target voxels whose nearest source voxel is in the mask.

    Each mask voxel lists the target voxels that may lie nearest to it, a box of a few, and
    those that do are kept: as many rows as the result has, not as the grid has.
    """
    boxes = []
    for a, n in enumerate("ijk"):
        low = target.index(a, source.position(a, F.col(n) - 0.5))
        high = target.index(a, source.position(a, F.col(n) + 0.5))
        first, last = F.greatest(F.ceil(low) - 1, F.lit(0)), F.least(F.floor(high) + 1, F.lit(target.dims[a] - 1))
        boxes.append(F.when(first <= last, F.sequence(first.cast("long"), last.cast("long"))).otherwise(F.array().cast("array<long>")))
    rows = mask.select("i", "j", "k", *[b.alias(f"b{n}") for b, n in zip(boxes, "ijk", strict=True)])
    for n in "ijk":
        rows = rows.withColumn(f"t{n}", F.explode(f"b{n}"))
    nearest = F.lit(True)
    for a, n in enumerate("ijk"):
        nearest = nearest & (F.round(source.index(a, target.position(a, F.col(f"t{n}")))) == F.col(n))
    return rows.where(nearest).select(*[F.col(f"t{n}").alias(n) for n in "ijk"]).distinct()


def trilinear(samples: DataFrame, dose: DataFrame, dims: tuple[int, int, int]) -> DataFrame:
    """JN-06, SF-11: dose at fractional indices (fi, fj, fk), edges clamped. Eight corners, one equi-join, a weighted sum."""
    f = {n: F.least(F.greatest(F.col(f"f{n}"), F.lit(0.0)), F.lit(float(dims[a] - 1))) for a, n in enumerate("ijk")}
    low = {n: F.least(F.floor(f[n]), F.lit(max(dims[a] - 2, 0))).cast("long") for a, n in enumerate("ijk")}
    base = samples.select("id", *[low[n].alias(f"l{n}") for n in "ijk"], *[(f[n] - low[n]).alias(f"t{n}") for n in "ijk"])
    part = lambda n, d: F.col(f"t{n}") if d else 1 - F.col(f"t{n}")
    corner = F.explode(F.array(*[F.struct((F.col("li") + a).alias("i"), (F.col("lj") + b).alias("j"), (F.col("lk") + c).alias("k"), (part("i", a) * part("j", b) * part("k", c)).alias("p")) for a in (0, 1) for b in (0, 1) for c in (0, 1)]))
    rows = base.select("id", corner.alias("c")).select("id", "c.*").where("p > 0")
    return rows.join(dose, ["i", "j", "k"]).groupBy("id").agg(F.sum(F.col("p") * F.col("dose")).alias("dose"))


def interpolated(points: DataFrame, values: DataFrame, nx: int, ny: int, x0: float, x1: float, y0: float, y1: float) -> DataFrame:
    """SF-10: bilinear from values (ix, iy, v) at points (id, x, y), 0 outside the closed range."""
    fx, fy = (F.col("x") - x0) / (x1 - x0) * (nx - 1), (F.col("y") - y0) / (y1 - y0) * (ny - 1)
    inside = F.col("x").between(x0, x1) & F.col("y").between(y0, y1)
    rows = points.select("id", inside.alias("inside"), fx.alias("fx"), fy.alias("fy"))
    rows = rows.withColumn("lx", F.greatest(F.least(F.floor("fx"), F.lit(nx - 2)), F.lit(0))).withColumn("ly", F.greatest(F.least(F.floor("fy"), F.lit(ny - 2)), F.lit(0)))
    tx, ty = F.col("fx") - F.col("lx"), F.col("fy") - F.col("ly")
    corner = F.explode(F.array(*[F.struct((F.col("lx") + a).alias("ix"), (F.col("ly") + b).alias("iy"), ((tx if a else 1 - tx) * (ty if b else 1 - ty)).alias("p")) for a in (0, 1) for b in (0, 1)]))
    found = rows.where("inside").select("id", corner.alias("c")).select("id", "c.*").join(values, ["ix", "iy"]).groupBy("id").agg(F.sum(F.col("p") * F.col("v")).alias("v"))
    return points.select("id").join(found, "id", "left").select("id", F.coalesce("v", F.lit(0.0)).alias("v"))


def sliced(volume: DataFrame, plane: str, at: int, dims: tuple[int, int, int], value: str = "hu") -> DataFrame:
    """PF-22: (row, col, value) of an axial, sagittal or coronal slice as displayed."""
    ni, nj, nk = dims
    if plane == "axial":
        return volume.where(F.col("k") == at).select(F.col("i").alias("row"), F.col("j").alias("col"), value)
    if plane == "sagittal":
        return volume.where(F.col("j") == at).select((nk - 1 - F.col("k")).alias("row"), F.col("i").alias("col"), value)
    return volume.where(F.col("i") == ni - 1 - at).select((nk - 1 - F.col("k")).alias("row"), F.col("j").alias("col"), value)


def lerp_table(x: Column, step: float, values: Column) -> Column:
    """SF-12: from equidistant values (an array column), 0 beyond the last, clamped below the first."""
    n = F.size(values)
    at = F.greatest(F.floor(x / step), F.lit(0)).cast("int")
    inner = linear(F.try_element_at(values, F.least(at, n - 2) + 1), F.try_element_at(values, F.least(at, n - 2) + 2), F.greatest(x, F.lit(0.0)) / step - F.least(at, n - 2))
    return F.when(x > (n - 1) * step, 0.0).otherwise(inner)

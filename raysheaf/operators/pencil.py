"""Dose influence of pencil beams: rays, voxels and density to sparse entries (voxel, bixel, value).

One plan over all beams: beams are columns, never loops. What moves is, in this order, voxels
by beam (narrowed to the beam's cone first), their rays to the bricks of density on their way, and
pairs of voxel and ray to the kernel row that they need. Pairs come from the ray lattice: a
voxel lists the lattice places within its cut-off and meets the rays that are there, so no
pair is made that does not count. Kernels are tables of rows, and no table of data's size is
broadcast.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import depth_dose
from ..functions.lineage import cut
from . import bricks as bk
from . import raytrace as rt
from . import sparse as sp
from .kernels import convolve
from .steering import patient_point, to_bev


@dataclass(frozen=True)
class Machine:
    """What a dose calculation needs of a treatment machine; lengths in mm."""

    sad: float = 1000.0
    mu: float = 0.005066
    betas: tuple[float, float, float] = (0.3252, 0.0160, 0.0051)
    fwhm: float = 5.0
    cutoff: float = 50.0

    def lateral(self, width: float) -> float:
        """PF-06: a ray's reach at the isocentre plane, to the corners of its bixel."""
        return self.cutoff + width / math.sqrt(2)


# Kernels


def kernel_grid(profiles: list[np.ndarray], positions: np.ndarray, width: float, fwhm: float, cutoff: float, step: float = 0.5) -> tuple[float, np.ndarray]:
    """AK-06: the first coordinate of a square grid, and (component, row, column): a bixel's field, blurred by a Gaussian and spread by each radial profile.

    The three images stand on grids from -n to n - 1 steps, so indices add up under convolution
    and the result is centred again.
    """
    sigma = fwhm / math.sqrt(8 * math.log(2))
    field, gauss, reach = math.ceil(width / (2 * step)), math.ceil(5 * sigma / step), math.ceil(cutoff / step)
    half = field + gauss + reach
    x = np.arange(-gauss, gauss) * step
    blur = step**2 / (2 * math.pi * sigma**2) * np.exp(-(x[:, None] ** 2 + x[None, :] ** 2) / (2 * sigma**2))
    side = math.floor(width / step)
    open_ = _padded(convolve(np.ones((side, side)), blur), 2 * (field + gauss))
    x = np.arange(-reach, reach) * step
    r = np.hypot(x[:, None], x[None, :])
    found = []
    for values in profiles:
        if len(values) and len(positions):
            n = min(len(values), len(positions))
            found.append(_padded(convolve(open_, np.interp(r, positions[:n], values[:n], right=0.0)), 2 * half))
        else:
            found.append(np.zeros((2 * half, 2 * half)))
    return -half * step, np.stack(found)


def _padded(image: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros((n, n))
    out[: image.shape[0], : image.shape[1]] = image[:n, :n]
    return out


#: Beams are broadcast to all voxels: no plan has as many.
MOST_BEAMS = 1_000
KERNEL_ROWS = "kernel int, gx int, origin double, step double, n int, a array<array<double>>, b array<array<double>>"


def kernel_rows(kernels: DataFrame, width: float, fwhm: float, cutoff: float, step: float = 0.5) -> DataFrame:
    """AK-06 as a table: per kernel and grid row gx the three components of rows gx (``a``) and gx + 1 (``b``), enough to interpolate between them.

    ``kernels`` has (kernel, positions, k1, k2, k3); each is one task's work, whatever the beams.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples():
                origin, grid = kernel_grid([np.asarray(k, float) for k in (row.k1, row.k2, row.k3)], np.asarray(row.positions, float), width, fwhm, cutoff, step)
                n = grid.shape[1]
                for low in range(0, n - 1, 64):
                    at = range(low, min(low + 64, n - 1))
                    yield pd.DataFrame({"kernel": row.kernel, "gx": list(at), "origin": origin, "step": step, "n": n, "a": [grid[:, i].tolist() for i in at], "b": [grid[:, i + 1].tolist() for i in at]})

    return kernels.repartition("kernel").mapInPandas(run, KERNEL_ROWS)


def with_lateral(pairs: DataFrame, grids: DataFrame) -> DataFrame:
    """SF-10 by an equi-join: ``pairs`` (kernel, ox, oz, ...) with k1 to k3, bilinear in the kernel's rows; 0 outside the grid.

    Only the row numbers of a grid, one line per kernel, are broadcast.
    """
    shape = grids.groupBy("kernel").agg(F.first("origin").alias("origin"), F.first("step").alias("step"), F.first("n").alias("n"))
    fx, fz = ((F.col(c) - F.col("origin")) / F.col("step") for c in ("ox", "oz"))
    last = F.col("n") - 1
    inside = (fx >= 0) & (fz >= 0) & (fx <= last) & (fz <= last)
    low = lambda f: F.greatest(F.least(F.floor(f), F.col("n") - 2), F.lit(0)).cast("int")
    rows = pairs.join(F.broadcast(shape), "kernel").withColumn("gx", F.when(inside, low(fx))).withColumn("gz", F.when(inside, low(fz)))
    rows = rows.withColumn("tx", fx - F.col("gx")).withColumn("tz", fz - F.col("gz")).drop("origin", "step", "n")
    met = rows.join(grids.select("kernel", "gx", "a", "b"), ["kernel", "gx"], "left")

    def component(c: int) -> Column:
        line = lambda side: F.element_at(F.col(side)[c], F.col("gz") + 1) * (1 - F.col("tz")) + F.element_at(F.col(side)[c], F.col("gz") + 2) * F.col("tz")
        return F.coalesce(line("a") * (1 - F.col("tx")) + line("b") * F.col("tx"), F.lit(0.0))

    return met.select(*pairs.columns, *[component(c).alias(f"k{c + 1}") for c in range(3)])


# Beams


def in_beams(voxels: DataFrame, plan: DataFrame, rays: DataFrame, machine: Machine, width: float, iso: tuple[float, float, float]) -> DataFrame:
    """AK-07, PF-05: (beam, voxel, x, y, z, bx, by, bz, geo) of the voxels within reach of any of a beam's rays. ``plan`` (beam, gantry, couch) and the beams' largest offsets are a row per beam."""
    reach = rays.groupBy("beam").agg((F.max(F.sqrt(F.col("ix") * F.col("ix") + F.col("iz") * F.col("iz"))) * width + machine.lateral(width)).alias("reach"))
    beams = plan.join(reach, "beam")
    bx, by, bz = to_bev(F.col("gantry"), F.col("couch"), (F.col("x"), F.col("y"), F.col("z")), iso)
    rows = voxels.crossJoin(F.broadcast(beams)).select("beam", "gantry", "couch", "voxel", "x", "y", "z", bx.alias("bx"), by.alias("by"), bz.alias("bz"), "reach")
    depth = machine.sad + F.col("by")
    rows = rows.where((depth > 1) & (F.col("bx") * F.col("bx") + F.col("bz") * F.col("bz") <= F.pow(F.col("reach") / machine.sad, 2) * depth * depth))
    geo = F.sqrt(F.col("bx") * F.col("bx") + depth * depth + F.col("bz") * F.col("bz"))
    return rows.withColumn("geo", geo).drop("reach")


def _source(machine: Machine, iso: tuple[float, float, float]) -> list[Column]:
    zero = F.lit(0.0)
    return patient_point(F.col("gantry"), F.col("couch"), (zero, F.lit(-machine.sad), zero), iso)


def with_depths(near: DataFrame, bricks: DataFrame | None, box: rt.Box | None, machine: Machine, iso: tuple[float, float, float]) -> DataFrame:
    """AK-07, AK-02: ``near`` with radiological ``depth``; without density the depth of water from the source; 0 for voxels whose ray misses the volume."""
    if bricks is None:
        return near.withColumn("depth", F.greatest(machine.sad + F.col("by"), F.lit(0.0)))
    rays = near.select("beam", "voxel", *[c.alias(f"s{a}") for a, c in zip("xyz", _source(machine, iso), strict=True)], *[F.col(a).alias(f"t{a}") for a in "xyz"])
    deep = bk.traced(rays, ("beam", "voxel"), bricks, box).select("beam", "voxel", "depth")
    return near.join(deep, ["beam", "voxel"], "left").withColumn("depth", F.coalesce("depth", F.lit(0.0)))


def ray_targets(rays: DataFrame, plan: DataFrame, machine: Machine, width: float, iso: tuple[float, float, float]) -> DataFrame:
    """(beam, ray, ix, iz, sx..sz, x..z): source and target of each ray, in patient axes."""
    point = (2 * F.col("ix") * width, F.lit(machine.sad), 2 * F.col("iz") * width)
    end = patient_point(F.col("gantry"), F.col("couch"), point, iso)
    return rays.join(F.broadcast(plan), "beam").select("beam", "ray", "ix", "iz", *[c.alias(f"s{a}") for a, c in zip("xyz", _source(machine, iso), strict=True)], *[c.alias(a) for a, c in zip("xyz", end, strict=True)])


def beam_distances(rays: DataFrame, plan: DataFrame, bricks: DataFrame | None, box: rt.Box | None, machine: Machine, width: float, iso: tuple[float, float, float], cell: float = 20.0) -> DataFrame:
    """AK-07, AK-03: (beam, mean_ssd) over rays, those that meet no surface taking the nearest ray's distance."""
    if bricks is None:
        return rays.select("beam").distinct().select("beam", F.lit(machine.sad).alias("mean_ssd"))
    ends = ray_targets(rays, plan, machine, width, iso)
    found = bk.traced(ends.select("beam", "ray", "sx", "sy", "sz", *[F.col(a).alias(f"t{a}") for a in "xyz"]), ("beam", "ray"), bricks, box)
    ssd = found.select("beam", "ray", "ssd")
    whole = rt.with_nearest(ssd, ends.select("beam", "ray", "x", "y", "z"), machine.sad, cell)
    return whole.groupBy("beam").agg(F.avg("ssd").alias("mean_ssd"))


def nearest_kernels(distances: DataFrame, kernels: DataFrame) -> DataFrame:
    """JN-09: (beam, kernel) with the nearest SSD, the first on ties. Both sides are small: beams, and a machine's kernels."""
    return distances.crossJoin(F.broadcast(kernels.select("kernel", F.col("ssd").alias("of")))).groupBy("beam").agg(F.min_by("kernel", F.struct(F.abs(F.col("mean_ssd") - F.col("of")), "kernel")).alias("kernel"))


def ray_pairs(near: DataFrame, bixels: DataFrame, machine: Machine, width: float) -> DataFrame:
    """JN-07, PF-06: (near's columns, bixel, ox, oz) of voxels and rays of a beam within the cut-off, offsets at the isocentre plane.

    A voxel's lattice places within reach are listed and met by an equi-join with the rays
    (beam, ix, iz, bixel).
    """
    depth, cut = machine.sad + F.col("by"), machine.lateral(width)
    r = cut * depth / machine.sad
    ends = lambda c: (F.ceil((F.col(c) - r) / width), F.floor((F.col(c) + r) / width))
    (x0, x1), (z0, z1) = ends("bx"), ends("bz")
    rows = near.where((F.col("geo") >= 1e-6) & (depth >= 1) & (x0 <= x1) & (z0 <= z1))
    rows = rows.withColumn("ix", F.explode(F.sequence(x0, x1)))
    # Of a column of places only those within the circle.
    lat = F.col("bx") - F.col("ix") * width
    h = F.sqrt(F.greatest(r * r - lat * lat, F.lit(0.0)))
    a, b = F.ceil((F.col("bz") - h) / width) - 1, F.floor((F.col("bz") + h) / width) + 1
    rows = rows.withColumn("iz", F.explode(F.sequence(a, b)))
    scale = machine.sad / depth
    rows = rows.withColumn("ox", (F.col("bx") - F.col("ix") * width) * scale).withColumn("oz", (F.col("bz") - F.col("iz") * width) * scale)
    rows = rows.where(F.sqrt(F.col("ox") * F.col("ox") + F.col("oz") * F.col("oz")) <= cut)
    return rows.join(bixels.select("beam", "ix", "iz", "bixel"), ["beam", "ix", "iz"]).drop("ix", "iz")


def influence(voxels: DataFrame, plan: DataFrame, bixels: DataFrame, grids: DataFrame, kernels: DataFrame, machine: Machine, width: float, iso: tuple[float, float, float] = (0.0, 0.0, 0.0), density: DataFrame | None = None, box: rt.Box | None = None, relative: float = 0.0, absolute: float = 0.0, cell: float = 20.0) -> DataFrame:
    """AK-08: (voxel, bixel, value).

    ``voxels`` (voxel, x, y, z) in patient axes; ``plan`` (beam, gantry, couch); ``bixels``
    (beam, ray, ix, iz, bixel); ``kernels`` (kernel, ssd); ``grids`` from ``kernel_rows``;
    ``density`` (i, j, k, rho) on ``box``, or None for water.
    """
    if plan.limit(MOST_BEAMS + 1).count() > MOST_BEAMS:
        raise ValueError(f"a plan of at most {MOST_BEAMS} beams")
    bixels = cut(bixels)
    bricks = None if density is None else cut(bk.packed(density))
    near = with_depths(in_beams(voxels, plan, bixels, machine, width, iso), bricks, box, machine, iso)
    chosen = nearest_kernels(cut(beam_distances(bixels.select("beam", "ray", "ix", "iz"), plan, bricks, box, machine, width, iso, cell)), kernels)
    pairs = ray_pairs(near.select("beam", "voxel", "bx", "by", "bz", "geo", "depth").join(F.broadcast(chosen), "beam"), bixels, machine, width)
    lateral = with_lateral(pairs.select("kernel", "voxel", "bixel", "geo", "depth", "ox", "oz"), grids)
    value = depth_dose(F.col("depth"), machine.betas, machine.mu, [F.col(f"k{c}") for c in (1, 2, 3)], F.col("geo"), machine.sad)
    return sp.thresholded(sp.combined(lateral.select("voxel", "bixel", value.alias("value"))), relative, absolute)

"""Density in bricks, and rays walked through them: what moves is a row per ray and brick, not per voxel.

A volume is kept as packed arrays of ``SIDE`` voxels a side. A ray meets the bricks on its way
by an equi-join; a task walks all rays of a brick at once, and what it gives of each ray (length
times density, the last step, where the first dense voxel begins) adds up over bricks in any
order. A brick that many rays pass is sent to as many tasks as it has times ``RAYS`` of them.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .raytrace import AXES, TOUCHING, Box, segments

SIDE = 32
#: Rays of a brick that one task walks; rays that it walks at once.
RAYS, CHUNK = 100_000, 2_048
_ENDS = [f"{e}{a}" for e in "st" for a in AXES]
_PARTS = ("total", "last", "at", "first", "dense")


def packed(density: DataFrame, side: int = SIDE) -> DataFrame:
    """(bi, bj, bk, rho): a density (i, j, k, rho), at most one row per voxel, as arrays; voxels without a row, or with null, have 1."""

    def pack(rows: pa.Table) -> pa.Table:
        at = [rows[n].to_numpy() for n in "ijk"]
        block = np.ones((side, side, side))
        rho = rows["rho"].cast(pa.float64()).to_numpy(zero_copy_only=False)
        there = ~np.isnan(rho)
        block[tuple(x[there] % side for x in at)] = rho[there]
        return pa.table({**{f"b{n}": pa.array([int(x[0]) // side], pa.int64()) for n, x in zip("ijk", at, strict=True)}, "rho": [block.tobytes()]})

    place = [F.floor(F.col(n) / side).alias(f"b{n}") for n in "ijk"]
    rows = density.select(*[F.col(n).cast("long").alias(n) for n in "ijk"], "rho", *place)
    return rows.groupBy("bi", "bj", "bk").applyInArrow(pack, "bi long, bj long, bk long, rho binary")


def walked(ends: np.ndarray, block: np.ndarray, box: Box, brick: tuple[int, int, int], threshold: float) -> np.ndarray:
    """Per ray (rows of sx, sy, sz, tx, ty, tz): total length times density, that of the last step and where it begins, where the first step and the first step denser than the threshold begin; NaN without any."""
    side = block.shape[0]
    out = np.full((len(ends), 5), np.nan)
    for c in range(0, len(ends), CHUNK):
        own = ends[c : c + CHUNK]
        s, d = own[:, :3], own[:, 3:] - own[:, :3]
        length = np.sqrt((d * d).sum(1))
        moving = np.abs(d) > TOUCHING
        by = np.where(moving, d, 1.0)
        low, high, planes = np.zeros(len(own)), np.ones(len(own)), []
        for a in range(3):
            cells = min(side, box.dims[a] - brick[a] * side)
            first = box.origin[a] + (brick[a] * side - 0.5) * box.spacing[a]
            cuts = (first + np.arange(cells + 1) * box.spacing[a] - s[:, a : a + 1]) / by[:, a : a + 1]
            inside = (s[:, a] >= first) & (s[:, a] <= first + cells * box.spacing[a])
            low = np.maximum(low, np.where(moving[:, a], np.minimum(cuts[:, 0], cuts[:, -1]), np.where(inside, 0.0, 2.0)))
            high = np.minimum(high, np.where(moving[:, a], np.maximum(cuts[:, 0], cuts[:, -1]), np.where(inside, 1.0, -1.0)))
            planes.append(np.where(moving[:, a : a + 1], cuts, 0.0))
        ok = (low < high) & (length > TOUCHING)
        cuts = np.sort(np.clip(np.hstack([low[:, None], high[:, None], *planes]), low[:, None], np.maximum(low, high)[:, None]), axis=1)
        step = np.diff(cuts, axis=1) * length[:, None]
        real = (step > 1e-9) & ok[:, None]
        middle = (cuts[:, 1:] + cuts[:, :-1]) / 2
        at = [np.clip(np.floor((s[:, a : a + 1] + middle * d[:, a : a + 1] - box.origin[a]) / box.spacing[a] + 0.5).astype(np.int64) - brick[a] * side, 0, side - 1) for a in range(3)]
        rho, start = block[at[0], at[1], at[2]], cuts[:, :-1] * length[:, None]
        weighed = np.where(real, step * rho, 0.0)
        any_ = real.any(1)
        last = real.shape[1] - 1 - np.argmax(real[:, ::-1], axis=1)
        rows, found = np.arange(len(own)), out[c : c + CHUNK]
        found[:, 0], found[:, 1], found[:, 2] = weighed.sum(1), weighed[rows, last], start[rows, last]
        found[:, 3] = start[rows, np.argmax(real, axis=1)]
        dense = real & (rho > threshold)
        found[:, 4] = np.where(dense.any(1), start[rows, np.argmax(dense, axis=1)], np.nan)
        found[~any_] = np.nan
    return out


def traced(rays: DataFrame, keys: tuple[str, ...], bricks: DataFrame, box: Box, threshold: float = 0.05, side: int = SIDE, most: int = RAYS) -> DataFrame:
    """AK-01, AK-02, AK-03, JN-08 at volume scale: (keys, depth, ssd, entry) of rays (keys, sx, sy, sz, tx, ty, tz) that meet the volume.

    ``depth`` is the radiological depth at the middle of the last voxel, ``ssd`` the distance from
    the source to the first voxel denser than the threshold (-1 without one), ``entry`` that to
    the volume. ``bricks`` are ``packed`` densities; those that are missing have density 1. Keys are longs.
    """
    coarse = Box(tuple(math.ceil(n / side) for n in box.dims), tuple(x * side for x in box.spacing), tuple(o + (side - 1) / 2 * x for o, x in zip(box.origin, box.spacing, strict=True)))
    met = segments(rays.select(F.struct(*keys, *_ENDS).alias("ray"), *_ENDS), coarse)
    met = met.select("ray.*", *[F.col(n).alias(f"b{n}") for n in "ijk"])
    place = ["bi", "bj", "bk"]
    copies = met.groupBy(*place).agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias("copies"))
    dealt = met.join(copies, place).withColumn("copy", F.pmod(F.xxhash64(*keys), F.col("copies")).cast("int")).drop("copies")
    there = copies.select(*[F.col(p).alias(f"of_{p}") for p in place], F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("of_copy"))
    sent = there.join(bricks, [F.col(p) == F.col(f"of_{p}") for p in place]).select(*[f"of_{p}" for p in place], "of_copy", "rho")

    def walk(rows: pa.Table, brick: pa.Table) -> pa.Table:
        names = [*keys, *_PARTS]
        if not rows.num_rows:
            return pa.table({n: pa.array([], pa.int64() if n in keys else pa.float64()) for n in names})
        block = np.frombuffer(brick["rho"][0].as_py()).reshape(side, side, side) if brick.num_rows else np.ones((side, side, side))
        at = tuple(rows[p][0].as_py() for p in place)
        found = walked(np.stack([rows[c].to_numpy() for c in _ENDS], 1), block, box, at, threshold)
        met = ~np.isnan(found[:, 0])
        return pa.table({**{k: rows[k].cast(pa.int64()).filter(pa.array(met)) for k in keys}, **{n: pa.array(found[met, i], from_pandas=True) for i, n in enumerate(_PARTS)}})

    kinds = ", ".join([*(f"{k} long" for k in keys), *(f"{n} double" for n in _PARTS)])
    parts = dealt.groupBy(*place, "copy").cogroup(sent.groupBy(*[f"of_{p}" for p in place], "of_copy")).applyInArrow(walk, kinds)
    found = parts.groupBy(*keys).agg((F.sum("total") - F.max_by("last", "at") / 2).alias("depth"), F.coalesce(F.min("dense"), F.lit(-1.0)).alias("ssd"), F.min("first").alias("entry"))
    return found

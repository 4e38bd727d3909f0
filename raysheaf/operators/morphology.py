"""Masks and contours: rasterization, dilation, flood fill, components, body outline."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import cut


def rasterized(contours: DataFrame, x0: float | Column, dx: float | Column, nx: int | Column, y0: float | Column, dy: float | Column, ny: int | Column) -> DataFrame:
    """AK-10, WN-12, WN-13, SF-31: voxels (struct_id, i, j, k) whose centre lies within a contour by the even-odd rule.

    Rows of (struct_id, contour_id, k, points), points being an array of (x, y). Edges,
    crossings and spans are arrays of the contour's own row: a contour is never shuffled.
    What moves are spans; on a line each is cut by those before it, so that contours of one
    structure are united before there are voxels, and no task holds any. Less than three
    points make none.
    The grid may be given by columns of the contours, so that each has its own.
    """
    grid = {"x0": x0, "dx": dx, "nx": nx, "y0": y0, "dy": dy, "ny": ny}
    own = [name for name, v in grid.items() if isinstance(v, Column)]
    rows = contours.where(F.size("points") >= 3).select("struct_id", "k", "points", *[grid[name].alias(name) for name in own])
    x0, dx, nx, y0, dy, ny = (F.col(name) if name in own else v for name, v in grid.items())
    n = F.size("points")
    edges = F.transform("points", lambda p, i: F.struct(p["x"].alias("x1"), p["y"].alias("y1"), F.element_at("points", (i + 1) % n + 1)["x"].alias("x2"), F.element_at("points", (i + 1) % n + 1)["y"].alias("y2")))
    low, high = F.array_min(F.transform("points", lambda p: p["y"])), F.array_max(F.transform("points", lambda p: p["y"]))
    first, last = F.greatest(F.ceil((low - y0) / dy), F.lit(0)).cast("int"), F.least(F.floor((high - y0) / dy), F.lit(ny - 1)).cast("int")
    rows = rows.select("struct_id", "k", edges.alias("edges"), first.alias("first"), last.alias("last"), *own).where("first <= last")
    rows = rows.select("struct_id", "k", "edges", F.explode(F.sequence("first", "last")).alias("i"), *own)
    y = y0 + F.col("i") * dy
    crossed = F.filter("edges", lambda e: ((e["y1"] <= y) & (y < e["y2"])) | ((e["y2"] <= y) & (y < e["y1"])))
    xs = F.array_sort(F.transform(crossed, lambda e: e["x1"] + (y - e["y1"]) * (e["x2"] - e["x1"]) / (e["y2"] - e["y1"])))
    spans = rows.select("struct_id", "k", "i", xs.alias("xs"), *own).where(F.size("xs") >= 2)
    pairs = F.transform(F.sequence(F.lit(0), F.floor(F.size("xs") / 2).cast("int") - 1), lambda p: F.struct(F.element_at("xs", 2 * p + 1).alias("a"), F.element_at("xs", 2 * p + 2).alias("b")))
    spans = spans.select("struct_id", "k", "i", F.explode(pairs).alias("s"), *own)
    a, b = F.greatest(F.ceil((F.col("s.a") - x0) / dx), F.lit(0)).cast("int"), F.least(F.floor((F.col("s.b") - x0) / dx), F.lit(nx - 1)).cast("int")
    spans = spans.select("struct_id", "i", a.alias("a"), b.alias("b"), "k").where("a <= b")
    before = Window.partitionBy("struct_id", "k", "i").orderBy("a").rowsBetween(Window.unboundedPreceding, -1)
    fresh = spans.withColumn("a", F.greatest("a", F.coalesce(F.max("b").over(before) + 1, F.col("a")))).where("a <= b")
    return fresh.select("struct_id", "i", F.explode(F.sequence("a", "b")).alias("j"), "k")


def dilated(target: DataFrame, allowed: DataFrame, dims: tuple[int, int, int], spacing: tuple[float, float, float], margin: tuple[float, float, float]) -> DataFrame:
    """AK-11, ST-07: target (i, j, k) grown by the margin within ``allowed``; the first target stays though it lies outside.

    A round per voxel of the largest margin. An axis takes part while its margin lasts, and
    voxels at the border do not spread. Each round grows the last one's new voxels only and
    is cut from its lineage.
    """
    reach = [round(m / s) for m, s in zip(margin, spacing, strict=True)]
    grown = cut(target.select("i", "j", "k").distinct())
    inner = F.lit(True)
    for n, d in zip("ijk", dims, strict=True):
        inner = inner & F.col(n).between(1, d - 2)
    for step in range(1, max(reach, default=0) + 1):
        side = [(-1, 0, 1) if r >= step else (0,) for r in reach]
        moves = F.array(*[F.struct(F.lit(a).alias("i"), F.lit(b).alias("j"), F.lit(c).alias("k")) for a in side[0] for b in side[1] for c in side[2]])
        near = grown.where(inner).select("i", "j", "k", F.explode(moves).alias("m")).select(*[(F.col(n) + F.col(f"m.{n}")).alias(n) for n in "ijk"])
        grown = cut(grown.unionByName(near.distinct().join(allowed, ["i", "j", "k"], "left_semi")).distinct())
    return grown


def with_margin(target: DataFrame, allowed: DataFrame, dims: tuple[int, int, int], spacing: tuple[float, float, float], width: float) -> DataFrame:
    """AK-12: target voxels (i, j, k) grown within ``allowed`` by a bixel or a voxel, whichever is wider, per axis."""
    return dilated(target, allowed, dims, spacing, tuple(max(s, width) for s in spacing))


def exterior(mask: np.ndarray) -> np.ndarray:
    """AK-18: cells outside the mask that are 4-connected with the border."""
    free = ~np.pad(mask, 1)
    found = np.zeros_like(free)
    found[0, 0] = True
    while True:  # sweeps along both axes and directions until nothing changes
        before = found.sum()
        for view, open_ in ((found, free), (found[::-1], free[::-1]), (found.T, free.T), (found.T[::-1], free.T[::-1])):
            for r in range(1, view.shape[0]):
                view[r] |= view[r - 1] & open_[r]
        if found.sum() == before:
            return found[1:-1, 1:-1]


def labels4(mask: np.ndarray) -> np.ndarray:
    """AK-19: 4-connected components, each cell labelled by the least column-major number of its component, -1 outside."""
    rows, cols = mask.shape
    far = rows * cols
    label = np.where(mask, np.arange(far).reshape(cols, rows).T, far)
    while True:
        before = label.copy()
        for view, open_ in ((label, mask), (label[::-1], mask[::-1]), (label.T, mask.T), (label.T[::-1], mask.T[::-1])):
            for r in range(1, view.shape[0]):
                view[r] = np.where(open_[r] & (view[r - 1] < view[r]), view[r - 1], view[r])
        if (label == before).all():
            return np.where(mask, label, -1)


def _plane(pdf: pd.DataFrame, rows: int, cols: int) -> np.ndarray:
    mask = np.zeros((rows, cols), bool)
    mask[pdf["i"].to_numpy(int), pdf["j"].to_numpy(int)] = True
    return mask


def body_mask(mask: np.ndarray) -> np.ndarray:
    """AK-17 to AK-20 of one slice: cavities filled, the largest component alone; an empty slice stays empty."""
    label = labels4(mask | ~(exterior(mask) | mask))
    found, counts = np.unique(label[label >= 0], return_counts=True)
    return label == found[np.argmax(counts)] if len(found) else mask


def filled_body(cells: DataFrame, rows: int, cols: int) -> DataFrame:
    """AK-17 to AK-20: per slice k the mask cells (i, j) with cavities filled and only the largest component kept. A group is one slice of fixed size."""

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = np.nonzero(body_mask(_plane(pdf, rows, cols)))
        return pd.DataFrame({"k": pdf["k"].iloc[0], "i": i, "j": j})

    return cells.groupBy("k").applyInPandas(fill, f"k {cells.schema['k'].dataType.simpleString()}, i int, j int")


def component_labels(cells: DataFrame, rows: int, cols: int) -> DataFrame:
    """AK-19: (k, i, j, label) of every cell."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        label = labels4(_plane(pdf, rows, cols))
        i, j = np.nonzero(label >= 0)
        return pd.DataFrame({"k": pdf["k"].iloc[0], "i": i, "j": j, "label": label[i, j]})

    return cells.groupBy("k").applyInPandas(run, f"k {cells.schema['k'].dataType.simpleString()}, i int, j int, label long")


def row_edges(cells: DataFrame) -> DataFrame:
    """WN-11: leftmost and rightmost cell of each row of a slice."""
    return cells.groupBy("k", "i").agg(F.min("j").alias("left"), F.max("j").alias("right"))


def outline(edges: DataFrame, spacing: float = 1.0) -> DataFrame:
    """AK-20, SL-06: a slice's polygon, down the right edge and back up the left; over 600 points are thinned. A slice has a point per row and side."""
    points = edges.select("k", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("i").alias("o"), F.col("i"), F.col("right").alias("j")), F.struct(F.lit(1).alias("side"), (-F.col("i")).alias("o"), F.col("i"), F.col("left").alias("j")))).alias("p")).select("k", "p.*")
    place = F.row_number().over(Window.partitionBy("k").orderBy("side", "o")) - 1
    size = F.count(F.lit(1)).over(Window.partitionBy("k"))
    step = F.when(F.col("size") > 600, F.greatest(F.lit(2), F.floor(F.col("size") / 300))).otherwise(1)
    return points.withColumn("pos", place).withColumn("size", size).where(F.col("pos") % step == 0).select("k", "pos", (F.col("j") * spacing).alias("x"), (F.col("i") * spacing).alias("y"))


def blurred(volume: DataFrame, dims: tuple[int, int, int]) -> DataFrame:
    """AK-37: weighted 3 by 3 by 3 mean with weights 1 / (1 + |di| + |dj| + |dk|) of the inner voxels; those at the border become 0. Absent voxels count as 0."""
    moves = [(a, b, c, 1.0 / (1 + abs(a) + abs(b) + abs(c))) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1)]
    near = F.explode(F.array(*[F.struct(F.lit(a).alias("i"), F.lit(b).alias("j"), F.lit(c).alias("k"), F.lit(w).alias("w")) for a, b, c, w in moves]))
    inner = F.lit(True)
    for n, d in zip("ijk", dims, strict=True):
        inner = inner & F.col(n).between(1, d - 2)
    spread = volume.select("i", "j", "k", "v", near.alias("m")).select(*[(F.col(n) + F.col(f"m.{n}")).alias(n) for n in "ijk"], (F.col("v") * F.col("m.w")).alias("wv"))
    sums = spread.where(inner).groupBy("i", "j", "k").agg((F.sum("wv") / sum(w for *_, w in moves)).alias("b"))
    return volume.join(sums, ["i", "j", "k"], "left").select("i", "j", "k", F.coalesce("b", F.lit(0.0)).alias("v"))

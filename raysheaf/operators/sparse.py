"""The sparse dose-influence matrix as a table of (voxel, bixel, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RUN = 1024


def combined(entries: DataFrame) -> DataFrame:
    """AG-01: duplicates summed. One shuffle, after partial sums."""
    return entries.groupBy("voxel", "bixel").agg(F.sum("value").alias("value"))


def exclusive_prefix(counts: DataFrame, key: str, value: str, run: int = RUN) -> DataFrame:
    """WN-02: exclusive running sum of ``value`` in order of the integer ``key``.

    Two levels: sums of runs of ``run`` keys are prefix-summed (one row per run), rows only
    within their run.
    """
    rows = counts.withColumn("__run", F.floor(F.col(key) / run))
    before = Window.orderBy("__run").rowsBetween(Window.unboundedPreceding, -1)
    bases = rows.groupBy("__run").agg(F.sum(value).alias("__sum")).withColumn("__base", F.coalesce(F.sum("__sum").over(before), F.lit(0))).select("__run", "__base")
    inside = Window.partitionBy("__run").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("__in", F.coalesce(F.sum(value).over(inside), F.lit(0))).join(bases, "__run").withColumn("start", F.col("__base") + F.col("__in")).drop("__run", "__base", "__in")


def row_pointers(dij: DataFrame) -> DataFrame:
    """AG-02: (voxel, n, start) of each row's entries."""
    return exclusive_prefix(dij.groupBy("voxel").agg(F.count(F.lit(1)).alias("n")), "voxel", "n")


def shape(dij: DataFrame) -> DataFrame:
    """AG-03: number of entries and largest value, 0 without any."""
    return dij.agg(F.count(F.lit(1)).alias("nnz"), F.coalesce(F.max("value"), F.lit(0.0)).alias("max_value"))


def forward(dij: DataFrame, weights: DataFrame, voxels: DataFrame | None = None) -> DataFrame:
    """JN-01: dose of each voxel; ``voxels`` adds those without entries at 0. Zero weights are dropped before the join."""
    dose = dij.join(weights.where("weight <> 0"), "bixel").groupBy("voxel").agg(F.sum(F.col("value") * F.col("weight")).alias("dose"))
    return dose if voxels is None else voxels.join(dose, "voxel", "left").select("voxel", F.coalesce("dose", F.lit(0.0)).alias("dose"))


def transposed(dij: DataFrame, gradient: DataFrame) -> DataFrame:
    """JN-02: gradient by bixel; zero rows are dropped before the join."""
    return dij.join(gradient.where("g <> 0"), "voxel").groupBy("bixel").agg(F.sum(F.col("value") * F.col("g")).alias("grad"))


def looked_up(entries: DataFrame, wanted: DataFrame) -> DataFrame:
    """JN-03: value at each (voxel, bixel) of ``wanted``, 0 where absent; duplicate entries count together."""
    return wanted.join(combined(entries), ["voxel", "bixel"], "left").withColumn("value", F.coalesce("value", F.lit(0.0)))


def bixel_peaks(dij: DataFrame) -> DataFrame:
    """WN-05 as a grouped maximum: (bixel, peak)."""
    return dij.groupBy("bixel").agg(F.max("value").alias("peak"))


def thresholded(dij: DataFrame, relative: float, absolute: float = 0.0) -> DataFrame:
    """PF-07: entries of at least max(relative times their bixel's peak, absolute)."""
    kept = F.col("value") >= F.greatest(F.col("peak") * relative, F.lit(absolute))
    return dij.join(bixel_peaks(dij), "bixel").where(kept).select("voxel", "bixel", "value")


def kept_ratio(dij: DataFrame, relative: float, absolute: float = 0.0) -> DataFrame:
    """AG-29: percentage of entries that a threshold keeps."""
    kept = F.col("value") >= F.greatest(F.col("peak") * relative, F.lit(absolute))
    return dij.join(bixel_peaks(dij), "bixel").agg(F.count(F.lit(1)).alias("before"), F.count_if(kept).alias("after"), F.coalesce(100.0 * F.count_if(kept) / F.nullif(F.count(F.lit(1)), F.lit(0)), F.lit(0.0)).alias("percent"))


def regularised(weights: DataFrame, l2: float, l1: float) -> DataFrame:
    """AG-16: value of both penalties, and the sum of their gradients."""
    w = F.col("weight")
    return weights.agg((l2 * F.sum(w * w)).alias("l2"), (l1 * F.sum(w)).alias("l1"), F.sum(2 * l2 * w + F.when(w > 0, l1).otherwise(0.0)).alias("grad_sum"))


def projected_norm(weights: DataFrame, grad: DataFrame, low: float, high: float) -> DataFrame:
    """AG-18: largest move of a projected gradient step."""
    x = F.col("weight")
    step = F.least(F.greatest(x - F.coalesce("grad", F.lit(0.0)), F.lit(low)), F.lit(high))
    return weights.join(grad, "bixel", "left").agg(F.max(F.abs(x - step)).alias("pg_norm"))


def neighbours(bixels: DataFrame, across: tuple[str, ...] = ()) -> DataFrame:
    """JN-11: (bixel, neighbor) for the four neighbours of (col, row), by an equi-join on shifted places; of two bixels in a place the last counts."""
    place = bixels.groupBy(*across, "col", "row").agg(F.max("bixel").alias("neighbor"))
    shifts = F.explode(F.array(*[F.struct(F.lit(c).alias("dc"), F.lit(r).alias("dr")) for c, r in ((1, 0), (-1, 0), (0, 1), (0, -1))])).alias("s")
    moved = bixels.select(*across, "bixel", "col", "row", shifts).select(*across, "bixel", (F.col("col") + F.col("s.dc")).alias("col"), (F.col("row") + F.col("s.dr")).alias("row"))
    return moved.join(place, [*across, "col", "row"]).select("bixel", "neighbor")


def smoothing(edges: DataFrame, weights: DataFrame, strength: float) -> tuple[DataFrame, DataFrame]:
    """JN-20: penalty over all edges, and its gradient by bixel."""
    a = weights.select("bixel", F.col("weight").alias("wa"))
    b = weights.select(F.col("bixel").alias("neighbor"), F.col("weight").alias("wb"))
    d = edges.join(a, "bixel").join(b, "neighbor").withColumn("d", F.col("wa") - F.col("wb"))
    return d.agg((strength / 2 * F.sum(F.col("d") * F.col("d"))).alias("penalty")), d.groupBy("bixel").agg((2 * strength * F.sum("d")).alias("grad"))



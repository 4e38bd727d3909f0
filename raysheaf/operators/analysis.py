"""Dose statistics, dose-volume curves and objective values by structure, over rows (structure, dose)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Parts of a structure's range of doses in which values are counted.
BANDS = 4096


def _d() -> Column:
    return F.col("dose")


def _n() -> Column:
    return F.count(F.lit(1))


def order_statistics(rows: DataFrame, wanted: DataFrame, by: str = "dose", bands: int = BANDS) -> DataFrame:
    """(structure, rank, value, below, equal): the value of each wanted (structure, rank), ranks from 0, with how many are smaller and how many equal.

    Exact, and no task sees a structure: values are counted by ``bands`` equal parts of their
    structure's range, prefix sums over the bands tell in which one a rank lies, and only rows
    of such bands are read again, counted by value first, so that a value that most rows share
    is one row by then. What rows are joined with, the ends of a structure's range and its bands
    that hold a rank, is a few lines per structure and broadcast: joined by key all rows of a
    structure would be sorted in one task.
    """
    x = F.col(by).cast("double")
    ends = rows.groupBy("structure").agg(F.min(x).alias("__low"), F.max(x).alias("__high"))
    part = (x - F.col("__low")) / F.when(F.col("__high") > F.col("__low"), F.col("__high") - F.col("__low")).otherwise(1.0)
    banded = rows.where(x.isNotNull()).join(F.broadcast(ends), "structure").select("structure", x.alias("value"), F.least(F.floor(part * bands), F.lit(bands - 1)).alias("band"))
    before = Window.partitionBy("structure").orderBy("band").rowsBetween(Window.unboundedPreceding, -1)
    counts = banded.groupBy("structure", "band").agg(_n().alias("n")).withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))
    placed = wanted.select("structure", "rank").distinct().join(counts, "structure").where((F.col("rank") >= F.col("base")) & (F.col("rank") < F.col("base") + F.col("n")))
    held = banded.join(F.broadcast(placed.select("structure", "band").distinct()), ["structure", "band"], "left_semi").groupBy("structure", "band", "value").agg(_n().alias("equal"))
    lower = Window.partitionBy("structure", "band").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    held = held.withColumn("inside", F.coalesce(F.sum("equal").over(lower), F.lit(0)))
    found = placed.join(held, ["structure", "band"]).withColumn("below", F.col("base") + F.col("inside"))
    return found.where((F.col("rank") >= F.col("below")) & (F.col("rank") < F.col("below") + F.col("equal"))).select("structure", "rank", "value", "below", "equal")


def quantiles(rows: DataFrame, shares: dict[str, float], totals: DataFrame | None = None) -> DataFrame:
    """(structure, one column per name): exact quantiles, interpolated between the two neighbouring ranks. ``totals`` (structure, n) saves counting."""
    totals = rows.groupBy("structure").agg(_n().alias("n")) if totals is None else totals
    at = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), (F.lit(share) * (F.col("n") - 1)).alias("at")) for name, share in shares.items()])).alias("q")
    asked = totals.select("structure", at).select("structure", "q.name", F.col("q.at").alias("at"))
    asked = asked.select("structure", "name", F.floor("at").alias("low"), F.ceil("at").alias("high"), (F.col("at") - F.floor("at")).alias("part"))
    values = order_statistics(rows, asked.select("structure", F.explode(F.array("low", "high")).alias("rank")))
    asked = asked.select("structure", "name", "part", "low", F.explode(F.array_distinct(F.array("low", "high"))).alias("rank")).join(values, ["structure", "rank"])
    ends = asked.groupBy("structure", "name").agg(F.max("part").alias("part"), F.min("value").alias("v0"), F.max("value").alias("v1"))
    picked = [F.max(F.when(F.col("name") == name, F.col("v0") + (F.col("v1") - F.col("v0")) * F.col("part"))).alias(name) for name in shares]
    return ends.groupBy("structure").agg(*picked)


def doses_at_volumes(rows: DataFrame, percents: tuple[float, ...], totals: DataFrame | None = None) -> DataFrame:
    """AG-06: (structure, d<percent>...): the dose that so many percent of the volume get at least, interpolated."""
    return quantiles(rows, {f"d{p:g}": 1 - p / 100 for p in percents}, totals)


def volume_at_dose(limit: float, dose: Column | None = None) -> Column:
    """AG-07: percent of the volume with at least that dose."""
    return 100.0 * F.avg(F.when((_d() if dose is None else dose) >= limit, 1.0).otherwise(0.0))


def summary(rows: DataFrame, dx: tuple[float, ...] = (2, 5, 50, 95, 98), vx: tuple[float, ...] = (20, 40)) -> DataFrame:
    """AG-05 to AG-07, AG-35: one aggregation per structure, and its quantiles."""
    base = rows.groupBy("structure").agg(
        _n().alias("n"),
        F.min(_d()).alias("min_dose"),
        F.max(_d()).alias("max_dose"),
        F.avg(_d()).alias("mean_dose"),
        F.stddev_pop(_d()).alias("std_dose"),
        *[volume_at_dose(x).alias(f"v{x:g}") for x in vx],
    )
    if not dx:
        return base
    return base.join(doses_at_volumes(rows, dx), "structure", "left").select("structure", "n", "min_dose", "max_dose", "mean_dose", "std_dose", *[f"d{p:g}" for p in dx], *[f"v{x:g}" for x in vx])


def conformity(rows: DataFrame, prescription: float) -> DataFrame:
    """AG-08: share of the structure with the prescribed dose."""
    return rows.groupBy("structure").agg(F.avg(F.when(_d() >= prescription, 1.0).otherwise(0.0)).alias("ci"))


def homogeneity(rows: DataFrame) -> DataFrame:
    """AG-09: (D2 - D98) / D50, 0 unless D50 is positive."""
    per = doses_at_volumes(rows, (2, 50, 98))
    return per.select("structure", F.when(F.col("d50") > 0, (F.col("d2") - F.col("d98")) / F.when(F.col("d50") > 0, F.col("d50")).otherwise(1.0)).otherwise(0.0).alias("hi"))


def grid_summary(rows: DataFrame) -> DataFrame:
    """AG-04: largest and mean dose, 0 without rows."""
    return rows.agg(F.coalesce(F.max(_d()), F.lit(0.0)).alias("max_dose"), F.coalesce(F.avg(_d()), F.lit(0.0)).alias("mean_dose"))


def curves(rows: DataFrame, bins: int = 200, top: DataFrame | None = None) -> DataFrame:
    """AG-10: cumulative dose-volume curve, ``bins`` thresholds from 0 to the largest dose.

    Each row is counted once at the last threshold that it reaches; the counts, at most
    ``bins`` per structure, are then summed from above. No row is multiplied by thresholds.
    ``top`` (one row, ``top``) replaces the largest dose, for curves on common bins.
    """
    top = rows.agg(F.max(_d()).alias("top")) if top is None else top
    width = F.col("top") / (bins - 1)
    at = F.least(F.floor(_d() / F.when(F.col("top") > 0, width).otherwise(1.0)), F.lit(bins - 1)).cast("int")
    # Division may be off by one place in its last digit: the threshold itself decides.
    at = F.when(_d() < at * F.col("top") / (bins - 1), at - 1).when((at < bins - 1) & (_d() >= (at + 1) * F.col("top") / (bins - 1)), at + 1).otherwise(at)
    counted = rows.crossJoin(F.broadcast(top)).select("structure", "top", at.alias("bin")).groupBy("structure", "bin").agg(_n().alias("n"), F.first("top").alias("top"))
    per = counted.groupBy("structure").agg(F.sum("n").alias("total"), F.first("top").alias("top"), F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("by_bin"))
    grid = per.select("structure", "total", "top", "by_bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    above = Window.partitionBy("structure").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)
    reached = F.sum(F.coalesce(F.try_element_at("by_bin", F.col("bin")), F.lit(0))).over(above)
    return grid.select("structure", "bin", (F.col("bin") * F.col("top") / (bins - 1)).cast("float").alias("dose"), (100.0 * reached / F.col("total")).cast("float").alias("volume"))


def compared(primary: DataFrame, other: DataFrame, metrics: tuple[str, ...], target: Column) -> DataFrame:
    """JN-19: (structure, metric, primary, compare, diff, sign) of two summaries; less is better but for targets."""
    long = lambda df, name: df.select("structure", F.explode(F.map_from_arrays(F.array(*map(F.lit, metrics)), F.array(*[F.col(m) for m in metrics]))).alias("metric", name))
    d = F.col("primary") - F.col("compare")
    both = long(primary, "primary").join(long(other, "compare"), ["structure", "metric"], "left").withColumn("diff", d)
    sign = F.when(F.abs("diff") < 1e-6, "=").when((F.col("diff") > 0) == target, "better").otherwise("worse")
    return both.withColumn("sign", sign)


# Objectives: value and the sum of the gradient over voxels


def squared_deviation(rows: DataFrame, prescribed: float, weight: float) -> DataFrame:
    """AG-11."""
    e = _d() - prescribed
    return rows.groupBy("structure").agg((weight * F.sum(e * e) / _n()).alias("value"), (2 * weight * F.sum(e) / _n()).alias("grad_sum"))


def squared_overdose(rows: DataFrame, most: float, weight: float) -> DataFrame:
    """AG-12, with the hinge of PF-17."""
    e = F.greatest(_d() - most, F.lit(0.0))
    return rows.groupBy("structure").agg((weight * F.sum(e * e) / _n()).alias("value"), (2 * weight * F.sum(e) / _n()).alias("grad_sum"))


def squared_underdose(rows: DataFrame, least: float, weight: float) -> DataFrame:
    """AG-13, with the hinge of PF-17."""
    e = F.greatest(least - _d(), F.lit(0.0))
    return rows.groupBy("structure").agg((weight * F.sum(e * e) / _n()).alias("value"), (-2 * weight * F.sum(e) / _n()).alias("grad_sum"))


def dvh_cut(rows: DataFrame, kind: str, fraction: float | Column) -> DataFrame:
    """WN-04: (structure, value, ties): the dose at which an objective begins (``min``) or ceases (``max``) to count, and how many of the equal doses count. ``fraction`` is one number per structure."""
    totals = rows.groupBy("structure").agg(_n().alias("n"), F.first(_column(fraction)).alias("f"))
    k = F.floor((1.0 - F.col("f")) * F.col("n")) if kind == "min" else F.col("n") - F.ceil(F.col("f") * F.col("n"))
    # The first rank that counts, or the first that does not; beyond the last there is none.
    ranks = totals.select("structure", F.greatest(k, F.lit(0)).cast("long").alias("rank"))
    at = order_statistics(rows, ranks)
    ties = F.col("below") + F.col("equal") - F.col("rank") if kind == "min" else F.col("rank") - F.col("below")
    return at.select("structure", "value", ties.alias("ties"))


def _column(x: float | Column) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def _dvh_error(kind: str, threshold: float | Column) -> Column:
    return F.greatest(_column(threshold) - _d(), F.lit(0.0)) if kind == "min" else F.greatest(_d() - _column(threshold), F.lit(0.0))


def dvh_objective(rows: DataFrame, kind: str, threshold: float, fraction: float, weight: float) -> DataFrame:
    """AG-14: squared under- or overdose of those voxels whose rank counts.

    ``min`` leaves the lowest floor((1 - fraction) n) doses free, ``max`` the highest
    ceil(fraction n). Equal doses have equal errors, so how many of those at the cut count is
    all that matters for the value.
    """
    cut, e = dvh_cut(rows, kind, fraction), _dvh_error(kind, threshold)
    beyond = _d() > F.col("value") if kind == "min" else _d() < F.col("value")
    inner = F.when(F.col("value").isNull(), F.lit(kind == "max")).otherwise(beyond)  # without a cut a max keeps all, a min none
    sums = rows.join(cut, "structure", "left").groupBy("structure").agg(
        F.sum(F.when(inner, e * e).otherwise(0.0)).alias("s"),
        F.max(F.when(_d() == F.col("value"), e * e * F.col("ties"))).alias("t"),
    )
    return sums.select("structure", (weight * (F.col("s") + F.coalesce("t", F.lit(0.0)))).alias("value"))


def dvh_gradient(rows: DataFrame, kind: str, threshold: float | Column, fraction: float | Column, weight: float | Column, order: str) -> DataFrame:
    """AG-14: ``rows`` with each one's part ``f`` of the value and its gradient ``g``. Of the doses equal to that at the cut those with the last (``min``) or first (``max``) ids count, found by rank of the unique integer ``order``."""
    cut = dvh_cut(rows, kind, fraction).select("structure", F.col("value").alias("__cut"), F.col("ties").alias("__ties"))
    near = rows.join(cut, "structure", "left")
    tied = near.where(_d() == F.col("__cut"))
    equal = tied.groupBy("structure").agg(_n().alias("n"), F.max("__ties").alias("ties"))
    last = equal.select("structure", (F.col("n") - F.col("ties") if kind == "min" else F.col("ties") - 1).alias("rank"))
    ids = order_statistics(tied.select("structure", order), last, order).select("structure", F.col("value").alias("__id"))
    near = near.join(ids, "structure", "left")
    chosen = F.coalesce(F.col(order) >= F.col("__id") if kind == "min" else F.col(order) <= F.col("__id"), F.lit(False))
    beyond = _d() > F.col("__cut") if kind == "min" else _d() < F.col("__cut")
    counted = F.when(F.col("__cut").isNull(), F.lit(kind == "max")).when(_d() == F.col("__cut"), chosen).otherwise(beyond)
    e, w = _dvh_error(kind, threshold), _column(weight)
    g = (-2.0 if kind == "min" else 2.0) * w * e
    return near.select(*rows.columns, F.when(counted, w * e * e).otherwise(0.0).alias("f"), F.when(counted, g).otherwise(0.0).alias("g"))


def hotspots(rows: DataFrame, prescription: float, threshold: float = 1.04, penalty: float = 2000.0, exact: bool = False) -> DataFrame:
    """AG-15: progressive penalty above threshold times prescription. The gradient is the customary one, or the exact derivative."""
    e = F.greatest(_d() - threshold * prescription, F.lit(0.0))
    n = e / prescription
    g = penalty / prescription**2 * (4 * F.pow(e, 3) + 50 * F.pow(e, 4) / prescription) if exact else 2 * penalty * n * (1 + 15 * n) * e
    return rows.groupBy("structure").agg(F.sum(penalty * n * n * (1 + 10 * n) * e * e).alias("f"), F.sum(g).alias("g_sum"))

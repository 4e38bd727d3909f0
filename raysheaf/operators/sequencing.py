"""Fluence maps, leaf pairs and leaf sequences."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fluence_map(rays: DataFrame, weights: DataFrame) -> DataFrame:
    """JN-12, AG-25: (beam, row, col, fluence) with zeros for places without a ray; of rays in one place the last counts."""
    bounds = rays.groupBy("beam").agg(F.min("ix").alias("x0"), F.max("ix").alias("x1"), F.min("iz").alias("z0"), F.max("iz").alias("z1"))
    held = rays.join(weights, "bixel", "left").groupBy("beam", "ix", "iz").agg(F.max_by(F.coalesce("weight", F.lit(0.0)), "bixel").alias("fluence"))
    grid = bounds.select("beam", "x0", "z0", F.explode(F.sequence("x0", "x1")).alias("ix"), "z1").select("beam", "x0", "z0", "ix", F.explode(F.sequence("z0", "z1")).alias("iz"))
    return grid.join(held, ["beam", "ix", "iz"], "left").select("beam", (F.col("iz") - F.col("z0")).alias("row"), (F.col("ix") - F.col("x0")).alias("col"), F.coalesce("fluence", F.lit(0.0)).alias("fluence"))


def leaf_bounds(widths: DataFrame) -> DataFrame:
    """WN-07: (lp, low, high) of leaf pairs from their (lp, width), centred on 0. One row per leaf pair of a collimator."""
    total = F.sum("width").over(Window.partitionBy())
    upto = F.sum("width").over(Window.orderBy("lp").rowsBetween(Window.unboundedPreceding, 0))
    return widths.select("lp", (upto - F.col("width") - total / 2).alias("low"), (upto - total / 2).alias("high"))


def rows_to_pairs(rows: DataFrame, bounds: DataFrame) -> DataFrame:
    """JN-14: leaf pair that holds each z, lower edge included; -1 without one. A collimator's leaf pairs are few and are broadcast."""
    z = F.col("z")
    return rows.join(F.broadcast(bounds), (z >= F.col("low")) & (z < F.col("high")), "left").select(*rows.columns, F.coalesce("lp", F.lit(-1)).alias("lp"))


def field_pairs(rows: DataFrame, bounds: DataFrame, width: float) -> DataFrame:
    """JN-16: leaf pairs that overlap the field of each beam, strictly."""
    field = rows.groupBy("beam").agg((F.min("z") - width / 2).alias("bottom"), (F.max("z") + width / 2).alias("top"))
    return field.join(F.broadcast(bounds), (F.col("high") > F.col("bottom")) & (F.col("low") < F.col("top"))).select("beam", "lp", "low", "high")


def resampled(fluence: DataFrame, bounds: DataFrame, width: float) -> DataFrame:
    """JN-15: (beam, lp, col, value), rows weighted by their overlap with the leaf pair; ``fluence`` has the row centre z."""
    bottom, top = F.col("z") - width / 2, F.col("z") + width / 2
    share = (F.least("high", top) - F.greatest("low", bottom)) / (F.col("high") - F.col("low"))
    return fluence.join(F.broadcast(bounds), (F.col("high") > bottom) & (F.col("low") < top)).groupBy("beam", "lp", "col").agg(F.sum(share * F.col("fluence")).alias("value"))


def quantised(value: Column, top: Column, levels: int) -> Column:
    """SF-22: level 0 to ``levels``, halves away from zero."""
    return F.least(F.greatest(F.round(value / F.nullif(top, F.lit(0.0)) * levels), F.lit(0)), F.lit(levels)).cast("int")


def deliverable(level: Column, levels: int, factor: Column) -> Column:
    """SF-23."""
    return level / levels * factor


def openings(levels: DataFrame) -> DataFrame:
    """WN-09: leftmost and rightmost open column of each leaf pair at each level: (beam, level, lp, left, right)."""
    each = levels.where("q > 0").select("beam", "lp", "col", F.explode(F.sequence(F.lit(1), F.col("q"))).alias("level"))
    return each.groupBy("beam", "level", "lp").agg(F.min("col").alias("left"), F.max("col").alias("right"))


def shape_runs(levels: DataFrame) -> DataFrame:
    """WN-08: runs of levels whose open columns are the same: (beam, first_level, weight).

    The open set at a level holds that at the next, so two neighbouring levels differ
    exactly if some place has the lower one: the distinct levels above 0 end the runs.
    """
    ends = levels.where("q > 0").select("beam", F.col("q").alias("last")).distinct()
    before = F.coalesce(F.lag("last").over(Window.partitionBy("beam").orderBy("last")), F.lit(0))
    return ends.select("beam", (before + 1).alias("first_level"), (F.col("last") - before).alias("weight"))


def merged_runs(runs: DataFrame, levels: int, factor: float, least: float) -> DataFrame:
    """AK-32: runs below the least weight absorb the next one, the last is absorbed by the one before: (beam, first_level, weight, mu).

    The loop is sequential within a beam, whose runs are at most ``levels``.
    """

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("first_level")
        found = [[f, int(w), w / levels * factor] for f, w in zip(pdf["first_level"], pdf["weight"], strict=True)]
        i = 0
        while i < len(found) and len(found) > 1:
            if found[i][2] >= least:
                i += 1
                continue
            into, gone = (i, i + 1) if i + 1 < len(found) else (i - 1, i)
            found[into][1] += found[gone][1]
            found[into][2] += found[gone][2]
            del found[gone]
            i = 0
        return pd.DataFrame({"beam": pdf["beam"].iloc[0], "first_level": [f[0] for f in found], "weight": [f[1] for f in found], "mu": [f[2] for f in found]})

    kind = runs.schema["beam"].dataType.simpleString()
    return runs.groupBy("beam").applyInPandas(merge, f"beam {kind}, first_level int, weight int, mu double")


def banks(opened: DataFrame, width: float, resolution: float) -> DataFrame:
    """SF-14, AK-40: leaf positions (bank_a, bank_b) of open leaf pairs, snapped to the resolution."""
    snap = lambda x: F.round(x / resolution) * resolution if resolution > 0 else x
    return opened.select("beam", "level", "lp", snap(F.col("left") * width - width / 2).alias("bank_a"), snap(F.col("right") * width + width / 2).alias("bank_b"))


def fidelity(pairs: DataFrame) -> DataFrame:
    """AG-26: correlation of columns a and b per beam; 1 if both are constant, 0 if one is."""
    n, a, b = F.count(F.lit(1)), F.col("a"), F.col("b")
    va, vb = F.var_pop(a), F.var_pop(b)
    cov = F.covar_pop(a, b)
    flat = 1e-24
    r = F.when((va < flat) & (vb < flat), 1.0).when((va < flat) | (vb < flat), 0.0).otherwise(cov / F.sqrt(F.when((va < flat) | (vb < flat), 1.0).otherwise(va * vb)))
    return pairs.groupBy("beam").agg(r.alias("fidelity"), n.alias("n"))


def totals(runs: DataFrame, per_beam: DataFrame) -> DataFrame:
    """AG-27: monitor units, segments, and mean fidelity of beams that have a segment."""
    per = runs.groupBy("beam").agg(F.sum("mu").alias("mu"), F.count(F.lit(1)).alias("segments"))
    return per.join(per_beam, "beam", "left").agg(F.sum("mu").alias("mu"), F.sum("segments").alias("segments"), F.avg("fidelity").alias("fidelity"))



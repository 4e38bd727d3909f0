"""Queries that iterate or that use array kernels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import cut
from ..operators import kernels as ke
from ..operators import objectives as ob
from ..operators import optimize as op
from ..operators import sparse as sp
from .plan import SPOT, _built
from .registry import query
from .tables import Tables


@query("ak05_convolve", """
WITH a AS (SELECT p_partkey % 40 AS i, (p_partkey // 40) % 30 AS j, avg(p_size)::DOUBLE AS v FROM part GROUP BY ALL),
b AS (SELECT r_regionkey % 3 AS i, r_regionkey // 3 AS j, (r_regionkey + 1)::DOUBLE AS v FROM region)
SELECT i, j, round(v, 6) AS v FROM (SELECT a.i + b.i - 1 AS i, a.j + b.j - 1 AS j, sum(a.v * b.v) AS v FROM a, b GROUP BY ALL) WHERE i BETWEEN 0 AND 39 AND j BETWEEN 0 AND 29""")
def _(t):
    p, r = F.col("p_partkey"), F.col("r_regionkey")
    a = t.read("part").groupBy((p % 40).alias("i"), (F.floor(p / 40) % 30).alias("j")).agg(F.avg("p_size").alias("v"))
    b = t.read("region").select((r % 3).cast("long").alias("i"), F.floor(r / 3).alias("j"), (r + 1).cast("double").alias("v"))
    return ke.convolved_same(a, b, 40, 30, 3, 2)


def _optimised(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, float]:
    """AK-24, AK-29: (weights, matrix, objectives, goals, upper bound): one weight per bixel of the table that brings every structure nearest its goals, within bounds. Of the objectives those that have a gradient everywhere, so that there is one optimum."""
    objectives, goals = _built(t)
    objectives = objectives.where(~F.col("kind").isin("min_dvh", "max_dvh"))
    dij = cut(sp.combined(t.entries()))
    bixels = [r[0] for r in t.read("supplier").select("s_suppkey").orderBy("s_suppkey").collect()]  # a plan's bixels
    voxels = t.read("part").select(F.col("p_partkey").alias("voxel"))
    found = op.optimised(dij, bixels, voxels, objectives, goals, SPOT, 60.0, tolerance=1e-4, l2=L2)
    weights = t.spark.createDataFrame([(int(b), float(w)) for b, w in zip(bixels, found.weights, strict=True)], "bixel long, weight double")
    return weights, dij, objectives, goals, op.most_fluence(dij, 60.0)


L2 = 0.1


@query("ak24_optimized_weights", digits=2)
def _(t):
    return _optimised(t)[0]


@query("ak24_optimality", "SELECT s_suppkey AS bixel, true AS within, true AS stationary FROM supplier")
def _(t):
    """The conditions that the optimum of ``ak24_optimized_weights`` meets: weights within bounds, and a gradient, taken here by joins (AG-17), that vanishes or points out of them."""
    weights, dij, objectives, goals, top = _optimised(t)
    dose = sp.forward(dij, weights, t.read("part").select(F.col("p_partkey").alias("voxel")))
    slope = sp.transposed(dij, ob.evaluated(dose, objectives, goals, SPOT).select("voxel", "g"))
    g = F.coalesce("grad", F.lit(0.0)) + 2 * L2 * F.col("weight")
    moved = F.col("weight") - F.least(F.greatest(F.col("weight") - g, F.lit(0.0)), F.lit(top))
    return weights.join(slope, "bixel", "left").select("bixel", F.col("weight").between(0.0, top).alias("within"), (F.abs(moved) < STATIONARY).alias("stationary"))


#: The optimizer ends where the projected gradient is below 1e-4, or below 1e-2 and the value falls no more.
STATIONARY = 0.02

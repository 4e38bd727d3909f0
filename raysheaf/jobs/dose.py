"""Queries on the influence matrix, dose statistics, curves and objectives."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as fc
from ..functions.lineage import cut, shared_folder
from ..operators import analysis as an
from ..operators import sparse as sp
from ..sources import influence as inf
from .registry import query
from .tables import DOSES, ENTRIES, GRADIENT, WEIGHTS, Tables

DIJ = f"(SELECT voxel, bixel, sum(value) AS value FROM {ENTRIES} GROUP BY voxel, bixel)"
FORWARD = f"(SELECT p.p_partkey AS voxel, coalesce(d.dose, 0e0) AS dose FROM part p LEFT JOIN (SELECT voxel, sum(value * weight) AS dose FROM {DIJ} JOIN {WEIGHTS} USING (bixel) GROUP BY voxel) d ON d.voxel = p.p_partkey)"
RX, LEVEL, PENALTY = 60.0, 1.04, 2000.0


def by_brand(t: Tables) -> DataFrame:
    """The flagship: matrix, forward dose, statistics of each structure (a part's brand)."""
    voxels = t.read("part").select(F.col("p_partkey").alias("voxel"), F.col("p_brand").alias("structure"))
    dose = sp.forward(sp.combined(t.entries()), t.weights(), voxels.select("voxel"))
    return an.summary(dose.join(voxels, "voxel"))


def _stats_sql(rows: str) -> str:
    dx = ", ".join(f"round(quantile_cont(dose, {1 - p / 100:.10g}), 9) AS d{p}" for p in (2, 5, 50, 95, 98))
    vx = ", ".join(f"round(100e0 * avg(CASE WHEN dose >= {x} THEN 1e0 ELSE 0e0 END), 9) AS v{x}" for x in (20, 40))
    return f"SELECT structure, count(*) AS n, round(min(dose), 9) AS min_dose, round(max(dose), 9) AS max_dose, round(avg(dose), 9) AS mean_dose, round(stddev_pop(dose), 9) AS std_dose, {dx}, {vx} FROM {rows} GROUP BY structure"


query("flagship_structure_dose", _stats_sql(f"(SELECT p_brand AS structure, dose FROM {FORWARD} f JOIN part ON p_partkey = f.voxel)"), digits=9)(by_brand)


@query("ag01_dij_finalize", f"SELECT voxel, bixel, round(value, 6) AS value FROM {DIJ}")
def _(t):
    return sp.combined(t.entries())


@query("ag02_row_pointers", f"SELECT voxel, count(*) AS n, (sum(count(*)) OVER (ORDER BY voxel) - count(*))::BIGINT AS start FROM {DIJ} GROUP BY voxel")
def _(t):
    return sp.row_pointers(sp.combined(t.entries()))


@query("ag03_dij_shape", f"SELECT count(*) AS nnz, round(coalesce(max(value), 0), 6) AS max_value FROM {DIJ}")
def _(t):
    return sp.shape(sp.combined(t.entries()))


@query("jn01_forward_dose", f"SELECT voxel, round(dose, 6) AS dose FROM {FORWARD}")
def _(t):
    return sp.forward(sp.combined(t.entries()), t.weights(), t.read("part").select(F.col("p_partkey").alias("voxel")))


def _binary(t: Tables) -> DataFrame:
    """The matrix written to a binary file of its own and read back."""
    dij, folder = cut(sp.combined(t.entries())), shared_folder(t.spark)
    if not folder.startswith(("file:", "/")):
        raise ValueError("binary matrices need a mounted folder; spark.checkpoint.dir names another file system")
    ends = dij.agg(F.coalesce(F.max("voxel") + 1, F.lit(0)), F.coalesce(F.max("bixel") + 1, F.lit(0))).first()
    path = f"{folder.removeprefix('file:')}/matrix-{uuid.uuid4().hex}.dij"
    inf.save_binary(dij, path, *ends)
    return inf.load_binary(t.spark, path)


@query("io28_binary_matrix", f"SELECT voxel, bixel, round(value, 6) AS value FROM {DIJ}")
def _(t):
    """IO-28, IO-29: through a binary file."""
    return _binary(t)


@query("io29_binary_dose", f"SELECT voxel, round(dose, 6) AS dose FROM {FORWARD} WHERE voxel >= 50")
def _(t):
    """IO-29: dose of the voxels from 50 on, whose rows alone are read where filters are pushed down."""
    voxels = t.read("part").select(F.col("p_partkey").alias("voxel")).where("voxel >= 50")
    return sp.forward(_binary(t).where("voxel >= 50"), t.weights(), voxels)


@query("jn02_transpose", f"SELECT bixel, round(sum(value * g), 6) AS grad FROM {DIJ} JOIN {GRADIENT} USING (voxel) WHERE g <> 0 GROUP BY bixel")
def _(t):
    return sp.transposed(sp.combined(t.entries()), t.gradient())


@query("jn03_point_lookup", f"SELECT w.voxel, w.bixel, round(coalesce(d.value, 0e0), 6) AS value FROM (SELECT p_partkey AS voxel, p_partkey % 97 + 1 AS bixel FROM part) w LEFT JOIN {DIJ} d USING (voxel, bixel)")
def _(t):
    v = F.col("p_partkey")
    return sp.looked_up(t.entries(), t.read("part").select(v.alias("voxel"), (v % 97 + 1).alias("bixel")))


@query("wn05_bixel_peaks", f"SELECT bixel, round(max(value), 6) AS peak FROM {DIJ} GROUP BY bixel")
def _(t):
    return sp.bixel_peaks(sp.combined(t.entries()))


THRESHOLD = f"(SELECT *, value >= greatest(2513e-4 * max(value) OVER (PARTITION BY bixel), 31e-2) AS kept FROM {DIJ})"


@query("pf07_threshold", f"SELECT voxel, bixel, round(value, 6) AS value FROM {THRESHOLD} WHERE kept")
def _(t):
    return sp.thresholded(sp.combined(t.entries()), 0.2513, 0.31)


@query("ag29_kept_ratio", f"SELECT count(*) AS before, count_if(kept)::BIGINT AS after, round(100e0 * count_if(kept) / count(*), 6) AS percent FROM {THRESHOLD}")
def _(t):
    return sp.kept_ratio(sp.combined(t.entries()), 0.2513, 0.31)


@query("ag16_regularization", f"SELECT round(1e-2 * sum(weight * weight), 6) AS l2, round(5e-2 * sum(weight), 6) AS l1, round(sum(2e-2 * weight + CASE WHEN weight > 0 THEN 5e-2 ELSE 0e0 END), 6) AS grad_sum FROM {WEIGHTS}")
def _(t):
    return sp.regularised(t.weights(), 0.01, 0.05)


@query("ag18_projected_gradient", f"WITH g AS (SELECT bixel, sum(value * g) AS grad FROM {DIJ} JOIN {GRADIENT} USING (voxel) WHERE g <> 0 GROUP BY bixel) SELECT round(max(abs(weight - least(greatest(weight - coalesce(grad, 0e0), 0e0), 1e1))), 6) AS pg_norm FROM {WEIGHTS} LEFT JOIN g USING (bixel)")
def _(t):
    return sp.projected_norm(t.weights(), sp.transposed(sp.combined(t.entries()), t.gradient()), 0.0, 10.0)


@query("sf24_max_fluence", f"SELECT round(CASE WHEN max(value) > 0 THEN 12e1 / max(value) ELSE 1e3 END, 6) AS max_fluence FROM {DIJ}")
def _(t):
    top = F.max("value")
    return sp.combined(t.entries()).agg(F.when(top > 0, 2 * RX / F.nullif(top, F.lit(0.0))).otherwise(1000.0).alias("max_fluence"))


PLACED = "(SELECT s_suppkey AS bixel, s_suppkey % 25 AS col, s_suppkey // 25 AS row FROM supplier)"
EDGES = f"(SELECT a.bixel, b.bixel AS neighbor FROM {PLACED} a JOIN {PLACED} b ON abs(a.col - b.col) + abs(a.row - b.row) = 1)"


def _placed(t: Tables) -> DataFrame:
    k = F.col("s_suppkey")
    return t.read("supplier").select(k.alias("bixel"), (k % 25).alias("col"), F.floor(k / 25).alias("row"))


@query("jn11_neighbors", f"SELECT * FROM {EDGES}")
def _(t):
    return sp.neighbours(_placed(t))


@query("jn20_smoothing", f"SELECT bixel, round(sum(2 * 1e-1 * (a.weight - b.weight)), 6) AS grad FROM {EDGES} e JOIN {WEIGHTS} a USING (bixel) JOIN {WEIGHTS} b ON b.bixel = e.neighbor GROUP BY bixel")
def _(t):
    return sp.smoothing(sp.neighbours(_placed(t)), t.weights(), 0.1)[1]


# Statistics


@query("ag04_dose_max_mean", f"SELECT round(coalesce(max(dose), 0e0), 6) AS max_dose, round(coalesce(avg(dose), 0e0), 6) AS mean_dose FROM {DOSES}")
def _(t):
    return an.grid_summary(t.doses())


@query("ag05_structure_stats", _stats_sql(DOSES), digits=9)
def _(t):
    return an.summary(t.doses())


@query("ag06_dx", f"SELECT structure, round(quantile_cont(dose, 5e-1), 6) AS d50, round(quantile_cont(dose, 1e-1), 6) AS d90, round(quantile_cont(dose, 99e-2), 6) AS d1 FROM {DOSES} GROUP BY structure")
def _(t):
    return an.doses_at_volumes(t.doses(), (50, 90, 1))


@query("ag07_vx", f"SELECT structure, {', '.join(f'round(100e0 * avg(CASE WHEN dose >= {x} THEN 1e0 ELSE 0e0 END), 6) AS v{x}' for x in (20, 40, 50, 60))} FROM {DOSES} GROUP BY structure")
def _(t):
    return t.doses().groupBy("structure").agg(*[an.volume_at_dose(x).alias(f"v{x}") for x in (20, 40, 50, 60)])


@query("ag08_conformity", f"SELECT structure, round(avg(CASE WHEN dose >= 60 THEN 1e0 ELSE 0e0 END), 6) AS ci FROM {DOSES} GROUP BY structure")
def _(t):
    return an.conformity(t.doses(), RX)


@query("ag09_homogeneity", f"SELECT structure, round(CASE WHEN quantile_cont(dose, 5e-1) > 0 THEN (quantile_cont(dose, 98e-2) - quantile_cont(dose, 2e-2)) / quantile_cont(dose, 5e-1) ELSE 0e0 END, 6) AS hi FROM {DOSES} GROUP BY structure")
def _(t):
    return an.homogeneity(t.doses())


def _curve_sql(rows: str, top: str, bins: int = 200) -> str:
    return f"""
WITH d AS (SELECT structure, dose FROM {rows}), top AS ({top}),
b AS (SELECT i AS bin, i * top / {bins - 1} AS edge FROM top, range({bins}) r(i)),
n AS (SELECT structure, count(*) AS total FROM d GROUP BY structure)
SELECT structure, bin::INT AS bin, edge::FLOAT AS dose, (100e0 * (SELECT count(*) FROM d WHERE d.structure = n.structure AND d.dose >= b.edge) / total)::FLOAT AS volume
FROM n CROSS JOIN b"""


@query("ag10_dvh", _curve_sql(DOSES, "SELECT max(dose) AS top FROM d"))
def _(t):
    return an.curves(t.doses())


@query("ag35_dvh_overlay", _curve_sql(f"(SELECT structure, compare AS dose FROM {DOSES})", f"SELECT greatest(max(dose), max(compare)) AS top FROM {DOSES}"))
def _(t):
    rows = t.doses()
    top = rows.agg(F.greatest(F.max("dose"), F.max("compare")).alias("top"))
    return an.curves(rows.select("structure", F.col("compare").alias("dose")), top=top)


METRICS = ("mean_dose", "d95", "v20")


def _metrics_sql(name: str, dose: str) -> str:
    return f"SELECT structure, unnest(['mean_dose', 'd95', 'v20']) AS metric, unnest([avg({dose}), quantile_cont({dose}, 5e-2), 100e0 * avg(CASE WHEN {dose} >= 20 THEN 1e0 ELSE 0e0 END)]) AS {name} FROM {DOSES} GROUP BY structure"


@query("jn19_dose_compare", f"""
WITH a AS ({_metrics_sql("p", "dose")}), b AS ({_metrics_sql("c", "compare")})
SELECT structure, metric, round(p, 6) AS "primary", round(c, 6) AS compare, round(p - c, 6) AS diff,
  CASE WHEN abs(p - c) < 1e-6 THEN '=' WHEN (p > c) = (structure LIKE 'A%') THEN 'better' ELSE 'worse' END AS sign
FROM a LEFT JOIN b USING (structure, metric)""")
def _(t):
    rows = t.doses()
    return an.compared(an.summary(rows), an.summary(rows.select("structure", F.col("compare").alias("dose"))), METRICS, F.col("structure").startswith("A"))


# Objectives


@query("ag11_squared_deviation", f"SELECT structure, round(2e0 * sum((dose - 60) * (dose - 60)) / count(*), 6) AS value, round(4e0 * sum(dose - 60) / count(*), 6) AS grad_sum FROM {DOSES} GROUP BY structure")
def _(t):
    return an.squared_deviation(t.doses(), RX, 2.0)


@query("ag12_squared_overdose", f"SELECT structure, round(2e0 * sum(pow(greatest(dose - 40, 0e0), 2)) / count(*), 6) AS value, round(4e0 * sum(greatest(dose - 40, 0e0)) / count(*), 6) AS grad_sum FROM {DOSES} GROUP BY structure")
def _(t):
    return an.squared_overdose(t.doses(), 40.0, 2.0)


@query("ag13_squared_underdose", f"SELECT structure, round(2e0 * sum(pow(greatest(50 - dose, 0e0), 2)) / count(*), 6) AS value, round(-4e0 * sum(greatest(50 - dose, 0e0)) / count(*), 6) AS grad_sum FROM {DOSES} GROUP BY structure")
def _(t):
    return an.squared_underdose(t.doses(), 50.0, 2.0)


RANKED = f"(SELECT structure, dose, row_number() OVER (PARTITION BY structure ORDER BY dose, o1, o2, o3, o4) - 1 AS rank, count(*) OVER (PARTITION BY structure) AS total FROM {DOSES})"


@query("ag14_dvh_min", f"SELECT structure, round(3e0 * sum(CASE WHEN rank >= floor(5e-2 * total) THEN pow(greatest(60 - dose, 0e0), 2) ELSE 0e0 END), 4) AS value FROM {RANKED} GROUP BY structure", digits=4)
def _(t):
    return an.dvh_objective(t.doses(), "min", 60.0, 0.95, 3.0)


@query("ag14_dvh_max", f"SELECT structure, round(3e0 * sum(CASE WHEN rank < total - ceil(3e-1 * total) THEN pow(greatest(dose - 20, 0e0), 2) ELSE 0e0 END), 4) AS value FROM {RANKED} GROUP BY structure", digits=4)
def _(t):
    return an.dvh_objective(t.doses(), "max", 20.0, 0.3, 3.0)


_E, _N = f"greatest(dose - {RX * LEVEL}::DOUBLE, 0e0)", f"(greatest(dose - {RX * LEVEL}::DOUBLE, 0e0) / {RX}::DOUBLE)"


@query("ag15_hotspots", f"SELECT structure, round(sum({PENALTY}::DOUBLE * {_N} * {_N} * (1 + 10 * {_N}) * {_E} * {_E}), 2) AS f, round(sum(2 * {PENALTY}::DOUBLE * {_N} * (1 + 15 * {_N}) * {_E}), 2) AS g_sum FROM {DOSES} GROUP BY structure", digits=2)
def _(t):
    return an.hotspots(t.doses(), RX, LEVEL, PENALTY)


@query("ag17_objective_gradient", f"""
WITH d AS (SELECT voxel, dose FROM {FORWARD}),
g AS (SELECT voxel, 2 * (dose - 20) / (SELECT count(*) FROM d) AS g FROM d)
SELECT bixel, round(sum(value * g) + 2e-2 * weight, 6) AS grad FROM {DIJ} JOIN g USING (voxel) JOIN {WEIGHTS} USING (bixel) GROUP BY bixel, weight""")
def _(t):
    """AG-17: one evaluation: forward dose, voxel gradient of a squared deviation, transposed product, L2 term."""
    dij, w = sp.combined(t.entries()), t.weights()
    dose = sp.forward(dij, w, t.read("part").select(F.col("p_partkey").alias("voxel")))
    g = dose.crossJoin(F.broadcast(dose.agg(F.count(F.lit(1)).alias("n")))).select("voxel", (2 * (F.col("dose") - 20.0) / F.col("n")).alias("g"))
    return sp.transposed(dij, g).join(w, "bixel").select("bixel", (F.col("grad") + 0.02 * F.col("weight")).alias("grad"))


@query("pf16_constraints", f"SELECT structure, min(dose) >= 1 AS min_ok, max(dose) <= 100 AS max_ok, avg(dose) <= 40 AS mean_ok FROM {DOSES} GROUP BY structure")
def _(t):
    d = F.col("dose")
    return t.doses().groupBy("structure").agg(fc.satisfied("min", F.min(d), 1.0).alias("min_ok"), fc.satisfied("max", F.max(d), 100.0).alias("max_ok"), fc.satisfied("mean", F.avg(d), 40.0).alias("mean_ok"))


@query("pf19_overlay_threshold", f"SELECT structure, count(*) AS n, round(sum(dose), 6) AS total FROM {DOSES} WHERE dose >= 10 GROUP BY structure")
def _(t):
    return t.doses().where("dose >= 10").groupBy("structure").agg(F.count(F.lit(1)).alias("n"), F.sum("dose").alias("total"))


@query("ag34_improvement", f"SELECT structure, round(CASE WHEN sum(dose * dose) > 0 THEN 100 * (sum(dose * dose) - sum(compare * compare)) / sum(dose * dose) ELSE 0e0 END, 6) AS percent FROM {DOSES} GROUP BY structure")
def _(t):
    before, after = F.sum(F.col("dose") * F.col("dose")), F.sum(F.col("compare") * F.col("compare"))
    return t.doses().groupBy("structure").agg(F.when(before > 0, 100 * (before - after) / F.nullif(before, F.lit(0.0))).otherwise(0.0).alias("percent"))


@query("sf35_log_objective", f"SELECT structure, round(CASE WHEN sum(dose) > 0 THEN log10(sum(dose)) ELSE 0e0 END, 6) AS log_total FROM {DOSES} GROUP BY structure")
def _(t):
    return t.doses().groupBy("structure").agg(F.sum("dose").alias("s")).select("structure", fc.positive_log10(F.col("s")).alias("log_total"))

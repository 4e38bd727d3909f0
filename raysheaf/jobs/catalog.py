"""Queries on catalog tables, vectors and colours."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as fc
from ..functions.lineage import shared_folder
from ..operators import catalog as ca
from ..operators import results as rs
from ..operators import sequencing as sq
from . import geometry as ge
from .registry import query
from .tables import PARTICLES, POINTS


@query("io04_slice_order", "SELECT user_id AS series, event_id AS path, round(value, 6) AS z, (row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) - 1)::INT AS k FROM events WHERE value IS NOT NULL")
def _(t):
    return ca.slices(t.read("events").select(F.col("user_id").alias("series"), F.col("event_id").alias("path"), F.col("value").alias("z")))


@query("io11_roi_names", "SELECT s_suppkey % 40 AS roi, arg_max(s_name, s_suppkey) AS name FROM supplier GROUP BY 1")
def _(t):
    k = F.col("s_suppkey")
    return ca.roi_names(t.read("supplier").select((k % 40).alias("roi"), F.col("s_name").alias("name"), k.alias("ordinal")))


@query("io10_roi_join", "SELECT p_partkey AS item, p_partkey % 55 AS roi, coalesce(name, 'Unknown') AS name FROM part LEFT JOIN (SELECT s_suppkey % 40 AS roi, arg_max(s_name, s_suppkey) AS name FROM supplier GROUP BY 1) n ON n.roi = p_partkey % 55")
def _(t):
    k, p = F.col("s_suppkey"), F.col("p_partkey")
    names = ca.roi_names(t.read("supplier").select((k % 40).alias("roi"), F.col("s_name").alias("name"), k.alias("ordinal")))
    return ca.named(t.read("part").select(p.alias("item"), (p % 55).alias("roi")), names)


_RED, _GREEN, _BLUE = "[255, 0, 0, 255, 255, 0, 255, 128, 255, 0]", "[0, 255, 0, 255, 0, 255, 128, 0, 192, 128]", "[0, 0, 255, 0, 255, 255, 0, 255, 203, 0]"
_PICK = [f"coalesce(CASE WHEN p_size > 25 THEN p_size + {c} END, {x}[(p_partkey % 10 + 1)::INT])::INT" for c, x in enumerate((_RED, _GREEN, _BLUE))]


@query("io13_colours", f"SELECT p_partkey AS ordinal, {_PICK[0]} AS red, {_PICK[1]} AS green, {_PICK[2]} AS blue FROM part")
def _(t):
    size = F.col("p_size")
    return ca.coloured(t.read("part").select(F.col("p_partkey").alias("ordinal"), *[F.when(size > 25, size + c).alias(n) for c, n in enumerate(("red", "green", "blue"))]))


@query("io14_contour_points", "SELECT vec_id AS item, round(embedding[3]::DOUBLE, 6) AS z, (len(v) // 3)::INT AS n, round(v[len(v) - 2]::DOUBLE, 6) AS last_x FROM (SELECT *, embedding[1:60 + (vec_id % 5)::INT] AS v FROM embeddings) WHERE len(v) % 3 = 0 AND len(v) > 0")
def _(t):
    items = t.read("embeddings").select(F.col("vec_id").alias("item"), F.slice("embedding", F.lit(1), (F.col("vec_id") % 5 + 60).cast("int")).cast("array<double>").alias("values"))
    got = ca.contour_points(items)
    return got.select("item", "z", F.size("points").alias("n"), F.element_at("points", -1)["x"].alias("last_x"))


@query("pf21_contours_on_slice", f"SELECT id, round(z, 6) AS z FROM {POINTS} WHERE abs((z + 40) / 25e-1 - 16) <= 5e-1")
def _(t):
    return ca.on_slice(t.points(), 16, -40.0, 2.5).select("id", "z")


@query("jn21_dose_lineage", "SELECT o.o_orderkey AS dose_id, o.o_orderpriority AS name, o.o_custkey AS linked, l.o_orderpriority AS linked_name FROM orders o LEFT JOIN orders l ON l.o_orderkey = o.o_custkey")
def _(t):
    return ca.lineage(t.read("orders").select(F.col("o_orderkey").alias("dose_id"), F.col("o_orderpriority").alias("name"), F.col("o_custkey").alias("linked")))


@query("pf20_displayed_fluence", f"SELECT beam, row, col, round(fluence, 6) AS fluence FROM {ge.FLUENCE} QUALIFY fluence > 1e-3 * max(fluence) OVER (PARTITION BY beam)")
def _(t):
    return ca.displayed(ge._fluence(t).select("beam", "row", "col", "fluence"))


@query("ag25_fluence_bounds", f"SELECT beam, max(row) + 1 AS rows, max(col) + 1 AS cols, round(max(fluence), 6) AS top FROM {ge.FLUENCE} GROUP BY beam")
def _(t):
    return ge._fluence(t).groupBy("beam").agg((F.max("row") + 1).alias("rows"), (F.max("col") + 1).alias("cols"), F.max("fluence").alias("top"))


@query("ag27_sequence_totals", f"WITH f AS ({ge.EXACT_FIDELITY}) SELECT round(sum(weight / 1e1), 6) AS mu, count(*) AS segments, (SELECT round(avg(fidelity), 5) FROM f WHERE beam IN (SELECT beam FROM {ge.RUNS})) AS fidelity FROM {ge.RUNS}")
def _(t):
    runs = sq.shape_runs(ge._quantised(t)).withColumn("mu", F.col("weight") / 10.0)
    return sq.totals(runs, ge._fidelity(t).select("beam", "fidelity")).select("mu", "segments", F.round("fidelity", 5).alias("fidelity"))


@query("jn18_beam_angles", f"SELECT beam::INT AS beam, gantry, couch FROM {ge.PLAN}")
def _(t):
    return ge._plan(t)


@query("sf01_vectors", f"""
WITH p AS (SELECT id, x, y, z, y AS u, z AS v, x AS w FROM {POINTS})
SELECT id, round(x * u + y * v + z * w, 4) AS dot, round(y * w - z * v, 4) AS cross_x, round(CASE WHEN sqrt(x * x + y * y + z * z) < 1e-14 THEN 0e0 ELSE z / sqrt(x * x + y * y + z * z) END, 4) AS unit_z FROM p""", digits=4)
def _(t):
    a = tuple(F.col(c) for c in "xyz")
    b = tuple(F.col(c) for c in "yzx")
    return t.points().select("id", fc.dot(a, b).alias("dot"), fc.cross(a, b)[0].alias("cross_x"), fc.normalised(a)[2].alias("unit_z"))


_ROTATION = fc.rotation(40.0, 20.0)


@query("sf02_rotated_points", "SELECT id, " + ", ".join(f"round({r[0]:.17e} * x + {r[1]:.17e} * y + {r[2]:.17e} * z, 4) AS {n}" for r, n in zip(_ROTATION, "xyz", strict=True)) + f" FROM {POINTS}", digits=4)
def _(t):
    moved = fc.times(_ROTATION, tuple(F.col(c) for c in "xyz"))
    return t.points().select("id", *[m.alias(n) for m, n in zip(moved, "xyz", strict=True)])


@query("sf09_interpolation", "SELECT o_orderkey, round(10 + (o_totalprice - 10) * (o_custkey % 10) / 1e1, 4) AS line, round((10 + (20 - 10) * (o_orderkey % 7) / 7e0) + ((30 + (o_totalprice - 30) * (o_orderkey % 7) / 7e0) - (10 + (20 - 10) * (o_orderkey % 7) / 7e0)) * (o_custkey % 10) / 1e1, 4) AS plane FROM orders", digits=4)
def _(t):
    tx, ty, top = F.col("o_custkey") % 10 / 10.0, F.col("o_orderkey") % 7 / 7.0, F.col("o_totalprice")
    return t.read("orders").select("o_orderkey", fc.linear(F.lit(10.0), top, tx).alias("line"), fc.bilinear(F.lit(10.0), F.lit(20.0), F.lit(30.0), top, tx, ty).alias("plane"))


STOPS = [(0, 0, 1), (0, 1, 1), (0, 1, 0), (1, 1, 0), (1, 0, 0)]


@query("sf33_energy_ramp", f"""
WITH e AS (SELECT rec, least(greatest(energy / 15, 0e0), 1e0) * 4 AS x FROM {PARTICLES}), a AS (SELECT *, least(floor(x), 3)::INT AS i FROM e)
SELECT rec, {', '.join(f"round({[float(s[c]) for s in STOPS]}[i + 1] + ({[float(s[c]) for s in STOPS]}[i + 2] - {[float(s[c]) for s in STOPS]}[i + 1]) * (x - i), 6)::DOUBLE AS {n}" for c, n in enumerate(('red', 'green', 'blue')))} FROM a""")
def _(t):
    return t.particles().select("rec", *[c.alias(n) for n, c in fc.ramp(F.col("energy") / 15, STOPS).items()])


@query("st05_near_equal", "SELECT l_suppkey AS key, round(l_extendedprice, 6) AS x FROM lineitem WINDOW w AS (PARTITION BY l_suppkey ORDER BY l_extendedprice) QUALIFY lag(l_extendedprice) OVER w IS NULL OR l_extendedprice - lag(l_extendedprice) OVER w >= 5e-1")
def _(t):
    return ca.distinct_within(t.read("lineitem").select(F.col("l_suppkey").alias("key"), F.col("l_extendedprice").alias("x")), 0.5)


@query("sl07_largest_structures", "SELECT p_brand AS structure, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, structure LIMIT 5")
def _(t):
    """SL-07, SL-08: a preview of the five largest."""
    return t.read("part").groupBy(F.col("p_brand").alias("structure")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "structure").limit(5)


@query("ag19_vector_products", "SELECT round(sum(s_acctbal * s_nationkey), 4) AS dot, round(max(abs(s_acctbal + 2 * s_nationkey)), 4) AS axpy_norm FROM supplier", digits=4)
def _(t):
    x, y = F.col("s_acctbal"), F.col("s_nationkey")
    return t.read("supplier").agg(F.sum(x * y).alias("dot"), F.max(F.abs(x + 2 * y)).alias("axpy_norm"))


@query("ak42_invalidated", """
WITH RECURSIVE needs AS (SELECT DISTINCT 'plan ' || o_orderkey AS artefact, 'patient ' || o_custkey AS needs FROM orders
  UNION SELECT DISTINCT 'matrix ' || l_partkey, 'plan ' || l_orderkey FROM lineitem
  UNION SELECT DISTINCT 'dose ' || l_partkey || ' ' || l_suppkey, 'matrix ' || l_partkey FROM lineitem),
found AS (SELECT 'patient ' || c_custkey AS artefact, 0 AS step FROM customer WHERE c_acctbal < -900
  UNION SELECT n.artefact, step + 1 FROM found f JOIN needs n ON n.needs = f.artefact)
SELECT artefact, min(step) AS step FROM found GROUP BY artefact""")
def _(t):
    """AK-42: plans, matrices and doses that the changed patients make invalid."""
    orders, lines = t.read("orders"), t.read("lineitem")
    named = lambda kind, *c: F.concat_ws(" ", F.lit(kind), *c)
    needs = orders.select(named("plan", "o_orderkey").alias("artefact"), named("patient", "o_custkey").alias("needs"))
    needs = needs.unionByName(lines.select(named("matrix", "l_partkey").alias("artefact"), named("plan", "l_orderkey").alias("needs")))
    needs = needs.unionByName(lines.select(named("dose", "l_partkey", "l_suppkey").alias("artefact"), named("matrix", "l_partkey").alias("needs")))
    return rs.affected(needs, t.read("customer").where("c_acctbal < -900").select(named("patient", "c_custkey").alias("artefact")))


_RX = "CASE WHEN l_linestatus = 'O' THEN 50e0 END"


@query("ak41_kept_statistics", f"""
SELECT l_linestatus AS dose_id, {_RX} AS prescription, l_returnflag AS structure, count(*) AS n, round(min(l_extendedprice / 1e3), 6) AS min_dose, round(max(l_extendedprice / 1e3), 6) AS max_dose, round(avg(l_extendedprice / 1e3), 6) AS mean_dose,
  round(quantile_cont(l_extendedprice / 1e3, 5e-1), 6) AS d50, round(CASE WHEN {_RX} IS NOT NULL THEN avg(CASE WHEN l_extendedprice / 1e3 >= {_RX} THEN 1e0 ELSE 0e0 END) END, 6) AS ci FROM lineitem GROUP BY l_linestatus, l_returnflag""")
def _(t):
    """AK-41: statistics of every dose, from the shared folder where they are there already."""
    doses = t.read("lineitem").select(F.col("l_linestatus").alias("dose_id"), F.col("l_returnflag").alias("structure"), (F.col("l_extendedprice") / 1000).cast("double").alias("dose"))
    wanted = t.spark.createDataFrame([("O", 50.0)], "dose_id string, prescription double")
    found, _ = rs.kept_statistics(doses, wanted, shared_folder(t.spark))
    return found.select("dose_id", "prescription", "structure", "n", "min_dose", "max_dose", "mean_dose", "d50", "ci")

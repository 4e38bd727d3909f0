"""Queries on grids, beams, rays, tracing, sequencing and masks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as fc
from ..functions.lineage import cut
from ..operators import bricks as bk
from ..operators import grids as gr
from ..operators import morphology as mo
from ..operators import raytrace as rt
from ..operators import sequencing as sq
from ..operators import sparse as sp
from ..operators import steering as st
from ..operators import surface as su
from .registry import query
from .tables import POINTS, Tables

CT = gr.Grid((60, 50, 40), (1.0, 1.5, 2.0), (-20.0, 5.0, 0.0))
DOSE = CT.resampled((2.5, 2.5, 2.5))
VOXELS = "(SELECT DISTINCT o_custkey % 60 AS i, o_orderkey % 50 AS j, (o_orderkey // 50) % 40 AS k FROM orders WHERE o_orderstatus = 'F')"


def _voxels(t: Tables) -> DataFrame:
    key = F.col("o_orderkey")
    return t.read("orders").where("o_orderstatus = 'F'").select((F.col("o_custkey") % 60).alias("i"), (key % 50).alias("j"), (F.floor(key / 50) % 40).alias("k")).distinct()


#: The target among the voxels: those of urgent orders.
URGENT = VOXELS.replace("o_orderstatus = 'F'", "o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'")


def _urgent(t: Tables) -> DataFrame:
    key = F.col("o_orderkey")
    rows = t.read("orders").where("o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'")
    return rows.select((F.col("o_custkey") % 60).alias("i"), (key % 50).alias("j"), (F.floor(key / 50) % 40).alias("k")).distinct()


def _index(grid: gr.Grid, axis: int, x: str) -> str:
    return f"(({x}) - {grid.origin[axis]}::DOUBLE) / {grid.spacing[axis]}::DOUBLE"


def _place(grid: gr.Grid, axis: int, i: str) -> str:
    return f"{grid.origin[axis]}::DOUBLE + {i} * {grid.spacing[axis]}::DOUBLE"


_MAPPED = ", ".join(f"round({_index(DOSE, a, _place(CT, a, n))})::BIGINT AS {n}" for a, n in enumerate("ijk"))
_INSIDE = " AND ".join(f"{n} BETWEEN 0 AND {DOSE.dims[a] - 1}" for a, n in enumerate("ijk"))


@query("jn04_grid_map", f"SELECT DISTINCT i, j, k FROM (SELECT {_MAPPED} FROM {VOXELS}) WHERE {_INSIDE}")
def _(t):
    return gr.mapped(_voxels(t), CT, DOSE)


_BACK = " AND ".join(f"round({_index(CT, a, _place(DOSE, a, f'g{n}.{n}'))}) = v.{n}" for a, n in enumerate("ijk"))


@query("jn05_mask_resample", f"SELECT DISTINCT gi.i, gj.j, gk.k FROM {VOXELS} v JOIN range({DOSE.dims[0]}) gi(i) ON {_BACK.split(' AND ')[0]} JOIN range({DOSE.dims[1]}) gj(j) ON {_BACK.split(' AND ')[1]} JOIN range({DOSE.dims[2]}) gk(k) ON {_BACK.split(' AND ')[2]}")
def _(t):
    return gr.resampled_mask(_voxels(t), CT, DOSE)


@query("sf08_flat_ids", f"SELECT i, j, k, i + j * 60 + k * 3000 AS a, i * 50 + j + k * 3000 AS b, round({_place(CT, 0, 'i')}, 6) AS y, round({_place(CT, 1, 'j')}, 6) AS x, round({_place(CT, 2, 'k')}, 6) AS z FROM {VOXELS}")
def _(t):
    v = _voxels(t)
    i, j, k = F.col("i"), F.col("j"), F.col("k")
    return v.select("i", "j", "k", CT.flat_a(i, j, k).alias("a"), CT.flat_b(i, j, k).alias("b"), *[CT.position(a, F.col(n)).alias(c) for a, n, c in ((0, "i", "y"), (1, "j", "x"), (2, "k", "z"))])


FIELD = "(SELECT p_partkey % 10 AS i, (p_partkey // 10) % 10 AS j, (p_partkey // 100) % 2 AS k, avg(p_retailprice) / 100 AS dose FROM part GROUP BY ALL)"


def _field(t: Tables) -> DataFrame:
    p = F.col("p_partkey")
    return t.read("part").groupBy((p % 10).alias("i"), (F.floor(p / 10) % 10).alias("j"), (F.floor(p / 100) % 2).alias("k")).agg((F.avg("p_retailprice") / 100).alias("dose"))


SAMPLES = "(SELECT id, (x + 45) / 8 AS fi, (y + 45) / 8 AS fj, (z + 45) / 90 AS fk FROM {POINTS})".replace("{POINTS}", POINTS)


@query("jn06_trilinear", f"""
WITH s AS (SELECT id, least(greatest(fi, 0e0), 9e0) AS fi, least(greatest(fj, 0e0), 9e0) AS fj, least(greatest(fk, 0e0), 1e0) AS fk FROM {SAMPLES}),
b AS (SELECT *, least(floor(fi), 8)::BIGINT AS li, least(floor(fj), 8)::BIGINT AS lj, 0 AS lk FROM s)
SELECT id, round(sum((1 - abs(fi - d.i)) * (1 - abs(fj - d.j)) * (1 - abs(fk - d.k)) * d.dose), 6) AS dose
FROM b JOIN {FIELD} d ON d.i BETWEEN li AND li + 1 AND d.j BETWEEN lj AND lj + 1 AND d.k BETWEEN lk AND lk + 1 GROUP BY id""")
def _(t):
    s = t.points().select("id", ((F.col("x") + 45) / 8).alias("fi"), ((F.col("y") + 45) / 8).alias("fj"), ((F.col("z") + 45) / 90).alias("fk"))
    return gr.trilinear(s, _field(t), (10, 10, 2))


@query("sf10_grid_interpolant", f"""
WITH v AS (SELECT i AS ix, j AS iy, dose AS v FROM {FIELD} WHERE k = 0), p AS (SELECT id, x, y, (x + 20) / 40 * 9 AS fx, (y + 20) / 40 * 9 AS fy FROM {POINTS}),
b AS (SELECT *, least(floor(fx), 8) AS lx, least(floor(fy), 8) AS ly FROM p WHERE x BETWEEN -20 AND 20 AND y BETWEEN -20 AND 20),
s AS (SELECT id, sum((1 - abs(fx - v.ix)) * (1 - abs(fy - v.iy)) * v.v) AS v FROM b JOIN v ON v.ix BETWEEN lx AND lx + 1 AND v.iy BETWEEN ly AND ly + 1 GROUP BY id)
SELECT p.id, round(coalesce(s.v, 0e0), 6) AS v FROM p LEFT JOIN s USING (id)""")
def _(t):
    return gr.interpolated(t.points(), _field(t).where("k = 0").select(F.col("i").alias("ix"), F.col("j").alias("iy"), F.col("dose").alias("v")), 10, 10, -20.0, 20.0, -20.0, 20.0)


@query("pf22_slices", f"SELECT 'axial' AS plane, i AS row, j AS col, round(dose, 6) AS v FROM {FIELD} WHERE k = 1 UNION ALL SELECT 'sagittal', 1 - k, i, round(dose, 6) FROM {FIELD} WHERE j = 4 UNION ALL SELECT 'coronal', 1 - k, j, round(dose, 6) FROM {FIELD} WHERE i = 9 - 4")
def _(t):
    f, found = _field(t), None
    for plane, at in (("axial", 1), ("sagittal", 4), ("coronal", 4)):
        one = gr.sliced(f, plane, at, (10, 10, 2), "dose").select(F.lit(plane).alias("plane"), "row", "col", F.col("dose").alias("v"))
        found = one if found is None else found.unionByName(one)
    return found


# Beams and rays

SAD, BW = 1000.0, 7.0


def _plan(t: Tables) -> DataFrame:
    """Gantry by region, couch by two nations: a plan's few angles."""
    gantry = t.read("region").select((F.col("r_regionkey") * 72).cast("double").alias("gantry"))
    couch = t.read("nation").where("n_nationkey < 2").select((F.col("n_nationkey") * 15).cast("double").alias("couch"))
    return st.beams(gantry, couch)


PLAN = "(SELECT row_number() OVER (ORDER BY couch, gantry) - 1 AS beam, gantry, couch FROM (SELECT (r_regionkey * 72)::DOUBLE AS gantry FROM region) CROSS JOIN (SELECT (n_nationkey * 15)::DOUBLE AS couch FROM nation WHERE n_nationkey < 2))"


def angles_sql(plan: str) -> str:
    return f"(SELECT *, cos(radians(gantry)) AS cg, sin(radians(gantry)) AS sg, cos(radians(couch)) AS cc, sin(radians(couch)) AS sc FROM {plan})"


def bev_sql(plan: str, points: str = POINTS) -> str:
    """(id, beam, x, y, z, bx, b_y, bz) of points in each beam's eye view."""
    return f"(SELECT id, beam, x, y, z, cc * cg * x + sg * y - sc * cg * z AS bx, -cc * sg * x + cg * y + sc * sg * z AS b_y, sc * x + cc * z AS bz FROM {points}, {angles_sql(plan)})"


def rays_sql(bev: str) -> str:
    return f"(SELECT DISTINCT beam, round(round(bx * 1e3 / (1e3 + b_y) / 7, 9))::BIGINT AS ix, round(round(bz * 1e3 / (1e3 + b_y) / 7, 9))::BIGINT AS iz FROM {bev})"


def numbered_sql(rays: str) -> str:
    return f"(SELECT beam, ix, iz, row_number() OVER (PARTITION BY beam ORDER BY ix, iz) - 1 AS ray FROM {rays})"


def bixels_sql(numbered: str) -> str:
    return f"(SELECT beam, ray, ix, iz, (first + ray)::BIGINT AS bixel FROM {numbered} JOIN (SELECT beam, sum(count(*)) OVER (ORDER BY beam) - count(*) AS first FROM {numbered} GROUP BY beam) USING (beam))"


BEV = bev_sql(PLAN)
RAYS = rays_sql(BEV)


def _rays(t: Tables, pad: int = 0) -> DataFrame:
    return st.target_rays(t.points(), _plan(t), SAD, BW, pad=pad)


@query("ak13_target_rays", RAYS[1:-1])
def _(t):
    return _rays(t)


@query("ak13_padded_rays", f"SELECT DISTINCT beam, ix + a.i AS ix, iz + b.i AS iz FROM {RAYS}, range(-1, 2) a(i), range(-1, 2) b(i)")
def _(t):
    return _rays(t, 1)


NUMBERED = numbered_sql(RAYS)


@query("sl01_ray_order", NUMBERED[1:-1])
def _(t):
    return st.numbered(_rays(t))


@query("ag28_bixel_offsets", f"SELECT beam, count(*) AS n, (sum(count(*)) OVER (ORDER BY beam) - count(*))::BIGINT AS first FROM {RAYS} GROUP BY beam")
def _(t):
    return st.bixel_offsets(_rays(t))


@query("sf19_ray_corners", f"""
SELECT beam, ix, iz, round(-cc * sg * -1e3, 4) AS source_x, round(cc * cg * 14 * ix - cc * sg * 1e3 + sc * 14 * iz, 4) AS target_x, round(-sc * cg * (7 * ix - 35e-1) + cc * (7 * iz - 35e-1), 4) AS corner_z,
  round(sg * (7 * ix + 35e-1) * 5e-1 + cg * -5e2, 4) AS scd_y
FROM {RAYS} JOIN (SELECT *, cos(radians(gantry)) AS cg, sin(radians(gantry)) AS sg, cos(radians(couch)) AS cc, sin(radians(couch)) AS sc FROM {PLAN}) USING (beam)""", digits=4)
def _(t):
    g = st.geometry(_rays(t), _plan(t), SAD, 500.0, BW)
    return g.select("beam", "ix", "iz", F.col("source.x").alias("source_x"), F.col("target.x").alias("target_x"), F.col("corners_iso")[2]["z"].alias("corner_z"), F.col("corners_scd")[0]["y"].alias("scd_y"))


@query("ag24_isocentre", f"SELECT round(avg(j) * 15e-1 + 5, 6) AS x, round(avg(i) - 20, 6) AS y, round(avg(k) * 2, 6) AS z FROM {VOXELS}")
def _(t):
    return st.isocentre(_voxels(t), CT.spacing, CT.origin)


# Tracing

BOX = rt.Box((10, 10, 10), (10.0, 10.0, 10.0), (-45.0, -45.0, -45.0))
RHO = "(SELECT p_partkey % 10 AS i, (p_partkey // 10) % 10 AS j, (p_partkey // 100) % 10 AS k, CASE WHEN min(p_partkey) % 10 < 2 THEN 0e0 ELSE max(p_size) / 25e0 END AS rho FROM part GROUP BY ALL)"
def traced_sql(rays: str, p: str = "") -> str:
    """Common table expressions up to ``{p}dense`` (ray, i, j, k, start, length, rho): segments in BOX of the relation (id, sx, sy, sz, tx, ty, tz)."""
    planes = " UNION ALL ".join(f"SELECT id, (-50 + 10 * p.i - s{a}) / (t{a} - s{a}) AS alpha FROM {p}r, range(11) p(i)" for a in "xyz")
    ends = lambda f: ", ".join(f"{f}((-50 - s{a}) / (t{a} - s{a}), (50 - s{a}) / (t{a} - s{a}))" for a in "xyz")
    at = ", ".join(f"round((s{a} + (a + b) / 2 * (t{a} - s{a}) + 45) / 10)::BIGINT AS {n}" for a, n in zip("xyz", "ijk", strict=True))
    return f"""
{p}r AS ({rays}),
{p}planes AS ({planes}),
{p}ends AS (SELECT id, greatest(0, {ends("least")}) AS lo, least(1, {ends("greatest")}) AS hi FROM {p}r),
{p}cuts AS (SELECT id, alpha FROM {p}planes JOIN {p}ends USING (id) WHERE lo < hi AND alpha > lo AND alpha < hi UNION ALL SELECT id, lo FROM {p}ends WHERE lo < hi UNION ALL SELECT id, hi FROM {p}ends WHERE lo < hi),
{p}pieces AS (SELECT id, alpha AS a, lead(alpha) OVER (PARTITION BY id ORDER BY alpha) AS b FROM {p}cuts),
{p}seg AS (SELECT p.id, a, b, sqrt(pow(tx - sx, 2) + pow(ty - sy, 2) + pow(tz - sz, 2)) AS len, {at} FROM {p}pieces p JOIN {p}r USING (id) WHERE b IS NOT NULL),
{p}traced AS (SELECT id AS ray, i, j, k, a * len AS start, (b - a) * len AS length FROM {p}seg WHERE (b - a) * len > 1e-9 AND i BETWEEN 0 AND 9 AND j BETWEEN 0 AND 9 AND k BETWEEN 0 AND 9),
{p}dense AS (SELECT t.*, coalesce(d.rho, 1e0) AS rho FROM {p}traced t LEFT JOIN {RHO} d USING (i, j, k))"""


SEGMENTS = "WITH " + traced_sql(f"SELECT id, -200e0 AS sx, 3e0 AS sy, -4e0 AS sz, 150e0 AS tx, y AS ty, z AS tz FROM {POINTS}")


def _traced(t: Tables) -> DataFrame:
    rays = t.points().select(F.col("id").alias("ray"), F.lit(-200.0).alias("sx"), F.lit(3.0).alias("sy"), F.lit(-4.0).alias("sz"), F.lit(150.0).alias("tx"), F.col("y").alias("ty"), F.col("z").alias("tz"))
    return rt.segments(rays, BOX)


def _density(t: Tables) -> DataFrame:
    p = F.col("p_partkey")
    return t.read("part").groupBy((p % 10).alias("i"), (F.floor(p / 10) % 10).alias("j"), (F.floor(p / 100) % 10).alias("k")).agg(F.when(F.first(p % 10) < 2, 0.0).otherwise(F.max("p_size") / 25.0).alias("rho"))


def _dense(t: Tables) -> DataFrame:
    return rt.with_density(_traced(t), _density(t))


@query("ak01_ray_segments", f"{SEGMENTS} SELECT ray, i, j, k, round(length, 5) AS length FROM traced", digits=5)
def _(t):
    return _traced(t).select("ray", "i", "j", "k", "length")


@query("wn01_radiological_depth", f"{SEGMENTS} SELECT ray, i, j, k, round(coalesce(sum(length * rho) OVER (PARTITION BY ray ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0) + length * rho / 2, 5) AS depth FROM dense", digits=5)
def _(t):
    return rt.depths(_dense(t)).select("ray", "i", "j", "k", "depth")


@query("ak02_depth_at_end", f"{SEGMENTS} SELECT ray, round(sum(length * rho) - arg_max(length * rho, start) / 2, 5) AS depth FROM dense GROUP BY ray", digits=5)
def _(t):
    return rt.deepest(_dense(t))


BRICKED = f"""{SEGMENTS} SELECT ray, round(sum(length * rho) - arg_max(length * rho, start) / 2, 5) AS depth, round(coalesce(min(CASE WHEN rho > 5e-2 THEN start END), -1), 5) AS ssd, round(min(start), 5) AS entry FROM dense GROUP BY ray"""


@query("jn08_brick_depths", BRICKED, digits=5)
def _(t):
    """AK-01 to AK-03 through a store of bricks, small ones here so that rays pass several."""
    rays = t.points().select(F.col("id").alias("ray"), F.lit(-200.0).alias("sx"), F.lit(3.0).alias("sy"), F.lit(-4.0).alias("sz"), F.lit(150.0).alias("tx"), F.col("y").alias("ty"), F.col("z").alias("tz"))
    return bk.traced(rays, ("ray",), bk.packed(_density(t), 4), BOX, side=4, most=1000)


@query("ak03_surface_distance", f"{SEGMENTS} SELECT ray, round(coalesce(min(CASE WHEN rho > 5e-2 THEN start END), -1), 5) AS ssd FROM dense GROUP BY ray", digits=5)
def _(t):
    return rt.surface_distance(_dense(t))


@query("wn06_surface_from_entry", f"{SEGMENTS} SELECT ray, round(coalesce(min(CASE WHEN rho > 5e-2 THEN start END) - min(start), -1), 5) AS ssd FROM dense GROUP BY ray", digits=5)
def _(t):
    return rt.surface_distance(_dense(t), compat=True)


@query("ag30_mean_ssd", f"{SEGMENTS}, s AS (SELECT ray, min(CASE WHEN rho > 5e-2 THEN start END) AS ssd FROM dense GROUP BY ray) SELECT round(coalesce(avg(ssd), 1e3), 5) AS mean_ssd FROM s WHERE ssd > 0", digits=5)
def _(t):
    return rt.mean_valid(rt.surface_distance(_dense(t)), 1000.0)


KERNELS = [100.0 * k for k in range(8)]


@query("jn09_nearest_kernel", f"SELECT p_partkey, (list_position(list_transform({KERNELS}, lambda k: abs(p_retailprice / 3 - k)), list_min(list_transform({KERNELS}, lambda k: abs(p_retailprice / 3 - k)))) - 1)::INT AS kernel FROM part")
def _(t):
    return t.read("part").withColumn("d", F.col("p_retailprice") / 3).select("p_partkey", rt.nearest_value(t.read("part"), KERNELS, "d").alias("kernel"))


@query("jn10_nearest_ray", f"""
WITH m AS (SELECT * FROM {POINTS} WHERE id % 5 = 0), v AS (SELECT * FROM {POINTS} WHERE id % 5 <> 0),
d AS (SELECT m.id, v.id AS nearest, sqrt(pow(m.x - v.x, 2) + pow(m.y - v.y, 2) + pow(m.z - v.z, 2)) AS distance FROM m, v)
SELECT id, nearest, round(distance, 6) AS distance FROM d QUALIFY row_number() OVER (PARTITION BY id ORDER BY distance, nearest) = 1""")
def _(t):
    p = t.points()
    return rt.nearest_point(p.where("id % 5 = 0"), p.where("id % 5 <> 0"), 8.0)


# Sequencing

BIXELS = f"(SELECT beam, ix, iz, first + ray AS bixel, abs((first + ray) * 37 % 101) / 101e0 AS weight FROM {NUMBERED} JOIN (SELECT beam, sum(count(*)) OVER (ORDER BY beam) - count(*) AS first FROM {RAYS} GROUP BY beam) USING (beam))"
FLUENCE = f"""(SELECT g.beam, g.iz - z0 AS row, g.ix - x0 AS col, coalesce(weight, 0e0) AS fluence, g.iz * 7e0 AS z
  FROM (SELECT beam, x0, z0, ix, unnest(range(z0, z1 + 1)) AS iz FROM (SELECT *, unnest(range(x0, x1 + 1)) AS ix FROM (SELECT beam, min(ix) AS x0, max(ix) AS x1, min(iz) AS z0, max(iz) AS z1 FROM {BIXELS} GROUP BY beam))) g LEFT JOIN {BIXELS} w ON w.beam = g.beam AND w.ix = g.ix AND w.iz = g.iz)"""
LEAVES = "(SELECT n_nationkey AS lp, (sum(5 + n_regionkey) OVER (ORDER BY n_nationkey) - (5 + n_regionkey) - (SELECT sum(5 + n_regionkey) FROM nation) / 2)::DOUBLE AS low, (sum(5 + n_regionkey) OVER (ORDER BY n_nationkey) - (SELECT sum(5 + n_regionkey) FROM nation) / 2)::DOUBLE AS high FROM nation)"
LEVELS = 10
RESAMPLED = f"(SELECT beam, lp, col, sum((least(high, z + 35e-1) - greatest(low, z - 35e-1)) / (high - low) * fluence) AS value FROM {FLUENCE} JOIN {LEAVES} ON high > z - 35e-1 AND low < z + 35e-1 GROUP BY beam, lp, col)"
QUANT = f"(SELECT beam, lp, col, least(greatest(round(value / (max(value) OVER (PARTITION BY beam)) * {LEVELS}), 0), {LEVELS})::INT AS q FROM (SELECT beam, lp, col, round(value, 9) AS value FROM {RESAMPLED}))"


def _bixels(t: Tables) -> DataFrame:
    rays = st.numbered(_rays(t))
    return rays.join(F.broadcast(st.bixel_offsets(rays)), "beam").select("beam", "ix", "iz", (F.col("first") + F.col("ray")).alias("bixel"))


def _fluence(t: Tables) -> DataFrame:
    b = _bixels(t)
    w = b.select("bixel", (F.abs(F.col("bixel") * 37 % 101) / 101.0).alias("weight"))
    z0 = b.groupBy("beam").agg(F.min("iz").alias("z0"))
    return sq.fluence_map(b, w).join(F.broadcast(z0), "beam").withColumn("z", (F.col("row") + F.col("z0")) * BW)


def _leaves(t: Tables) -> DataFrame:
    return sq.leaf_bounds(t.read("nation").select(F.col("n_nationkey").alias("lp"), (F.col("n_regionkey") + 5).cast("double").alias("width")))


def _quantised(t: Tables) -> DataFrame:
    r = sq.resampled(_fluence(t), _leaves(t), BW).withColumn("value", F.round("value", 9))  # sums stay equal, whatever their order
    top = r.groupBy("beam").agg(F.max("value").alias("top"))
    return r.join(F.broadcast(top), "beam").select("beam", "lp", "col", sq.quantised(F.col("value"), F.col("top"), LEVELS).alias("q"))


@query("jn12_fluence_map", f"SELECT beam, row, col, round(fluence, 6) AS fluence FROM {FLUENCE}")
def _(t):
    return _fluence(t).select("beam", "row", "col", "fluence")


@query("wn07_leaf_bounds", f"SELECT lp, round(low, 6) AS low, round(high, 6) AS high FROM {LEAVES}")
def _(t):
    return _leaves(t)


@query("jn14_rows_to_leaves", f"SELECT beam, row, col, coalesce(lp, -1) AS lp FROM {FLUENCE} LEFT JOIN {LEAVES} ON z >= low AND z < high")
def _(t):
    return sq.rows_to_pairs(_fluence(t), _leaves(t)).select("beam", "row", "col", "lp")


@query("jn16_field_leaves", f"SELECT beam, lp FROM (SELECT beam, min(z) - 35e-1 AS bottom, max(z) + 35e-1 AS top FROM {FLUENCE} GROUP BY beam) JOIN {LEAVES} ON high > bottom AND low < top")
def _(t):
    return sq.field_pairs(_fluence(t), _leaves(t), BW).select("beam", "lp")


@query("jn15_leaf_resample", f"SELECT beam, lp, col, round(value, 6) AS value FROM {RESAMPLED}")
def _(t):
    return sq.resampled(_fluence(t), _leaves(t), BW)


@query("sf22_quantize", QUANT[1:-1])
def _(t):
    return _quantised(t)


@query("wn09_openings", f"SELECT beam, l.i::INT AS level, lp, min(col) AS \"left\", max(col) AS \"right\" FROM {QUANT} JOIN range(1, {LEVELS + 1}) l(i) ON q >= l.i GROUP BY ALL")
def _(t):
    return sq.openings(_quantised(t))


RUNS = f"(SELECT beam, coalesce(lag(q) OVER (PARTITION BY beam ORDER BY q), 0) + 1 AS first_level, q - coalesce(lag(q) OVER (PARTITION BY beam ORDER BY q), 0) AS weight FROM (SELECT DISTINCT beam, q FROM {QUANT} WHERE q > 0))"


@query("wn08_shape_runs", RUNS[1:-1])
def _(t):
    return sq.shape_runs(_quantised(t))


@query("ak32_merged_segments", f"""
WITH RECURSIVE r AS (SELECT *, row_number() OVER (PARTITION BY beam ORDER BY first_level) AS n FROM {RUNS}),
g AS (SELECT beam, n, first_level AS start, weight AS held, 0 AS part FROM r WHERE n = 1
  UNION ALL SELECT r.beam, r.n, CASE WHEN held / 1e1 >= 15e-2 THEN r.first_level ELSE start END, CASE WHEN held / 1e1 >= 15e-2 THEN r.weight ELSE held + r.weight END, CASE WHEN held / 1e1 >= 15e-2 THEN part + 1 ELSE part END FROM g JOIN r ON r.beam = g.beam AND r.n = g.n + 1),
w AS (SELECT beam, part, min(start) AS start, max(held) AS held, max(part) OVER (PARTITION BY beam) AS last FROM g GROUP BY beam, part),
m AS (SELECT beam, CASE WHEN part = last AND held / 1e1 < 15e-2 AND last > 0 THEN part - 1 ELSE part END AS part, start, held FROM w)
SELECT beam, min(start)::INT AS first_level, sum(held)::INT AS weight, round(sum(held) / 1e1, 6) AS mu FROM m GROUP BY beam, part""")
def _(t):
    return sq.merged_runs(sq.shape_runs(_quantised(t)), LEVELS, 1.0, 0.15)


@query("ak31_leaf_banks", f"SELECT beam, level, lp, round(round((lft * 7 - 35e-1) / 5e-1) * 5e-1, 6) AS bank_a, round(round((rgt * 7 + 35e-1) / 5e-1) * 5e-1, 6) AS bank_b FROM (SELECT beam, l.i::INT AS level, lp, min(col) AS lft, max(col) AS rgt FROM {QUANT} JOIN range(1, {LEVELS + 1}) l(i) ON q >= l.i GROUP BY ALL)")
def _(t):
    return sq.banks(sq.openings(_quantised(t)), BW, 0.5)


EXACT_FIDELITY = f"""
WITH p AS (SELECT f.beam, f.fluence AS a, coalesce(q.q, 0) / 1e1 AS b FROM (SELECT beam, row, col, fluence, coalesce(lp, -1) AS lp FROM {FLUENCE} LEFT JOIN {LEAVES} ON z >= low AND z < high) f LEFT JOIN {QUANT} q USING (beam, lp, col))
SELECT beam, CASE WHEN var_pop(a) < 1e-24 AND var_pop(b) < 1e-24 THEN 1e0 WHEN var_pop(a) < 1e-24 OR var_pop(b) < 1e-24 THEN 0e0 ELSE covar_pop(a, b) / sqrt(var_pop(a) * var_pop(b)) END AS fidelity, count(*) AS n FROM p GROUP BY beam"""
FIDELITY = f"SELECT beam, round(fidelity, 6) AS fidelity, n FROM ({EXACT_FIDELITY})"


def _fidelity(t: Tables) -> DataFrame:
    f = sq.rows_to_pairs(_fluence(t), _leaves(t))
    both = f.join(_quantised(t), ["beam", "lp", "col"], "left").select("beam", F.col("fluence").alias("a"), sq.deliverable(F.coalesce("q", F.lit(0)), LEVELS, F.lit(1.0)).alias("b"))
    return sq.fidelity(both)


query("ag26_fidelity", FIDELITY)(_fidelity)


# Masks

CELLS = "(SELECT (event_id // 4000)::BIGINT AS k, (user_id % 12)::INT AS i, (event_id % 12)::INT AS j FROM events GROUP BY ALL HAVING avg(value) > 70)"


def _cells(t: Tables) -> DataFrame:
    """Cells of a slice whose mean value is over a threshold, of all rows; slices grow with the table."""
    e, u = F.col("event_id"), F.col("user_id")
    cells = t.read("events").groupBy(F.floor(e / 4000).alias("k"), (u % 12).cast("int").alias("i"), (e % 12).cast("int").alias("j"))
    return cells.agg(F.avg("value").alias("mean")).where("mean > 70").select("k", "i", "j")


@query("wn11_row_edges", f'SELECT k, i, min(j) AS "left", max(j) AS "right" FROM {CELLS} GROUP BY k, i')
def _(t):
    return mo.row_edges(_cells(t))


@query("ak19_components", f"""
WITH RECURSIVE c AS (SELECT k, i, j, (j * 12 + i)::BIGINT AS id FROM {CELLS}),
reach AS (SELECT k, i, j, id FROM c UNION SELECT c.k, c.i, c.j, r.id FROM reach r JOIN c ON c.k = r.k AND abs(c.i - r.i) + abs(c.j - r.j) = 1)
SELECT k, i, j, min(id) AS label FROM reach GROUP BY k, i, j""")
def _(t):
    return mo.component_labels(_cells(t), 12, 12)


@query("ak17_filled_body", f"""
WITH RECURSIVE c AS (SELECT * FROM {CELLS}), grid AS (SELECT k, a.i::INT AS i, b.i::INT AS j FROM (SELECT DISTINCT k FROM c), range(12) a(i), range(12) b(i)),
free AS (SELECT * FROM grid EXCEPT SELECT k, i, j FROM c),
outer_ AS (SELECT * FROM free WHERE i IN (0, 11) OR j IN (0, 11) UNION SELECT f.k, f.i, f.j FROM outer_ o JOIN free f ON f.k = o.k AND abs(f.i - o.i) + abs(f.j - o.j) = 1),
body AS (SELECT k, i, j, (j * 12 + i)::BIGINT AS id FROM (SELECT * FROM grid EXCEPT SELECT * FROM outer_)),
reach AS (SELECT k, i, j, id FROM body UNION SELECT b.k, b.i, b.j, r.id FROM reach r JOIN body b ON b.k = r.k AND abs(b.i - r.i) + abs(b.j - r.j) = 1),
label AS (SELECT k, i, j, min(id) AS id FROM reach GROUP BY k, i, j),
top AS (SELECT k, id FROM label GROUP BY k, id QUALIFY row_number() OVER (PARTITION BY k ORDER BY count(*) DESC, id) = 1)
SELECT k, i, j FROM label JOIN top USING (k, id)""")
def _(t):
    return mo.filled_body(_cells(t), 12, 12)


@query("ak20_outline", f"""
WITH e AS (SELECT k, i, min(j) AS l, max(j) AS r FROM {CELLS} GROUP BY k, i), p AS (SELECT k, 0 AS side, i AS o, i, r AS j FROM e UNION ALL SELECT k, 1, -i, i, l FROM e)
SELECT k, (row_number() OVER (PARTITION BY k ORDER BY side, o) - 1)::INT AS pos, j::DOUBLE AS x, i::DOUBLE AS y FROM p""")
def _(t):
    return mo.outline(mo.row_edges(_cells(t)))


@query("ak10_rasterize", """
WITH c AS (SELECT s_suppkey AS struct_id, s_suppkey % 4 AS k, 16 + s_suppkey % 7 + 25e-2 AS cx, 15 + s_suppkey % 5 + 35e-2 AS cy, 4 + s_suppkey % 6 AS r FROM supplier),
e AS (SELECT struct_id, k, cx + r * cos(n.i * pi() / 4) AS x1, cy + r * sin(n.i * pi() / 4) AS y1, cx + r * cos((n.i + 1) % 8 * pi() / 4) AS x2, cy + r * sin((n.i + 1) % 8 * pi() / 4) AS y2 FROM c, range(8) n(i)),
x AS (SELECT struct_id, k, g.i, x1 + (g.i - y1) * (x2 - x1) / (y2 - y1) AS x FROM e, range(32) g(i) WHERE (y1 <= g.i AND g.i < y2) OR (y2 <= g.i AND g.i < y1)),
n AS (SELECT *, row_number() OVER (PARTITION BY struct_id, k, i ORDER BY x) AS rn FROM x),
s AS (SELECT struct_id, k, i, min(x) AS a, max(x) AS b FROM n GROUP BY struct_id, k, i, (rn - 1) // 2 HAVING count(*) = 2)
SELECT DISTINCT struct_id, s.i::INT AS i, j.i::INT AS j, k FROM s JOIN range(32) j(i) ON j.i BETWEEN a AND b""")
def _(t):
    s = F.col("s_suppkey")
    cx, cy, r = 16 + s % 7 + F.lit(0.25), 15 + s % 5 + F.lit(0.35), 4 + s % 6
    octagon = F.array(*[F.struct((cx + r * F.cos(F.lit(float(n)) * F.pi() / 4)).alias("x"), (cy + r * F.sin(F.lit(float(n)) * F.pi() / 4)).alias("y")) for n in range(8)])
    contours = t.read("supplier").select(s.alias("struct_id"), F.lit(0).alias("contour_id"), (s % 4).alias("k"), octagon.alias("points"))
    return mo.rasterized(contours, 0.0, 1.0, 32, 0.0, 1.0, 32)


@query("ak11_dilate", f"""
WITH RECURSIVE allowed AS (SELECT * FROM {VOXELS}), target AS (SELECT DISTINCT i, j, k FROM {URGENT}),
g AS (SELECT i, j, k, 0 AS step FROM target UNION SELECT a.i, a.j, a.k, g.step + 1 FROM g JOIN allowed a ON abs(a.i - g.i) <= 1 AND abs(a.j - g.j) <= 1 AND abs(a.k - g.k) <= CASE WHEN g.step < 1 THEN 1 ELSE 0 END
  WHERE g.step < 2 AND g.i BETWEEN 1 AND 58 AND g.j BETWEEN 1 AND 48 AND g.k BETWEEN 1 AND 38)
SELECT DISTINCT i, j, k FROM g""")
def _(t):
    v = _voxels(t)
    return mo.dilated(_urgent(t), v, (60, 50, 40), (1.0, 1.0, 2.0), (2.0, 2.0, 2.0))


@query("ak37_blur", f"""
WITH v AS (SELECT p_partkey % 10 AS i, (p_partkey // 10) % 10 AS j, (p_partkey // 100) % 4 AS k, avg(p_retailprice) / 100 AS v FROM part GROUP BY ALL)
SELECT a.i, a.j, a.k, round(CASE WHEN a.i BETWEEN 1 AND 8 AND a.j BETWEEN 1 AND 8 AND a.k BETWEEN 1 AND 2 THEN sum(b.v / (1 + abs(a.i - b.i) + abs(a.j - b.j) + abs(a.k - b.k))) / (1 + 6 / 2e0 + 12 / 3e0 + 8 / 4e0) ELSE 0e0 END, 6) AS v
FROM v a JOIN v b ON abs(a.i - b.i) <= 1 AND abs(a.j - b.j) <= 1 AND abs(a.k - b.k) <= 1 GROUP BY a.i, a.j, a.k""")
def _(t):
    p = F.col("p_partkey")
    volume = t.read("part").groupBy((p % 10).alias("i"), (F.floor(p / 10) % 10).alias("j"), (F.floor(p / 100) % 4).alias("k")).agg((F.avg("p_retailprice") / 100).alias("v"))
    return mo.blurred(volume, (10, 10, 4))


_SAMPLES = "(SELECT o_orderstatus AS structure, o_custkey % 60 AS i, o_orderkey % 50 AS j, (o_orderkey // 50) % 40 AS k, max(o_totalprice)::DOUBLE / 4e5 AS value FROM orders GROUP BY ALL)"
#: Vertices by themselves: the lattice edges of which one end exceeds the level.
_VERTICES = f"""(
WITH f AS {_SAMPLES}, a AS (SELECT unnest([0, 1, 2]) AS axis),
e AS (SELECT DISTINCT structure, i - d * (axis = 0)::INT AS i, j - d * (axis = 1)::INT AS j, k - d * (axis = 2)::INT AS k, axis FROM f, a, (SELECT unnest([0, 1]) AS d)),
v AS (SELECT e.*, coalesce(p.value, 0e0) AS low, coalesce(q.value, 0e0) AS high FROM e LEFT JOIN f p USING (structure, i, j, k)
  LEFT JOIN f q ON q.structure = e.structure AND q.i = e.i + (axis = 0)::INT AND q.j = e.j + (axis = 1)::INT AND q.k = e.k + (axis = 2)::INT)
SELECT *, (5e-1 - low) / (high - low) AS part FROM v WHERE (low > 5e-1) <> (high > 5e-1))"""


def _surface(t: Tables) -> DataFrame:
    key = F.col("o_orderkey")
    samples = t.read("orders").groupBy(F.col("o_orderstatus").alias("structure"), (F.col("o_custkey") % 60).alias("i"), (key % 50).alias("j"), (F.floor(key / 50) % 40).alias("k")).agg((F.max("o_totalprice").cast("double") / 4e5).alias("value"))
    return su.placed(su.triangles(samples, 0.5, ("structure",)), 0.5, CT.spacing, CT.origin, ("structure",))


@query("ak36_surface_vertices", f"SELECT structure, i, j, k, axis, round((i + CASE WHEN axis = 0 THEN part ELSE 0 END) * 1e0 - 20, 6) AS x, round((j + CASE WHEN axis = 1 THEN part ELSE 0 END) * 15e-1 + 5, 6) AS y, round((k + CASE WHEN axis = 2 THEN part ELSE 0 END) * 2e0, 6) AS z FROM {_VERTICES}")
def _(t):
    """AK-36, ST-09: the vertices that the surfaces' triangles share, each once."""
    return su.vertices(_surface(t), ("structure",)).drop("nx", "ny", "nz")


@query("st09_closed_surfaces", f"SELECT structure, count(*) AS vertices, 0::BIGINT AS uneven, true AS outward FROM {_VERTICES} GROUP BY structure")
def _(t):
    """ST-09: vertices of each surface, edges along which triangles do not run both ways alike, and whether it encloses a volume with its normals outward."""
    found = cut(_surface(t))
    key = ("structure",)
    uneven = su.edges(found, key).groupBy(*key).agg(F.count_if(F.col("forward") != F.col("backward")).alias("uneven"))
    counts = su.vertices(found, key).groupBy(*key).agg(F.count(F.lit(1)).alias("vertices"))
    return counts.join(uneven, *key).join(su.measures(found, key), *key).select(*key, "vertices", "uneven", (F.col("volume") > 0).alias("outward"))


@query("st01_union_voxels", f"SELECT i, j, k FROM {VOXELS} UNION SELECT p_partkey % 60, p_size % 50, p_partkey % 40 FROM part")
def _(t):
    """ST-01 to ST-06: voxels of all structures, each once."""
    p = F.col("p_partkey")
    return _voxels(t).unionByName(t.read("part").select((p % 60).alias("i"), (F.col("p_size") % 50).cast("long").alias("j"), (p % 40).alias("k"))).distinct()


@query("st07_intersect_difference", f"SELECT v.i, v.j, v.k, CASE WHEN p.i IS NULL THEN 'only' ELSE 'both' END AS side FROM {VOXELS} v LEFT JOIN (SELECT DISTINCT p_partkey % 60 AS i, p_size % 50 AS j, p_partkey % 40 AS k FROM part) p USING (i, j, k)")
def _(t):
    """ST-07, ST-08."""
    p = F.col("p_partkey")
    v, other = _voxels(t), t.read("part").select((p % 60).alias("i"), (F.col("p_size") % 50).cast("long").alias("j"), (p % 40).alias("k")).distinct()
    on = ["i", "j", "k"]
    return v.join(other, on, "left_semi").withColumn("side", F.lit("both")).unionByName(v.join(other, on, "left_anti").withColumn("side", F.lit("only")))


@query("pf05_cone_prefilter", f"""
WITH lim AS (SELECT beam, max(sqrt(ix * ix + iz * iz)) * 7 AS off FROM {RAYS} WHERE abs(ix) <= 3 AND abs(iz) <= 3 GROUP BY beam)
SELECT beam, count(*) AS n FROM {BEV} JOIN lim USING (beam) WHERE 1e3 + b_y > 1 AND bx * bx + bz * bz <= pow((off + 5) / 1e3, 2) * pow(1e3 + b_y, 2) GROUP BY beam""")
def _(t):
    """PF-05, AG-31: points within a beam's cone, from its largest ray offset."""
    limit = _rays(t).where("abs(ix) <= 3 and abs(iz) <= 3").groupBy("beam").agg((F.max(F.sqrt(F.col("ix") * F.col("ix") + F.col("iz") * F.col("iz"))) * BW).alias("off"))
    x, y, z = st.to_bev(F.col("gantry"), F.col("couch"), (F.col("x"), F.col("y"), F.col("z")), (0.0, 0.0, 0.0))
    bev = t.points().crossJoin(F.broadcast(_plan(t))).select("beam", x.alias("bx"), y.alias("by"), z.alias("bz")).join(F.broadcast(limit), "beam")
    depth = F.lit(SAD) + F.col("by")
    return bev.where((depth > 1) & (F.col("bx") * F.col("bx") + F.col("bz") * F.col("bz") <= F.pow((F.col("off") + 5) / SAD, 2) * F.pow(depth, 2))).groupBy("beam").agg(F.count(F.lit(1)).alias("n"))


CUT = 10.0


@query("jn07_ray_voxel", f"""
WITH b AS (SELECT beam, bx * 1e3 / (1e3 + b_y) AS u, bz * 1e3 / (1e3 + b_y) AS v FROM {BEV})
SELECT r.beam, r.ix, r.iz, count(*) AS n, round(sum(sqrt(pow(u - ix * 7, 2) + pow(v - iz * 7, 2))), 4) AS total FROM {RAYS} r JOIN b ON b.beam = r.beam AND pow(u - ix * 7, 2) + pow(v - iz * 7, 2) <= {CUT * CUT}::DOUBLE GROUP BY r.beam, r.ix, r.iz""", digits=4)
def _(t):
    """JN-07, PF-06: points within the cut-off of a ray, met in cells of the cut-off's size: an equi-join on the nine cells around."""
    x, y, z = st.to_bev(F.col("gantry"), F.col("couch"), (F.col("x"), F.col("y"), F.col("z")), (0.0, 0.0, 0.0))
    flat = t.points().crossJoin(F.broadcast(_plan(t))).select("beam", fc.project_to_iso(x, y, SAD).alias("u"), fc.project_to_iso(z, y, SAD).alias("v"))
    cells = flat.withColumn("cu", F.floor(F.col("u") / CUT)).withColumn("cv", F.floor(F.col("v") / CUT))
    around = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)]))
    rays = _rays(t).select("beam", "ix", "iz", around.alias("d")).select("beam", "ix", "iz", (F.floor(F.col("ix") * BW / CUT) + F.col("d.a")).alias("cu"), (F.floor(F.col("iz") * BW / CUT) + F.col("d.b")).alias("cv"))
    d2 = F.pow(F.col("u") - F.col("ix") * BW, 2) + F.pow(F.col("v") - F.col("iz") * BW, 2)
    return rays.join(cells, ["beam", "cu", "cv"]).withColumn("d2", d2).where(F.col("d2") <= CUT * CUT).groupBy("beam", "ix", "iz").agg(F.count(F.lit(1)).alias("n"), F.sum(F.sqrt("d2")).alias("total"))


@query("jn13_deliverable_dose", f"SELECT voxel, round(sum(value * w), 6) AS dose FROM (SELECT l_partkey AS voxel, l_suppkey AS bixel, l_quantity / 50 AS value FROM lineitem) JOIN (SELECT s_suppkey AS bixel, least(greatest(round(greatest(s_acctbal, 0e0) / 1e4 * 20), 0), 20) / 2e1 * 1e1 AS w FROM supplier) USING (bixel) GROUP BY voxel")
def _(t):
    """JN-13, AK-33: weights at their deliverable level, then the forward product."""
    level = sq.quantised(F.col("weight"), F.lit(10.0), 20)
    w = t.weights().select("bixel", sq.deliverable(level, 20, F.lit(10.0)).alias("weight"))
    return sp.combined(t.entries()).join(w, "bixel").groupBy("voxel").agg(F.sum(F.col("value") * F.col("weight")).alias("dose"))


@query("sf20_depth_dose", """
WITH d AS (SELECT p_partkey, (p_size - 3)::DOUBLE AS depth, 9e2 + p_size AS geo FROM part)
SELECT p_partkey, round(CASE WHEN depth <= 0 OR geo < 1 THEN 0e0 ELSE greatest((3252e-4 / (3252e-4 - 5066e-6) * (exp(-5066e-6 * depth) - exp(-3252e-4 * depth)) * 3e-1
  + 16e-3 / (16e-3 - 5066e-6) * (exp(-5066e-6 * depth) - exp(-16e-3 * depth)) * 2e-1 + 5066e-6 * depth * exp(-5066e-6 * depth) * 1e-1) * pow(1e3 / geo, 2), 0e0) END, 6) AS dose FROM d""")
def _(t):
    rows = t.read("part").select("p_partkey", (F.col("p_size") - 3).cast("double").alias("depth"), (F.col("p_size") + 900.0).alias("geo"))
    k = [F.lit(0.3), F.lit(0.2), F.lit(0.1)]
    return rows.select("p_partkey", fc.depth_dose(F.col("depth"), (0.3252, 0.016, 0.005066), 0.005066, k, F.col("geo"), SAD).alias("dose"))

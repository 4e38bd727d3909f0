"""Queries on whole steps of planning: ray sets, dose influence, objectives, statistics, sequencing, particles of all beams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as fc
from ..functions.lineage import shared_folder
from ..operators import analysis as an
from ..operators import catalog as ca
from ..operators import grids as gr
from ..operators import morphology as mo
from ..operators import objectives as ob
from ..operators import particles as ps
from ..operators import pencil as pb
from ..operators import sequencing as sq
from ..operators import sparse as sp
from ..operators import steering as st
from ..operators import workflow as wf
from . import geometry as ge
from .dose import DIJ, EDGES, FORWARD, _placed, _stats_sql
from .phase_space import NAMES, WITH_W, _names
from .registry import query
from .tables import ENTRIES, POINTS, WEIGHTS, Tables

# Ray sets


@query("ak14_field_rays", f"""
SELECT beam, (z.i * 7 + x.i)::BIGINT AS pos, round(round((-21 + x.i * 7) / 7e0, 9))::BIGINT AS ix, round(round((-245e-1 + z.i * 7) / 7e0, 9))::BIGINT AS iz FROM {ge.PLAN}, range(7) x(i), range(8) z(i)""")
def _(t):
    return st.field_rays(ge._plan(t), ge.BW, (42.0, 49.0))


@query("ak15_ray_set", ge.bixels_sql(ge.NUMBERED)[1:-1])
def _(t):
    return st.ray_set(t.points(), ge._plan(t), ge.SAD, ge.BW, (1.0, 1.5, 2.0))


MARGIN = f"""
WITH RECURSIVE allowed AS (SELECT * FROM {ge.VOXELS}), target AS (SELECT DISTINCT i, j, k FROM {ge.URGENT}),
g AS (SELECT i, j, k, 0 AS step FROM target UNION SELECT a.i, a.j, a.k, g.step + 1 FROM g JOIN allowed a ON abs(a.i - g.i) <= 1 AND abs(a.j - g.j) <= CASE WHEN g.step < 1 THEN 1 ELSE 0 END AND abs(a.k - g.k) <= CASE WHEN g.step < 1 THEN 1 ELSE 0 END
  WHERE g.step < 2 AND g.i BETWEEN 1 AND 58 AND g.j BETWEEN 1 AND 48 AND g.k BETWEEN 1 AND 38)
SELECT DISTINCT round(j * 15e-1 + 5, 6) AS x, round(i * 1e0 - 20, 6) AS y, round(k * 2e0, 6) AS z FROM g"""


@query("ak12_target_margin", MARGIN)
def _(t):
    """AK-12: the grown target's positions in patient axes."""
    v = ge._voxels(t)
    grown = mo.with_margin(ge._urgent(t), v, ge.CT.dims, ge.CT.spacing, 2.0)
    return grown.select(*[ge.CT.position(a, F.col(n)).alias(c) for a, n, c in ((1, "j", "x"), (0, "i", "y"), (2, "k", "z"))])


TARGETS = f"(SELECT * FROM {POINTS} WHERE x > 0)"
ISO = f"(SELECT avg(x) AS ox, avg(y) AS oy, avg(z) AS oz FROM {TARGETS})"


@query("ak16_plan", f"""
WITH p AS (SELECT id, x - ox AS x, y - oy AS y, z - oz AS z FROM {TARGETS}, {ISO}), r AS (SELECT beam, count(*) AS rays FROM {ge.rays_sql(ge.bev_sql(ge.PLAN, "p"))} GROUP BY beam)
SELECT beam, gantry, couch, round(ox, 4) AS iso_x, round(oy, 4) AS iso_y, round(oz, 4) AS iso_z, rays FROM {ge.PLAN} JOIN r USING (beam), {ISO}""", digits=4)
def _(t):
    """AK-16: isocentre of the targets, beams, and their rays."""
    target = t.points().where("x > 0")
    iso = target.agg(*[F.avg(c).alias(f"o{c}") for c in "xyz"])
    centred = target.crossJoin(F.broadcast(iso)).select(*[(F.col(c) - F.col(f"o{c}")).alias(c) for c in "xyz"])
    rays = st.target_rays(centred, ge._plan(t), ge.SAD, ge.BW).groupBy("beam").agg(F.count(F.lit(1)).alias("rays"))
    return ge._plan(t).join(rays, "beam").crossJoin(F.broadcast(iso)).select("beam", "gantry", "couch", *[F.col(f"o{c}").alias(f"iso_{c}") for c in "xyz"], "rays")


@query("st02_target_union", f"SELECT DISTINCT p_partkey % 60 AS i, (p_partkey // 7) % 50 AS j, p_partkey % 40 AS k FROM {NAMES} WHERE kind IN ('PTV', 'GTV', 'CTV', 'TARGET')")
def _(t):
    p = F.col("p_partkey")
    return _names(t).where(fc.is_target_steering(F.col("kind"))).select((p % 60).alias("i"), (F.floor(p / 7) % 50).alias("j"), (p % 40).alias("k")).distinct()


# Dose influence

TILTED = f"(SELECT beam, gantry + 11 AS gantry, couch + 4 AS couch FROM {ge.PLAN})"
TBEV = ge.bev_sql(TILTED)
TBIXELS = ge.bixels_sql(ge.numbered_sql(ge.rays_sql(TBEV)))
MACHINE = pb.Machine(cutoff=8.0, betas=(0.3252, 0.016, 0.0051))
KERNEL_SSDS = (850.0, 900.0, 950.0, 1000.0, 1050.0)
_REACH = "(8 + 7 / sqrt(2e0))"
_K = [f"(exp(-(pow(x, 2) + pow(z, 2)) / (2 * pow({8 + 2 * c}, 2))) / ({c + 1} + kernel))" for c in range(3)]
_BILINEAR = [
    "(" + " + ".join(f"{wx} * {wz} * {k.replace('(x,', f'(lx + {a} - 20,').replace('(z,', f'(lz + {b} - 20,')}" for a, wx in ((0, "(1 - (ox + 20 - lx))"), (1, "(ox + 20 - lx)")) for b, wz in ((0, "(1 - (oz + 20 - lz))"), (1, "(oz + 20 - lz)"))) + ")"
    for k in _K
]
_TERM = [f"{b}::DOUBLE / ({b}::DOUBLE - 5066e-6) * (exp(-5066e-6 * depth) - exp(-{b}::DOUBLE * depth)) * {_BILINEAR[c]}" for c, b in enumerate(MACHINE.betas)]
_SX, _SY, _SZ = "1e3 * cc * sg", "-1e3 * cg", "-1e3 * sc * sg"

INFLUENCE = f"""
WITH bix AS (SELECT * FROM {TBIXELS}), angles AS (SELECT * FROM {ge.angles_sql(TILTED)}),
lim AS (SELECT beam, max(sqrt(ix * ix + iz * iz)) * 7 + {_REACH} AS reach FROM bix GROUP BY beam),
near AS (SELECT *, sqrt(bx * bx + pow(1e3 + b_y, 2) + bz * bz) AS geo FROM {TBEV} JOIN lim USING (beam) WHERE 1e3 + b_y > 1 AND bx * bx + bz * bz <= pow(reach / 1e3, 2) * pow(1e3 + b_y, 2)),
{ge.traced_sql(f"SELECT beam * 1000000 + id AS id, {_SX} AS sx, {_SY} AS sy, {_SZ} AS sz, x AS tx, y AS ty, z AS tz FROM near JOIN angles USING (beam)", "v")},
deep AS (SELECT ray AS id, sum(length * rho) - arg_max(length * rho, start) / 2 AS depth FROM vdense GROUP BY ray),
ends AS (SELECT beam, ray, {_SX} AS sx, {_SY} AS sy, {_SZ} AS sz, cc * cg * 14 * ix - cc * sg * 1e3 + sc * 14 * iz AS tx, sg * 14 * ix + cg * 1e3 AS ty, -sc * cg * 14 * ix + sc * sg * 1e3 + cc * 14 * iz AS tz FROM bix JOIN angles USING (beam)),
{ge.traced_sql("SELECT beam * 1000000 + ray AS id, sx, sy, sz, tx, ty, tz FROM ends", "r")},
ssd AS (SELECT e.beam, e.ray, tx, ty, tz, s.ssd FROM ends e LEFT JOIN (SELECT ray AS id, min(CASE WHEN rho > 5e-2 THEN start END) AS ssd FROM rdense GROUP BY ray) s ON s.id = e.beam * 1000000 + e.ray),
full_ssd AS (SELECT beam, ssd FROM ssd WHERE ssd > 0 UNION ALL SELECT m.beam, arg_min(v.ssd, (sqrt(pow(m.tx - v.tx, 2) + pow(m.ty - v.ty, 2) + pow(m.tz - v.tz, 2)), v.ray)) FROM ssd m JOIN ssd v ON v.beam = m.beam AND v.ssd > 0 WHERE m.ssd IS NULL OR m.ssd <= 0 GROUP BY m.beam, m.ray),
picked AS (SELECT beam, arg_min(k, (abs(mean_ssd - 850 - 50 * k), k)) AS kernel FROM (SELECT beam, avg(ssd) AS mean_ssd FROM full_ssd GROUP BY beam), range(5) r(k) GROUP BY beam),
pairs AS (SELECT n.id AS voxel, b.bixel, geo, coalesce(depth, 0e0) AS depth, kernel, (bx - ix * 7) * 1e3 / (1e3 + b_y) AS ox, (bz - iz * 7) * 1e3 / (1e3 + b_y) AS oz
  FROM near n JOIN bix b ON b.beam = n.beam JOIN picked p ON p.beam = n.beam LEFT JOIN deep d ON d.id = n.beam * 1000000 + n.id
  WHERE sqrt(pow((bx - ix * 7) * 1e3 / (1e3 + b_y), 2) + pow((bz - iz * 7) * 1e3 / (1e3 + b_y), 2)) <= {_REACH}),
placed AS (SELECT *, least(floor(ox + 20), 39) AS lx, least(floor(oz + 20), 39) AS lz FROM pairs),
doses AS (SELECT voxel, bixel, CASE WHEN depth <= 0 OR geo < 1 THEN 0e0 ELSE greatest(({" + ".join(_TERM)}) * pow(1e3 / geo, 2), 0e0) END AS value FROM placed)
SELECT voxel, bixel, round(value, 6) AS value FROM doses QUALIFY value >= greatest(5e-2 * max(value) OVER (PARTITION BY bixel), 1e-4)"""


def _tilted(t: Tables) -> DataFrame:
    return ge._plan(t).select("beam", (F.col("gantry") + 11).alias("gantry"), (F.col("couch") + 4).alias("couch"))


def _bell_grids(t: Tables) -> DataFrame:
    """Kernels given as Gaussians on a grid of 41 by 41 mm."""
    kernel, gx = F.col("kernel"), F.col("gx")
    row = lambda c, x: F.transform(F.sequence(F.lit(0), F.lit(40)), lambda z: F.exp(-(F.pow(x - 20, 2) + F.pow(z - 20, 2)) / (2.0 * (8 + 2 * c) ** 2)) / (c + 1 + kernel))
    base = t.spark.range(len(KERNEL_SSDS)).select(F.col("id").cast("int").alias("kernel")).select("kernel", F.explode(F.sequence(F.lit(0), F.lit(39))).alias("gx"))
    return base.select("kernel", "gx", F.lit(-20.0).alias("origin"), F.lit(1.0).alias("step"), F.lit(41).alias("n"), F.array(*[row(c, gx) for c in range(3)]).alias("a"), F.array(*[row(c, gx + 1) for c in range(3)]).alias("b"))


@query("ak08_dij", INFLUENCE)
def _(t):
    """AK-07, AK-08: from points, rays and density to thresholded entries, for kernels that SQL can state."""
    plan = _tilted(t)
    bixels = st.ray_set(t.points(), plan, ge.SAD, ge.BW, (1.0, 1.5, 2.0))
    kernels = t.spark.createDataFrame(list(enumerate(KERNEL_SSDS)), "kernel int, ssd double")
    return pb.influence(t.points().withColumnRenamed("id", "voxel"), plan, bixels, _bell_grids(t), kernels, MACHINE, ge.BW, density=ge._density(t), box=ge.BOX, relative=0.05, absolute=1e-4)


@query("ak09_kept_dij", INFLUENCE)
def _(t):
    """AK-09, IO-31: the same matrix from a store that keeps it by beam; computed where the store has not got it."""
    plan = _tilted(t)
    rays = st.ray_set(t.points(), plan, ge.SAD, ge.BW, (1.0, 1.5, 2.0))
    kernels = t.spark.createDataFrame(list(enumerate(KERNEL_SSDS)), "kernel int, ssd double")
    voxels = t.points().withColumnRenamed("id", "voxel")
    return wf.kept_influence(f"{shared_folder(t.spark)}/matrices", voxels, plan, rays, _bell_grids(t), kernels, MACHINE, ge.BW, density=ge._density(t), box=ge.BOX, keep=wf.Thresholds(0.05, 1e-4))[0]


# Objectives

_PART = "(substr(p_brand, 7)::INT % 5 + 1)"
STRUCTURES = f"(SELECT DISTINCT p_brand AS structure, (['PTV ', 'Lung ', 'Heart ', 'Cord ', 'CTV '])[{_PART}] || p_brand AS name, (['PTV', 'OAR', 'OAR', 'OAR', 'CTV'])[{_PART}] AS kind FROM part)"
SPECS = (ob.Spec("PTV ", "deviation", 30.0, 2.0), ob.Spec("Lung", "overdose", 20.0, 10.0), ob.Spec("CTV", "underdose", 35.0, 3.0), ob.Spec("Heart", "max_dvh", 15.0, 30.0, 30.0), ob.Spec("Cord", "max_dvh", 10.0, 200.0, 0.0))
_LINES = "(VALUES (0, 'PTV ', 'deviation', 3e1, 2e0, 0e0), (1, 'Lung', 'overdose', 2e1, 1e1, 0e0), (2, 'CTV', 'underdose', 35e0, 3e0, 0e0), (3, 'Heart', 'max_dvh', 15e0, 3e1, 3e-1), (4, 'Cord', 'max_dvh', 1e1, 2e2, 0e0)) s(line, pattern, what, dose, weight, fraction)"
OBJECTIVES = f"""(SELECT (row_number() OVER (ORDER BY line, structure) - 1)::INT AS objective, structure, kind, dose, weight, fraction, n FROM (
  SELECT t.structure, s.line, s.what AS kind, s.dose, s.weight, s.fraction FROM {STRUCTURES} t JOIN {_LINES} ON contains(t.name, s.pattern)
  UNION ALL SELECT structure, -1, 'min_dvh', 6e1, 1e2, 98e-2 FROM {STRUCTURES} WHERE regexp_matches(kind, 'TARGET|PTV|CTV|GTV') OR regexp_matches(name, 'PTV|CTV|GTV'))
  JOIN (SELECT p_brand AS structure, count(*) AS n FROM part GROUP BY 1) USING (structure))"""
_FREE = "CASE kind WHEN 'min_dvh' THEN rank >= floor((1e0 - fraction) * n) ELSE rank < n - ceil(fraction * n) END"
TERMS = f"""(SELECT objective, voxel,
    CASE kind WHEN 'deviation' THEN weight * (x - dose) * (x - dose) / n WHEN 'overdose' THEN weight * pow(greatest(x - dose, 0e0), 2) / n WHEN 'underdose' THEN weight * pow(greatest(dose - x, 0e0), 2) / n
      WHEN 'min_dvh' THEN CASE WHEN {_FREE} THEN weight * pow(greatest(dose - x, 0e0), 2) ELSE 0e0 END ELSE CASE WHEN {_FREE} THEN weight * pow(greatest(x - dose, 0e0), 2) ELSE 0e0 END END AS f,
    CASE kind WHEN 'deviation' THEN 2 * weight * (x - dose) / n WHEN 'overdose' THEN 2 * weight * greatest(x - dose, 0e0) / n WHEN 'underdose' THEN -2 * weight * greatest(dose - x, 0e0) / n
      WHEN 'min_dvh' THEN CASE WHEN {_FREE} THEN -2 * weight * greatest(dose - x, 0e0) ELSE 0e0 END ELSE CASE WHEN {_FREE} THEN 2 * weight * greatest(x - dose, 0e0) ELSE 0e0 END END AS g
  FROM (SELECT o.*, d.voxel, d.dose AS x, row_number() OVER (PARTITION BY objective ORDER BY d.dose, d.voxel) - 1 AS rank
    FROM {OBJECTIVES} o JOIN part p ON p.p_brand = o.structure JOIN (SELECT voxel, round(dose, 9) AS dose FROM {FORWARD}) d ON d.voxel = p.p_partkey))"""
HOT = "greatest(round(dose, 9) - 1.04::DOUBLE * 60, 0e0)"
VOXELS = f"(SELECT voxel, sum(f) AS f, sum(g) AS g FROM (SELECT voxel, f, g FROM {TERMS} UNION ALL SELECT voxel, 2e3 * pow({HOT} / 60, 2) * (1 + 10 * {HOT} / 60) * pow({HOT}, 2), 4e3 * {HOT} / 60 * (1 + 15 * {HOT} / 60) * {HOT} FROM {FORWARD}) GROUP BY voxel)"
SPOT = ob.Hotspot(60.0)


def _built(t: Tables) -> tuple[DataFrame, DataFrame]:
    part = t.read("part")
    at = lambda *x: F.element_at(F.array(*map(F.lit, x)), F.substring("p_brand", 7, 2).cast("int") % 5 + 1)
    structures = part.select(F.col("p_brand").alias("structure"), F.concat(at("PTV ", "Lung ", "Heart ", "Cord ", "CTV "), "p_brand").alias("name"), at("PTV", "OAR", "OAR", "OAR", "CTV").alias("kind")).distinct()
    return ob.built(t.spark, SPECS, structures, part.select(F.col("p_brand").alias("structure"), F.col("p_partkey").alias("voxel")), target_dose=60.0)


def _dose(t: Tables) -> DataFrame:
    dose = sp.forward(sp.combined(t.entries()), t.weights(), t.read("part").select(F.col("p_partkey").alias("voxel")))
    return dose.withColumn("dose", F.round("dose", 9))  # equal doses stay equal, whatever the order of their sums


@query("ak23_objectives", f"SELECT objective, structure, kind, dose, weight, fraction, n FROM {OBJECTIVES}")
def _(t):
    return _built(t)[0]


@query("ag14_voxel_gradients", f"SELECT objective, voxel, round(f, 5) AS f, round(g, 5) AS g FROM {TERMS}", digits=5)
def _(t):
    """AG-11 to AG-14: every objective's value and gradient by voxel."""
    objectives, goals = _built(t)
    return ob.terms(_dose(t), objectives, goals)


@query("ag17_total_gradient", f"""
WITH v AS (SELECT * FROM {VOXELS}),
s AS (SELECT bixel, sum(2 * 1e-1 * (a.weight - b.weight)) AS grad FROM {EDGES} e JOIN {WEIGHTS} a USING (bixel) JOIN {WEIGHTS} b ON b.bixel = e.neighbor GROUP BY bixel),
m AS (SELECT bixel, sum(value * g) AS grad FROM {DIJ} JOIN v USING (voxel) WHERE g <> 0 GROUP BY bixel)
SELECT bixel, round(coalesce(m.grad, 0e0) + coalesce(s.grad, 0e0) + 2e-2 * weight + CASE WHEN weight > 0 THEN 5e-2 ELSE 0e0 END, 3) AS grad FROM {WEIGHTS} LEFT JOIN m USING (bixel) LEFT JOIN s USING (bixel)""", digits=3)
def _(t):
    """AG-17 with all its terms: five kinds of objectives, hot spots, smoothing, L2 and L1."""
    objectives, goals = _built(t)
    dij, w = sp.combined(t.entries()), t.weights()
    main = sp.transposed(dij, ob.evaluated(_dose(t), objectives, goals, SPOT).select("voxel", "g"))
    smooth = sp.smoothing(sp.neighbours(_placed(t)), w, 0.1)[1].withColumnRenamed("grad", "smooth")
    x = F.col("weight")
    total = F.coalesce("grad", F.lit(0.0)) + F.coalesce("smooth", F.lit(0.0)) + 0.02 * x + F.when(x > 0, 0.05).otherwise(0.0)
    return w.join(main, "bixel", "left").join(smooth, "bixel", "left").select("bixel", total.alias("grad"))


@query("ag17_objective_value", f"SELECT round(sum(f), 3) AS f FROM {VOXELS}", digits=3)
def _(t):
    objectives, goals = _built(t)
    return ob.evaluated(_dose(t), objectives, goals, SPOT).agg(F.sum("f").alias("f"))


@query("pf18_valid_voxels", f"SELECT voxel, bixel, round(value, 6) AS value FROM (SELECT voxel + CASE WHEN bixel = 3 THEN (SELECT count(*) FROM part) WHEN bixel = 4 THEN -(SELECT count(*) FROM part) ELSE 0 END AS voxel, bixel, value FROM {ENTRIES}) WHERE voxel BETWEEN 0 AND (SELECT count(*) FROM part) - 1")
def _(t):
    """PF-18: the grid has as many voxels as the table; entries of two bixels are moved beyond either end."""
    total = t.read("part").count()
    moved = F.col("voxel") + F.when(F.col("bixel") == 3, total).when(F.col("bixel") == 4, -total).otherwise(0)
    return ob.valid_voxels(t.entries().withColumn("voxel", moved), total)


# Statistics and sequencing

COARSE = gr.Grid((10, 10, 2), (6.0, 8.0, 50.0), ge.CT.origin)
_AT = [f"(({ge._place(ge.CT, a, n)}) - {COARSE.origin[a]}::DOUBLE) / {COARSE.spacing[a]}::DOUBLE" for a, n in enumerate("ijk")]
PLANNED = f"""(SELECT structure, sum((1 - abs(fi - d.i)) * (1 - abs(fj - d.j)) * (1 - abs(fk - d.k)) * d.dose) AS dose
  FROM (SELECT *, least(floor(fi), 8)::BIGINT AS li, least(floor(fj), 8)::BIGINT AS lj FROM (SELECT 's' || (i + j) % 6 AS structure, i, j, k, least(greatest({_AT[0]}, 0e0), 9e0) AS fi, least(greatest({_AT[1]}, 0e0), 9e0) AS fj, least(greatest({_AT[2]}, 0e0), 1e0) AS fk
    FROM {ge.VOXELS} WHERE {_AT[0]} BETWEEN -5e-1 AND 95e-1 AND {_AT[1]} BETWEEN -5e-1 AND 95e-1 AND {_AT[2]} BETWEEN -5e-1 AND 15e-1)) v
  JOIN {ge.FIELD} d ON d.i BETWEEN li AND li + 1 AND d.j BETWEEN lj AND lj + 1 GROUP BY structure, v.i, v.j, v.k)"""


def _planned(t: Tables) -> DataFrame:
    voxels = ge._voxels(t).withColumn("structure", F.concat(F.lit("s"), (F.col("i") + F.col("j")) % 6))
    return gr.sampled(voxels, ge.CT, COARSE, ge._field(t))


@query("ak35_plan_statistics", _stats_sql(PLANNED), digits=9)
def _(t):
    """AK-35: dose interpolated at the structures' voxels, then all statistics."""
    return an.summary(_planned(t))


@query("io32_report", f"SELECT structure, structure || printf(': min %.2f max %.2f mean %.2f D95 %.2f D2 %.2f V20 %.2f%%', round(min_dose, 2), round(max_dose, 2), round(mean_dose, 2), round(d95, 2), round(d2, 2), round(v20, 2)) AS line FROM ({_stats_sql(PLANNED)})")
def _(t):
    stats = an.summary(_planned(t))
    return ca.report(stats.select("structure", *[F.round(c, 9).alias(c) for c in ("min_dose", "max_dose", "mean_dose", "d95", "d2", "v20")]))


@query("jn22_dose_on_slice", f"SELECT v.i, v.j, v.k, round(d.dose, 6) AS dose FROM {ge.VOXELS} v JOIN {ge.FIELD} d ON d.i = round({_AT[0].replace('+ i', '+ v.i')}) AND d.j = round({_AT[1].replace('+ j', '+ v.j')}) AND d.k = round({_AT[2].replace('+ k', '+ v.k')}) WHERE v.k = 12")
def _(t):
    return gr.overlaid(ge._voxels(t).where("k = 12"), ge.CT, COARSE, ge._field(t))


@query("ak34_sequencing", f"""
WITH f AS ({ge.EXACT_FIDELITY}), r AS (SELECT beam, count(*) AS segments, sum(weight / 1e1) AS mu FROM {ge.RUNS} GROUP BY beam)
SELECT beam, coalesce(segments, 0) AS segments, round(coalesce(mu, 0e0), 5) AS mu, round(fidelity, 5) AS fidelity FROM f LEFT JOIN r USING (beam)""", digits=5)
def _(t):
    """AK-31, AK-34: segments, monitor units and fidelity of each beam's sequence."""
    runs = sq.shape_runs(ge._quantised(t)).withColumn("mu", F.col("weight") / 10.0)
    per = runs.groupBy("beam").agg(F.count(F.lit(1)).alias("segments"), F.sum("mu").alias("mu"))
    return ge._fidelity(t).join(per, "beam", "left").select("beam", F.coalesce("segments", F.lit(0)).alias("segments"), F.coalesce("mu", F.lit(0.0)).alias("mu"), "fidelity")


# Particles of all beams


@query("ak22_all_beams", f"""
WITH b AS (SELECT beam, energy, cc * cg * x - cc * sg * (z - 1e3) + sc * y AS px, sg * x + cg * (z - 1e3) AS py, -sc * cg * x + sc * sg * (z - 1e3) + cc * y AS pz
  FROM {WITH_W}, {ge.angles_sql(ge.PLAN)} WHERE abs(w) >= 1e-10 AND x * 1e3 / 271.7e0 BETWEEN -800 AND 300 AND y * 1e3 / 271.7e0 BETWEEN -250 AND 250)
SELECT beam, count(*) AS n, round(avg(energy), 5) AS mean_energy, {', '.join(f"round({f}(p{c}), 5) AS {f}_{c}" for c in "xyz" for f in ("min", "max"))} FROM b GROUP BY beam""", digits=5)
def _(t):
    """AK-21, AK-22: particles read once, within the jaws, turned into every beam."""
    held = ps.within_jaws(ps.with_w(t.particles()), -800, 300, -250, 250, ge.SAD, 27.17)
    plan = ge._plan(t).withColumn("collimator", F.lit(0.0))
    return ps.metrics_by_beam(ps.in_all_beams(held, plan, ge.SAD, (0.0, 0.0, 0.0)))


# Small ones


@query("sf30_point_in_polygon", """
WITH c AS (SELECT s_suppkey, 16 + s_suppkey % 7 + 25e-2 AS cx, 15 + s_suppkey % 5 + 35e-2 AS cy, 4 + s_suppkey % 6 AS r FROM supplier),
e AS (SELECT s_suppkey, cx + r * cos(n.i * pi() / 4) AS x1, cy + r * sin(n.i * pi() / 4) AS y1, cx + r * cos((n.i + 1) % 8 * pi() / 4) AS x2, cy + r * sin((n.i + 1) % 8 * pi() / 4) AS y2 FROM c, range(8) n(i)),
p AS (SELECT row_number() OVER () AS id, l_suppkey, 10 + l_quantity / 3 AS x, 10 + l_discount * 150 + l_linenumber / 7e0 AS y FROM lineitem),
h AS (SELECT id, l_suppkey, count_if(((y1 > y) <> (y2 > y)) AND x < (x2 - x1) * (y - y1) / (CASE WHEN y2 = y1 THEN 1e0 ELSE y2 - y1 END) + x1) % 2 = 1 AS inside FROM p JOIN e ON s_suppkey = l_suppkey GROUP BY id, l_suppkey)
SELECT l_suppkey, count(*) AS n, count_if(inside)::BIGINT AS inside FROM h GROUP BY l_suppkey""")
def _(t):
    s = F.col("s_suppkey")
    cx, cy, r = 16 + s % 7 + F.lit(0.25), 15 + s % 5 + F.lit(0.35), 4 + s % 6
    octagon = F.array(*[F.struct((cx + r * F.cos(F.lit(float(n)) * F.pi() / 4)).alias("x"), (cy + r * F.sin(F.lit(float(n)) * F.pi() / 4)).alias("y")) for n in range(8)])
    shapes = t.read("supplier").select(s.alias("l_suppkey"), octagon.alias("points"))
    rows = t.read("lineitem").select("l_suppkey", (10 + F.col("l_quantity") / 3).alias("x"), (10 + F.col("l_discount") * 150 + F.col("l_linenumber") / 7).alias("y"))
    inside = fc.in_polygon(F.col("x"), F.col("y"), F.col("points"))
    return rows.join(shapes, "l_suppkey").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"), F.count_if(inside).alias("inside"))


@query("sf39_angle_lists", """
WITH l AS (SELECT o_orderkey, o_custkey % 90 || ', ' || o_orderkey % 45 || CASE WHEN o_orderkey % 3 = 0 THEN ',-5 7' WHEN o_orderkey % 3 = 1 THEN ' x,8' ELSE '' END AS s FROM orders)
SELECT o_orderkey, len(v)::INT AS n, round(list_sum(v), 6) AS total FROM (SELECT o_orderkey, list_filter(list_transform(regexp_split_to_array(CASE WHEN contains(s, '-') THEN split_part(s, ',-', 1) ELSE s END, '[,\\s]+'), lambda w: try_cast(w AS DOUBLE)), lambda w: w IS NOT NULL) AS v FROM l)""")
def _(t):
    c, k = F.col("o_custkey") % 90, F.col("o_orderkey")
    end = F.when(k % 3 == 0, ",-5 7").when(k % 3 == 1, " x,8").otherwise("")
    rows = t.read("orders").select("o_orderkey", fc.numbers_in(F.concat(c.cast("string"), F.lit(", "), (k % 45).cast("string"), end)).alias("v"))
    return rows.select("o_orderkey", F.size("v").alias("n"), F.aggregate("v", F.lit(0.0), lambda a, b: a + b).alias("total"))


@query("ak43_dose_store", "SELECT o_orderkey AS dose_id, CASE WHEN o_orderkey = 3 THEN 'boost' ELSE o_orderpriority END AS name, CASE WHEN o_custkey <> 2 THEN o_custkey END AS linked, false AS selected FROM orders WHERE o_orderkey <> 2 UNION ALL SELECT -1, 'sum', 3, true")
def _(t):
    doses = t.read("orders").select(F.col("o_orderkey").alias("dose_id"), F.col("o_orderpriority").alias("name"), F.col("o_custkey").alias("linked"), (F.col("o_orderkey") == 2).alias("selected"))
    return ca.dose_added(ca.dose_renamed(ca.dose_removed(doses, 2), 3, "boost"), -1, "sum", 3)

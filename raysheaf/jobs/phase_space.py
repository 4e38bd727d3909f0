"""Queries on particles and on voxel values."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as fc
from ..operators import particles as ps
from .registry import query
from .tables import HOUNSFIELD, PARTICLES

WITH_W = f"(SELECT *, sqrt(greatest(1 - u * u - v * v, 0e0)) * wsign AS w FROM {PARTICLES})"
FILE_ROWS = f"(SELECT *, row_number() OVER (PARTITION BY file ORDER BY rec) - 1 AS pos, count(*) OVER (PARTITION BY file) AS m FROM {PARTICLES})"


@query("pf03_type_filter", f"SELECT rec, round(energy, 6) AS energy FROM {PARTICLES} WHERE type = -1")
def _(t):
    return ps.of_type(t.particles(), ps.ELECTRON).select("rec", "energy")


@query("pf04_jaws", f"SELECT rec, round(x, 6) AS x, round(y, 6) AS y, round(w, 6) AS w FROM {WITH_W} WHERE abs(w) >= 1e-10 AND x * 1e3 / 271.7e0 BETWEEN -400 AND 300 AND y * 1e3 / 271.7e0 BETWEEN -250 AND 250")
def _(t):
    return ps.within_jaws(ps.with_w(t.particles()), -400, 300, -250, 250, 1000.0, 27.17).select("rec", "x", "y", "w")


def _metrics_sql(rows: str, prefix: str = "") -> str:
    spread = lambda c: f"round(coalesce(sqrt(greatest(avg({c} * {c}) - pow(avg({c}), 2), 0e0)), 0e0), 6) AS spread_{c}"
    ends = ", ".join(f"round(coalesce({n}({c}), 0e0), 6) AS {n}_{c}" for c in "xyz" for n in ("min", "max"))
    return f"SELECT {prefix} count(*) AS n, coalesce(count_if(type = 1), 0)::BIGINT AS photons, coalesce(count_if(type = -1), 0)::BIGINT AS electrons, coalesce(count_if(type = 2), 0)::BIGINT AS positrons, round(coalesce(min(energy), 0e0), 6) AS min_energy, round(coalesce(max(energy), 0e0), 6) AS max_energy, round(coalesce(avg(energy), 0e0), 6) AS mean_energy, {spread('u')}, {spread('v')}, {ends} FROM {rows}"


@query("ag20_particle_metrics", _metrics_sql(PARTICLES))
def _(t):
    return ps.metrics(t.particles())


@query("ag22_merged_metrics", f"""
WITH b AS (SELECT file AS beam, count(*) AS n, avg(energy) AS e, min(x) AS lo, max(x) AS hi FROM {PARTICLES} GROUP BY file)
SELECT sum(n)::BIGINT AS n, round(sum(e * n) / sum(n), 6) AS mean_energy, round(arg_min(lo, beam), 6) AS min_x, round(arg_min(hi, beam), 6) AS max_x FROM b""")
def _(t):
    per = t.particles().groupBy(F.col("file").alias("beam")).agg(F.count(F.lit(1)).alias("n"), F.avg("energy").alias("mean_energy"), F.min("x").alias("min_x"), F.max("x").alias("max_x"))
    return ps.merged_metrics(per)


@query("ag23_energy_histogram", f"""
WITH s AS (SELECT min(energy) AS low, max(energy) AS high FROM {PARTICLES}),
c AS (SELECT least(greatest(floor((energy - low) / ((high - low) / 50)), 0), 49)::INT AS bin, count(*) AS n FROM {PARTICLES}, s GROUP BY 1)
SELECT r.i::INT AS bin, round(low + (r.i + 5e-1) * ((high - low) / 50), 6) AS center, coalesce(n, 0) AS n FROM s, range(50) r(i) LEFT JOIN c ON c.bin = r.i""")
def _(t):
    return ps.energy_histogram(t.particles())


@query("io25_strided_scan", f"WITH s AS (SELECT greatest(1, (SELECT count(*) FROM events) // 1000) AS stride) SELECT rec, round(energy, 6) AS energy FROM {PARTICLES}, s WHERE rec % stride = 0 AND rec < stride * 1000")
def _(t):
    return ps.strided(t.particles(), 1000).select("rec", "energy")


@query("io26_capped_files", f"SELECT file, rec FROM (SELECT file, rec, row_number() OVER (ORDER BY file, rec) AS rn FROM {PARTICLES}) WHERE rn <= 600")
def _(t):
    return ps.capped(t.particles(), 600).select("file", "rec")


@query("io27_balanced_files", f"""
WITH f AS (SELECT *, 200 // 3 + CASE WHEN file < 200 % 3 THEN 1 ELSE 0 END AS share FROM {FILE_ROWS})
SELECT file, rec FROM f WHERE CASE WHEN share < m / 2 THEN pos % greatest(1, m // greatest(share, 1)) = 0 AND pos < greatest(1, m // greatest(share, 1)) * share ELSE pos < share END""")
def _(t):
    rows = t.particles().select("file", "rec", F.floor(F.col("rec") / 3).alias("at"))
    return ps.balanced(rows, 200).select("file", "rec")


@query("sl04_random_sample", f"SELECT rec FROM {PARTICLES} ORDER BY md5('42:' || rec::VARCHAR), rec LIMIT 100")
def _(t):
    return ps.random_sample(t.particles(), 100).select("rec")


@query("sf28_unit_vector", f"SELECT rec, round(w, 6) AS w, round(abs(energy), 6) AS energy FROM {WITH_W}")
def _(t):
    return ps.with_w(t.particles()).select("rec", "w", F.abs("energy").alias("energy"))


R = fc.rotation(30.0, 15.0)
_X, _Y, _Z = "(x * cos(radians(10)) - y * sin(radians(10)))", "(z - 1e3)", "(x * sin(radians(10)) + y * cos(radians(10)))"


@query("sf29_patient_transform", "SELECT rec, " + ", ".join(f"round({r[0]:.17e} * {_X} + {r[1]:.17e} * {_Y} + {r[2]:.17e} * {_Z} + {o}, 4) AS p{n}" for r, n, o in zip(R, "xyz", (5, -3, 2), strict=True)) + f" FROM {PARTICLES}", digits=4)
def _(t):
    return ps.to_patient(t.particles(), 30.0, 15.0, 10.0, 1000.0, (5.0, -3.0, 2.0))


@query("ak21_beam_source", _metrics_sql(f"(SELECT * FROM {WITH_W} WHERE abs(w) >= 1e-10 AND x * 1e3 / 271.7e0 BETWEEN -400 AND 300 AND y * 1e3 / 271.7e0 BETWEEN -250 AND 250)"))
def _(t):
    """AK-21: jaw filter, completed directions, metrics of what is left."""
    return ps.metrics(ps.within_jaws(ps.with_w(t.particles()), -400, 300, -250, 250, 1000.0, 27.17))


def _turned(x: str, y: str, z: str, names: str, offset: tuple[int, int, int]) -> str:
    beam = (f"({x} * cos(radians(10)) - {y} * sin(radians(10)))", z, f"({x} * sin(radians(10)) + {y} * cos(radians(10)))")
    return ", ".join(f"{r[0]:.17e} * {beam[0]} + {r[1]:.17e} * {beam[1]} + {r[2]:.17e} * {beam[2]} + {o} AS {n}" for r, n, o in zip(R, names, offset, strict=True))


_SHARED = f"(SELECT * FROM (SELECT *, 3000 // 3 + CASE WHEN file < 3000 % 3 THEN 1 ELSE 0 END AS share FROM {FILE_ROWS}) WHERE CASE WHEN share < m / 2 THEN pos % greatest(1, m // greatest(share, 1)) = 0 AND pos < greatest(1, m // greatest(share, 1)) * share ELSE pos < share END)"
_SOURCE = f"(SELECT rec, type, energy, {_turned('x', 'y', '(z - 1e3)', 'xyz', (5, -3, 2))}, {_turned('u', 'v', 'w', 'uvw', (0, 0, 0))} FROM (SELECT *, sqrt(greatest(1 - u * u - v * v, 0e0)) * wsign AS w FROM {_SHARED}) WHERE abs(w) >= 1e-10 AND x * 1e3 / 271.7e0 BETWEEN -400 AND 400 AND y * 1e3 / 271.7e0 BETWEEN -300 AND 300)"


def _source(t):
    rows = ps.balanced(t.particles().withColumn("at", F.floor(F.col("rec") / 3)), 3000).drop("at")
    return ps.beam_source(ps.with_w(rows), (800.0, 600.0), 27.17, 30.0, 15.0, 10.0, 1000.0, (5.0, -3.0, 2.0))


@query("ak21_source_metrics", _metrics_sql(_SOURCE).replace(", 6)", ", 4)"), digits=4)
def _(t):
    """AK-21 whole: quotas of the files, jaws, patient axes, metrics."""
    return ps.metrics(_source(t))


@query("ak21_source_sample", "SELECT rec, type, " + ", ".join(f"round({c}, 4) AS {c}" for c in "xyzuvw") + f" FROM {_SOURCE} ORDER BY md5('42:' || rec::VARCHAR), rec LIMIT 200", digits=4)
def _(t):
    return ps.random_sample(_source(t), 200).select("rec", "type", *"xyzuvw")


# Voxel values


@query("pf01_hu_to_density", f"SELECT event_id, hu, round(CASE WHEN hu <= -1000 THEN 0e0 WHEN hu <= 0 THEN 1 + hu / 1e3 WHEN hu <= 100 THEN 1 + 1e-3 * hu ELSE 1.1e0 + 5e-4 * (hu - 100) END, 6) AS rho FROM {HOUNSFIELD}")
def _(t):
    return t.hounsfield().withColumn("rho", fc.electron_density(F.col("hu")))


@query("pf02_body_threshold", f"SELECT event_id, hu FROM {HOUNSFIELD} WHERE hu > -300")
def _(t):
    return t.hounsfield().where("hu > -300")


@query("pf23_window_level", f"SELECT event_id, CASE WHEN hu <= -1350 THEN 0 WHEN hu >= 150 THEN 255 ELSE trunc(255e0 * (hu + 1350) / 15e2)::INT END AS grey FROM {HOUNSFIELD}")
def _(t):
    return t.hounsfield().select("event_id", fc.window_level(F.col("hu"), -1350, 150).alias("grey"))


@query("sf34_texture", f"SELECT event_id, trunc(least(greatest((hu + 1024) / 4096e0, 0e0), 1e0) * 65535)::INT AS texel FROM {HOUNSFIELD}")
def _(t):
    return t.hounsfield().select("event_id", fc.texture16(F.col("hu")).alias("texel"))


@query("ag32_hu_range", f"SELECT min(hu) AS lo, max(hu) AS hi FROM {HOUNSFIELD}")
def _(t):
    return t.hounsfield().agg(F.min("hu").alias("lo"), F.max("hu").alias("hi"))


@query("sf32_jet", f"SELECT rec, round(least(greatest(15e-1 - abs(4 * (energy / 20 - 75e-2)), 0e0), 1e0), 6) AS red, round(least(greatest(15e-1 - abs(4 * (energy / 20 - 5e-1)), 0e0), 1e0), 6) AS green, round(least(greatest(15e-1 - abs(4 * (energy / 20 - 25e-2)), 0e0), 1e0), 6) AS blue FROM {PARTICLES}")
def _(t):
    return t.particles().select("rec", *[c.alias(n) for n, c in fc.jet(F.col("energy") / 20).items()])


NAMES = "(SELECT p_partkey, (['PTV_', 'gtv ', 'Ctv-', 'Tumor bed ', 'Skin ', 'Lung '])[(p_partkey % 6 + 1)::INT] || p_name AS name, (['PTV', 'TARGET', 'CTV', 'EXTERNAL', 'OAR'])[(p_partkey % 5 + 1)::INT] AS kind FROM part)"


def _names(t):
    at = lambda n, *x: F.element_at(F.array(*map(F.lit, x)), (F.col("p_partkey") % n + 1).cast("int"))
    return t.read("part").select("p_partkey", F.concat(at(6, "PTV_", "gtv ", "Ctv-", "Tumor bed ", "Skin ", "Lung "), "p_name").alias("name"), at(5, "PTV", "TARGET", "CTV", "EXTERNAL", "OAR").alias("kind"))


@query("sf25_type_from_name", f"""
SELECT p_partkey, name, CASE WHEN u LIKE '%PTV%' THEN 'PTV' WHEN u LIKE '%GTV%' THEN 'GTV' WHEN u LIKE '%CTV%' THEN 'CTV' WHEN u LIKE '%TARGET%' OR u LIKE '%TUMOR%' THEN 'TARGET'
  WHEN u LIKE '%BODY%' OR u LIKE '%EXTERNAL%' OR u LIKE '%SKIN%' THEN 'EXTERNAL' ELSE 'OAR' END AS kind FROM (SELECT *, upper(name) AS u FROM {NAMES})""")
def _(t):
    return _names(t).select("p_partkey", "name", fc.type_from_name(F.col("name")).alias("kind"))


_NAMED = "(name LIKE '%PTV%' OR name LIKE '%CTV%' OR name LIKE '%GTV%')"


@query("pf11_target_predicates", f"SELECT p_partkey, regexp_matches(kind, 'TARGET|PTV|CTV|GTV') OR {_NAMED} AS objective, kind LIKE '%TARGET%' OR {_NAMED} AS conformity, kind IN ('PTV', 'GTV', 'CTV', 'TARGET') AS steering, kind IN ('PTV', 'GTV', 'CTV') AS isocentre FROM {NAMES}")
def _(t):
    name, kind = F.col("name"), F.col("kind")
    return _names(t).select("p_partkey", fc.is_target_objective(name, kind).alias("objective"), fc.is_target_conformity(name, kind).alias("conformity"), fc.is_target_steering(kind).alias("steering"), fc.is_target_isocentre(kind).alias("isocentre"))


@query("io12_priority", f"SELECT p_partkey, CASE WHEN kind IN ('PTV', 'TARGET') THEN 1 WHEN kind IN ('GTV', 'CTV') THEN 2 WHEN kind = 'EXTERNAL' THEN 5 ELSE 3 END AS priority FROM {NAMES}")
def _(t):
    return _names(t).select("p_partkey", fc.priority(F.col("kind")).alias("priority"))


@query("jn17_spec_structures", f"SELECT s.pattern, p.p_partkey FROM {NAMES} p JOIN (VALUES ('PTV', false), ('Lung', false), ('Skin ', false)) s(pattern, exact) ON CASE WHEN s.exact THEN p.name = s.pattern ELSE contains(p.name, s.pattern) END")
def _(t):
    """JN-17, PF-15: each objective pattern with the structures that it names; a protocol's patterns are few."""
    specs = t.spark.createDataFrame([("PTV", False), ("Lung", False), ("Skin ", False)], "pattern string, exact boolean")
    fits = F.when(F.col("exact"), F.col("name") == F.col("pattern")).otherwise(F.contains("name", "pattern"))
    return _names(t).join(F.broadcast(specs), fits).select("pattern", "p_partkey")


@query("ag33_type_existence", f"SELECT bool_or(kind = 'EXTERNAL') AS has_external, bool_or(kind = 'CAVITY') AS has_cavity FROM {NAMES}")
def _(t):
    return _names(t).agg(F.bool_or(F.col("kind") == "EXTERNAL").alias("has_external"), F.bool_or(F.col("kind") == "CAVITY").alias("has_cavity"))


@query("io16_json_dialect", "SELECT event_id, CASE WHEN json_extract(props, '$.machine') IS NOT NULL THEN 'phase_space' ELSE 'generic' END AS dialect, coalesce((json_extract(props, '$.k'))::INT, -1) AS k, round(coalesce((json_extract(props, '$.k'))::DOUBLE, 1e3) * 10, 6) AS k_mm FROM events")
def _(t):
    """IO-16 to IO-18, SF-27: dialect by a key's presence, fields with defaults, centimetres to millimetres."""
    p = F.col("props")
    k = F.get_json_object(p, "$.k")
    return t.read("events").select("event_id", F.when(F.get_json_object(p, "$.machine").isNotNull(), "phase_space").otherwise("generic").alias("dialect"), F.coalesce(k.cast("int"), F.lit(-1)).alias("k"), (F.coalesce(k.cast("double"), F.lit(1000.0)) * 10).alias("k_mm"))


@query("sf37_next_power", "SELECT o_orderkey, CASE WHEN o_orderkey <= 1 THEN 1 ELSE (2 ** ceil(log2(o_orderkey)))::BIGINT END AS padded FROM orders")
def _(t):
    return t.read("orders").select("o_orderkey", fc.next_power_of_two(F.col("o_orderkey")).alias("padded"))

"""Phase-space particles: filters, samples, metrics, histograms, transforms."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import rotation, w_component
from .steering import patient_point

PHOTON, ELECTRON, POSITRON = 1, -1, 2


def of_type(particles: DataFrame, kind: int) -> DataFrame:
    """PF-03."""
    return particles.where(F.col("type") == kind)


def within_jaws(particles: DataFrame, x1: float, x2: float, y1: float, y2: float, sad: float, plane_cm: float) -> DataFrame:
    """PF-04: scaled to the isocentre plane, closed interval; particles parallel to the plane are dropped."""
    scale = sad / (10 * plane_cm)
    return particles.where((F.abs("w") >= 1e-10) & (F.col("x") * scale).between(x1, x2) & (F.col("y") * scale).between(y1, y2))


def with_w(particles: DataFrame) -> DataFrame:
    """SF-28 on columns u, v and wsign."""
    return particles.withColumn("w", w_component(F.col("u"), F.col("v"), F.col("wsign")))


def metrics(particles: DataFrame) -> DataFrame:
    """AG-20, AG-21: one aggregation; zeros without particles."""
    def count(k: int):
        return F.count_if(F.col("type") == k)

    def spread(c: str):
        return F.sqrt(F.greatest(F.avg(F.col(c) * F.col(c)) - F.pow(F.avg(c), 2), F.lit(0.0)))

    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return particles.agg(
        F.count(F.lit(1)).alias("n"),
        count(PHOTON).alias("photons"),
        count(ELECTRON).alias("electrons"),
        count(POSITRON).alias("positrons"),
        *[zero(f("energy")).alias(f"{n}_energy") for n, f in (("min", F.min), ("max", F.max), ("mean", F.avg))],
        *[zero(spread(c)).alias(f"spread_{c}") for c in ("u", "v")],
        *[zero(f(c)).alias(f"{n}_{c}") for c in ("x", "y", "z") for n, f in (("min", F.min), ("max", F.max))],
    )


def merged_metrics(per_beam: DataFrame) -> DataFrame:
    """AG-22: count-weighted mean energy over beams; ranges are those of the first beam."""
    n = F.sum("n")
    return per_beam.agg(n.alias("n"), F.coalesce(F.sum(F.col("mean_energy") * F.col("n")) / F.nullif(n, F.lit(0)), F.lit(0.0)).alias("mean_energy"), F.min_by("min_x", "beam").alias("min_x"), F.min_by("max_x", "beam").alias("max_x"))


def energy_histogram(particles: DataFrame, bins: int = 50) -> DataFrame:
    """AG-23: (bin, center, n), empty bins kept; one bin if all energies are equal."""
    span = particles.agg(F.min("energy").alias("low"), F.max("energy").alias("high"))
    width = (F.col("high") - F.col("low")) / bins
    at = F.when(F.col("high") > F.col("low"), F.least(F.greatest(F.floor((F.col("energy") - F.col("low")) / F.when(F.col("high") > F.col("low"), width).otherwise(1.0)), F.lit(0)), F.lit(bins - 1))).otherwise(0)
    counted = particles.crossJoin(F.broadcast(span)).groupBy(at.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    grid = span.where("low is not null").select("low", width.alias("width"), F.explode(F.when(F.col("high") > F.col("low"), F.sequence(F.lit(0), F.lit(bins - 1))).otherwise(F.array(F.lit(0)))).alias("bin"))
    return grid.join(counted, "bin", "left").select("bin", (F.col("low") + (F.col("bin") + 0.5) * F.col("width")).alias("center"), F.coalesce("n", F.lit(0)).alias("n"))


def strided(particles: DataFrame, n: int) -> DataFrame:
    """IO-25: every stride-th record from the first on, n at most, the stride being the records' number over n. ``rec`` counts from 0 in its file."""
    stride = particles.agg(F.greatest(F.lit(1), F.floor(F.count(F.lit(1)) / n)).alias("__stride"))
    rows = particles.crossJoin(F.broadcast(stride))  # one row
    return rows.where((F.col("rec") % F.col("__stride") == 0) & (F.col("rec") < F.col("__stride") * n)).drop("__stride")


def capped(particles: DataFrame, most: int) -> DataFrame:
    """IO-26: files appended in order until the cap: whole files by prefix sums of their counts, then records by number within the last."""
    per = particles.groupBy("file").agg(F.count(F.lit(1)).alias("m"))
    before = per.withColumn("base", F.coalesce(F.sum("m").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("file", "base")
    run = F.floor(F.col("rec") / 4096)
    rows = particles.join(F.broadcast(before.where(F.col("base") < most)), "file").withColumn("run", run)
    runs = rows.groupBy("file", "run").agg(F.count(F.lit(1)).alias("k"))
    runs = runs.withColumn("in_file", F.coalesce(F.sum("k").over(Window.partitionBy("file").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("k")
    rows = rows.join(runs, ["file", "run"]).withColumn("rn", F.row_number().over(Window.partitionBy("file", "run").orderBy("rec")))
    return rows.where(F.col("base") + F.col("in_file") + F.col("rn") <= most).drop("base", "in_file", "run", "rn")


def balanced(particles: DataFrame, n: int) -> DataFrame:
    """IO-27: n shared among files, the remainder to the first; a file gives strided records if its share is under half its count, else its head."""
    per = particles.groupBy("file").agg(F.count(F.lit(1)).alias("m"), F.min("rec").alias("r0"))
    files = per.withColumn("i", F.row_number().over(Window.orderBy("file")) - 1).crossJoin(F.broadcast(per.agg(F.count(F.lit(1)).alias("files"))))
    share = F.floor(F.lit(n) / F.col("files")) + F.when(F.col("i") < F.lit(n) % F.col("files"), 1).otherwise(0)
    files = files.select("file", "m", share.alias("share"), F.greatest(F.lit(1), F.floor(F.col("m") / F.greatest(share, F.lit(1)))).alias("stride"))
    at = F.col("at")
    picked = F.when(F.col("share") < F.col("m") / 2, (at % F.col("stride") == 0) & (at < F.col("stride") * F.col("share"))).otherwise(at < F.col("share"))
    return particles.join(F.broadcast(files), "file").where(picked).drop("m", "share", "stride")


def random_sample(particles: DataFrame, n: int, key: str = "rec", seed: int = 42) -> DataFrame:
    """SL-04: n records in order of a hash, all if there are fewer."""
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary"))
    return particles.orderBy(order, key).limit(n)


def to_patient(particles: DataFrame, gantry: float, couch: float, collimator: float, sad: float, iso: tuple[float, float, float]) -> DataFrame:
    """SF-29: record axes to beam's eye (x, z - SAD, y), collimator rotation, then to the patient."""
    c, s = math.cos(math.radians(collimator)), math.sin(math.radians(collimator))
    if abs(collimator) <= 0.01:
        c, s = 1.0, 0.0
    r = rotation(gantry, couch)
    x, y, z = F.col("x") * c - F.col("y") * s, F.col("z") - sad, F.col("x") * s + F.col("y") * c
    return particles.select("rec", *[(r[i][0] * x + r[i][1] * y + r[i][2] * z + iso[i]).alias(f"p{n}") for i, n in enumerate("xyz")])


def beam_source(records: DataFrame, field: tuple[float, float], plane_cm: float, gantry: float, couch: float, collimator: float, sad: float, iso: tuple[float, float, float]) -> DataFrame:
    """AK-21: records (of all files, their quotas taken) that pass the jaws of a centred field, x, y and z and the directions u, v and w in patient axes. ``metrics`` and ``random_sample`` take the result."""
    half_x, half_y = field[0] / 2, field[1] / 2
    rows = within_jaws(records, -half_x, half_x, -half_y, half_y, sad, plane_cm)
    turned = math.radians(collimator) if abs(collimator) > 0.01 else 0.0
    c, s = math.cos(turned), math.sin(turned)
    r = rotation(gantry, couch)

    def placed(x: str, y: str, z: str, along: float, offset: tuple[float, float, float]) -> list:
        beam = (F.col(x) * c - F.col(y) * s, F.col(z) - along, F.col(x) * s + F.col(y) * c)
        return [sum((r[i][k] * beam[k] for k in range(3)), F.lit(offset[i])) for i in range(3)]

    moved = dict(zip("xyz", placed("x", "y", "z", sad, iso), strict=True)) | dict(zip("uvw", placed("u", "v", "w", 0.0, (0.0, 0.0, 0.0)), strict=True))
    return rows.select(*[moved[c].alias(c) if c in moved else F.col(c) for c in rows.columns])


def in_all_beams(particles: DataFrame, plan: DataFrame, sad: float, iso: tuple[float, float, float]) -> DataFrame:
    """AK-22, SF-29: the particles in patient axes of every beam (beam, gantry, couch, collimator): read once, turned per beam. A plan's beams are broadcast."""
    rows = particles.crossJoin(F.broadcast(plan.select("beam", "gantry", "couch", "collimator")))
    turned = F.abs("collimator") > 0.01
    c, s = F.when(turned, F.cos(F.radians("collimator"))).otherwise(1.0), F.when(turned, F.sin(F.radians("collimator"))).otherwise(0.0)
    point = (F.col("x") * c - F.col("y") * s, F.col("z") - sad, F.col("x") * s + F.col("y") * c)
    placed = patient_point(F.col("gantry"), F.col("couch"), point, iso)
    return rows.select("beam", *particles.columns, *[p.alias(f"p{n}") for n, p in zip("xyz", placed, strict=True)])


def metrics_by_beam(particles: DataFrame) -> DataFrame:
    """AG-20 per beam, for what AG-22 merges."""
    return particles.groupBy("beam").agg(F.count(F.lit(1)).alias("n"), F.avg("energy").alias("mean_energy"), *[f(f"p{c}").alias(f"{n}_{c}") for c in "xyz" for n, f in (("min", F.min), ("max", F.max))])

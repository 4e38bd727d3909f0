"""Beam angles, rays and bixels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import project_to_iso


def angle_range(start: int, step: int, stop: int) -> list[int]:
    """SF-38: start, then by step, below stop."""
    if step <= 0:
        raise ValueError("an angle step is positive")
    return list(range(start, stop, step))


def beams(gantry: DataFrame, couch: DataFrame) -> DataFrame:
    """JN-18: every gantry angle with every couch angle, couch-major: (beam, gantry, couch). The sides are angle lists of a plan."""
    order = Window.orderBy("couch", "gantry")
    return F.broadcast(couch).crossJoin(gantry).select((F.row_number().over(order) - 1).alias("beam"), "gantry", "couch")


def zipped_beams(gantry: DataFrame, couch: DataFrame) -> DataFrame:
    """JN-18 for lists: paired by position (pos); a short couch list repeats its last, or 0 if empty."""
    joined = gantry.join(couch, "pos", "left")
    last = F.last("couch", ignorenulls=True).over(Window.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    return joined.select(F.col("pos").alias("beam"), "gantry", F.coalesce(last, F.lit(0.0)).alias("couch"))


def rotated(angle: Column, couch: Column) -> list[list[Column]]:
    """SF-03 as columns: rows of the beam-to-patient rotation."""
    cg, sg, cc, sc = F.cos(F.radians(angle)), F.sin(F.radians(angle)), F.cos(F.radians(couch)), F.sin(F.radians(couch))
    zero = F.lit(0.0)
    return [[cc * cg, -cc * sg, sc], [sg, cg, zero], [-sc * cg, sc * sg, cc]]


def to_bev(angle: Column, couch: Column, p: tuple[Column, Column, Column], iso: tuple[float, float, float]) -> list[Column]:
    """SF-16: patient to beam's eye view, by the transposed rotation."""
    r, d = rotated(angle, couch), [x - o for x, o in zip(p, iso, strict=True)]
    return [r[0][i] * d[0] + r[1][i] * d[1] + r[2][i] * d[2] for i in range(3)]


def patient_point(angle: Column, couch: Column, p: tuple[Column, Column, Column], iso: tuple[float, float, float]) -> list[Column]:
    """SF-17: beam's eye view to patient."""
    r = rotated(angle, couch)
    return [r[i][0] * p[0] + r[i][1] * p[1] + r[i][2] * p[2] + iso[i] for i in range(3)]


def target_rays(points: DataFrame, plan: DataFrame, sad: float, width: float, iso: tuple[float, float, float] = (0.0, 0.0, 0.0), pad: int = 0) -> DataFrame:
    """AK-13: distinct bixel places (beam, ix, iz) that cover the target in each beam.

    Rotate, project on the isocentre plane, snap to the bixel grid, drop repeats before the
    padding multiplies rows, and again after it. The plan's beams are few and are broadcast.
    """
    x, y, z = to_bev(F.col("gantry"), F.col("couch"), (F.col("x"), F.col("y"), F.col("z")), iso)
    bev = points.crossJoin(F.broadcast(plan)).select("beam", x.alias("bx"), y.alias("by"), z.alias("bz"))
    at = lambda c: F.round(F.round(project_to_iso(F.col(c), F.col("by"), sad) / width, 9)).cast("long")
    places = bev.select("beam", at("bx").alias("ix"), at("bz").alias("iz")).distinct()
    if not pad:
        return places
    around = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in range(-pad, pad + 1) for b in range(-pad, pad + 1)]))
    return places.select("beam", "ix", "iz", around.alias("d")).select("beam", (F.col("ix") + F.col("d.a")).alias("ix"), (F.col("iz") + F.col("d.b")).alias("iz")).distinct()


def padding(width: float, spacing: tuple[float, float, float]) -> int:
    """AK-13: bixels of padding where the image is coarser than a bixel."""
    return int(max(spacing) // width) if width < max(spacing) else 0


def field_rays(plan: DataFrame, width: float, field: tuple[float, float]) -> DataFrame:
    """AK-14: (beam, pos, ix, iz) of a regular field: from edge to edge in steps of a bixel, snapped to the bixel grid, halves away from zero. Places that snap together stay separate rays."""
    steps = lambda size: F.sequence(F.lit(0), F.lit(int((size + 1e-10) // width)))
    at = lambda n, size: F.round(F.round((F.lit(-size / 2) + F.col(n) * width) / width, 9)).cast("long")
    rows = plan.select("beam", F.explode(steps(field[1])).alias("row")).select("beam", "row", F.explode(steps(field[0])).alias("col"))
    pos = F.col("row") * int((field[0] + 1e-10) // width + 1) + F.col("col")
    return rows.select("beam", pos.cast("long").alias("pos"), at("col", field[0]).alias("ix"), at("row", field[1]).alias("iz"))


def ray_set(targets: DataFrame, plan: DataFrame, sad: float, width: float, spacing: tuple[float, float, float], field: tuple[float, float] = (100.0, 100.0), iso: tuple[float, float, float] = (0.0, 0.0, 0.0)) -> DataFrame:
    """AK-15: (beam, ray, ix, iz, bixel): rays that cover the target (x, y, z), or a regular field if there is none; photon rays have one bixel each."""
    if targets.limit(1).count():
        rays = numbered(target_rays(targets, plan, sad, width, iso, padding(width, spacing)))
    else:
        rays = field_rays(plan, width, field).withColumnRenamed("pos", "ray")
    return rays.join(F.broadcast(bixel_offsets(rays).select("beam", "first")), "beam").select("beam", "ray", "ix", "iz", (F.col("first") + F.col("ray")).alias("bixel"))


def numbered(rays: DataFrame) -> DataFrame:
    """SL-01: ray index within the beam, in order of (ix, iz)."""
    return rays.withColumn("ray", F.row_number().over(Window.partitionBy("beam").orderBy("ix", "iz")) - 1)


def bixel_offsets(rays: DataFrame) -> DataFrame:
    """AG-28, WN-02: rays of each beam and the first bixel's number, (beam, n, first). One row per beam."""
    per = rays.groupBy("beam").agg(F.count(F.lit(1)).alias("n"))
    return per.withColumn("first", F.coalesce(F.sum("n").over(Window.orderBy("beam").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))


def geometry(rays: DataFrame, plan: DataFrame, sad: float, scd: float, width: float, iso: tuple[float, float, float] = (0.0, 0.0, 0.0)) -> DataFrame:
    """SF-17 to SF-19: source, target and corner places of each ray in patient axes, at the isocentre and collimator planes."""
    r = rotated(F.col("gantry"), F.col("couch"))

    def patient(x: Column, y: Column, z: Column) -> Column:
        return F.struct(*[(r[i][0] * x + r[i][1] * y + r[i][2] * z + iso[i]).alias(n) for i, n in enumerate("xyz")])

    x, z, h = F.col("ix") * width, F.col("iz") * width, width / 2
    corners = [(x + h, z + h), (x - h, z + h), (x - h, z - h), (x + h, z - h)]
    zero, scale, at_scd = F.lit(0.0), scd / sad, F.lit(scd - sad)
    return rays.join(F.broadcast(plan), "beam").select(
        "beam",
        "ix",
        "iz",
        patient(zero, F.lit(-sad), zero).alias("source"),
        patient(2 * x, F.lit(sad), 2 * z).alias("target"),
        F.array(*[patient(a, zero, b) for a, b in corners]).alias("corners_iso"),
        F.array(*[patient(a * scale, at_scd, b * scale) for a, b in corners]).alias("corners_scd"),
    )


def isocentre(voxels: DataFrame, spacing: tuple[float, float, float], origin: tuple[float, float, float] = (0.0, 0.0, 0.0)) -> DataFrame:
    """AG-24: centroid of the distinct voxels (i, j, k) of all targets; the origin without any. Returned as x, y, z."""
    d = voxels.select("i", "j", "k").distinct()
    return d.agg(*[F.coalesce(F.avg(F.col(n)) * spacing[a] + origin[a], F.lit(0.0)).alias(c) for n, a, c in (("j", 1, "x"), ("i", 0, "y"), ("k", 2, "z"))])

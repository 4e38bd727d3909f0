"""Rays through voxel grids: segments, radiological depth, source-to-surface distance, nearest joins."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import cut


@dataclass(frozen=True)
class Box:
    """Voxel centres at origin + index * spacing, by patient axis (x, y, z)."""

    dims: tuple[int, int, int]
    spacing: tuple[float, float, float]
    origin: tuple[float, float, float] = (0.0, 0.0, 0.0)


AXES = "xyz"
TOUCHING = 1e-12
#: Valid places that share a cell, on average, and halvings of the cell's width to get there.
CROWD, HALVINGS = 4, 32


def _alphas(planes: Column, first: float, step: float, start: Column, by: Column) -> Column:
    return F.transform(planes, lambda p: (first + p * step - start) / by)


def segments(rays: DataFrame, box: Box) -> DataFrame:
    """AK-01: (ray, seg, i, j, k, start, length) of each ray from (sx, sy, sz) to (tx, ty, tz).

    A ray's crossings of the planes between its entry and its exit are computed, sorted and cut
    into segments within its own row, as arrays: nothing is shuffled, and only segments inside
    the box become rows. Indices
    i, j, k are along x, y, z. A ray that misses, or has no length, has no segments.
    """
    d = {a: F.col(f"t{a}") - F.col(f"s{a}") for a in AXES}
    length = F.sqrt(sum((d[a] * d[a] for a in AXES), F.lit(0.0)))
    low, high = [F.lit(0.0)], [F.lit(1.0)]
    for n, a in enumerate(AXES):
        first = box.origin[n] - box.spacing[n] / 2
        last = first + box.dims[n] * box.spacing[n]
        moving = F.abs(d[a]) > TOUCHING
        by = F.when(moving, d[a]).otherwise(1.0)
        enter, leave = (first - F.col(f"s{a}")) / by, (last - F.col(f"s{a}")) / by
        inside = F.col(f"s{a}").between(first, last)
        low.append(F.when(moving, F.least(enter, leave)).when(inside, 0.0).otherwise(2.0))
        high.append(F.when(moving, F.greatest(enter, leave)).when(inside, 1.0).otherwise(-1.0))
    rows = rays.select("ray", *[f"s{a}" for a in AXES], *[d[a].alias(f"d{a}") for a in AXES], length.alias("len"), F.greatest(*low).alias("lo"), F.least(*high).alias("hi"))
    rows = rows.where((F.col("lo") < F.col("hi")) & (F.col("len") > TOUCHING))
    crossings = []
    for n, a in enumerate(AXES):
        first, step = box.origin[n] - box.spacing[n] / 2, box.spacing[n]
        moving = F.abs(F.col(f"d{a}")) > TOUCHING
        by = F.when(moving, F.col(f"d{a}")).otherwise(1.0)
        ends = [(F.col(f"s{a}") + F.col(x) * F.col(f"d{a}") - first) / step for x in ("lo", "hi")]
        p0, p1 = F.greatest(F.floor(F.least(*ends)), F.lit(0)).cast("int"), F.least(F.ceil(F.greatest(*ends)), F.lit(box.dims[n])).cast("int")
        crossings.append(F.when(moving, _alphas(F.sequence(p0, F.greatest(p0, p1)), first, step, F.col(f"s{a}"), by)).otherwise(F.array().cast("array<double>")))
    rows = rows.withColumn("all", F.concat(*crossings))
    within = F.filter("all", lambda x: (x > F.col("lo")) & (x < F.col("hi")))
    rows = rows.withColumn("cuts", F.array_sort(F.concat(F.array("lo", "hi"), within)))
    n = F.size("cuts")
    pieces = F.transform(F.slice("cuts", F.lit(1), n - 1), lambda x, i: F.struct(x.alias("from"), F.element_at("cuts", i + 2).alias("to")))
    pieces = F.filter(pieces, lambda p: (p["to"] - p["from"]) * F.col("len") > 1e-9)
    rows = rows.select("ray", *[f"s{a}" for a in AXES], *[f"d{a}" for a in AXES], "len", F.posexplode(pieces).alias("seg", "p"))
    middle = (F.col("p.from") + F.col("p.to")) / 2
    at = [F.round((F.col(f"s{a}") + middle * F.col(f"d{a}") - box.origin[n]) / box.spacing[n]).cast("long").alias(name) for n, (a, name) in enumerate(zip(AXES, "ijk", strict=True))]
    found = rows.select("ray", "seg", *at, (F.col("p.from") * F.col("len")).alias("start"), ((F.col("p.to") - F.col("p.from")) * F.col("len")).alias("length"))
    ok = F.lit(True)
    for n, name in enumerate("ijk"):
        ok = ok & F.col(name).between(0, box.dims[n] - 1)
    return found.where(ok)


def with_density(traced: DataFrame, density: DataFrame) -> DataFrame:
    """JN-08: density of each segment's voxel, 1 where unknown."""
    return traced.join(density, ["i", "j", "k"], "left").withColumn("rho", F.coalesce("rho", F.lit(1.0)))


def depths(traced: DataFrame) -> DataFrame:
    """WN-01: radiological depth at the middle of each segment. A window holds one ray, at most a few hundred segments."""
    step = F.col("length") * F.col("rho")
    before = Window.partitionBy("ray").orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)
    return traced.withColumn("depth", F.coalesce(F.sum(step).over(before), F.lit(0.0)) + step / 2)


def deepest(traced: DataFrame) -> DataFrame:
    """AK-02 as the engine uses it: depth at the middle of the last segment of each ray."""
    step = F.col("length") * F.col("rho")
    return traced.groupBy("ray").agg((F.sum(step) - F.max_by(step, "seg") / 2).alias("depth"))


def surface_distance(traced: DataFrame, threshold: float = 0.05, compat: bool = False) -> DataFrame:
    """PF-10, AK-03: distance from the source to the first segment denser than the threshold, per ray; -1 without one.

    ``compat`` measures from where the ray enters the volume instead (WN-06).
    """
    entry = F.lit(0.0) if not compat else F.min("start")
    found = traced.groupBy("ray").agg((F.min(F.when(F.col("rho") > threshold, F.col("start"))) - entry).alias("ssd"))
    return found.select("ray", F.coalesce("ssd", F.lit(-1.0)).alias("ssd"))


def mean_valid(ssd: DataFrame, default: float) -> DataFrame:
    """AG-30: mean of the positive distances."""
    return ssd.agg(F.coalesce(F.avg(F.when(F.col("ssd") > 0, F.col("ssd"))), F.lit(default)).alias("mean_ssd"))


def nearest_value(rows: DataFrame, values: list[float], column: str) -> Column:
    """JN-09: index of the nearest of a short list of values, the first on ties."""
    distances = F.array(*[F.abs(F.col(column) - v) for v in values])
    return F.array_position(distances, F.array_min(distances)).cast("int") - 1


def nearest_point(missing: DataFrame, valid: DataFrame, cell: float, across: tuple[str, ...] = ()) -> DataFrame:
    """JN-10: for each (id, x, y, z) of ``missing`` the nearest (id, x, y, z) of ``valid`` as (id, nearest, distance); ties go to the smaller id.

    Points at one place are one. Places meet in cells: a place is compared with those in its own
    and the 26 cells around it, and the nearest found there is exact if it lies within one cell's
    width. The others go on with cells of twice the width. The first cells are as wide as ``cell``,
    or narrower by halves until a valid place shares its cell with ``CROWD`` others at most, on
    average: so however dense points lie, a place meets a number of others that does not grow with
    them. The number of rounds is the logarithm of the largest distance: a cell as wide as all
    points together settles what is left. Each round is cut from its lineage.

    Points with a null or NaN coordinate, and those whose group of ``across`` has no valid
    point, have null as their nearest.
    """
    placed = lambda df: df.where(sum((F.when(F.isnan(F.col(a).cast("double")) | F.col(a).isNull(), 1).otherwise(0) for a in AXES), F.lit(0)) == 0)
    found, able = None, cut(placed(valid).groupBy(*across, *AXES).agg(F.min("id").alias("id")))
    if across:
        groups = able.select(*[F.col(c).alias(f"__{c}") for c in across]).distinct()
        same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in across]
        left = placed(missing).join(groups, same, "left_semi")
    else:
        left = placed(missing) if able.limit(1).count() else placed(missing).limit(0)
    left = places = cut(left.groupBy(*across, *AXES).agg(F.min("id").alias("id")))
    ends = left.select(*AXES).unionByName(able.select(*AXES)).agg(*[(F.max(a) - F.min(a)).alias(a) for a in AXES]).first()
    extent = max((ends[a] or 0.0) for a in AXES)
    for _ in range(HALVINGS):
        crowd = able.groupBy(*across, *[F.floor(F.col(a) / cell).alias(f"c{a}") for a in AXES]).agg(F.count(F.lit(1)).cast("double").alias("n"))
        if (crowd.agg(F.sum(F.col("n") * F.col("n")) / F.sum("n")).first()[0] or 0) <= CROWD:
            break
        cell /= 2
    while left.limit(1).count():
        at = [F.floor(F.col(a) / cell).alias(f"c{a}") for a in AXES]
        around = F.explode(F.array(*[F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), F.lit(c).alias("z")) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1)]))
        probes = left.select(*across, "id", *AXES, *at, around.alias("o")).select(*across, "id", *AXES, *[(F.col(f"c{a}") + F.col(f"o.{a}")).alias(f"c{a}") for a in AXES])
        own = able.select(*across, F.col("id").alias("v"), *[F.col(a).alias(f"v{a}") for a in AXES], *at)
        distance = F.sqrt(sum(((F.col(a) - F.col(f"v{a}")) * (F.col(a) - F.col(f"v{a}")) for a in AXES), F.lit(0.0)))
        best = probes.join(own, [*across, "cx", "cy", "cz"]).groupBy(*across, "id").agg(F.min(F.struct(distance.alias("d"), F.col("v"))).alias("__best"))
        near = best.select(*across, "id", F.col("__best.v").alias("nearest"), F.col("__best.d").alias("distance"))
        met = cut(near)
        sure = met if cell >= extent else met.where(F.col("distance") <= cell)
        found = sure if found is None else found.unionByName(sure)
        if cell >= extent:
            break
        left = left.join(sure.select(*across, "id"), [*across, "id"], "left_anti")
        cell *= 2
    if found is None:
        return missing.select(*across, "id", F.lit(None).cast("long").alias("nearest"), F.lit(None).cast("double").alias("distance"))
    near = places.join(found, [*across, "id"]).drop("id")
    return missing.select(*across, "id", *AXES).join(near, [*across, *AXES], "left").select(*across, "id", "nearest", "distance")


def with_nearest(ssd: DataFrame, targets: DataFrame, default: float = 1000.0, cell: float = 20.0) -> DataFrame:
    """AK-03 with JN-10: (beam, ray, ssd), rays without a surface taking that of the ray with the nearest target; ``default`` where a beam has none.

    ``ssd`` has (beam, ray, ssd) and ``targets`` (beam, ray, x, y, z), one row per ray.
    """
    rows = cut(targets.join(ssd, ["beam", "ray"], "left").select("beam", F.col("ray").alias("id"), *AXES, "ssd"))
    missing, valid = rows.where(F.coalesce(F.col("ssd") <= 0, F.lit(True))), rows.where("ssd > 0")
    near = nearest_point(missing, valid, cell, ("beam",))
    taken = near.join(valid.select("beam", F.col("id").alias("nearest"), F.col("ssd").alias("of")), ["beam", "nearest"], "left")
    return valid.select("beam", F.col("id").alias("ray"), "ssd").unionByName(taken.select("beam", F.col("id").alias("ray"), F.coalesce("of", F.lit(default)).alias("ssd")))

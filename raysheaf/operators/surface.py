"""Surfaces of structures: marching cubes over the cells between samples, vertices known by the lattice edge that they lie on."""

from __future__ import annotations

from functools import cache
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Cells of a block are put together in one task before they are shuffled.
BLOCK = 32


def _edge(a: int, b: int) -> tuple[int, int]:
    """An edge of the cube by its lower corner and its axis; corner c lies at its bits (x, y, z)."""
    return min(a, b), (a ^ b).bit_length() - 1


def _faces() -> list[list[int]]:
    """The corners of each face in turn, counter-clockwise from outside."""
    found = []
    for axis, side in product(range(3), (0, 1)):
        u, v = (axis + 1) % 3, (axis + 2) % 3
        ring = [(side << axis) | (a << u) | (b << v) for a, b in ((0, 0), (1, 0), (1, 1), (0, 1))]
        found.append(ring if side else ring[::-1])
    return found


@cache
def triangles_of() -> tuple[tuple[tuple[tuple[int, int], ...], ...], ...]:
    """The triangles of each of the 256 cases, a case being the bits of the corners inside.

    On a face every run of inside corners is cut off by one segment, which depends on that face's corners alone, so that
    neighbours agree. A crossed edge begins one segment and ends one: segments join to loops, and loops are cut to fans,
    from a vertex whose diagonals keep off the faces, where there is one.
    """
    cases = []
    for case in range(256):
        after = {}
        for ring in _faces():
            inside = [case >> c & 1 for c in ring]
            for n in range(4):
                if inside[n] and not inside[n - 1]:  # a run begins behind corner n - 1
                    end = next(m for m in range(n, n + 4) if not inside[(m + 1) % 4])
                    after[_edge(ring[n - 1], ring[n])] = _edge(ring[end % 4], ring[(end + 1) % 4])
        triangles = []
        while after:
            start = min(after)
            loop = [start]
            while (following := after.pop(loop[-1])) != start:
                loop.append(following)
            rings = [loop[i:] + loop[:i] for i in range(len(loop))]
            best = min(rings, key=lambda r: sum(_share_face(r[0], e) for e in r[2:-1]))
            triangles += [(best[0], best[i], best[i + 1]) for i in range(1, len(best) - 1)]
        cases.append(tuple(triangles))
    return tuple(cases)


def _share_face(a: tuple[int, int], b: tuple[int, int]) -> bool:
    def faces(edge):
        return {(axis, edge[0] >> axis & 1) for axis in range(3) if axis != edge[1]}

    return bool(faces(a) & faces(b))


def _cells(samples: DataFrame, keys: list[str]) -> DataFrame:
    """A row per cell that the surface may cross: its lowest corner's place and the eight samples, absent ones being 0."""
    corner = F.explode(F.sequence(F.lit(0), F.lit(7))).alias("c")
    near = samples.repartition(*keys, *[F.floor(F.col(n) / BLOCK) for n in "ijk"]).select(*keys, *"ijk", "value", corner)
    bit = lambda n: F.shiftright("c", n).bitwiseAND(F.lit(1))
    near = near.select(*keys, *[(F.col(a) - bit(n)).alias(a) for n, a in enumerate("ijk")], "c", "value")
    values = [F.coalesce(F.max(F.when(F.col("c") == c, F.col("value"))), F.lit(0.0)) for c in range(8)]
    return near.groupBy(*keys, *"ijk").agg(F.array(*values).alias("values"))


def triangles(samples: DataFrame, level: float = 0.5, keys: tuple[str, ...] = ()) -> DataFrame:
    """AK-36: (keys, i, j, k, values, corners) per triangle: three (corner, axis) of the cell whose lowest corner is (i, j, k), counter-clockwise from outside.

    samples: (keys, i, j, k, value), one a place; null values and absent places are 0, so that with a positive level
    every surface is closed. Inside is what exceeds the level. ``ValueError`` for a level below 0.
    """
    if level < 0:
        raise ValueError("the level must not be negative")
    known = samples.where("value is not null").select(*keys, *[F.col(n).cast("long").alias(n) for n in "ijk"], F.col("value").cast("double").alias("value"))
    cells = _cells(known, list(keys))
    case = sum((F.when(F.element_at("values", c + 1) > level, 1 << c).otherwise(0) for c in range(8)), F.lit(0))
    crossed = cells.withColumn("case", case).where("case not in (0, 255)")
    rows = [(n, [[list(e) for e in t] for t in case]) for n, case in enumerate(triangles_of())]
    table = samples.sparkSession.createDataFrame(rows, "case int, found array<array<array<int>>>")
    return crossed.join(F.broadcast(table), "case").select(*keys, *"ijk", "values", F.explode("found").alias("corners"))  # 256 rows


def _vertex(edge: Column, level: float, spacing: tuple[float, float, float], origin: tuple[float, float, float]) -> Column:
    """Lattice edge (i, j, k, axis) and place of a triangle's corner."""
    corner, axis = edge[0], edge[1]
    place = [F.col(n) + F.shiftright(corner, b).bitwiseAND(F.lit(1)) for b, n in enumerate("ijk")]
    low, high = F.element_at("values", corner + 1), F.element_at("values", corner + F.element_at(F.array(F.lit(1), F.lit(2), F.lit(4)), axis + 1) + 1)
    part = (F.lit(level) - low) / (high - low)
    at = [(p + F.when(axis == b, part).otherwise(0.0)) * s + o for b, (p, s, o) in enumerate(zip(place, spacing, origin, strict=True))]
    return F.struct(*[p.alias(n) for p, n in zip(place, "ijk", strict=True)], axis.alias("axis"), *[a.alias(n) for a, n in zip(at, "xyz", strict=True)])


def placed(found: DataFrame, level: float = 0.5, spacing: tuple[float, float, float] = (1.0, 1.0, 1.0), origin: tuple[float, float, float] = (0.0, 0.0, 0.0), keys: tuple[str, ...] = ()) -> DataFrame:
    """Triangles as (keys, a, b, c, normal): corners with their lattice edges and places, i along x, and the normal of twice the area's length."""
    rows = found.select(*keys, *[_vertex(F.col("corners")[n], level, spacing, origin).alias(v) for n, v in enumerate("abc")])
    side = lambda v, n: F.col(f"{v}.{n}") - F.col(f"a.{n}")
    cross = [side("b", p) * side("c", q) - side("b", q) * side("c", p) for p, q in ("yz", "zx", "xy")]
    return rows.withColumn("normal", F.struct(*[c.alias(n) for c, n in zip(cross, "xyz", strict=True)]))


def vertices(placed_triangles: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """ST-09: each vertex once, known by its lattice edge, with the mean of its triangles' normals by area, of length 1 (null where they cancel out)."""
    rows = placed_triangles.select(*keys, F.explode(F.array("a", "b", "c")).alias("v"), "normal").select(*keys, "v.*", "normal")
    edge = [*keys, *"ijk", "axis"]
    one = rows.groupBy(*edge).agg(*[F.first(n).alias(n) for n in "xyz"], *[F.sum(f"normal.{n}").alias(f"n{n}") for n in "xyz"])  # x, y and z follow from the edge
    length = F.sqrt(sum((F.col(f"n{n}") * F.col(f"n{n}") for n in "xyz"), F.lit(0.0)))
    return one.select(*edge, *"xyz", *[(F.col(f"n{n}") / F.nullif(length, F.lit(0.0))).alias(f"n{n}") for n in "xyz"])


def edges(placed_triangles: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Each edge once: (keys, low, high, forward, backward), how often triangles run along it either way. A closed surface runs both ways alike."""
    ids = {v: F.struct(*[F.col(f"{v}.{n}").alias(n) for n in (*"ijk", "axis")]) for v in "abc"}
    runs = F.explode(F.array(*[F.struct(ids[p].alias("p"), ids[q].alias("q")) for p, q in ("ab", "bc", "ca")])).alias("e")
    rows = placed_triangles.select(*keys, runs).select(*keys, F.least("e.p", "e.q").alias("low"), F.greatest("e.p", "e.q").alias("high"), (F.col("e.p") < F.col("e.q")).alias("up"))
    return rows.groupBy(*keys, "low", "high").agg(F.count_if("up").alias("forward"), F.count_if(~F.col("up")).alias("backward"))


def measures(placed_triangles: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, triangles, area, volume) of each surface: partial sums only."""
    n = F.col("normal")
    area = F.sqrt(n["x"] * n["x"] + n["y"] * n["y"] + n["z"] * n["z"]) / 2
    volume = sum((F.col(f"a.{c}") * n[c] for c in "xyz"), F.lit(0.0)) / 6
    return placed_triangles.groupBy(*keys).agg(F.count(F.lit(1)).alias("triangles"), F.sum(area).alias("area"), F.sum(volume).alias("volume"))

"""Column builders: look-ups, predicates, conversions and colour maps, all inside code generation."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def electron_density(hu: Column) -> Column:
    """PF-01: relative electron density, linear in four pieces."""
    return F.when(hu <= -1000, 0.0).when(hu <= 0, 1.0 + hu / 1000.0).when(hu <= 100, 1.0 + 0.001 * hu).otherwise(1.1 + 0.0005 * (hu - 100))


def window_level(hu: Column, low: float, high: float) -> Column:
    """PF-23: grey value 0 to 255, truncated."""
    return F.when(hu <= low, 0).when(hu >= high, 255).otherwise((255.0 * (hu - low) / (high - low)).cast("int"))


def texture16(hu: Column) -> Column:
    """SF-34: 12-bit range as 16-bit texture value."""
    return (F.least(F.greatest((hu + 1024) / 4096.0, F.lit(0.0)), F.lit(1.0)) * 65535).cast("int")


def any_contains(text: Column, parts: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for p in parts:
        found = found | text.contains(p)
    return found


def is_target_objective(name: Column, kind: Column) -> Column:
    """PF-11: for objectives."""
    return any_contains(kind, ("TARGET", "PTV", "CTV", "GTV")) | any_contains(name, ("PTV", "CTV", "GTV"))


def is_target_conformity(name: Column, kind: Column) -> Column:
    """PF-12: for conformity and homogeneity; a type of PTV alone does not count."""
    return kind.contains("TARGET") | any_contains(name, ("PTV", "CTV", "GTV"))


def is_target_steering(kind: Column) -> Column:
    """PF-13: for ray generation."""
    return kind.isin("PTV", "GTV", "CTV", "TARGET")


def is_target_isocentre(kind: Column) -> Column:
    """PF-14: for the isocentre."""
    return kind.isin("PTV", "GTV", "CTV")


def type_from_name(name: Column) -> Column:
    """SF-25: structure type by the first pattern found in the upper-cased name."""
    n = F.upper(name)
    return (
        F.when(n.contains("PTV"), "PTV")
        .when(n.contains("GTV"), "GTV")
        .when(n.contains("CTV"), "CTV")
        .when(any_contains(n, ("TARGET", "TUMOR")), "TARGET")
        .when(any_contains(n, ("BODY", "EXTERNAL", "SKIN")), "EXTERNAL")
        .otherwise("OAR")
    )


def priority(kind: Column) -> Column:
    """IO-12: overlap priority of a structure type."""
    return F.when(kind.isin("PTV", "TARGET"), 1).when(kind.isin("GTV", "CTV"), 2).when(kind == "EXTERNAL", 5).otherwise(3)


def satisfied(kind: str, value: Column, limit: float) -> Column:
    """PF-16: inclusive constraint; kind is min, max or mean."""
    return value >= limit if kind == "min" else value <= limit


def snap(x: Column, width: float) -> Column:
    """SF-13: index on a grid of that width, halves away from zero."""
    return F.round(x / width).cast("long")


def snap_to(x: Column, resolution: float) -> Column:
    """SF-14: to a multiple of the resolution; none leaves x."""
    return F.round(x / resolution) * resolution if resolution > 0 else x


def project_to_iso(x: Column, depth: Column, sad: float) -> Column:
    """SF-15: divergence projection on the isocentre plane."""
    return x * sad / (sad + depth)


def rotation(gantry: float, couch: float) -> list[list[float]]:
    """SF-03: couch rotation about y after gantry rotation about z, in degrees."""
    g, c = math.radians(gantry), math.radians(couch)
    rg = [[math.cos(g), -math.sin(g), 0.0], [math.sin(g), math.cos(g), 0.0], [0.0, 0.0, 1.0]]
    rc = [[math.cos(c), 0.0, math.sin(c)], [0.0, 1.0, 0.0], [-math.sin(c), 0.0, math.cos(c)]]
    return [[sum(rc[i][k] * rg[k][j] for k in range(3)) for j in range(3)] for i in range(3)]


def linear(v0: Column, v1: Column, t: Column) -> Column:
    """SF-09."""
    return v0 + (v1 - v0) * t


def bilinear(v00: Column, v01: Column, v10: Column, v11: Column, tx: Column, ty: Column) -> Column:
    """SF-09: v01 is one step along y."""
    return linear(linear(v00, v01, ty), linear(v10, v11, ty), tx)


def jet(t: Column) -> dict[str, Column]:
    """SF-32: red, green and blue of a value in 0 to 1."""
    return {n: F.least(F.greatest(1.5 - F.abs(4.0 * (t - c)), F.lit(0.0)), F.lit(1.0)) for n, c in (("red", 0.75), ("green", 0.5), ("blue", 0.25))}


def next_power_of_two(n: Column) -> Column:
    """SF-37: by the length of n - 1 in binary digits, exact for any n."""
    return F.when(n <= 1, F.lit(1).cast("long")).otherwise(F.call_function("shiftleft", F.lit(1).cast("long"), F.length(F.bin(n - 1)).cast("int")))


def positive_log10(x: Column) -> Column:
    """SF-35."""
    return F.when(x > 0, F.log10(F.when(x > 0, x).otherwise(1.0))).otherwise(0.0)


def w_component(u: Column, v: Column, sign: Column) -> Column:
    """SF-28: third direction cosine; none is left if u and v use it up."""
    return F.sqrt(F.greatest(1 - u * u - v * v, F.lit(0.0))) * sign


def depth_dose(depth: Column, betas: tuple[float, ...], mu: float, kernels: list[Column], geo: Column, sad: float) -> Column:
    """SF-20: three-component exponential depth dose with inverse square, cut off at 0."""
    total = F.lit(0.0)
    for beta, k in zip(betas, kernels, strict=True):
        term = mu * depth * F.exp(-mu * depth) if abs(beta - mu) <= 1e-12 else beta / (beta - mu) * (F.exp(-mu * depth) - F.exp(-beta * depth))
        total = total + term * k
    return F.when((depth <= 0) | (geo < 1), 0.0).otherwise(F.greatest(total * F.pow(sad / geo, 2), F.lit(0.0)))


Vector = tuple[Column, Column, Column]


def dot(a: Vector, b: Vector) -> Column:
    """SF-01."""
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: Vector, b: Vector) -> Vector:
    """SF-01."""
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def normalised(a: Vector) -> Vector:
    """SF-01: of length 1, or zero where the length is below 1e-14."""
    n = F.sqrt(dot(a, a))
    short = n < 1e-14
    by = F.when(short, 1.0).otherwise(n)
    return tuple(F.when(short, 0.0).otherwise(x / by) for x in a)


def times(m: list[list[float]], a: Vector) -> Vector:
    """SF-02: matrix of numbers by vector of columns."""
    return tuple(m[i][0] * a[0] + m[i][1] * a[1] + m[i][2] * a[2] for i in range(3))


def ramp(t: Column, stops: list[tuple[float, float, float]]) -> dict[str, Column]:
    """SF-33: colour of t in 0 to 1 between equidistant stops."""
    n = len(stops) - 1
    x = F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0)) * n
    at = F.least(F.floor(x), F.lit(n - 1)).cast("int")
    pick = lambda c, d: F.element_at(F.array(*[F.lit(float(s[c])) for s in stops]), at + 1 + d)
    return {name: linear(pick(c, 0), pick(c, 1), x - at) for c, name in enumerate(("red", "green", "blue"))}


def in_polygon(x: Column, y: Column, points: Column) -> Column:
    """SF-30: even-odd rule over an array of (x, y); an edge holds its lower end and not its upper."""
    n = F.size(points)
    following = lambda i: F.element_at(points, (i + 1) % n + 1)
    crossed = F.filter(points, lambda p, i: ((p["y"] > y) != (following(i)["y"] > y)) & (x < (following(i)["x"] - p["x"]) * (y - p["y"]) / F.nullif(following(i)["y"] - p["y"], F.lit(0.0)) + p["x"]))
    return F.size(crossed) % 2 == 1


def numbers_in(text: Column, negative: bool = False) -> Column:
    """SF-39: array of the numbers in a list with commas or blanks; other words are left out. Unless ``negative``, the list ends at a word that begins with a minus sign."""
    held = text if negative else F.regexp_replace(text, r"(^|[,\s]+)-[\s\S]*$", "")
    return F.filter(F.transform(F.split(held, r"[,\s]+"), lambda w: w.try_cast("double")), lambda v: v.isNotNull())


def inverse(m: list[list[float]]) -> list[list[float]]:
    """SF-02: inverse of a 3 by 3 matrix of numbers, the identity where it has none."""
    c = lambda i, j: m[(i + 1) % 3][(j + 1) % 3] * m[(i + 2) % 3][(j + 2) % 3] - m[(i + 1) % 3][(j + 2) % 3] * m[(i + 2) % 3][(j + 1) % 3]
    det = sum(m[0][j] * c(0, j) for j in range(3))
    if abs(det) < 1e-14:
        return [[float(i == j) for j in range(3)] for i in range(3)]
    return [[c(j, i) / det for j in range(3)] for i in range(3)]


def by_type(kind: Column, colours: dict[int, tuple[float, float, float]], default: tuple[float, float, float]) -> dict[str, Column]:
    """SF-33: colour of a particle's type."""
    found = {}
    for c, name in enumerate(("red", "green", "blue")):
        pick = F.lit(float(default[c]))
        for k, colour in colours.items():
            pick = F.when(kind == k, float(colour[c])).otherwise(pick)
        found[name] = pick
    return found


def ramp_between(x: Column, low: Column, high: Column, stops: list[tuple[float, float, float]]) -> dict[str, Column]:
    """SF-33: colour of a value in a range; grey where the range is empty."""
    t = (x - low) / F.nullif(high - low, F.lit(0.0))
    return {n: F.when(high > low, c).otherwise(0.5) for n, c in ramp(F.coalesce(t, F.lit(0.0)), stops).items()}

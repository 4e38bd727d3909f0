"""Surfaces by marching cubes."""

from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from raysheaf.operators import surface as su


def samples(spark, values):
    rows = [(*map(int, p), float(v)) for p, v in np.ndenumerate(values) if v]
    return spark.createDataFrame(rows, "i int, j int, k int, value double")


def test_every_case_is_closed_with_its_neighbours():
    """Triangles use all crossed edges of the case and no others; what lies on a face depends on its corners alone."""
    for case, found in enumerate(su.triangles_of()):
        crossed = {su._edge(a, a | 1 << n) for a in range(8) for n in range(3) if not a >> n & 1 and (case >> a ^ case >> (a | 1 << n)) & 1}
        assert {e for t in found for e in t} == crossed
        runs = [(t[m], t[(m + 1) % 3]) for t in found for m in range(3)]
        once = [r for r in runs if (r[1], r[0]) not in runs]
        assert len(once) == len(crossed) and all(su._share_face(*r) for r in once)
    assert su.triangles_of()[0] == su.triangles_of()[255] == () and len(su.triangles_of()[1]) == 1


def test_ball(spark):
    """Closed, every edge twice, volume and area of the ball, normals outward."""
    n, r = 24, 9.3
    at = np.stack(np.meshgrid(*[np.arange(n) - 11.4] * 3, indexing="ij"))
    field = np.clip(0.5 + r - np.sqrt((at**2).sum(0)), 0, 1)
    spacing, origin = (1.0, 2.0, 0.5), (5.0, -1.0, 2.0)
    found = su.placed(su.triangles(samples(spark, field)), 0.5, spacing, origin).cache()
    edges = su.edges(found)
    assert edges.where("forward != 1 or backward != 1").count() == 0
    m = su.measures(found).first()
    v = su.vertices(found).cache()
    assert v.count() - edges.count() + m.triangles == 2
    assert m.volume == pytest.approx(4 / 3 * np.pi * r**3 * np.prod(spacing), rel=0.02)
    outward = sum((F.col(f"n{c}") * (F.col(c) - (11.4 * s + o)) for c, s, o in zip("xyz", spacing, origin)), F.lit(0.0))
    assert v.where(outward <= 0).count() == 0
    even = su.measures(su.placed(su.triangles(samples(spark, field)))).first()
    assert even.area == pytest.approx(4 * np.pi * r**2, rel=0.02)


def test_noise_like_plain_loops(spark):
    """A field without order, across blocks: triangles like a plain loop's, surfaces balanced."""
    values = np.round(np.random.default_rng(1).random((9, 8, 37)), 3)
    found = su.placed(su.triangles(samples(spark, values), 0.6), 0.6).cache()
    full = np.zeros(tuple(d + 2 for d in values.shape))
    full[1:-1, 1:-1, 1:-1] = values
    want = set()
    for p in product(*[range(d - 1) for d in full.shape]):
        corners = [full[tuple(p[n] + (c >> n & 1) for n in range(3))] for c in range(8)]
        for t in su.triangles_of()[sum((v > 0.6) << c for c, v in enumerate(corners))]:
            want.add(tuple((*[p[n] - 1 + (c >> n & 1) for n in range(3)], axis) for c, axis in t))
    got = [tuple((r[v].i, r[v].j, r[v].k, r[v].axis) for v in "abc") for r in found.collect()]
    assert len(got) == len(want) and set(got) == want
    assert su.edges(found).where("forward != backward").count() == 0
    for r in found.limit(200).collect():
        for v in (r.a, r.b, r.c):
            low = full[v.i + 1, v.j + 1, v.k + 1]
            high = full[tuple(n + 1 + (b == v.axis) for b, n in enumerate((v.i, v.j, v.k)))]
            assert (v.x, v.y, v.z)[v.axis] - (v.i, v.j, v.k)[v.axis] == pytest.approx((0.6 - low) / (high - low))


def test_keys_nulls_and_nothing(spark):
    rows = spark.createDataFrame([("a", 0, 0, 0, 1.0), ("b", 0, 0, 0, 1.0), ("b", 5, 5, 5, None), (None, 2, 2, 2, 0.9)], "structure string, i int, j int, k int, value double")
    found = su.placed(su.triangles(rows, keys=("structure",)), keys=("structure",))
    assert {(r.structure, r.triangles) for r in su.measures(found, ("structure",)).collect()} == {("a", 8), ("b", 8), (None, 8)}
    assert su.vertices(found, ("structure",)).count() == 18
    assert su.triangles(rows.limit(0)).count() == 0 and su.triangles(rows.where("value < 0.4").drop("structure")).count() == 0
    with pytest.raises(ValueError):
        su.triangles(rows, -0.1)

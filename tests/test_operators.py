"""Closed-form values of the operators, each derived from the definitions by hand."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from raysheaf.functions import columns as fc
from raysheaf.operators import analysis as an
from raysheaf.operators import grids as gr
from raysheaf.operators import kernels as ke
from raysheaf.operators import morphology as mo
from raysheaf.operators import optimize as op
from raysheaf.operators import particles as ps
from raysheaf.operators import raytrace as rt
from raysheaf.operators import sequencing as sq
from raysheaf.operators import sparse as sp
from raysheaf.operators import steering as st


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


@pytest.fixture
def dij(spark):
    return spark.createDataFrame([(0, 0, 1.0), (1, 0, 0.5), (0, 1, 0.3), (7, 1, 2.0)], "voxel long, bixel long, value double")


def test_duplicates_are_summed(spark):
    d = spark.createDataFrame([(1, 2, 3.0), (1, 2, 7.0)], "voxel long, bixel long, value double")
    assert rows(sp.combined(d), "voxel", "bixel", "value") == [(1, 2, 10.0)]


def test_forward_and_transposed(spark, dij):
    w = spark.createDataFrame([(0, 10.0), (1, 5.0)], "bixel long, weight double")
    voxels = spark.range(8).withColumnRenamed("id", "voxel")
    assert rows(sp.forward(dij, w, voxels), "voxel", "dose") == [(0, 11.5), (1, 5.0), (2, 0.0), (3, 0.0), (4, 0.0), (5, 0.0), (6, 0.0), (7, 10.0)]
    g = spark.createDataFrame([(0, 2.0), (7, 0.0), (1, -1.0)], "voxel long, g double")
    assert rows(sp.transposed(dij, g), "bixel", "grad") == [(0, 1.5), (1, 0.6)]


def test_lookup_and_shape(spark, dij):
    want = spark.createDataFrame([(0, 1), (3, 3)], "voxel long, bixel long")
    assert rows(sp.looked_up(dij, want), "voxel", "bixel", "value") == [(0, 1, 0.3), (3, 3, 0.0)]
    assert rows(sp.shape(dij.limit(0)), "nnz", "max_value") == [(0, 0.0)]


def test_prefix_sums_cross_runs(spark):
    d = spark.range(10).select(F.col("id").alias("k"), F.lit(2).alias("n"))
    assert rows(sp.exclusive_prefix(d, "k", "n", run=3), "k", "start") == [(i, 2 * i) for i in range(10)]


def test_threshold_is_inclusive(spark):
    d = spark.createDataFrame([(0, 0, 1.0), (1, 0, 0.5), (2, 0, 0.25)], "voxel long, bixel long, value double")
    assert rows(sp.thresholded(d, 0.5), "voxel") == [(0,), (1,)]


def test_dose_statistics(spark):
    d = spark.createDataFrame([("a", x) for x in (100.0, 50.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0)], "structure string, dose double")
    r = an.summary(d).first()
    assert (r.n, r.max_dose, r.mean_dose) == (8, 100.0, 18.75)
    assert an.grid_summary(d.limit(0)).first() == (0.0, 0.0)
    assert an.homogeneity(d).first().hi == 0.0


def test_curve_counts_from_above(spark):
    d = spark.createDataFrame([("a", float(x)) for x in range(11)], "structure string, dose double")
    got = rows(an.curves(d, bins=11), "bin", "dose", "volume")
    assert got == [(i, float(i), float(np.float32(100.0 * (11 - i) / 11))) for i in range(11)]


def test_dvh_objectives(spark):
    d = spark.createDataFrame([("a", float(x), x) for x in range(10)], "structure string, dose double, o long")
    low = an.dvh_objective(d, "min", 5.0, 0.75, 1.0).first().value
    assert low == sum((5 - x) ** 2 for x in range(2, 5))
    high = an.dvh_objective(d, "max", 5.0, 0.25, 1.0).first().value
    assert high == sum((x - 5) ** 2 for x in range(6, 7))


def test_quantiles_of_piled_up_doses(spark):
    """99 % of a structure at one dose: quantiles and cuts as of the sorted values."""
    rng = np.random.default_rng(7)
    values = {"piled": np.r_[np.zeros(990), rng.uniform(0, 70, 10)], "spread": rng.normal(50, 5, 501), "one": np.array([3.0]), "ends": np.array([0.0, 1e9, 1e-9])}
    d = spark.createDataFrame([(s, float(x)) for s, v in values.items() for x in v], "structure string, dose double").repartition(3)
    shares = {"a": 0.02, "b": 0.5, "c": 0.995, "d": 0.0, "e": 1.0}
    got = {r.structure: r for r in an.quantiles(d, shares).collect()}
    for s, v in values.items():
        assert [got[s][n] for n in shares] == pytest.approx([float(np.quantile(v, q)) for q in shares.values()], abs=1e-9)
    assert an.quantiles(d.limit(0), shares).count() == 0


@pytest.mark.parametrize(("kind", "fraction"), [("min", 0.95), ("max", 0.3), ("min", 0.0), ("max", 0.0), ("min", 1.0), ("max", 1.0)])
def test_dvh_gradient_by_sorting(spark, kind, fraction):
    rng = np.random.default_rng(5)
    data = [(s, float(x), i) for s, v in (("a", np.r_[np.full(60, 2.0), rng.uniform(0, 9, 41).round(1)]), ("b", rng.uniform(0, 9, 20))) for i, x in enumerate(v)]
    d = spark.createDataFrame(data, "structure string, dose double, voxel long")
    got = {(r.structure, r.voxel): r.g for r in an.dvh_gradient(d, kind, 5.0, fraction, 3.0, "voxel").collect()}
    value = {r.structure: r.value for r in an.dvh_objective(d, kind, 5.0, fraction, 3.0).collect()}
    for s in "ab":
        rows = sorted((x, i) for t, x, i in data if t == s)
        n = len(rows)
        free = math.floor((1.0 - fraction) * n) if kind == "min" else math.ceil(fraction * n)
        counted = rows[free:] if kind == "min" else rows[: n - free]
        e = {i: max(5.0 - x, 0.0) if kind == "min" else max(x - 5.0, 0.0) for x, i in counted}
        assert value[s] == pytest.approx(3 * sum(x * x for x in e.values()))
        assert {i: g for (t, i), g in got.items() if t == s} == pytest.approx({i: (-6 if kind == "min" else 6) * e.get(i, 0.0) for _, i in rows})


def test_exact_hotspot_gradient(spark):
    def at(x, exact=True):
        return an.hotspots(spark.createDataFrame([("a", x)], "structure string, dose double"), 60.0, exact=exact).first()

    h = 1e-4
    assert math.isclose((at(66 + h).f - at(66 - h).f) / (2 * h), at(66.0).g_sum, rel_tol=1e-5)


def test_density_breakpoints(spark):
    d = spark.createDataFrame([(-1000,), (0,), (100,), (200,)], "hu int")
    assert [r[0] for r in d.select(fc.electron_density(F.col("hu"))).collect()] == [0.0, 1.0, 1.1, 1.1500000000000001]


def test_snap_rounds_halves_away(spark):
    d = spark.createDataFrame([(3.5,), (-3.5,), (10.4,)], "x double")
    assert [r[0] for r in d.select(fc.snap(F.col("x"), 7.0)).collect()] == [1, -1, 1]


def test_particles(spark):
    d = spark.createDataFrame([(i, -1 if i % 10 == 0 else 1, i - 50.0, 0.0, 271.7, 0.0, 0.0, 1.0, 1 + 0.05 * i) for i in range(100)], "rec long, type int, x double, y double, z double, u double, v double, w double, energy double")
    m = ps.metrics(d).first()
    assert (m.photons, m.electrons, m.positrons) == (90, 10, 0)
    assert ps.random_sample(d, 10).count() == 10 and ps.random_sample(d, 200).count() == 100
    assert ps.of_type(d, ps.ELECTRON).count() == 10
    assert ps.within_jaws(d, -200, 200, -200, 200, 1000.0, 27.17).count() == 100
    h = rows(ps.energy_histogram(d, 5), "bin", "n")
    assert [n for _, n in h] == [20] * 5
    assert ps.energy_histogram(d.limit(0), 5).count() == 0


def test_trace_straight(spark):
    box = rt.Box((5, 5, 5), (10.0, 10.0, 10.0), (5.0, 5.0, 5.0))
    rays = spark.createDataFrame([(1, -20.0, 25.0, 25.0, 70.0, 25.0, 25.0), (2, -20.0, 100.0, 100.0, 70.0, 100.0, 100.0)], "ray long, sx double, sy double, sz double, tx double, ty double, tz double")
    s = rt.segments(rays, box)
    assert rows(s, "ray", "i", "j", "k") == [(1, i, 2, 2) for i in range(5)]
    assert all(abs(r.length - 10) < 1e-9 for r in s.collect())
    dense = rt.with_density(s, spark.createDataFrame([], "i long, j long, k long, rho double"))
    assert abs(rt.deepest(dense).first().depth - 45) < 1e-9
    assert abs(rt.surface_distance(dense).first().ssd - 20) < 1e-9 and abs(rt.surface_distance(dense, compat=True).first().ssd) < 1e-9
    assert rt.surface_distance(dense, threshold=2.0).first().ssd == -1


def test_nearest_point(spark):
    rng = np.random.default_rng(3)
    p = rng.normal(size=(60, 3)) * 30
    d = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(p)], "id long, x double, y double, z double")
    got = {r.id: r.nearest for r in rt.nearest_point(d.where("id < 20"), d.where("id >= 20"), 1.0).collect()}
    assert got == {i: 20 + int(np.argmin(((p[20:] - p[i]) ** 2).sum(axis=1))) for i in range(20)}


def test_nearest_point_ends(spark):
    nan, kind = float("nan"), "b string, id long, x double, y double, z double"
    missing = spark.createDataFrame([("a", 1, 0.0, 0.0, 0.0), ("a", 2, None, 0.0, 0.0), ("a", 3, nan, 0.0, 0.0), ("b", 4, 0.0, 0.0, 0.0)], kind)
    valid = spark.createDataFrame([("a", 9, 5000.0, 0.0, 0.0), ("a", 8, 5000.0, 0.0, 0.0), ("a", 7, None, 0.0, 0.0)], kind)
    got = {r.id: (r.nearest, r.distance) for r in rt.nearest_point(missing, valid, 1.0, ("b",)).collect()}
    assert got == {1: (8, 5000.0), 2: (None, None), 3: (None, None), 4: (None, None)}
    assert [r.nearest for r in rt.nearest_point(missing.drop("b"), valid.drop("b").limit(0), 1.0).collect()] == [None] * 4
    ssd = spark.createDataFrame([("a", 1, 900.0), ("a", 2, -1.0), ("b", 1, -1.0)], "beam string, ray long, ssd double")
    targets = spark.createDataFrame([("a", 1, 0.0, 0.0, 0.0), ("a", 2, 9.0, 0.0, 0.0), ("b", 1, 0.0, 0.0, 0.0), ("b", 2, 1.0, 0.0, 0.0)], "beam string, ray long, x double, y double, z double")
    assert rows(rt.with_nearest(ssd, targets), "beam", "ray", "ssd") == [("a", 1, 900.0), ("a", 2, 900.0), ("b", 1, 1000.0), ("b", 2, 1000.0)]


def test_trace_through_a_large_box(spark):
    box = rt.Box((512, 512, 512), (1.0, 1.0, 1.0), (-255.5, -255.5, -255.5))
    rng = np.random.default_rng(2)
    ends = rng.uniform(-200, 200, (40, 3))
    rays = spark.createDataFrame([(i, -1000.0, 3.3, -4.4, *map(float, e)) for i, e in enumerate(ends)], "ray long, sx double, sy double, sz double, tx double, ty double, tz double")
    got = {r.ray: r for r in rt.segments(rays, box).groupBy("ray").agg(F.sum("length").alias("length"), F.count(F.lit(1)).alias("n")).collect()}
    for i, e in enumerate(ends):
        d = e - np.array([-1000.0, 3.3, -4.4])
        entry = (-256 + 1000.0) / d[0]
        at = np.array([-1000.0, 3.3, -4.4]) + (entry + 1e-9) * d
        assert got[i].length == pytest.approx((1 - entry) * np.linalg.norm(d), rel=1e-6)
        assert got[i].n == 1 + sum(int(np.floor(max(a, b) - 0.0)) - int(np.floor(min(a, b) - 0.0)) for a, b in zip(at, e, strict=True))


def test_blur_leaves_the_border(spark):
    d = spark.createDataFrame([(i, j, k, 1.0) for i in range(4) for j in range(3) for k in range(3)], "i long, j long, k long, v double")
    got = {(r.i, r.j, r.k): r.v for r in mo.blurred(d, (4, 3, 3)).collect()}
    assert len(got) == 36 and {p for p, v in got.items() if v} == {(1, 1, 1), (2, 1, 1)} and got[1, 1, 1] == pytest.approx(1.0)


@pytest.mark.parametrize(("margin", "n"), [(0, 1), (1, 27), (2, 125)])
def test_dilation(spark, margin, n):
    allowed = spark.range(10).select(F.col("id").alias("i")).crossJoin(spark.range(10).select(F.col("id").alias("j"))).crossJoin(spark.range(10).select(F.col("id").alias("k")))
    t = spark.createDataFrame([(5, 5, 5)], "i long, j long, k long")
    assert mo.dilated(t, allowed, (10, 10, 10), (1.0, 1.0, 1.0), (float(margin),) * 3).count() == n


def test_flood_fill_and_components():
    ring = np.zeros((7, 7), bool)
    ring[1:6, 1:6] = True
    ring[2:5, 2:5] = False
    assert (~(mo.exterior(ring) | ring)).sum() == 9
    two = np.zeros((4, 6), bool)
    two[0, 0] = two[2:4, 3:6] = True
    assert sorted(np.unique(mo.labels4(two), return_counts=True)[1].tolist()) == [1, 6, 17]


def test_rasterized_square(spark):
    c = spark.createDataFrame([(1, 0, 2, [(1.5, 1.5), (4.5, 1.5), (4.5, 3.5), (1.5, 3.5)]), (1, 1, 2, [(0.0, 0.0), (1.0, 1.0)])], "struct_id int, contour_id int, k int, points array<struct<x:double,y:double>>")
    assert rows(mo.rasterized(c, 0.0, 1.0, 8, 0.0, 1.0, 8), "i", "j") == [(i, j) for i in (2, 3) for j in (2, 3, 4)]


def test_grids(spark):
    g = gr.Grid((3, 4, 2), (1.0, 1.0, 1.0))
    d = spark.createDataFrame([(1, 0, 0), (0, 1, 0), (0, 0, 1)], "i long, j long, k long")
    assert [r[0] for r in d.select(g.flat_a(F.col("i"), F.col("j"), F.col("k"))).collect()] == [1, 3, 12]
    assert gr.Grid((10, 10, 1), (1.0, 1.0, 3.0)).resampled((2.5, 2.5, 2.5)).dims == (4, 4, 1)
    dose = spark.createDataFrame([(i, j, k, float(i + 10 * j + 100 * k)) for i in range(3) for j in range(3) for k in range(3)], "i long, j long, k long, dose double")
    s = spark.createDataFrame([(1, 0.5, 1.25, 1.75), (2, -4.0, 9.0, 2.0)], "id long, fi double, fj double, fk double")
    assert rows(gr.trilinear(s, dose, (3, 3, 3)), "id", "dose") == [(1, 0.5 + 12.5 + 175), (2, 220.0)]
    v = spark.createDataFrame([(0, 0, 0.0), (0, 1, 0.0), (1, 0, 10.0), (1, 1, 10.0)], "ix long, iy long, v double")
    p = spark.createDataFrame([(1, 0.25, 0.5), (2, 1.5, 0.0)], "id long, x double, y double")
    assert rows(gr.interpolated(p, v, 2, 2, 0.0, 1.0, 0.0, 1.0), "id", "v") == [(1, 2.5), (2, 0.0)]
    t = spark.createDataFrame([(-1.0,), (0.5,), (2.0,), (2.5,)], "x double")
    assert [r[0] for r in t.select(gr.lerp_table(F.col("x"), 1.0, F.array(*map(F.lit, (1.0, 3.0, 7.0))))).collect()] == [1.0, 2.0, 7.0, 0.0]


def test_rays(spark):
    plan = spark.createDataFrame([(0, 0.0, 0.0)], "beam long, gantry double, couch double")
    p = spark.createDataFrame([(14.0, 1000.0, 0.0)], "x double, y double, z double")
    assert rows(st.target_rays(p, plan, 1000.0, 7.0), "ix", "iz") == [(1, 0)]
    assert st.target_rays(p, plan, 1000.0, 7.0, pad=2).count() == 25
    gantry = spark.createDataFrame([(float(a),) for a in st.angle_range(0, 90, 360)], "gantry double")
    couch = spark.createDataFrame([(0.0,), (15.0,)], "couch double")
    assert rows(st.beams(gantry, couch), "beam", "gantry", "couch")[4] == (4, 0.0, 15.0)
    with pytest.raises(ValueError):
        st.angle_range(0, 0, 360)


def test_sequencing(spark):
    q = spark.createDataFrame([(0, 0, 0, 3), (0, 0, 1, 1), (0, 1, 0, 0), (0, 1, 1, 3)], "beam long, lp long, col long, q int")
    assert rows(sq.shape_runs(q), "first_level", "weight") == [(1, 1), (2, 2)]
    assert rows(sq.openings(q), "level", "lp", "left", "right")[0] == (1, 0, 0, 1)
    assert rows(sq.merged_runs(sq.shape_runs(q), 10, 10.0, 1.5), "first_level", "weight", "mu") == [(1, 3, 3.0)]
    flat = spark.createDataFrame([(0, 1.0, 2.0), (0, 1.0, 2.0), (1, 1.0, 2.0), (1, 1.0, 3.0), (2, 1.0, 2.0), (2, 2.0, 4.0)], "beam long, a double, b double")
    assert rows(sq.fidelity(flat), "beam", "fidelity") == [(0, 1.0), (1, 0.0), (2, 1.0)]


def test_convolution(spark):
    a, b = np.arange(12.0).reshape(3, 4), np.array([[1.0, 2.0], [0.0, -1.0]])
    long = lambda x: spark.createDataFrame([(i, j, float(x[i, j])) for i in range(x.shape[0]) for j in range(x.shape[1])], "i long, j long, v double")
    full = ke.convolve(a, b)
    assert np.allclose(full, sum(np.pad(a * b[i, j], ((i, 1 - i), (j, 1 - j))) for i in (0, 1) for j in (0, 1)))
    assert all(abs(r.v - full[r.i, r.j]) < 1e-9 for r in ke.convolved(long(a), long(b)).collect())
    assert abs(ke.penumbra(5.0, 20, 0.5).sum() - 1) < 1e-12


def test_bounded_minimum():
    h = np.array([[3.0, 1.0], [1.0, 2.0]])
    goal = np.array([2.0, -1.0])
    found = op.minimise(lambda x: (0.5 * (x - goal) @ h @ (x - goal), h @ (x - goal)), 2, 0.0, 10.0)
    assert found.converged and np.allclose(found.weights, [2 - 1 / 3, 0], atol=1e-4)


def test_nearest_point_places_and_crowds(spark):
    """Copies at one place are one, cells narrow where points are dense, and ties still go to the smaller id."""
    rng = np.random.default_rng(3)
    at = rng.uniform(0, 1, (300, 3))
    data = [(i, *map(float, at[i % 300])) for i in range(1200)]
    d = spark.createDataFrame(data, "id long, x double, y double, z double")
    got = {r.id: (r.nearest, r.distance) for r in rt.nearest_point(d.where("id % 300 < 60"), d.where("id % 300 >= 60"), 100.0).collect()}
    assert len(got) == 240
    for i, (nearest, distance) in got.items():
        far = np.sqrt(((at[60:] - at[i % 300]) ** 2).sum(1))
        assert nearest == 60 + int(far.argmin()) and distance == pytest.approx(far.min())


def test_rasterized_spans_are_united_before_voxels(spark):
    """Contours that overlap, touch or repeat: a voxel once, and no aggregation over voxels."""
    square = lambda a, b: [(a, 1.5), (b, 1.5), (b, 4.5), (a, 4.5)]
    data = [(1, n, 0, s) for n, s in enumerate([square(0.5, 5.5), square(2.5, 3.5), square(4.5, 8.5), square(0.5, 5.5), square(10.5, 12.5)])] + [(None, 9, 0, square(0.5, 2.5))]
    c = spark.createDataFrame(data, "struct_id long, contour_id int, k int, points array<struct<x double, y double>>")
    found = mo.rasterized(c, 0.0, 1.0, 16, 0.0, 1.0, 16)
    want = [(1, i, j) for i in (2, 3, 4) for j in (*range(1, 9), 11, 12)]
    assert sorted((r.struct_id, r.i, r.j) for r in found.where("struct_id = 1").collect()) == want
    assert found.where("struct_id is null").count() == 6
    assert "HashAggregate" not in found._jdf.queryExecution().executedPlan().toString()

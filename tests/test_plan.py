"""Dose influence, objectives and optimization as wholes, against NumPy."""

import math
import os
import shutil
import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import Row

from raysheaf.functions import columns as fc
from raysheaf.operators import bricks as bk
from raysheaf.operators import grids as gr
from raysheaf.operators import objectives as ob
from raysheaf.operators import optimize as op
from raysheaf.operators import pencil as pb
from raysheaf.operators import raytrace as rt
from raysheaf.operators import rowblocks as rb
from raysheaf.operators import sparse as sp
from raysheaf.operators import steering as st
from raysheaf.operators import workflow as wf


def test_kernel_grid_by_direct_sums():
    """The field blurred and spread, at a few places, by sums over the three images."""
    positions, profiles = np.arange(0, 12.0, 1.0), [np.exp(-np.arange(12) / 3.0), np.ones(12), np.zeros(0)]
    origin, grid = pb.kernel_grid(profiles, positions, 4.0, 3.0, 6.0, 0.5)
    sigma = 3.0 / math.sqrt(8 * math.log(2))
    field, gauss, reach = np.arange(-4, 4), np.arange(-math.ceil(5 * sigma / 0.5), math.ceil(5 * sigma / 0.5)), np.arange(-12, 12)
    assert origin == -0.5 * (4 + len(gauss) // 2 + 12) and grid.shape[1] == 2 * (4 + len(gauss) // 2 + 12)
    blur = np.exp(-(gauss * 0.5) ** 2 / (2 * sigma**2))
    line = np.convolve(np.ones(len(field)), blur)  # separable: field and Gaussian along one axis
    at = np.arange(len(line)) + field[0] + gauss[0]
    for x, z in ((0, 0), (3, -2), (10, 4)):
        total = 0.0
        for i, a in zip(at, line, strict=True):
            for j, b in zip(at, line, strict=True):
                dx, dz = x - i, z - j
                if -12 <= dx < 12 and -12 <= dz < 12:
                    total += a * b * np.interp(math.hypot(dx, dz) * 0.5, positions, profiles[0], right=0.0)
        total *= 0.5**2 / (2 * math.pi * sigma**2)
        n = grid.shape[1] // 2
        assert grid[0, x + n, z + n] == pytest.approx(total, rel=1e-9)
    assert not grid[2].any()


def test_influence_of_two_beams(spark):
    """Every entry by its formula: geometry, depth in a uniform block, nearest kernel, bilinear look-up, cut-off, threshold."""
    machine, width, iso = pb.Machine(cutoff=6.0), 5.0, (1.0, -2.0, 3.0)
    box = rt.Box((20, 20, 20), (10.0, 10.0, 10.0), (-95.0, -95.0, -95.0))
    density = spark.range(20).selectExpr("id as i").crossJoin(spark.range(20).selectExpr("id as j")).crossJoin(spark.range(20).selectExpr("id as k")).selectExpr("i", "j", "k", "double(0.5) as rho")
    rng = np.random.default_rng(4)
    points = rng.uniform(-30, 30, (60, 3))
    voxels = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(points)], "voxel long, x double, y double, z double")
    plan = spark.createDataFrame([(0, 20.0, 5.0), (1, 110.0, 5.0)], "beam long, gantry double, couch double")
    rays = st.ray_set(voxels.where("voxel < 30"), plan, machine.sad, width, (1.0, 1.0, 1.0), iso=iso)
    positions = np.arange(0, 40.0, 1.0)
    profiles = [[list(np.exp(-positions / (s + c + 2))) for c in range(3)] for s in range(2)]
    kernels = spark.createDataFrame([(s, list(map(float, positions)), *[list(map(float, x)) for x in profiles[s]]) for s in range(2)], "kernel int, positions array<double>, k1 array<double>, k2 array<double>, k3 array<double>")
    grids = pb.kernel_rows(kernels, width, machine.fwhm, 20.0)
    ssds = spark.createDataFrame([(0, 700.0), (1, 905.0)], "kernel int, ssd double")
    got = {(r.voxel, r.bixel): r.value for r in pb.influence(voxels, plan, rays, grids, ssds, machine, width, iso, density, box, relative=0.02).collect()}
    origin, grid = pb.kernel_grid([np.array(p) for p in profiles[1]], positions, width, machine.fwhm, 20.0)
    want = {}
    for beam, gantry in ((0, 20.0), (1, 110.0)):
        r = np.array(fc.rotation(gantry, 5.0))
        source = r @ np.array([0, -machine.sad, 0]) + iso
        for ray in rays.where(f"beam = {beam}").collect():
            own = {}
            for v, p in enumerate(points):
                b = r.T @ (p - iso)
                depth, geo = machine.sad + b[1], np.linalg.norm(p - source)
                ox, oz = (b[0] - ray.ix * width) * machine.sad / depth, (b[2] - ray.iz * width) * machine.sad / depth
                if math.hypot(ox, oz) > machine.lateral(width):
                    continue
                # Radiological depth at the middle of the last segment: from the entry into the block at half density.
                d = p - source
                alphas = sorted({(x - source[a]) / d[a] for a in range(3) for x in np.arange(-100, 101, 10.0)})
                entry = max(min((-100 - source[a]) / d[a], (100 - source[a]) / d[a]) for a in range(3))
                last = max([x for x in alphas if x < 1 - 1e-12 and x > entry], default=entry)
                rad = 0.5 * ((last - entry) + (1 - last) / 2) * geo
                fx, fz = (ox - origin) / 0.5, (oz - origin) / 0.5
                ix, iz = int(fx), int(fz)
                tx, tz = fx - ix, fz - iz
                total = 0.0
                for c, beta in enumerate(machine.betas):
                    g = grid[c]
                    k = (1 - tx) * ((1 - tz) * g[ix, iz] + tz * g[ix, iz + 1]) + tx * ((1 - tz) * g[ix + 1, iz] + tz * g[ix + 1, iz + 1])
                    total += beta / (beta - machine.mu) * (math.exp(-machine.mu * rad) - math.exp(-beta * rad)) * k
                own[v] = max(total * (machine.sad / geo) ** 2, 0.0)
            top = max(own.values(), default=0.0)
            want |= {(v, ray.bixel): x for v, x in own.items() if x >= 0.02 * top}
    assert got.keys() == want.keys() and len(want) > 200
    for k, x in want.items():
        assert got[k] == pytest.approx(x, rel=1e-6)


def test_influence_in_water(spark):
    machine = pb.Machine(cutoff=6.0)
    voxels = spark.createDataFrame([(0, 0.0, 0.0, 0.0)], "voxel long, x double, y double, z double")
    plan = spark.createDataFrame([(0, 0.0, 0.0)], "beam long, gantry double, couch double")
    rays = st.ray_set(voxels, plan, machine.sad, 5.0, (1.0, 1.0, 1.0))
    kernels = spark.createDataFrame([(0, [0.0, 30.0], [1.0, 1.0], [0.0, 0.0], [])], "kernel int, positions array<double>, k1 array<double>, k2 array<double>, k3 array<double>")
    got = pb.influence(voxels, plan, rays, pb.kernel_rows(kernels, 5.0, 5.0, 20.0), spark.createDataFrame([(0, 1000.0)], "kernel int, ssd double"), machine, 5.0).collect()
    assert len(got) == 1 and got[0].value > 0


def test_ray_sets(spark):
    plan = spark.createDataFrame([(0, 0.0, 0.0), (1, 90.0, 0.0)], "beam long, gantry double, couch double")
    none = spark.createDataFrame([], "x double, y double, z double")
    field = st.ray_set(none, plan, 1000.0, 7.0, (1.0, 1.0, 1.0), (21.0, 14.0)).collect()
    assert len(field) == 2 * 4 * 3 and sorted(r.bixel for r in field) == list(range(24))
    assert sorted({r.ix for r in field}) == [-2, -1, 1, 2]  # halves away from zero: column 0 is skipped
    assert st.padding(7.0, (1.0, 1.0, 15.0)) == 2 and st.padding(7.0, (1.0, 1.0, 7.0)) == 0


def dense_problem(spark):
    rng = np.random.default_rng(9)
    n_voxels, n_bixels = 60, 9
    a = rng.uniform(0, 1, (n_voxels, n_bixels)) * (rng.uniform(size=(n_voxels, n_bixels)) < 0.5)
    dij = spark.createDataFrame([(v, b, float(a[v, b])) for v, b in zip(*np.nonzero(a), strict=True) for v, b in [(int(v), int(b))]], "voxel long, bixel long, value double")
    kinds = [("deviation", 30.0, 5.0, 0.0), ("overdose", 10.0, 2.0, 0.0), ("underdose", 25.0, 3.0, 0.0), ("min_dvh", 28.0, 0.2, 0.9), ("max_dvh", 12.0, 0.1, 0.25)]
    members = {i: [int(v) for v in range(n_voxels) if v % 5 == i or v % 7 == i] for i in range(5)}
    objectives = spark.createDataFrame([(i, f"s{i}", k, d, w, f, len(members[i])) for i, (k, d, w, f) in enumerate(kinds)], "objective int, structure string, kind string, dose double, weight double, fraction double, n long")
    goals = spark.createDataFrame([(i, v) for i, vs in members.items() for v in vs], "objective int, voxel long")

    def evaluate(w, spot):
        dose, f, g = a @ w, 0.0, np.zeros(n_voxels)
        for i, (kind, level, weight, fraction) in enumerate(kinds):
            vs = members[i]
            if kind.endswith("dvh"):
                order = sorted(vs, key=lambda v: (dose[v], v))
                n = len(order)
                vs = order[math.floor((1.0 - fraction) * n) :] if kind == "min_dvh" else order[: n - math.ceil(fraction * n)]
            scale = weight if kind.endswith("dvh") else weight / len(members[i])
            for v in vs:
                e = dose[v] - level if kind == "deviation" else max(dose[v] - level, 0) if kind in ("overdose", "max_dvh") else -max(level - dose[v], 0)
                f += scale * e * e
                g[v] += 2 * scale * e
        for v in range(n_voxels):
            e = dose[v] - spot.threshold * spot.prescription
            if e > 0:
                x = e / spot.prescription
                f += spot.penalty * x * x * (1 + 10 * x) * e * e
                g[v] += 2 * spot.penalty * x * (1 + 15 * x) * e
        return f, a.T @ g

    return a, dij, objectives, goals, evaluate


def test_evaluation_like_dense(spark):
    a, dij, objectives, goals, dense = dense_problem(spark)
    spot = ob.Hotspot(30.0, 1.04, 50.0)
    voxels = spark.range(60).withColumnRenamed("id", "voxel")
    edges = [(i, j) for i in range(9) for j in (i - 1, i + 1) if 0 <= j < 9]

    def whole(w):
        f, g = dense(w, spot)
        step = np.array([w[i] - w[j] for i, j in edges])
        g = g + 2 * 0.01 * w + 0.02 * (w > 0)
        for (i, _), s in zip(edges, step, strict=True):
            g[i] += 2 * 0.05 * s
        return f + 0.05 / 2 * (step**2).sum() + 0.01 * w @ w + 0.02 * w.sum(), g

    how = {"l2": 0.01, "l1": 0.02, "smoothing": 0.05, "edges": edges}
    evaluate = rb.Objective(dij, list(range(9)), voxels, objectives, goals, spot, **how)
    trials = [np.zeros(9), np.linspace(0, 20, 9), np.full(9, 7.0), np.eye(9)[3] * 30]
    for w, (f, g) in zip(trials, evaluate.many(trials), strict=True):
        want_f, want_g = whole(w)
        assert f == pytest.approx(want_f) and g == pytest.approx(want_g)
    assert evaluate.jobs <= 4
    blocks = evaluate.blocks.collect()
    assert sum(len(r.voxel) for r in blocks) == 60 and sum(len(r.value) for r in blocks) == np.count_nonzero(a)
    evaluate.release()
    assert op.optimised(dij, list(range(9)), voxels, objectives.limit(0), goals) is None


def test_optimum_like_dense(spark):
    a, dij, objectives, goals, _ = dense_problem(spark)
    vs = goals.where("objective = 0").toPandas()["voxel"].to_numpy()

    def whole(w):
        e = a[vs] @ w - 30.0
        return 5.0 / len(vs) * e @ e + 0.01 * w @ w, 10.0 / len(vs) * a[vs].T @ e + 0.02 * w

    found = op.optimised(dij, list(range(9)), spark.range(60).withColumnRenamed("id", "voxel"), objectives.where("objective = 0"), goals.where("objective = 0"), None, 30.0, tolerance=1e-6, l2=0.01)
    top = op.most_fluence(dij, 30.0)
    # Bounded least squares by projected gradient steps of the inverse of the largest curvature, until they end.
    w, step = np.zeros(9), 1 / np.linalg.eigvalsh(10.0 / len(vs) * a[vs].T @ a[vs] + 0.02 * np.eye(9)).max()
    for _ in range(200_000):
        w = np.clip(w - step * whole(w)[1], 0.0, top)
    assert found.converged and found.weights == pytest.approx(w, abs=1e-3) and found.objective == pytest.approx(whole(w)[0], rel=1e-7)


def test_evaluations_do_not_move_the_matrix(spark):
    """The blocks are cached: an evaluation reads them and shuffles partial sums by bixel only."""
    _, dij, objectives, goals, _ = dense_problem(spark)
    evaluate = rb.Objective(dij, list(range(9)), spark.range(60).withColumnRenamed("id", "voxel"), objectives, goals)
    plan = evaluate.blocks.mapInArrow(lambda b: b, rb._BLOCK).select("start")._jdf.queryExecution().executedPlan().toString()
    assert "InMemoryTableScan" in plan and "Exchange" not in plan.split("InMemoryTableScan")[0]
    evaluate.release()


def test_statistics_leave_out_what_lies_outside(spark):
    source, target = gr.Grid((4, 4, 4), (1.0, 1.0, 1.0)), gr.Grid((2, 2, 2), (1.0, 1.0, 1.0))
    dose = spark.createDataFrame([(i, j, k, 1.0 + i) for i in range(2) for j in range(2) for k in range(2)], "i long, j long, k long, dose double")
    voxels = spark.createDataFrame([("in", 1, 1, 1), ("in", 0, 0, 0), ("out", 3, 3, 3), ("half", 1, 3, 1)], "structure string, i long, j long, k long")
    assert sorted((r.structure, r.dose) for r in gr.sampled(voxels, source, target, dose).collect()) == [("in", 1.0), ("in", 2.0)]
    assert sorted((r.i, r.dose) for r in gr.overlaid(voxels, source, target, dose).collect()) == [(0, 1.0), (1, 2.0)]


def test_inverse():
    m = fc.rotation(30.0, 20.0)
    assert np.allclose(np.array(fc.inverse(m)) @ np.array(m), np.eye(3)) and fc.inverse([[1, 2, 3], [2, 4, 6], [0, 0, 1]]) == np.eye(3).tolist()


def test_particle_colours(spark):
    kind, x = fc.F.col("kind"), fc.F.col("x")
    d = spark.createDataFrame([(1, 2.0), (7, 2.0)], "kind int, x double")
    by = d.select(*[c.alias(n) for n, c in fc.by_type(kind, {1: (1, 0, 0)}, (0.5, 0.5, 0.5)).items()]).collect()
    assert [tuple(r) for r in by] == [(1.0, 0.0, 0.0), (0.5, 0.5, 0.5)]
    grey = d.select(*[c.alias(n) for n, c in fc.ramp_between(x, fc.F.lit(2.0), fc.F.lit(2.0), [(0, 0, 1), (1, 0, 0)]).items()]).first()
    assert tuple(grey) == (0.5, 0.5, 0.5)


def test_rest_works_without_text_operators(tmp_path):
    """With the text operators and their tests gone the other queries are there, and the pipeline is not."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(root, tmp_path / "copy", ignore=shutil.ignore_patterns("llm", ".git", "__pycache__", "spark-warehouse"))
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert 'flagship_structure_dose' in q and 'pipeline' not in q and not any(n.startswith('op') for n in [*q, *s]); assert set(s) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "copy", check=True, env={**os.environ, "PYTHONPATH": str(tmp_path / "copy")})


def a_patient(spark):
    ct = gr.Grid((8, 10, 6), (5.0, 4.0, 6.0), (-20.0, -18.0, -15.0))
    image = spark.createDataFrame([(i, j, k, -1000 if min(i, j) == 0 else 0) for i in range(8) for j in range(10) for k in range(6)], "i long, j long, k long, hu int")
    structures = spark.createDataFrame([("body", "EXTERNAL", i, j, k) for i in range(2, 7) for j in range(2, 8) for k in range(1, 5)] + [("target", "PTV", 4, j, 2) for j in (4, 5)], "structure string, kind string, i long, j long, k long")
    positions = [float(x) for x in range(0, 30, 2)]
    kernel = lambda ssd, s: Row(SSD=ssd, **{f"kernel{c + 1}": [math.exp(-x / (s + c + 2)) for x in positions] for c in range(3)})
    machine = Row(name="m", sad=1000.0, mu=0.005066, betas=[0.3252, 0.016, 0.0051], fwhm=5.0, kernel_positions=positions, kernels=[kernel(990.0, 2), kernel(900.0, 1)])
    plan = [(0, 0.0, 0.0), (1, 72.0, 0.0), (2, 144.0, 10.0)]
    return ct, image, structures, machine, lambda *angles: spark.createDataFrame([(b, g if a is None else a, c) for (b, g, c), a in zip(plan, angles, strict=True)], "beam long, gantry double, couch double")


def test_dose_pipeline_computes_changed_beams_only(spark, tmp_path):
    ct, image, structures, machine, plan = a_patient(spark)
    how = {"width": 5.0, "resolution": (5.0, 5.0, 6.0), "cutoff": 8.0, "step": 1.0, "keep": wf.Thresholds(0.02, 0.0)}
    first, dose, computed = wf.dose_pipeline(f"file://{tmp_path}/a", structures, image, ct, plan(None, None, None), machine, **how)
    first = {(r.voxel, r.bixel): r.value for r in first.collect()}
    assert computed == [0, 1, 2] and len(first) > 100 and dose.dims == (8, 8, 6)
    other, _, computed = wf.dose_pipeline(f"file://{tmp_path}/a", structures, image, ct, plan(None, 80.0, None), machine, **how)
    other = {(r.voxel, r.bixel): r.value for r in other.collect()}
    assert computed == [1] and other != first
    whole, _, computed = wf.dose_pipeline(f"file://{tmp_path}/b", structures, image, ct, plan(None, 80.0, None), machine, **how)
    assert computed == [0, 1, 2] and {(r.voxel, r.bixel): r.value for r in whole.collect()} == other
    again, _, computed = wf.dose_pipeline(f"file://{tmp_path}/a", structures, image, ct, plan(None, None, None), machine, **how)
    assert computed == [] and {(r.voxel, r.bixel): r.value for r in again.collect()} == first
    denser = image.withColumn("hu", fc.F.col("hu") + 10)
    assert wf.dose_pipeline(f"file://{tmp_path}/a", structures, denser, ct, plan(None, None, None), machine, **how)[2] == [0, 1, 2]


def test_dose_voxels_fall_back_to_the_whole_grid(spark):
    ct, _, structures, _, _ = a_patient(spark)
    dose = ct.resampled((5.0, 5.0, 6.0))
    some, every = wf.dose_voxels(structures, ct, dose), wf.dose_voxels(structures.limit(0), ct, dose)
    assert 0 < some.count() < every.count() == 8 * 8 * 6
    assert {tuple(r) for r in some.collect()} < {tuple(r) for r in every.collect()}


def test_bricks_like_segments(spark):
    """Depths and distances of rays through bricks equal those over all segments: rays along planes, that miss, that end inside, that have no length."""
    rng = np.random.default_rng(6)
    box = rt.Box((13, 9, 11), (3.0, 4.0, 2.5), (-17.0, -16.0, -12.0))
    density = spark.createDataFrame([(i, j, k, float(rng.uniform(0, 2)) if rng.random() < 0.8 else 0.0) for i in range(13) for j in range(9) for k in range(11) if rng.random() < 0.9], "i long, j long, k long, rho double")
    ends = [tuple(map(float, rng.uniform(-40, 40, 6))) for _ in range(300)]
    ends += [(-50.0, 2.0, 1.0, 50.0, 2.0, 1.0), (-50.0, -2.0, -0.75, 50.0, -2.0, -0.75), (0.0, 0.0, 0.0, 0.0, 0.0, 0.0), (0.0, 0.0, 0.0, 1.0, 1.0, 1.0), (100.0, 100.0, 0.0, 100.0, 200.0, 0.0)]
    rays = spark.createDataFrame([(i, *e) for i, e in enumerate(ends)], "ray long, sx double, sy double, sz double, tx double, ty double, tz double")
    dense = rt.with_density(rt.segments(rays, box), density)
    want = {r.ray: (r.depth, r.ssd) for r in rt.deepest(dense).join(rt.surface_distance(dense), "ray").collect()}
    for side, most in ((4, 10), (32, 100_000)):
        got = {r.ray: (r.depth, r.ssd) for r in bk.traced(rays, ("ray",), bk.packed(density, side), box, side=side, most=most).collect()}
        assert got.keys() == want.keys() and len(want) > 100
        for ray, values in want.items():
            assert got[ray] == pytest.approx(values, abs=1e-9)


def test_rays_through_a_large_volume(spark):
    """512 by 512 by 200 voxels: what is joined is a row per ray and brick."""
    box = rt.Box((512, 512, 200), (1.0, 1.0, 2.5), (-255.5, -255.5, -248.75))
    dense = spark.range(0, 512 * 512 * 200, 4001).selectExpr("id % 512 as i", "id div 512 % 512 as j", "id div (512 * 512) as k", "1.0D as rho")
    rays = spark.range(2000).selectExpr("id as ray", "-1000.0D as sx", "0.0D as sy", "0.0D as sz", "1000.0D as tx", "double(id % 50) * 4 - 100 as ty", "double(id div 50) * 5 - 100 as tz")
    found = bk.traced(rays, ("ray",), bk.packed(dense), box).collect()
    assert len(found) == 2000
    for r in found:
        y, z = (r.ray % 50) * 4 - 100, (r.ray // 50) * 5 - 100
        step = math.sqrt(1 + (y / 2000) ** 2 + (z / 2000) ** 2)  # water throughout: the whole way less half of the last voxel
        assert r.depth == pytest.approx(512 * step, abs=1.0) and r.entry == pytest.approx(744 * step, rel=1e-9)

"""Kept statistics, and what a change makes invalid."""

import pytest

from raysheaf.operators import results as rs


def test_affected(spark):
    """A chain, a diamond, a circle, a null and what does not depend on the change."""
    needs = spark.createDataFrame([("b", "a"), ("c", "b"), ("d", "a"), ("c", "d"), ("e", "c"), ("a", "e"), ("y", "x"), (None, "a"), ("z", None), ("b", "a")], "artefact string, needs string")
    changed = spark.createDataFrame([("a",), (None,), ("a",)], "artefact string")
    assert sorted(map(tuple, rs.affected(needs, changed).collect())) == [("a", 0), ("b", 1), ("c", 2), ("d", 1), ("e", 3)]
    assert rs.affected(needs, changed.limit(0)).count() == 0 and rs.affected(needs.limit(0), changed).collect() == [("a", 0)]


def test_statistics_are_never_stale(spark, tmp_path):
    folder = f"file://{tmp_path}"
    doses = spark.createDataFrame([(1, "t", 10.0), (1, "t", 30.0), (1, None, 5.0), (2, "t", 20.0), (3, "t", 20.0)], "dose_id int, structure string, dose double")
    rx = lambda *of: spark.createDataFrame(list(of), "dose_id int, prescription double")

    def got(rows, prescriptions):
        found, computed = rs.kept_statistics(rows, prescriptions, folder)
        return {(r.dose_id, r.structure): (r.n, r.mean_dose, r.ci) for r in found.collect()}, computed

    first, computed = got(doses, rx((1, 20.0), (2, 20.0)))
    assert first == {(1, "t"): (2, 20.0, 0.5), (1, None): (1, 5.0, 0.0), (2, "t"): (1, 20.0, 1.0), (3, "t"): (1, 20.0, None)} and computed == 3
    assert got(doses.repartition(3), rx((1, 20.0), (2, 20.0))) == (first, 0)
    changed, computed = got(doses, rx((1, 40.0), (2, 20.0)))
    assert changed == first | {(1, "t"): (2, 20.0, 0.0)} and computed == 1
    more, computed = got(doses.unionByName(spark.createDataFrame([(2, "t", 20.0)], doses.schema)), rx((1, 20.0), (2, 20.0)))
    assert more == first | {(2, "t"): (2, 20.0, 1.0)} and computed == 1
    # A digest of which a part only was written does not count, and what was written twice counts once.
    path = f"{folder}/statistics"
    part = spark.read.parquet(path).where("n = 2 or structures = 1").collect()
    kept = spark.createDataFrame(part + part, spark.read.parquet(path).schema)
    kept.write.parquet(f"{folder}/half/statistics")
    found, computed = rs.kept_statistics(doses, rx((1, 20.0), (2, 20.0)), f"{folder}/half")
    assert computed == 1 and found.count() == 4
    found, computed = rs.kept_statistics(doses.limit(0), rx((1, 20.0)), f"{folder}/none")
    assert (found.count(), computed) == (0, 0)
    with pytest.raises(Exception, match="prescription"):
        rs.kept_statistics(doses, rx().drop("prescription"), folder)


def test_statistics_do_not_gather_a_dose_in_a_task(spark):
    """What rows of doses and structures are joined with is broadcast: no exchange of rows by structure."""
    from pyspark.sql import functions as F

    from raysheaf.operators import analysis as an

    rows = spark.range(1000).select(F.lit("s").alias("structure"), (F.col("id") % 7).cast("double").alias("dose"))
    found = an.order_statistics(rows, spark.createDataFrame([("s", 0), ("s", 999)], "structure string, rank long"))
    assert sorted((r.rank, r.value) for r in found.collect()) == [(0, 0.0), (999, 6.0)]
    plan = an.order_statistics(rows, spark.createDataFrame([("s", 0)], "structure string, rank long"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("strategy=broadcast") >= 2

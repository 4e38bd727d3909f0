"""Results kept by what they were computed from, and what a change makes invalid."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lineage import cut
from . import analysis as an


def affected(needs: DataFrame, changed: DataFrame) -> DataFrame:
    """AK-42: (artefact, step) of all that depends on a changed artefact, itself at step 0, each at its least step.

    needs: (artefact, needs) per dependency; changed: (artefact). A round per step, which joins the last one's artefacts
    only and is cut from its lineage; circles end by themselves. Null names depend on nothing.
    """
    needs = cut(needs.select("artefact", "needs").where("artefact is not null and needs is not null").distinct())
    last = cut(changed.select("artefact").where("artefact is not null").distinct().withColumn("step", F.lit(0)))
    found = last
    while last.limit(1).count():
        after = needs.join(last.select(F.col("artefact").alias("needs"), "step"), "needs").select("artefact", (F.col("step") + 1).alias("step")).distinct()
        last = cut(after.join(found, "artefact", "left_anti"))
        found = found.unionByName(last)
    return found


def digests(doses: DataFrame, prescriptions: DataFrame) -> DataFrame:
    """(dose_id, prescription, structures, digest): what a dose's statistics depend on. The order of rows has no part in it, their number has."""
    rows = doses.groupBy("dose_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.xxhash64("structure", "dose").cast("decimal(38,0)")).alias("s"),
        F.sum(F.xxhash64(F.lit(1), "dose", "structure").cast("decimal(38,0)")).alias("t"),
        F.count_distinct(F.coalesce(F.concat(F.lit("="), "structure"), F.lit(""))).alias("structures"),
    )
    text = F.concat_ws(":", "n", "s", "t", F.coalesce(F.col("prescription").cast("string"), F.lit("-")))
    return rows.join(prescriptions.select("dose_id", "prescription"), "dose_id", "left").select("dose_id", "prescription", "structures", F.sha2(text, 256).alias("digest"))


def _statistics(doses: DataFrame, keys: DataFrame) -> DataFrame:
    """Statistics of the doses in ``keys``, by digest and structure. Keys are a line per dose and broadcast: a dose's rows, a share of all, never meet in one task."""
    rows = doses.join(F.broadcast(keys), "dose_id").select(F.to_json(F.struct("digest", "structure")).alias("structure"), "dose", "prescription")
    rows = cut(rows)
    inside = F.avg(F.when(F.col("dose") >= F.col("prescription"), 1.0).otherwise(0.0))
    found = an.summary(rows).join(rows.groupBy("structure").agg(F.when(F.first("prescription").isNotNull(), inside).alias("ci")), "structure")
    key = F.from_json("structure", "digest string, structure string")
    return found.select(key["digest"].alias("digest"), key["structure"].alias("structure"), *[c for c in found.columns if c != "structure"])


def _kept(spark: SparkSession, path: str) -> DataFrame | None:
    """Statistics of the digests that are there as a whole, each once: what a lost job left in part, or wrote twice, does not count."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(at) or not any(f.getPath().getName().endswith(".parquet") for f in files.listStatus(at)):
        return None
    rows = spark.read.parquet(path).dropDuplicates(["digest", "structure"])
    whole = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.max("structures").alias("structures")).where("n = structures")
    return rows.join(whole.select("digest"), "digest", "left_semi").drop("structures")


def kept_statistics(doses: DataFrame, prescriptions: DataFrame, folder: str) -> tuple[DataFrame, int]:
    """AK-41: (statistics, number of doses computed now) of doses (dose_id, structure, dose), with the coverage ``ci`` of each dose's prescription (dose_id, prescription).

    Statistics stand in ``folder`` by a digest of the dose and its prescription: a dose that was there before is not computed
    again, and a changed prescription or dose gives new ones, not stale ones. Doses without a prescription have a null ``ci``;
    equal doses share statistics; an empty table gives none.
    """
    spark, path = doses.sparkSession, f"{folder.rstrip('/')}/statistics"
    doses = doses.select("dose_id", "structure", "dose")
    keys = cut(digests(doses, prescriptions))
    before = _kept(spark, path)
    missing = keys if before is None else keys.join(before.select("digest").distinct(), "digest", "left_anti")
    missing = cut(missing.groupBy("digest").agg(F.min("dose_id").alias("dose_id"), F.first("prescription").alias("prescription"), F.first("structures").alias("structures")))  # equal digests have equal values
    computed = missing.count()
    if computed:
        found = _statistics(doses, missing.select("dose_id", "digest", "prescription"))
        found.join(missing.select("digest", "structures"), "digest").write.mode("append").parquet(path)
    kept = _kept(spark, path)
    if kept is None:
        kept = _statistics(doses, missing.select("dose_id", "digest", "prescription"))
    return keys.select("dose_id", "prescription", "digest").join(kept, "digest").drop("digest"), computed

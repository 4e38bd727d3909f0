from pyspark.sql import functions as F

from raysheaf.operators import analysis as an
from raysheaf.streaming import doses


def test_stream_ends_in_the_batch_result(spark, tmp_path):
    batch = spark.range(100).select((F.col("id") % 3).cast("string").alias("structure"), (F.col("id") * 0.5).alias("dose"))
    batch.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = doses.running_summary(stream).writeStream.outputMode("complete").format("memory").queryName("doses").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    columns = ["structure", "n", "min_dose", "max_dose", "mean_dose"]
    assert sorted(spark.table("doses").select(columns).collect()) == sorted(an.summary(batch).select(columns).collect())


def test_late_particles_are_dropped(spark, tmp_path):
    rows = spark.createDataFrame([(0, 1, 2.0), (100, 1, 4.0), (7200, 2, 1.0)], "s long, type int, energy double").select(F.timestamp_seconds("s").alias("ts"), "type", "energy")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = doses.windowed_counts(stream).writeStream.outputMode("append").format("memory").queryName("windows").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert [(r.type, r.n, r.mean_energy) for r in spark.table("windows").collect()] == [(1, 2, 3.0)]

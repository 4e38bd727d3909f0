"""Dose samples as a stream: running statistics by structure, one small state row each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def running_summary(samples: DataFrame) -> DataFrame:
    """Count, extremes, mean and population deviation of ``dose`` by ``structure``; in update mode a micro-batch emits the structures that it touched."""
    d = F.col("dose")
    return samples.groupBy("structure").agg(F.count(F.lit(1)).alias("n"), F.min(d).alias("min_dose"), F.max(d).alias("max_dose"), F.avg(d).alias("mean_dose"), F.stddev_pop(d).alias("std_dose"))


def windowed_counts(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Particles by type and window of their time, dropped once later than the watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "type").agg(F.count(F.lit(1)).alias("n"), F.avg("energy").alias("mean_energy"))

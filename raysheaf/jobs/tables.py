"""Planning concepts on the given tables: each as a DataFrame and as the same relation in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Tables:
    """The tables of a folder, and the views on them that the queries share."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def entries(self) -> DataFrame:
        """Sparse dose-influence entries, with duplicates: (voxel, bixel, value)."""
        return self.read("lineitem").select(F.col("l_partkey").alias("voxel"), F.col("l_suppkey").alias("bixel"), (F.col("l_quantity") / 50).alias("value"))

    def weights(self) -> DataFrame:
        """(bixel, weight), not negative."""
        return self.read("supplier").select(F.col("s_suppkey").alias("bixel"), (F.greatest("s_acctbal", F.lit(0.0)) / 1000).alias("weight"))

    def gradient(self) -> DataFrame:
        """(voxel, g), signed and with zeros."""
        return self.read("part").select(F.col("p_partkey").alias("voxel"), (F.col("p_size") - 25).cast("double").alias("g"))

    def doses(self) -> DataFrame:
        """Dose samples by structure: (structure, dose, compare, and a unique order o1..o4)."""
        li = self.read("lineitem")
        dose = F.col("l_extendedprice") / 1000
        return li.select(F.concat("l_returnflag", "l_linestatus").alias("structure"), dose.alias("dose"), (dose * (1 - F.col("l_discount"))).alias("compare"), F.col("l_orderkey").alias("o1"), F.col("l_linenumber").alias("o2"), F.col("l_partkey").alias("o3"), F.col("l_suppkey").alias("o4"))

    def hounsfield(self) -> DataFrame:
        return self.read("events").select("event_id", F.floor(F.col("value") * 8 - 1200).cast("int").alias("hu"))

    def particles(self) -> DataFrame:
        """(rec, file, type, x, y, z, u, v, wsign, energy, weight) in record order."""
        e, uid = F.col("event_id"), F.col("user_id")
        kind = F.when(F.col("event_type") == "purchase", -1).when(F.col("event_type") == "signup", 2).otherwise(1)
        return self.read("events").select(
            e.alias("rec"),
            (e % 3).cast("int").alias("file"),
            kind.alias("type"),
            ((uid % 401) - 200).cast("double").alias("x"),
            ((e % 301) - 150).cast("double").alias("y"),
            (F.lit(250.0) + (e % 50)).alias("z"),
            ((uid % 100) / 200.0 - 0.25).alias("u"),
            ((e % 100) / 200.0 - 0.25).alias("v"),
            F.when(e % 7 == 0, -1).otherwise(1).alias("wsign"),
            (F.col("value") / 60).alias("energy"),
        )

    def points(self) -> DataFrame:
        """Target points in mm: (id, x, y, z)."""
        v = F.col("embedding")
        return self.read("embeddings").select(F.col("vec_id").alias("id"), *[(v[i].cast("double") * 100).alias(n) for i, n in enumerate("xyz")])


ENTRIES = "(SELECT l_partkey AS voxel, l_suppkey AS bixel, l_quantity / 50 AS value FROM lineitem)"
WEIGHTS = "(SELECT s_suppkey AS bixel, greatest(s_acctbal, 0e0) / 1000 AS weight FROM supplier)"
GRADIENT = "(SELECT p_partkey AS voxel, (p_size - 25)::DOUBLE AS g FROM part)"
DOSES = "(SELECT l_returnflag || l_linestatus AS structure, l_extendedprice / 1000 AS dose, l_extendedprice / 1000 * (1 - l_discount) AS compare, l_orderkey AS o1, l_linenumber AS o2, l_partkey AS o3, l_suppkey AS o4 FROM lineitem)"
HOUNSFIELD = "(SELECT event_id, floor(value * 8 - 1200)::INT AS hu FROM events)"
PARTICLES = """(SELECT event_id AS rec, (event_id % 3)::INT AS file, CASE event_type WHEN 'purchase' THEN -1 WHEN 'signup' THEN 2 ELSE 1 END AS type,
  ((user_id % 401) - 200)::DOUBLE AS x, ((event_id % 301) - 150)::DOUBLE AS y, 250e0 + event_id % 50 AS z,
  (user_id % 100) / 200e0 - 25e-2 AS u, (event_id % 100) / 200e0 - 25e-2 AS v, CASE WHEN event_id % 7 = 0 THEN -1 ELSE 1 END AS wsign, value / 60 AS energy FROM events)"""
POINTS = "(SELECT vec_id AS id, embedding[1]::DOUBLE * 100 AS x, embedding[2]::DOUBLE * 100 AS y, embedding[3]::DOUBLE * 100 AS z FROM embeddings)"

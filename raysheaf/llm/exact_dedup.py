"""Exact duplicates, combined in stages that each compare whole contents.

Texts are equal if they are so after all white space of the contract is deleted. The
combining is skew-safe:

1. within each input partition, equal texts are merged before anything is shuffled (the
   map-side half of the first aggregation, whose key holds the whole normalised text);
2. partial groups are merged by (digest, text, salt), so a text that a third of all rows
   share is met by ``SALTS`` tasks, with one row per input partition at most;
3. the salts' winners are merged by (digest, text).

A digest that has one text only, as every SHA-256 is expected to, then finds its rows by
the digest alone; the texts of colliding digests are compared once more for that. Both
joins can be split by Spark where a digest is hot, since nothing above them needs its
rows together.

Edge cases: a null text counts as empty and all empty texts are one group; the kept row
has most code points, then the smallest doc_id, and a null doc_id comes last; repeated
rows count as often as they occur and share one decision, that of their doc_id; of rows with
one doc_id and text that differ elsewhere ``deduplicated`` keeps the one with the least hash;
texts of any length are compared whole; an empty table gives an empty result; further columns
have no effect, and may have any name but ``__row`` and ``__kept``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE_CLASS, table, written

SALTS = 32
_BEYOND = "9223372036854775807"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE_CLASS, "")


def _prefer(length: Column, key: Column) -> Column:
    """Grows with the length, then falls with the key: one fixed-width number, so that Spark can hash-aggregate it."""
    return length.cast("decimal(10,0)") * F.lit("18446744073709551616").cast("decimal(20,0)") - F.coalesce(key, F.lit(_BEYOND).cast("long")).cast("decimal(19,0)")


def duplicate_groups(docs: DataFrame, text: str = "text", key: str = "doc_id", salts: int = SALTS) -> DataFrame:
    """One row per distinct text: digest, content, keep_id, group_size."""
    rows = docs.select(F.col(key).alias("id"), F.length(F.coalesce(F.col(text), F.lit(""))).alias("n"), normalised(F.col(text)).alias("content"))
    rows = rows.select("id", _prefer(F.col("n"), F.col("id")).alias("prefer"), F.sha2("content", 256).alias("digest"), "content", F.pmod(F.spark_partition_id(), F.lit(salts)).alias("salt"))
    salted = rows.groupBy("digest", "content", "salt").agg(F.max_by("id", "prefer").alias("id"), F.max("prefer").alias("prefer"), F.count(F.lit(1)).alias("n"))
    return salted.groupBy("digest", "content").agg(F.max_by("id", "prefer").alias("keep_id"), F.sum("n").alias("group_size"))


def exact_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", salts: int = SALTS) -> DataFrame:
    """One row per row of ``docs``: the key, keep_id, group_size, kept and text_sha256."""
    groups = duplicate_groups(docs, text, key, salts)
    single = written(groups.groupBy("digest").agg(F.count(F.lit(1)).alias("texts"), F.first("keep_id").alias("keep_id"), F.first("group_size").alias("group_size")), "dedup")
    rows = docs.select(F.col(key).alias("id"), normalised(F.col(text)).alias("content")).select("id", "content", F.sha2("content", 256).alias("digest"))
    found = rows.select("id", "digest").join(single.where("texts = 1"), "digest").select("id", "digest", "keep_id", "group_size")
    colliding = single.where("texts > 1").select("digest")
    if not colliding.isEmpty():  # different texts of one SHA-256
        whole = rows.join(colliding, "digest", "left_semi").join(groups, ["digest", "content"])
        found = found.unionByName(whole.select("id", "digest", "keep_id", "group_size"))
    return found.select(F.col("id").alias(key), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("digest").alias("text_sha256"))


def deduplicated(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that stay: one for each distinct text."""
    groups = exact_duplicates(docs, text, key).where("kept").select(_row_key(F.col(key), F.col("text_sha256")).alias("__row")).distinct()
    rows = docs.withColumn("__row", _row_key(F.col(key), F.sha2(normalised(F.col(text)), 256)))
    held = rows.join(groups, "__row", "left_semi").groupBy("__row").agg(F.min_by(F.struct(*docs.columns), F.xxhash64(*docs.columns)).alias("__kept"))
    return held.select("__kept.*")


def _row_key(key: Column, digest: Column) -> Column:
    return F.concat(digest, F.lit(" "), F.coalesce(key.cast("string"), F.lit("")))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


#: DuckDB's normalised text.
NORM_SQL = "regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g')"

SQL = f"""
WITH t AS (SELECT doc_id, {NORM_SQL} AS content, length(coalesce(text, '')) AS n FROM documents)
SELECT doc_id, first_value(doc_id) OVER (PARTITION BY content ORDER BY n DESC, doc_id) AS keep_id,
  count(*) OVER (PARTITION BY content) AS group_size,
  doc_id = first_value(doc_id) OVER (PARTITION BY content ORDER BY n DESC, doc_id) AS kept,
  sha256(content) AS text_sha256
FROM t
"""

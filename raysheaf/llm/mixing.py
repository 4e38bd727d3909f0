"""Mixing sources to target weights by systematic sampling (DataFrame functions only).

``source_targets`` water-fills word targets over the sources; ``mix`` gives every
document its number of copies. Within a source the documents stand in a fixed order
(size class, hash slice, size, id); each adds ``target / source_size`` expected copies
to a running sum that starts at one offset per source, and is emitted once for every
integer that the sum crosses.

The running sum is taken in two levels, so that no task sees a whole source: documents
are counted by (source, block), the few thousand block counts of a source are summed up
in order, and ranks are then taken within blocks only. A block is a size class (1/32 of
an octave) and one of ``SLICES`` hash slices, so a source in which all sizes are equal
still spreads over ``SLICES`` tasks.

Edge cases: a null text has size 0; a null source is a source of its own, last in order;
documents of size 0 are emitted or not like others but take no words; a source without
words gets target 0; empty input gives an empty result; repeated rows are separate
documents and the multiset of their copies is fixed; texts of any length are counted whole;
further columns are carried along and may clash with none, since the names used inside begin
with ``__mix_``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, table, written

WEIGHTS = (5.0, 2.0, 1.0)
MAX_COPIES = 3
SLICES = 64
SEED = 20260


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _unit(seed: int, name: Column) -> Column:
    """A number in [0, 1) from a name: 32 bits of its MD5."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), name).cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def _size_class(size: Column) -> Column:
    """Grows with size; 32 classes per octave."""
    octave = F.length(F.bin(size)).cast("int")
    return octave * 64 + F.call_function("shiftright", size, F.greatest(octave - 6, F.lit(0))).cast("int")


def source_targets(sizes: DataFrame, source: str = "source", size: str = "size", weights: Sequence[float] = WEIGHTS, max_copies: int = MAX_COPIES) -> DataFrame:
    """One row per source: source, source_size, weight, target.

    The weights repeat over the sources in code-point order (null last) and share all
    words. A source's target stops at ``max_copies`` times its size and the excess is
    shared by weight among the others, until none is above: with the sources sorted by
    cap over weight, the level is that of the first source whose fair share of what the
    earlier ones left does not exceed its own cap. Windows here run over one row per
    source.
    """
    per = sizes.groupBy(F.col(source).alias("source")).agg(F.sum(size).cast("long").alias("source_size"))
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    by_ratio = Window.orderBy("ratio", F.col("source").isNull(), "source")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    ranked = (
        per.withColumn("rn", F.row_number().over(by_name))
        .withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("rn") - 1, F.lit(len(weights))) + 1).cast("int")))
        .withColumn("ratio", F.col("source_size") * float(max_copies) / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(Window.partitionBy()))
        .withColumn("weights", F.sum("weight").over(Window.partitionBy()))
        .withColumn("pos", F.row_number().over(by_ratio))
        .withColumn("used", F.coalesce(F.sum("source_size").over(before), F.lit(0)) * max_copies)
        .withColumn("share", (F.col("total") - F.col("used")) / (F.col("weights") - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
        .withColumn("level", F.min(F.when(F.col("share") <= F.col("ratio"), F.struct("pos", "share"))).over(Window.partitionBy()))
    )
    target = F.round(F.least(F.col("source_size") * float(max_copies), F.coalesce(F.col("level.share"), F.lit(0.0)) * F.col("weight")), 6)
    return ranked.select("source", "source_size", "weight", target.alias("target"))


def _slice(key: Column) -> Column:
    """A number below SLICES from the id: 16 bits of its MD5."""
    return F.pmod(F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 4), 16, 10).cast("int"), F.lit(SLICES))


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, max_copies: int = MAX_COPIES, seed: int = SEED, text: str = "text", source: str = "source", key: str = "doc_id", keep: Sequence[str] | None = None) -> DataFrame:
    """``docs`` (or its ``keep`` columns) with size, source_size, target, copies and taken per row.

    One shuffle of the kept columns, by (source, block), serves both the ranks and the
    join to the block offsets. A kept column named like an added one stays, and the added
    one is called ``mix_<name>``.
    """
    keep = list(docs.columns if keep is None else keep)
    rows = docs.select(
        *[F.col(c).alias(f"__mix_keep_{i}") for i, c in enumerate(keep)],
        F.col(source).isNull().alias("__mix_null"),
        F.coalesce(F.col(source), F.lit("")).alias("__mix_source"),
        F.col(key).alias("__mix_key"),
        word_count(F.col(text)).alias("__mix_size"),
    )
    rows = rows.withColumn("__mix_block", _size_class(F.col("__mix_size")) * SLICES + _slice(F.col("__mix_key")))
    of_source, group = ["__mix_null", "__mix_source"], ["__mix_null", "__mix_source", "__mix_block"]
    # Written, so that the texts are counted once for targets and offsets.
    blocks = written(rows.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.sum("__mix_size").alias("words")), "blocks")
    name = F.when(~F.col("__mix_null"), F.col("__mix_source"))
    targets = source_targets(blocks.select(name.alias("source"), F.col("words").alias("size")), weights=weights, max_copies=max_copies)
    targets = targets.select(F.col("source").isNull().alias("__mix_null"), F.coalesce("source", F.lit("")).alias("__mix_source"), "source_size", "target")
    in_order = Window.partitionBy(*of_source).orderBy("__mix_block").rowsBetween(Window.unboundedPreceding, -1)
    plan = (
        blocks.withColumn("base", F.coalesce(F.sum("n").over(in_order), F.lit(0)))
        .join(targets, of_source)
        .select(
            *group,
            F.col("base").alias("__mix_base"),
            F.col("source_size").alias("__mix_source_size"),
            F.col("target").alias("__mix_target"),
            F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)).alias("__mix_step"),
            _unit(seed, F.col("__mix_source")).alias("__mix_offset"),
        )
    )
    rows = rows.withColumn("__mix_row", F.row_number().over(Window.partitionBy(*group).orderBy("__mix_size", "__mix_key"))).join(plan, group)
    rank = F.col("__mix_base") + F.col("__mix_row")
    crossed = F.floor(F.col("__mix_offset") + rank * F.col("__mix_step")) - F.floor(F.col("__mix_offset") + (rank - 1) * F.col("__mix_step"))
    copies = F.least(crossed, F.lit(max_copies)).cast("long")
    own = {"size": F.col("__mix_size"), "source_size": F.col("__mix_source_size"), "target": F.col("__mix_target"), "copies": copies, "taken": copies * F.col("__mix_size")}
    return rows.select(*[F.col(f"__mix_keep_{i}").alias(c) for i, c in enumerate(keep)], *[v.alias(k if k not in keep else f"mix_{k}") for k, v in own.items()])


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: every row as often as it is taken, with the columns of ``docs``."""
    plan = mix(docs.select(F.struct(*docs.columns).alias("row"), F.col("text").alias("__t"), F.col("source").alias("__s"), F.col("doc_id").alias("__k")), keep=["row"], text="__t", source="__s", key="__k", **how)
    copies = plan.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return copies.select("row.*")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), keep=["doc_id", "source"]).select("doc_id", "source", "size", "source_size", "target", "taken")


def targets_sql(sizes: str) -> str:
    """Common table expressions up to ``targets`` (source, source_size, target), from a relation of source and size."""
    cap = f"{float(MAX_COPIES)}::DOUBLE"
    earlier = "OVER (ORDER BY ratio, source IS NULL, encode(source) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    return f"""
per AS (SELECT source, sum(size)::BIGINT AS source_size FROM {sizes} GROUP BY source),
named AS (SELECT *, [{", ".join(f"{w}::DOUBLE" for w in WEIGHTS)}][((row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % {len(WEIGHTS)} + 1)::INT] AS weight FROM per),
ratios AS (SELECT *, source_size * {cap} / weight AS ratio, sum(source_size) OVER () AS total, sum(weight) OVER () AS weights FROM named),
shares AS (
  SELECT *, row_number() OVER (ORDER BY ratio, source IS NULL, encode(source)) AS pos,
    (total - {MAX_COPIES} * coalesce(sum(source_size) {earlier}, 0))::DOUBLE / (weights - coalesce(sum(weight) {earlier}, 0e0)) AS share
  FROM ratios),
level AS (SELECT arg_min(share, pos) AS share FROM shares WHERE share <= ratio),
targets AS (
  SELECT s.source, s.source_size, round(least(s.source_size * {cap}, coalesce(level.share, 0e0) * s.weight), 6) AS target
  FROM shares s CROSS JOIN level)"""


def mix_sql(docs: str) -> str:
    """Common table expressions up to ``mixed``: the rows of ``docs`` (with ``size``) and source_size, target, copies."""
    return f"""{targets_sql(docs)},
mix_rows AS (
  SELECT d.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0e0 END AS step,
    ('0x' || substr(md5('{SEED}|' || coalesce(d.source, '')), 1, 8))::BIGINT / 4294967296e0 AS start,
    row_number() OVER (PARTITION BY d.source ORDER BY
      (length(bin(d.size)) * 64 + (d.size >> greatest(length(bin(d.size)) - 6, 0)::INT)) * {SLICES}
        + ('0x' || substr(md5(coalesce(d.doc_id::VARCHAR, '')), 1, 4))::BIGINT % {SLICES}, d.size, d.doc_id NULLS FIRST) AS rank
  FROM {docs} d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source),
mixed AS (SELECT *, least(floor(start + rank * step) - floor(start + (rank - 1) * step), {MAX_COPIES})::BIGINT AS copies FROM mix_rows)"""


#: DuckDB's word count.
SIZE_SQL = "len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT"

SQL = f"""
WITH sized AS (SELECT doc_id, source, {SIZE_SQL} AS size FROM documents),
{mix_sql("sized")}
SELECT doc_id, source, size, source_size, target, copies * size AS taken FROM mixed
"""

"""Objectives of a plan: built from a protocol, and evaluated per voxel with their gradients.

An objective is a row (objective, kind, dose, weight, fraction, n) and its voxels are rows
(objective, voxel). Kinds: deviation, overdose, underdose, min_dvh, max_dvh. A plan has a few dozen
objectives: their table is broadcast, their voxels never are.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import is_target_objective
from . import analysis as an

KINDS = ("deviation", "overdose", "underdose", "min_dvh", "max_dvh")


@dataclass(frozen=True)
class Spec:
    """A line of a protocol: which structures, and what they shall get; ``volume`` in percent."""

    pattern: str
    kind: str
    dose: float
    weight: float = 1.0
    volume: float = 0.0
    exact: bool = False


@dataclass(frozen=True)
class Hotspot:
    """AG-15: the penalty on doses over ``threshold`` times the prescription, in all voxels."""

    prescription: float
    threshold: float = 1.04
    penalty: float = 2000.0


#: The customary lung protocol.
LUNG = (
    Spec("Poumon_D", "overdose", 20.0, 10.0, 0.0, True),
    Spec("Poumon_G", "overdose", 20.0, 10.0, 0.0, True),
    Spec("Coeur", "max_dvh", 40.0, 30.0, 30.0, True),
    Spec("Oesophage", "max_dvh", 50.0, 50.0, 30.0, True),
    Spec("Canal_Medullaire", "max_dvh", 10.0, 200.0, 0.0, True),
)


def built(spark: SparkSession, specs: Sequence[Spec], structures: DataFrame, members: DataFrame, target_dose: float | None = None, target_weight: float = 100.0) -> tuple[DataFrame, DataFrame]:
    """AK-23, JN-17: (objectives, goals) from a protocol, ``structures`` (structure, name, kind) and ``members`` (structure, voxel).

    With a ``target_dose`` each target gets a min_dvh of 98 % first. Structures without voxels get
    none. Objectives are numbered in order of target, line and structure.
    """
    for s in specs:
        if s.kind not in KINDS:
            raise ValueError(f"no objective of kind {s.kind}")
    lines = [(i, s.pattern, s.exact, s.kind, s.dose, s.weight, s.volume / 100) for i, s in enumerate(specs)]
    table = spark.createDataFrame(lines, "line int, pattern string, exact boolean, what string, dose double, weight double, fraction double")
    fits = F.when(F.col("exact"), F.col("name") == F.col("pattern")).otherwise(F.contains("name", "pattern"))
    found = structures.join(F.broadcast(table), fits).select("structure", "line", F.col("what").alias("kind"), "dose", "weight", "fraction")
    if target_dose is not None:
        targets = structures.where(is_target_objective(F.col("name"), F.col("kind")))
        found = found.unionByName(targets.select("structure", F.lit(-1).alias("line"), F.lit("min_dvh").alias("kind"), F.lit(float(target_dose)).alias("dose"), F.lit(float(target_weight)).alias("weight"), F.lit(0.98).alias("fraction")))
    sizes = members.groupBy("structure").agg(F.count(F.lit(1)).alias("n"))
    held = found.join(sizes, "structure")
    objectives = held.withColumn("objective", F.row_number().over(Window.orderBy("line", "structure")) - 1)  # a plan's few objectives
    goals = members.join(F.broadcast(objectives.select("objective", "structure")), "structure").select("objective", "voxel")
    return objectives.select("objective", "structure", "kind", "dose", "weight", "fraction", "n"), goals


def valid_voxels(rows: DataFrame, total: int) -> DataFrame:
    """PF-18: rows whose voxel number lies in the grid."""
    return rows.where(F.col("voxel").between(0, total - 1))


def terms(dose: DataFrame, objectives: DataFrame, goals: DataFrame) -> DataFrame:
    """AG-11 to AG-14 for all objectives at once: (objective, voxel, f, g), each voxel's part of the value and its derivative by its dose.

    Goals whose voxel has no dose count in n only.
    """
    few = F.broadcast(objectives.select("objective", "kind", F.col("dose").alias("level"), "weight", "fraction", "n"))
    rows = goals.join(dose, "voxel").join(few, "objective")
    e = F.when(F.col("kind") == "deviation", F.col("dose") - F.col("level")).when(F.col("kind") == "overdose", F.greatest(F.col("dose") - F.col("level"), F.lit(0.0))).otherwise(F.greatest(F.col("level") - F.col("dose"), F.lit(0.0)))
    slope = F.when(F.col("kind") == "underdose", -2.0).otherwise(2.0)
    plain = rows.where(~F.col("kind").isin("min_dvh", "max_dvh")).select("objective", "voxel", (F.col("weight") * e * e / F.col("n")).alias("f"), (slope * F.col("weight") * e / F.col("n")).alias("g"))
    lines = [r for r in objectives.collect() if r.kind.endswith("_dvh")]  # a plan's few objectives
    return plain.unionByName(_dvh_terms(rows.where(F.col("kind").isin("min_dvh", "max_dvh")), lines)) if lines else plain


def _dvh_terms(rows: DataFrame, lines: list) -> DataFrame:
    """AG-14, WN-04: as ``analysis.dvh_gradient``, for all objectives of both kinds together. What the driver holds is a line per objective: where it begins or ceases to count."""
    spark = rows.sparkSession
    first = {r.objective: max(0, math.floor((1.0 - r.fraction) * r.n) if r.kind == "min_dvh" else r.n - math.ceil(r.fraction * r.n)) for r in lines}
    ranks = lambda held: spark.createDataFrame(sorted(held.items()), "structure int, rank long")
    own = rows.select(F.col("objective").alias("structure"), "dose", "voxel")
    cuts = {r.structure: r for r in an.order_statistics(own, F.broadcast(ranks(first))).collect()}
    table, tied = {}, {}
    for r in lines:
        low, cut = r.kind == "min_dvh", cuts.get(r.objective)
        if cut is None:  # no voxel lies at the rank: a max counts all, a min none
            table[r.objective] = [None, None]
            continue
        ties = cut.below + cut.equal - cut.rank if low else cut.rank - cut.below
        table[r.objective] = [cut.value, None]
        if (r.dose - cut.value if low else cut.value - r.dose) <= 0 or ties == (cut.equal if low else 0):
            table[r.objective][1] = -1 if low else None  # all, or none, or without an error
        else:
            tied[r.objective] = cut.equal - ties if low else ties - 1
    if tied:
        held = spark.createDataFrame([(o, table[o][0]) for o in tied], "structure int, cut double")
        at = own.join(F.broadcast(held), "structure").where(F.col("dose") == F.col("cut")).select("structure", "voxel")
        for r in an.order_statistics(at, F.broadcast(ranks(tied)), "voxel").collect():
            table[r.structure][1] = int(r.value)
    where = spark.createDataFrame([(o, *v) for o, v in table.items()], "objective int, cut double, id long")
    near, low = rows.join(F.broadcast(where), "objective"), F.col("kind") == "min_dvh"
    at_cut = F.when(low, F.col("voxel") >= F.col("id")).otherwise(F.col("voxel") <= F.col("id"))
    counted = F.when(F.col("cut").isNull(), ~low).when(F.col("dose") == F.col("cut"), F.coalesce(at_cut, F.lit(False))).otherwise(F.when(low, F.col("dose") > F.col("cut")).otherwise(F.col("dose") < F.col("cut")))
    e = F.when(counted, F.greatest(F.when(low, F.col("level") - F.col("dose")).otherwise(F.col("dose") - F.col("level")), F.lit(0.0))).otherwise(0.0)
    return near.select("objective", "voxel", (F.col("weight") * e * e).alias("f"), (F.when(low, -2.0).otherwise(2.0) * F.col("weight") * e).alias("g"))


def hotspot_terms(dose: DataFrame, spot: Hotspot) -> DataFrame:
    """AG-15 per voxel: (voxel, f, g)."""
    e = F.col("dose") - spot.threshold * spot.prescription
    n = e / spot.prescription
    hot = dose.where(e > 0)
    return hot.select("voxel", (spot.penalty * n * n * (1 + 10 * n) * e * e).alias("f"), (2 * spot.penalty * n * (1 + 15 * n) * e).alias("g"))


def evaluated(dose: DataFrame, objectives: DataFrame, goals: DataFrame, spot: Hotspot | None = None) -> DataFrame:
    """AG-17 in voxel space: (voxel, f, g) summed over all objectives."""
    rows = terms(dose, objectives, goals).select("voxel", "f", "g")
    if spot and spot.prescription > 0 and spot.penalty > 0:
        rows = rows.unionByName(hotspot_terms(dose, spot))
    return rows.groupBy("voxel").agg(F.sum("f").alias("f"), F.sum("g").alias("g"))

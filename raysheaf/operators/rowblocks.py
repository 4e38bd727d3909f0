"""A plan's objective over row blocks: the matrix as compressed rows, one Arrow row per block of voxels.

A block holds its voxels' entries, sorted by bixel, and which objectives its voxels belong to.
One evaluation takes several weight vectors at once (the steps that a line search may try next)
and is two or three jobs, whatever the number of objectives: where the dose-volume objectives
begin to count, by counts of bands and then of the values within one band of each; and values
and gradients, added up by bixel. What comes to the driver is a line per vector and objective,
and one per bixel. Blocks are cached; lost ones are packed again.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import analysis as an
from .objectives import KINDS, Hotspot

#: Entries of a block, more only if one voxel has more.
ENTRIES = 1 << 19
#: Bits of a dose that make its band: sign, exponent and nine of the mantissa.
BAND = 44
_BLOCK = "voxel array<long>, start array<int>, bixel array<int>, value array<double>, goal_at array<int>, goal_of array<int>"
Evaluate = Callable[[np.ndarray], tuple[float, np.ndarray]]


def packed(dij: DataFrame, bixels: list[int], voxels: DataFrame, goals: DataFrame) -> DataFrame:
    """Blocks of ``dij`` (voxel, bixel, value; each pair once), ``voxels`` (voxel) and ``goals`` (objective, voxel). Entries and goals of other voxels or bixels are left out."""
    spark = dij.sparkSession
    places = F.broadcast(spark.createDataFrame([(int(b), i) for i, b in enumerate(bixels)], "bixel long, place int"))  # a plan's bixels
    none = F.lit(None).cast("double")
    rows = voxels.select(F.col("voxel").cast("long").alias("voxel"), F.lit(0).alias("what"), F.lit(0).alias("place"), none.alias("value")).distinct()
    rows = rows.unionByName(dij.join(places, "bixel").select(F.col("voxel").cast("long").alias("voxel"), F.lit(1).alias("what"), "place", "value"))
    rows = rows.unionByName(goals.select(F.col("voxel").cast("long").alias("voxel"), F.lit(2).alias("what"), F.col("objective").cast("int").alias("place"), none.alias("value")))

    def block(voxel: np.ndarray, what: np.ndarray, place: np.ndarray, value: np.ndarray) -> pa.RecordBatch:
        own = np.unique(voxel[what == 0])
        known = np.isin(voxel, own)
        at = np.searchsorted(own, voxel)
        entry, goal = known & (what == 1), known & (what == 2)
        start = np.r_[0, np.cumsum(np.bincount(at[entry], minlength=len(own)))]
        columns = [own, start.astype(np.int32), place[entry], value[entry], at[goal].astype(np.int32), place[goal]]
        kinds = [pa.list_(t) for t in (pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.int32(), pa.int32())]
        return pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(columns, kinds, strict=True)], ["voxel", "start", "bixel", "value", "goal_at", "goal_of"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        for batch in batches:
            held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            if sum(len(h[0]) for h in held) >= ENTRIES:
                whole = [np.concatenate(c) for c in zip(*held, strict=True)]
                end = int(np.searchsorted(whole[0], whole[0][-1]))  # the last voxel may go on
                if end:
                    yield block(*(c[:end] for c in whole))
                held = [[c[end:] for c in whole]]
        if held:
            yield block(*(np.concatenate(c) for c in zip(*held, strict=True)))

    return rows.repartition("voxel").sortWithinPartitions("voxel", "what", "place").mapInArrow(pack, _BLOCK)


def _doses(batch: pa.RecordBatch, weights: np.ndarray) -> Iterator[tuple]:
    """Per block: its voxels, entries (row, bixel, value), goals (row, objective) and the doses of all weight vectors."""
    for i in range(batch.num_rows):
        voxel, start, bixel, value, goal_at, goal_of = (batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in range(6))
        row = np.repeat(np.arange(len(voxel)), np.diff(start))
        dose = np.stack([np.bincount(row, value * w[bixel], minlength=len(voxel)) for w in weights]) if len(voxel) else np.zeros((len(weights), 0))
        yield voxel, (row, bixel, value), (goal_at, goal_of), dose


def _bands(dose: np.ndarray) -> np.ndarray:
    """Numbers that grow with the (non-negative) doses."""
    return (dose + 0.0).view(np.int64) >> BAND


def _counts(key: list[np.ndarray]) -> list[np.ndarray]:
    order = np.lexsort(key[::-1])
    key = [k[order] for k in key]
    fresh = np.flatnonzero(np.r_[True, np.any([k[1:] != k[:-1] for k in key], axis=0)][: len(order)])
    return [*(k[fresh] for k in key), np.diff(np.r_[fresh, len(order)])]


class Objective:
    """The value and gradient of a plan's objectives, with penalties on the weights, at several weight vectors at once."""

    def __init__(self, dij: DataFrame, bixels: list[int], voxels: DataFrame, objectives: DataFrame, goals: DataFrame, spot: Hotspot | None = None, l2: float = 0.0, l1: float = 0.0, smoothing: float = 0.0, edges: list[tuple[int, int]] = ()) -> None:
        self.spark, self.bixels, self.spot = dij.sparkSession, bixels, spot
        self.l2, self.l1, self.smooth, self.jobs = l2, l1, smoothing, 0
        self.lines = sorted(objectives.select("objective", "kind", "dose", "weight", "fraction", "n").collect())  # a plan's few objectives
        for r in self.lines:
            if r.kind not in KINDS:
                raise ValueError(f"no objective of kind {r.kind}")
        number = {r.objective: i for i, r in enumerate(self.lines)}
        named = self.spark.createDataFrame(list(number.items()), "was int, objective int") if number else None
        own = goals.select(F.col("objective").alias("was"), "voxel").join(F.broadcast(named), "was").select("objective", "voxel") if number else goals.limit(0).select("objective", "voxel")
        self.blocks = packed(dij, bixels, voxels, own).persist(StorageLevel.MEMORY_AND_DISK)
        place = {b: i for i, b in enumerate(bixels)}
        self.ends = np.array([(place[a], place[b]) for a, b in edges if a in place and b in place], np.int64).reshape(-1, 2)
        low = [r.kind == "min_dvh" for r in self.lines]
        self.first = {i: max(0, math.floor((1.0 - r.fraction) * r.n) if low[i] else r.n - math.ceil(r.fraction * r.n)) for i, r in enumerate(self.lines) if r.kind.endswith("_dvh")}

    def release(self) -> None:
        self.blocks.unpersist()

    def _ranked(self, counts: DataFrame, by: str) -> list:
        """Of (trial, objective, by, n): where the rank of each objective falls, with how many lie below."""
        ranks = F.broadcast(self.spark.createDataFrame(list(self.first.items()), "objective int, rank long"))
        total = counts.groupBy("trial", "objective", by).agg(F.sum("n").alias("n"))
        before = F.sum("n").over(Window.partitionBy("trial", "objective").orderBy(by)) - F.col("n")
        found = total.withColumn("below", before).join(ranks, "objective")
        self.jobs += 1
        return found.where((F.col("below") <= F.col("rank")) & (F.col("rank") < F.col("below") + F.col("n"))).collect()

    def _cuts(self, weights: np.ndarray) -> dict[tuple[int, int], tuple[float | None, int | None]]:
        """Per trial and dose-volume objective the dose from which, or up to which, it counts, and the voxel from or up to which it does at that dose."""
        if not self.first:
            return {}
        dvh = np.array(sorted(self.first))

        def banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for _, _, (at, of), dose in _doses(batch, weights):
                    own = np.isin(of, dvh)
                    for t in range(len(weights)):
                        objective, band, n = _counts([of[own], _bands(dose[t, at[own]])])
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), t, np.int32)), pa.array(objective), pa.array(band), pa.array(n)], ["trial", "objective", "band", "n"])

        found = self._ranked(self.blocks.mapInArrow(banded, "trial int, objective int, band long, n long"), "band")
        below = {(r.trial, r.objective): r.below for r in found}
        band_of = np.full((len(weights), len(self.lines)), -1, np.int64)
        for r in found:
            band_of[r.trial, r.objective] = r.band

        def valued(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for _, _, (at, of), dose in _doses(batch, weights):
                    for t in range(len(weights)):
                        own = _bands(dose[t, at]) == band_of[t, of]
                        objective, value, n = _counts([of[own], dose[t, at[own]]])
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), t, np.int32)), pa.array(objective), pa.array(value), pa.array(n)], ["trial", "objective", "value", "n"])

        counts = self.blocks.mapInArrow(valued, "trial int, objective int, value double, n long")
        offsets = self.spark.createDataFrame([(t, o, b) for (t, o), b in below.items()], "trial int, objective int, offset long")
        ranks = self.spark.createDataFrame(list(self.first.items()), "objective int, rank long")
        total = counts.groupBy("trial", "objective", "value").agg(F.sum("n").alias("n")).join(F.broadcast(offsets), ["trial", "objective"]).join(F.broadcast(ranks), "objective")
        before = F.col("offset") + F.sum("n").over(Window.partitionBy("trial", "objective").orderBy("value")) - F.col("n")
        at_rank = total.withColumn("below", before).where((F.col("below") <= F.col("rank")) & (F.col("rank") < F.col("below") + F.col("n")))
        self.jobs += 1
        cuts: dict[tuple[int, int], tuple[float | None, int | None]] = {(t, o): (None, None) for t in range(len(weights)) for o in self.first}
        tied = {}
        for r in at_rank.collect() if below else []:
            line = self.lines[r.objective]
            low = line.kind == "min_dvh"
            counted = r.below + r.n - r.rank if low else r.rank - r.below
            if (line.dose - r.value if low else r.value - line.dose) <= 0 or counted == (r.n if low else 0):
                cuts[r.trial, r.objective] = (r.value, -1 if low else None)
            else:
                cuts[r.trial, r.objective] = (r.value, None)
                tied[r.trial, r.objective] = r.n - counted if low else counted - 1
        if tied:
            self._break_ties(weights, cuts, tied)
        return cuts

    def _break_ties(self, weights: np.ndarray, cuts: dict, tied: dict[tuple[int, int], int]) -> None:
        keys = sorted(tied)

        def equal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for voxel, _, (at, of), dose in _doses(batch, weights):
                    for k, (t, o) in enumerate(keys):
                        own = at[(of == o) & (dose[t, at] == cuts[t, o][0])]
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), k, np.int32)), pa.array(voxel[own])], ["structure", "voxel"])

        ranks = self.spark.createDataFrame([(k, tied[key]) for k, key in enumerate(keys)], "structure int, rank long")
        self.jobs += 1
        for r in an.order_statistics(self.blocks.mapInArrow(equal, "structure int, voxel long"), F.broadcast(ranks), "voxel").collect():
            cuts[keys[r.structure]] = (cuts[keys[r.structure]][0], int(r.value))

    def __call__(self, w: np.ndarray) -> tuple[float, np.ndarray]:
        return self.many([w])[0]

    def many(self, trials: list[np.ndarray]) -> list[tuple[float, np.ndarray]]:
        weights = np.stack(trials)
        cuts, lines, spot = self._cuts(weights), self.lines, self.spot
        kinds = np.array([KINDS.index(r.kind) for r in lines] or [0])
        level, weight, size = (np.array([getattr(r, c) for r in lines] or [1.0], float) for c in ("dose", "weight", "n"))
        cut = np.full((len(trials), len(kinds)), np.nan)
        voxel_at = np.full(cut.shape, np.nan)
        for (t, o), (value, at) in cuts.items():
            cut[t, o], voxel_at[t, o] = (np.nan if x is None else x for x in (value, at))

        def terms(voxel: np.ndarray, at: np.ndarray, of: np.ndarray, dose: np.ndarray, t: int) -> tuple[float, np.ndarray]:
            kind, d, own = kinds[of], dose[at], voxel[at]
            e = d - level[of]
            e = np.where(np.isin(kind, (1, 4)), np.maximum(e, 0.0), np.where(kind == 0, e, np.minimum(e, 0.0)))
            c, v = cut[t, of], voxel_at[t, of]
            least = np.where(np.isnan(c), False, np.where(d == c, own >= v, d > c))
            most = np.where(np.isnan(c), True, np.where(d == c, own <= v, d < c))
            counted = np.where(kind == 3, least, np.where(kind == 4, most, True))
            scale = weight[of] * counted / np.where(kind < 3, size[of], 1.0)
            g = np.bincount(at, 2 * scale * e, minlength=len(voxel))
            f = float((scale * e * e).sum())
            if spot and spot.prescription > 0 and spot.penalty > 0:
                over = np.maximum(dose - spot.threshold * spot.prescription, 0.0)
                n = over / spot.prescription
                f += float((spot.penalty * n * n * (1 + 10 * n) * over * over).sum())
                g += 2 * spot.penalty * n * (1 + 15 * n) * over
            return f, g

        count = len(self.bixels)

        def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, value = np.zeros((len(weights), count)), np.zeros(len(weights))
            for batch in batches:
                for voxel, (row, bixel, entry), (at, of), dose in _doses(batch, weights):
                    for t in range(len(weights)):
                        f, g = terms(voxel, at, of, dose[t], t)
                        value[t] += f
                        total[t] += np.bincount(bixel, entry * g[row], minlength=count)
            t, b = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(np.r_[np.arange(len(weights)), t].astype(np.int32)), pa.array(np.r_[np.full(len(weights), -1), b].astype(np.int32)), pa.array(np.r_[value, total[t, b]])], ["trial", "place", "x"])

        f, grad = np.zeros(len(trials)), np.zeros((len(trials), count))
        self.jobs += 1
        found = self.blocks.mapInArrow(summed, "trial int, place int, x double").groupBy("trial", "place").agg(F.sum("x").alias("x")).toArrow()  # a line per trial and bixel
        t, place, x = (found[c].to_numpy() for c in ("trial", "place", "x"))
        f[t[place < 0]] = x[place < 0]
        grad[t[place >= 0], place[place >= 0]] = x[place >= 0]
        return [self._penalised(w, float(f[i]), grad[i]) for i, w in enumerate(trials)]

    def _penalised(self, w: np.ndarray, f: float, grad: np.ndarray) -> tuple[float, np.ndarray]:
        step = w[self.ends[:, 0]] - w[self.ends[:, 1]]  # each pair of neighbours stands in both directions
        grad = grad + 2 * self.smooth * np.bincount(self.ends[:, 0], step, len(w)) + 2 * self.l2 * w + self.l1 * (w > 0)
        return float(f + self.smooth / 2 * (step @ step) + self.l2 * (w @ w) + self.l1 * w.sum()), grad

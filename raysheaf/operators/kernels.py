"""Convolution kernels: as joins, and as array kernels of bounded size."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def convolved(a: DataFrame, b: DataFrame) -> DataFrame:
    """AK-05, full: (i, j, v) of two sparse images, as a sum over the places of the smaller one, which is broadcast.

    ``b`` is a kernel: its size is a machine's, not the data's.
    """
    k = b.select(F.col("i").alias("di"), F.col("j").alias("dj"), F.col("v").alias("w"))
    return a.crossJoin(F.broadcast(k)).groupBy((F.col("i") + F.col("di")).alias("i"), (F.col("j") + F.col("dj")).alias("j")).agg(F.sum(F.col("v") * F.col("w")).alias("v"))


def convolved_same(a: DataFrame, b: DataFrame, a_rows: int, a_cols: int, b_rows: int, b_cols: int) -> DataFrame:
    """AK-05, cropped to the first image from half the kernel on."""
    full = convolved(a, b).withColumn("i", F.col("i") - b_rows // 2).withColumn("j", F.col("j") - b_cols // 2)
    return full.where(F.col("i").between(0, a_rows - 1) & F.col("j").between(0, a_cols - 1))


def convolve(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """AK-04, AK-05: full convolution by transforms padded to powers of two."""
    rows, cols = (x + y - 1 for x, y in zip(a.shape, b.shape, strict=True))
    size = [1 << max(0, math.ceil(math.log2(n))) for n in (rows, cols)]
    return np.fft.irfft2(np.fft.rfft2(a, size) * np.fft.rfft2(b, size), size)[:rows, :cols]


def penumbra(fwhm: float, half: int, step: float) -> np.ndarray:
    """SF-21: normalised Gaussian on a grid from -half to half - 1."""
    sigma = fwhm / math.sqrt(8 * math.log(2))
    x = np.arange(-half, half) * step
    g = np.exp(-(x[:, None] ** 2 + x[None, :] ** 2) / (2 * sigma**2))
    return g / g.sum()

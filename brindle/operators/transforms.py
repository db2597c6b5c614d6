"""Cosine transform and dictionary learning on image arrays."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.functions.pixels import wrapped


def _basis(n: int) -> np.ndarray:
    """Orthonormal DCT-II of order n, a row a frequency."""
    k, i = np.indices((n, n))
    return np.where(k == 0, math.sqrt(1 / n), math.sqrt(2 / n)) * np.cos(math.pi * (2 * i + 1) * k / (2 * n))


def _times(m: np.ndarray, column: Column) -> Column:
    """A fixed matrix times an array column."""
    rows = [F.array(*(F.lit(float(x)) for x in r)) for r in m]
    return F.array(*(F.aggregate(F.zip_with(column, r, lambda x, w: x * w), F.lit(0.0), lambda t, x: t + x) for r in rows))


def dct(elements: DataFrame, side: int) -> DataFrame:
    """Adds ``freq``: the orthonormal 2-D DCT-II of square images."""
    return elements.withColumn("freq", _times(np.kron(_basis(side), _basis(side)), F.transform("px", lambda x: x.cast("double"))))


def inverse_dct(elements: DataFrame, side: int) -> DataFrame:
    """Adds ``back``: pixels of ``freq``, rounded."""
    return elements.withColumn("back", F.transform(_times(np.kron(_basis(side), _basis(side)).T, F.col("freq")), lambda x: F.round(x).cast("int")))


def _codes(x: np.ndarray, words: np.ndarray, rounds: int = 40) -> np.ndarray:
    """Non-negative codes of rows of x by multiplicative updates from a fixed start."""
    c = np.full((len(x), len(words)), x.mean() / max(words.sum(axis=0).mean(), 1e-9))
    top, square = x @ words.T, words @ words.T
    for _ in range(rounds):
        c *= top / np.maximum(c @ square, 1e-9)
    return c


def learned_dictionary(elements: DataFrame, n: int, rounds: int = 10, seed: int = 0) -> np.ndarray:
    """``n`` non-negative words (P9): codes by task, the two sufficient matrices summed by Spark, words updated in the driver."""
    d = elements.select(F.size("px").alias("d")).first()["d"]
    words = np.random.default_rng(seed).random((n, d)) * 128

    for _ in range(rounds):
        now = words.copy()

        def sums(batches):
            square, top = np.zeros((n, n)), np.zeros((n, d))
            for batch in batches:
                x = np.array(batch.column(0).to_pylist(), float).reshape(-1, d)
                c = _codes(x, now)
                square, top = square + c.T @ c, top + c.T @ x
            both = np.hstack([square, top]).round(6)
            i, j = np.indices(both.shape)
            yield pa.RecordBatch.from_arrays([pa.array(i.ravel().astype(np.int32)), pa.array(j.ravel().astype(np.int32)), pa.array(both.ravel())], ["i", "j", "v"])

        both = np.zeros((n, n + d))
        for r in elements.select("px").mapInArrow(sums, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():  # n * (n + d) rows
            both[r["i"], r["j"]] = r["v"]
        square, top = both[:, :n], both[:, n:]
        for _ in range(20):
            words *= top / np.maximum(square @ words, 1e-9)
    return words


def dictionary_code(elements: DataFrame, words: np.ndarray, whole_codes: bool = False) -> DataFrame:
    """Adds ``code`` and ``back``, its product with the words, cut and wrapped (P10).

    whole_codes: codes cut to integers, as in the published scheme (a coarse loss).
    """
    names = ["elem", "px", "code"]

    def coded(batches):
        for batch in batches:
            x = np.array(batch.column(1).to_pylist(), float).reshape(-1, words.shape[1])
            c = _codes(x, words)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array((np.floor(c) if whole_codes else c).tolist(), pa.list_(pa.float64()))], names)

    df = elements.select("elem", "px").mapInArrow(coded, "elem long, px array<int>, code array<double>")
    return reconstructed(df, words)


def reconstructed(coded: DataFrame, words: np.ndarray) -> DataFrame:
    """Adds ``back``: codes times words, cut and wrapped (P10)."""
    return coded.withColumn("back", F.transform(_times(words.T, F.col("code")), lambda x: wrapped(F.floor(x))))

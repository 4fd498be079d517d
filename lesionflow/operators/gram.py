"""Correlations and principal components from one matrix of products.

Two passes: sums of each place of a vector give its mean, then each task adds up the products about these means for all its rows and puts out one
row a pair of places, which Spark adds up. What is added is centred, so no offset of the values is lost to rounding, and no list of parts is
gathered. Only places * places numbers reach the driver, at any number of rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SUMS = ("n", "a", "b", "aa", "bb", "ab")


def matrix(column: pa.Array, size: int) -> np.ndarray:
    """Rows of ``size`` numbers; missing places are not a number."""
    x = np.full((len(column), size), np.nan)
    for row, values in zip(x, column.to_pylist()):
        if values:
            row[: len(values)] = [np.nan if v is None else v for v in values]
    return x


def centres(vectors: DataFrame, vector: str) -> np.ndarray:
    """The mean of each place; 0 where no row has it."""
    size = vectors.select(F.max(F.size(vector))).first()[0] or 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(size), np.zeros(size)
        for batch in batches:
            x = matrix(batch.column(0), size)
            n += (~np.isnan(x)).sum(axis=0)
            total += np.nansum(x, axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size), pa.int32()), pa.array(n), pa.array(total)], ["place", "n", "total"])

    rows = vectors.select(vector).mapInArrow(run, "place int, n double, total double").groupBy("place").agg((F.sum("total") / F.greatest(F.sum("n"), F.lit(1.0))).alias("mean")).collect()
    return np.array([m for _, m in sorted((r["place"], r["mean"]) for r in rows)])


def products(vectors: DataFrame, vector: str, centre: np.ndarray) -> DataFrame:
    """(i, j, n, a, b, aa, bb, ab) of pairs of places i <= j: over the rows that have both, their number and the sums of both values less the centres, of
    their squares and of their product."""
    size = len(centre)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, a, aa, ab = (np.zeros((size, size)) for _ in range(4))
        for batch in batches:
            x = matrix(batch.column(0), size) - centre
            seen = (~np.isnan(x)).astype(float)
            z = np.nan_to_num(x)
            n += seen.T @ seen
            a += z.T @ seen
            aa += (z * z).T @ seen
            ab += z.T @ z
        i, j = np.triu_indices(size)
        sums = n[i, j], a[i, j], a[j, i], aa[i, j], aa[j, i], ab[i, j]
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), *map(pa.array, sums)], ["i", "j", *SUMS])

    parts = vectors.select(vector).mapInArrow(run, "i int, j int, " + ", ".join(f"{c} double" for c in SUMS))
    return parts.groupBy("i", "j").agg(*(F.sum(c).alias(c) for c in SUMS))


def all_correlations(vectors: DataFrame, vector: str) -> DataFrame:
    """(i, j, abs_corr) of all pairs of places, i < j, as many as the longest vector has; rows where either value is missing do not count for a pair; null where a value
    does not vary."""
    n, a, b = F.col("n"), F.col("a"), F.col("b")
    aa, bb, ab = F.col("aa") - a * a / n, F.col("bb") - b * b / n, F.col("ab") - a * b / n
    varies = (aa > 1e-14 * F.col("aa")) & (bb > 1e-14 * F.col("bb"))
    return products(vectors, vector, centres(vectors, vector)).where("i < j AND n > 0").select("i", "j", F.when(varies, F.abs(ab / F.sqrt(aa) / F.sqrt(bb))).alias("abs_corr"))


def standardised(vectors: DataFrame, vector: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, population standard deviation, correlation matrix) of the places of vectors without missing places."""
    centre = centres(vectors, vector)
    p = len(centre)
    cov, n, shift = np.zeros((p, p)), 1.0, np.zeros(p)
    for r in products(vectors, vector, centre).collect():  # p * p numbers
        n = max(n, r["n"])
        cov[r["i"], r["j"]] = cov[r["j"], r["i"]] = r["ab"]
        shift[r["i"]], shift[r["j"]] = r["a"], r["b"]
    cov = cov / n - np.outer(shift / n, shift / n)
    sd = np.sqrt(np.maximum(np.diag(cov), 0.0))
    sd[sd <= 1e-14 * np.maximum(1.0, np.abs(centre))] = 0.0
    scale = np.where(sd > 0, sd, 1.0)
    return centre + shift / n, sd, np.where(np.outer(sd, sd) > 0, cov / np.outer(scale, scale), 0.0)


def components(vectors: DataFrame, vector: str, k: int = 2) -> tuple[DataFrame, DataFrame, np.ndarray, np.ndarray]:
    """(shares, loadings, and for ``scores`` mean and weights) of the first k components of the standardised places, which do not vary
    counting as 0. Shares: (component, explained). Loadings: (component, feature, loading); a component's sign is such that its loading of largest size (of equals the
    first) is positive."""
    spark = vectors.sparkSession
    mean, sd, corr = standardised(vectors, vector)
    values, turn = np.linalg.eigh(corr)
    best = np.argsort(-values, kind="stable")[:k]
    turn = turn[:, best]
    lead = np.abs(np.round(turn, 12)).argmax(axis=0)
    turn = turn * np.where(turn[lead, np.arange(turn.shape[1])] < 0, -1.0, 1.0)
    total = max(float(np.trace(corr)), 1e-300)
    shares = spark.createDataFrame([(c, float(values[b]) / total) for c, b in enumerate(best.tolist())], "component int, explained double")
    loadings = spark.createDataFrame([(c, f, float(turn[f, c])) for c in range(turn.shape[1]) for f in range(len(turn))], "component int, feature int, loading double")
    return shares, loadings, mean, turn / np.where(sd > 0, sd, np.inf)[:, None]


def scores(vectors: DataFrame, key: str, vector: str, mean: np.ndarray, weights: np.ndarray) -> DataFrame:
    """(key, component, score): the rows' standardised places times the loadings."""
    kind = dict(vectors.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(((matrix(batch.column(1), len(mean)) - mean) @ weights).tolist(), pa.list_(pa.float64()))], [key, "scores"])

    rows = vectors.select(key, vector).mapInArrow(run, f"`{key}` {kind}, scores array<double>")
    return rows.select(key, F.posexplode("scores").alias("component", "score"))

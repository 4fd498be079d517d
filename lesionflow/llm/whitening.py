"""Whitening of embeddings by a bit-sliced scatter matrix.

1. Every entry becomes a whole number (``round_down(scale * c) + offset``). A task takes blocks of BLOCK rows, subtracts
   each dimension's smallest number, and packs each bit plane of each dimension across the rows into 64-bit
   words. The sum of products of two dimensions is the sum over their planes of 2^(i + j) times the bits set in
   both, so products come from AND and popcounts alone and are exact; the shift is put back in whole numbers. A
   task adds up its blocks and puts out one row for each pair of dimensions (in limbs of 40 bits, so that no sum
   overflows), which Spark adds up. Nothing but dimensions * dimensions sums reaches the driver, at any number of rows.
2. The driver centres in whole numbers (n * products - sums * sums) and only then divides: the covariance is
   rounded once. ``eigh`` gives its eigenvectors. Where eigenvalues differ by more than SPREAD, those of the small ones
   are lost in the rounding of the large ones: the matrix is then turned by the vectors in whole numbers and
   turned the rest of the way by Jacobi rotations.
3. Rows are projected in tasks; the deviation is taken in whole numbers. One more pass measures the covariance of what
   comes out.

A row is left out when its vector is null, empty, holds a null or an entry that is not finite, or has another
length than the most frequent one (the larger of equally frequent lengths). Entries beyond 2^62 / scale count as that.
Rows that repeat count each time; null ids stay; an empty table gives no rows; further columns are ignored. A
component without variance (a constant direction) has ``whitened`` null and no part in ``identity_error``. A
deviation of more than 38 digits is null.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE, OFFSET, COMPONENTS = 64, 1_000_000, 32
BLOCK = 8192
LIMB = 40
#: Eigenvalues further apart than this are refined in whole numbers.
SPREAD = 1e8


@dataclass(frozen=True)
class Whitening:
    """What the fit gives: count, sums, the components by falling eigenvalue (columns), their eigenvalues, the trace."""

    n: int
    sums: list[int]
    components: np.ndarray
    values: np.ndarray
    trace: float


def usable(rows: DataFrame, id_column: str, vector: str) -> DataFrame:
    """(id, v) of the rows that count."""
    v = F.col("v")
    kept = rows.select(F.col(id_column).alias("id"), F.col(vector).cast("array<double>").alias("v")).where(v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) != float("inf")), F.lit(False))))
    most = kept.groupBy(F.size(v).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return kept.where(F.size(v) == (most["d"] if most else 0))


def whole(batch: pa.RecordBatch) -> np.ndarray:
    """The batch's vectors as whole numbers without the offset, which cancels out of all that is centred; a row each."""
    flat = batch.column(1).flatten().to_numpy()
    return np.clip(np.floor(flat.reshape(batch.num_rows, -1) * SCALE), -(2.0**62), 2.0**62).astype(np.int64)


def planes(u: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, dimension, bit) of the bit planes that are not empty; a row of 64-bit words for each plane."""
    words, dims, bits = [], [], []
    padded = np.zeros((-(-len(u) // 64) * 64, u.shape[1]), np.uint64)
    padded[: len(u)] = u
    for bit in range(int(u.max(initial=0)).bit_length()):
        held = np.packbits(((padded >> np.uint64(bit)) & np.uint64(1)).astype(np.uint8), axis=0, bitorder="little")
        use = np.flatnonzero(held.any(axis=0))
        words.append(np.ascontiguousarray(held.T[use]).view(np.uint64))
        dims.append(use)
        bits.append(np.full(len(use), bit))
    if not words:
        return np.zeros((0, len(padded) // 64), np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(words), np.concatenate(dims), np.concatenate(bits)


def scatter(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sums, products) of the rows as Python numbers, the products from AND and popcounts of the shifted bit planes."""
    d = x.shape[1]
    low = x.min(axis=0)
    u = (x.astype(np.uint64) - low.astype(np.uint64)) if len(x) else x.astype(np.uint64)  # wraps to the right difference
    words, dims, bits = planes(u)
    products, sums = np.zeros((d, d), object), np.zeros(d, object)
    np.add.at(sums, dims, np.array([int(c) << int(b) for c, b in zip(np.bitwise_count(words).sum(axis=1, dtype=np.int64), bits)], object))
    small = 2 * int(bits.max(initial=0)) + int(len(x)).bit_length() < 61
    for k in range(len(dims)):
        both = np.bitwise_count(words[k:] & words[k]).sum(axis=1, dtype=np.int64)
        weights = bits[k:] + bits[k]
        if small:
            row = np.zeros(d, np.int64)
            np.add.at(row, dims[k:], both << weights)
        else:
            row = np.zeros(d, object)
            np.add.at(row, dims[k:], np.array([int(c) << int(w) for c, w in zip(both, weights)], object))
        row[dims[k]] -= int(both[0]) << int(weights[0])  # the plane with itself comes once, each other pair from both ends
        row = row.astype(object)
        products[dims[k]] += row
        products[:, dims[k]] += row
        products[dims[k], dims[k]] += int(both[0]) << int(weights[0])
    shift = np.array([int(v) for v in low], object)
    products += np.outer(shift, sums) + np.outer(sums, shift) + len(x) * np.outer(shift, shift)
    return sums + len(x) * shift, products


def limbs(value: int) -> Iterator[tuple[int, int]]:
    """The number as parts of LIMB bits, the last one with its sign."""
    k = 0
    while not -(1 << LIMB) < value < 1 << LIMB:
        yield k, value & ((1 << LIMB) - 1)
        value, k = value >> LIMB, k + 1
    yield k, value


def scattered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The task's sums: (-1, -1) count, (-1, i) sum of dimension i, (i, j) product of dimensions i <= j."""
    n, total = 0, None

    def add(x: np.ndarray) -> None:
        nonlocal total
        some = scatter(x)
        total = some if total is None else (total[0] + some[0], total[1] + some[1])

    held: list[np.ndarray] = []
    for batch in batches:
        if batch.num_rows:
            held.append(whole(batch))
            n += batch.num_rows
            if sum(map(len, held)) >= BLOCK:
                rows = np.concatenate(held)
                for at in range(0, len(rows) - BLOCK + 1, BLOCK):
                    add(rows[at : at + BLOCK])
                held = [rows[len(rows) - len(rows) % BLOCK :]]
    if n:
        if len(rows := np.concatenate(held)):
            add(rows)
        sums, products = total
        d = len(sums)
        values = [(-1, -1, n), *((-1, i, sums[i]) for i in range(d)), *((i, j, products[i, j]) for i in range(d) for j in range(i, d))]
        out = [(i, j, k, part) for i, j, value in values for k, part in limbs(int(value))]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.int32(), pa.int32(), pa.int64()))], ["i", "j", "limb", "part"])


def refined(exact: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(values, vectors) of the matrix of Python numbers from approximate vectors: turned by them exactly, then by Jacobi rotations."""
    d = len(exact)
    turn = np.array([[int(v) for v in row] for row in np.round(vectors * 2.0**53)], object)
    inner = turn.T @ exact @ turn
    m = np.array([[v / (1 << 106) for v in row] for row in inner], float)
    turned = np.eye(d)
    for _ in range(30):
        off = False
        for p in range(d - 1):
            for q in range(p + 1, d):
                if abs(m[p, q]) <= 1e-17 * np.sqrt(abs(m[p, p] * m[q, q])):
                    continue
                off = True
                slope = (m[q, q] - m[p, p]) / (2 * m[p, q])
                t = (1.0 if slope >= 0 else -1.0) / (abs(slope) + np.hypot(1.0, slope))
                c = 1 / np.hypot(1.0, t)
                spin = np.array([[c, t * c], [-t * c, c]])
                corner = m[p, p] - t * m[p, q], m[q, q] + t * m[p, q]
                m[:, [p, q]] = m[:, [p, q]] @ spin
                m[[p, q], :] = spin.T @ m[[p, q], :]
                m[p, p], m[q, q] = corner
                m[p, q] = m[q, p] = 0.0
                turned[:, [p, q]] = turned[:, [p, q]] @ spin
        if not off:
            break
    return np.diag(m).copy(), vectors @ turned


def solved(n: int, sums: list[int], products: dict[tuple[int, int], int], most: int) -> Whitening:
    """Components of exact sums: centred in whole numbers, rounded once, then ``eigh``."""
    d = len(sums)
    centred = np.empty((d, d), object)
    for (i, j), value in products.items():
        centred[i, j] = centred[j, i] = n * value - sums[i] * sums[j]
    v = np.array([[x / (n * n) for x in row] for row in centred], float)
    values, vectors = np.linalg.eigh(v)
    least = values[-min(most, d)]
    if values[-1] > 0 and least < values[-1] / SPREAD:
        values, vectors = refined(centred, vectors)
        values = values / (n * n)
    order = np.argsort(-values, kind="stable")[:most]
    trace = int(np.trace(centred)) / (n * n)
    return Whitening(n, sums, vectors[:, order], values[order], trace)


def fit(rows: DataFrame, most: int = COMPONENTS) -> Whitening | None:
    """The whitening of the usable rows (id, v); None without rows."""
    parts = rows.mapInArrow(scattered, "i int, j int, limb int, part bigint").groupBy("i", "j", "limb").agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("part"))
    total: dict[tuple[int, int], int] = {}
    for r in parts.collect():  # one row for each pair of dimensions and limb
        total[r["i"], r["j"]] = total.get((r["i"], r["j"]), 0) + (int(r["part"]) << (LIMB * r["limb"]))
    if not total:
        return None
    n = total.pop((-1, -1))
    sums = [total.pop((-1, i)) for i in range(sum(i < 0 for i, _ in total))]
    return solved(n, sums, total, most)


def project(rows: DataFrame, w: Whitening) -> DataFrame:
    """(id, deviation, whitened) of the usable rows: decimal(38,0), and an array with a number or null for each component."""
    quotient = [s // w.n for s in w.sums]
    rest = [s - q * w.n for s, q in zip(w.sums, quotient)]
    floor = len(w.sums) * np.finfo(float).eps ** 2 * max(float(w.values[0]), 0.0)
    varied = (w.values > floor).tolist()
    turn = w.components / np.sqrt(np.where(varied, w.values, 1.0))
    n, most = w.n, 10**38

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, r = np.array(quotient, object), np.array(rest, object)
        part = np.array([x / n for x in rest])
        for batch in batches:
            if not batch.num_rows:
                continue
            x = whole(batch)
            near = [abs(v) < 2**62 for v in quotient]
            y = x - np.array(quotient, np.int64) if all(near) and np.abs(x).max() < 2**61 else x.astype(object) - q
            out = (y.astype(float) - part) @ turn
            if y.dtype != object and (float(n) * float(np.abs(y).max() + 1)) ** 2 * len(q) < 2.0**62:
                moved = y * n - np.array(rest, np.int64)
                deviation = (moved * moved).sum(axis=1).tolist()
            else:
                moved = y.astype(object) * n - r
                deviation = (moved * moved).sum(axis=1).tolist()
            rows_out = out.tolist() if all(varied) else [[v if ok else None for v, ok in zip(row, varied)] for row in out.tolist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([Decimal(v) if v < most else None for v in deviation], pa.decimal128(38, 0)), pa.array(rows_out, pa.list_(pa.float64()))], ["id", "deviation", "whitened"])

    kind = dict(rows.dtypes)["id"]
    return rows.mapInArrow(run, f"id {kind}, deviation decimal(38,0), whitened array<double>")


def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The task's sums of the whitened numbers (i = -1) and of their products."""
    sums = products = None
    for batch in batches:
        if batch.num_rows:
            w = np.array(batch.column(0).to_pylist(), float)
            sums, products = (w.sum(axis=0), w.T @ w) if sums is None else (sums + w.sum(axis=0), products + w.T @ w)
    if sums is not None:
        i, j = np.triu_indices(len(sums))
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[np.full(len(sums), -1), i], pa.int32()), pa.array(np.r_[np.arange(len(sums)), j], pa.int32()), pa.array(np.r_[sums, products[i, j]])], ["i", "j", "part"])


def identity_error(projected: DataFrame, n: int) -> float | None:
    """The largest absolute entry of the covariance of the whitened rows, less the identity. The rows come centred; what is left of their means is taken off."""
    total = {(r["i"], r["j"]): r["part"] for r in projected.select("whitened").mapInArrow(moments, "i int, j int, part double").groupBy("i", "j").agg(F.sum("part").alias("part")).collect()}
    errors = [abs(part / n - total[-1, i] / n * total[-1, j] / n - (i == j)) for (i, j), part in total.items() if i >= 0 and part == part and total[i, i] == total[i, i] and total[j, j] == total[j, j]]
    return max(errors, default=None)


def whiten(rows: DataFrame, id_column: str, vector: str, most: int = COMPONENTS) -> DataFrame:
    """(id_column, component, n, deviation, whitened, explained, identity_error): a row for each usable row and component."""
    kept = usable(rows, id_column, vector)
    w = fit(kept, most)
    kind = dict(kept.dtypes)["id"]
    if w is None:
        return kept.sparkSession.createDataFrame([], f"`{id_column}` {kind}, component int, n bigint, deviation decimal(38,0), whitened double, explained double, identity_error double")
    projected = project(kept, w)
    error = identity_error(projected, w.n)
    share = [float(v / w.trace) if w.trace else None for v in w.values]
    each = projected.select("id", "deviation", F.posexplode("whitened").alias("k", "whitened"))
    explained = F.array(*(F.lit(x).cast("double") for x in share))
    return each.select(
        F.col("id").alias(id_column), (F.col("k") + 1).cast("int").alias("component"), F.lit(w.n).cast("long").alias("n"), "deviation", "whitened",
        F.element_at(explained, F.col("k") + 1).alias("explained"), F.lit(error).cast("double").alias("identity_error"),
    )

"""Whitening against plain whole-number arithmetic."""

from fractions import Fraction

import numpy as np
import pytest

from lesionflow.llm import catalog, whitening


@pytest.mark.parametrize("reach", [0, 20, 2**30, 2**61])
def test_planes_give_exact_products(reach):
    x = np.random.default_rng(1).integers(-reach, reach + 1, (300, 6))
    x[:, 3] = 5
    sums, products = whitening.scatter(x)
    exact = x.astype(object)
    assert (sums == exact.sum(axis=0)).all() and (products == exact.T @ exact).all()


def test_limbs_add_up():
    for value in (0, 1, -1, 2**40, -(2**40), 2**200 + 12345, -(2**130) - 7):
        assert sum(part << (whitening.LIMB * k) for k, part in whitening.limbs(value)) == value
        assert all(abs(part) <= 2**40 for _, part in whitening.limbs(value))


def test_small_components_survive_large_ones():
    rng = np.random.default_rng(0)
    d, n = 12, 400
    x = np.floor(rng.normal(size=(n, d)) @ rng.normal(size=(d, d)) * 10.0 ** rng.integers(1, 13, d)).astype(np.int64).astype(object)
    sums, products = x.sum(axis=0), x.T @ x
    w = whitening.solved(n, list(sums), {(i, j): products[i, j] for i in range(d) for j in range(i, d)}, d)
    y = (x * n - sums).astype(float) / n @ w.components / np.sqrt(w.values)
    assert w.values[0] / w.values[-1] > whitening.SPREAD
    assert abs(y.T @ y / n - np.eye(d)).max() < 1e-4 and abs(w.components.T @ w.components - np.eye(d)).max() < 1e-12


def whitened(rows):
    out = {}
    for r in rows.collect():
        out.setdefault(r["vec_id"], {})[r["component"]] = r
    return out


def test_query_keeps_its_contract(spark, sf_dir):
    table = {r["vec_id"]: r["embedding"] for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()}
    got = whitened(catalog.QUERIES["op12_whitening"](spark, sf_dir))
    assert got.keys() == table.keys()
    ids = sorted(table)
    x = np.array([[int(np.floor(64 * float(np.float64(c)))) + 1_000_000 for c in table[i]] for i in ids], object)
    n, sums = len(ids), x.sum(axis=0)
    moved = x * n - sums
    deviation = (moved * moved).sum(axis=1)
    v = np.array([[float(Fraction(int(c), n**3)) for c in row] for row in moved.T @ moved])
    values = np.linalg.eigvalsh(v)[::-1]
    w = np.array([[got[i][k]["whitened"] for k in range(1, 33)] for i in ids])
    assert [got[i][1]["deviation"] for i in ids] == deviation.tolist()
    assert abs(np.cov(w.T, bias=True) - np.eye(32)).max() < 1e-8
    first = got[ids[0]]
    assert [first[k]["explained"] for k in range(1, 33)] == pytest.approx((values / v.trace())[:32].tolist(), rel=1e-9)
    assert {r["n"] for of in got.values() for r in of.values()} == {n} and 0 <= first[1]["identity_error"] < 1e-8
    back = w * np.sqrt(values[:32])  # projections of centred rows: their products with the rows give the components again
    turn = np.linalg.lstsq(moved.astype(float) / n, back, rcond=None)[0]
    assert abs(turn.T @ turn - np.eye(32)).max() < 1e-6 and abs(v @ turn - turn * values[:32]).max() < 1e-6 * values[0]


def test_rows_odd(spark):
    nan, inf = float("nan"), float("inf")
    good = [[0.0, 1.0, 1e6], [1.0, 3.0, -1e6], [2.0, 2.5, 5e-9], [7.0, -1.0, 2.0]]
    rows = [(k, v, 1) for k, v in enumerate(good)] + [(3, good[3], 1), (None, good[0], 2), (9, None, 1), (10, [], 1), (11, [1.0, None, 2.0], 1), (12, [nan, 0.0, 0.0], 1), (13, [0.0, -inf, 0.0], 1), (14, [1.0, 2.0], 1)]
    table = spark.createDataFrame(rows, "vec_id bigint, v array<double>, component int")
    out = whitening.whiten(table, "vec_id", "v").collect()
    assert len(out) == 6 * 3 and {r["n"] for r in out} == {6} and {r["vec_id"] for r in out} == {0, 1, 2, 3, None}
    assert max(r["identity_error"] for r in out) < 1e-4
    assert whitening.whiten(table.where("vec_id > 8"), "vec_id", "v").columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert whitening.whiten(table.where("vec_id BETWEEN 9 AND 13"), "vec_id", "v").count() == 0
    (alone,) = {(r["whitened"], r["explained"], r["identity_error"], int(r["deviation"])) for r in whitening.whiten(table.where("vec_id = 0"), "vec_id", "v").collect()}
    assert alone == (None, None, None, 0)
    huge = spark.createDataFrame([(1, [1e300, 1.0]), (2, [-1e300, 2.0]), (3, [0.0, 4.0])], "vec_id bigint, v array<double>")
    assert whitening.whiten(huge, "vec_id", "v").count() == 6

"""Queries whose SQL covers a part: the whole jobs."""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from lesionflow.operators import cohort, evaluate, gram
from lesionflow.plans import catalog_cohort, catalog_rule


def test_correlations_of_all_pairs(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    x = np.array([r[0] for r in rows.select("embedding").collect()], float)
    want = np.abs(np.corrcoef(x.T))
    got = catalog_cohort.QUERIES["k06_correlations_whole"](spark, sf_dir).collect()
    assert len(got) == x.shape[1] * (x.shape[1] - 1) // 2 > 28
    assert all(r.abs_corr == pytest.approx(want[r.i, r.j], abs=2e-6) for r in got)


def test_correlations_with_offset_missing_and_constant_values(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 4)) @ rng.normal(size=(4, 4)) + 1e6
    x[:, 3] = 7.0
    rows = [(None if i % 50 == 0 else [None if i % 7 == 0 and j == 1 else float(v) for j, v in enumerate(r)],) for i, r in enumerate(x)]
    got = {(r.i, r.j): r.abs_corr for r in gram.all_correlations(spark.createDataFrame(rows, "v array<double>").repartition(5), "v").collect()}
    seen = np.array([i % 50 != 0 for i in range(300)])
    both = seen & np.array([i % 7 != 0 for i in range(300)])
    for (i, j), rows_ in {(0, 1): both, (0, 2): seen, (1, 2): both}.items():
        assert got[i, j] == pytest.approx(abs(np.corrcoef(x[rows_][:, i], x[rows_][:, j])[0, 1]), abs=1e-9)
    assert got[0, 3] is None and gram.all_correlations(spark.createDataFrame([], "v array<double>"), "v").count() == 0


def test_guard_sweep_has_the_whole_grids(spark, sf_dir):
    got = {r.profile: r for r in catalog_rule.QUERIES["i14_guard_sweep_whole"](spark, sf_dir).collect()}
    assert len(got) == 60 and sum("unlimited" in p for p in got) == 11 and sum("floor=10," in p for p in got) == 10
    far = [{**catalog_rule.SHIPPED, "profile": "far", "confirm_max_weeks": 1e9}]
    one = catalog_rule.rounded_summary(evaluate.class_figures(evaluate.confusion(evaluate.scorable(catalog_rule.rule_calls(spark, sf_dir, far)), "profile"), "profile"), "profile").first()
    assert got["floor=10, late=unlimited"][1:] == one[1:]


def test_bootstrap_is_of_balanced_accuracy(spark):
    rows = [(p, f"t{i}", e, a, b) for p in range(3) for i, (e, a, b) in enumerate([("PD", "PD", "PD")] * 8 + [("CR", "PD", "CR"), ("SD", "SD", "PD"), ("SD", "PD", "SD"), ("SD", "PD", "SD")])]
    rows.append((0, "only a", "PR", "PR", None))
    calls = spark.createDataFrame([(p, t, e, n, c) for p, t, e, a, b in rows for n, c in (("mrano_volumetric", a), ("rano_classic_ported", b)) if c], "patient long, timepoint string, expert string, profile string, predicted string")
    got = cohort.bootstrap_difference(catalog_cohort.patient_counts(calls), evaluate.CLASSES).collect()
    assert 1800 < len(got) <= 2000  # draws without any of three patients have no figure
    assert all(r.difference == pytest.approx((0 + 1 + 1 / 3) / 3) for r in got)


def test_sets_that_differ_after_the_look_ahead_share_it(spark, sf_dir):
    some = [g for g in catalog_rule.WHOLE_GRID if g["floor_mm3"] in (0.0, 10.0)] + [{**catalog_rule.SHIPPED, "profile": "no end", "keep_at_end": False}]
    calls = catalog_rule.rule_calls(spark, sf_dir, some)
    plan = calls._jdf.queryExecution().optimizedPlan().toString()
    ahead = plan.index("RangeFrame")
    assert "explode(sets" in plan[:ahead] and "explode(sets" not in plan[ahead:]  # the sweep was crossed before the windows once
    figures = ("profile", "timepoint", "call", "driver", "provisional", "unknowns")
    got = sorted((tuple(r) for r in calls.select(*figures).collect()), key=str)
    alone = [catalog_rule.rule_calls(spark, sf_dir, [g]).select(*figures) for g in (some[0], some[-1], some[-2])]
    for one in alone:
        want = sorted((tuple(r) for r in one.collect()), key=str)
        assert want == [r for r in got if r[0] == want[0][0]]
    assert len(got) == len(want) * len(some)


def test_sign_test_of_many_scans(spark):
    """Against whole numbers, then, where these are too many to add up, against the normal tail, which is right to 1 / n between two steps."""
    def whole(k, n):
        term = total = 1
        for i in range(min(k, n - k)):
            term = term * (n - i) // (i + 1)
            total += term
        return min(1.0, float(Fraction(2 * total, 2**n)))

    some = [(0, 1), (1, 1), (0, 40), (3, 17), (15, 40), (16, 40), (25, 40), (16, 33), (98, 196), (90, 250), (615, 1531), (980, 2020), (4900, 9990), (10_100, 20_000), (14_800, 30_000)]
    many = [(3 * 10**9 - d, 6 * 10**9) for d in (1, 1000, 40_000, 150_000, 10**8)]
    some += [(k, n) for n in (8, 20, 21) for k in range(n + 1)]
    got = [r.p for r in spark.createDataFrame(some + many, "k long, n long").select(evaluate.sign_test(F.col("k"), F.col("n")).alias("p")).collect()]
    assert got[: len(some)] == [pytest.approx(whole(k, n), rel=1e-11) for k, n in some]
    assert all(p == whole(k, n) for p, (k, n) in zip(got, some) if n <= 20)
    assert got[len(some) :] == [pytest.approx(math.erfc((n - 2 * k - 1) / math.sqrt(2 * n)), rel=1e-7, abs=1e-12) for k, n in many]


def test_disagreements_equal_a_join(spark):
    rows = [("a", 1, "PD", "PD"), ("b", 1, "PD", "SD"), ("a", 2, "SD", "PD"), ("b", 2, "SD", "SD"), ("a", 3, "CR", "CR"), ("b", 4, "CR", "CR"), ("c", 1, "PD", "PD"), ("a", None, "PD", "PD"), ("b", None, "PD", "SD")]
    rows += [("a", 5, "PD", "PD")] * 3 + [("a", 5, "PD", "SD")] + [("b", 5, "PD", "SD")] * 2 + [("b", 5, "PD", "PD")]  # a timepoint that comes many times
    pairs = spark.createDataFrame(rows, "profile string, timepoint int, expert string, predicted string").repartition(5)
    pairs.createOrReplaceTempView("sign_pairs")
    want = spark.sql("""SELECT count_if(a.predicted = a.expert AND b.predicted <> b.expert) AS lost, count_if(a.predicted <> a.expert AND b.predicted = b.expert) AS won
        FROM sign_pairs a JOIN sign_pairs b ON a.timepoint = b.timepoint AND a.profile = 'a' AND b.profile = 'b'""").first()
    assert tuple(evaluate.disagreements(pairs, "a", "b").first()) == tuple(want) == (7, 2)
    assert tuple(evaluate.disagreements(pairs.limit(0), "a", "b").first()) == (0, 0)


def test_sign_test_follows_each_patient_once(spark, sf_dir):
    plan = catalog_cohort.QUERIES["k08_sign_test"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RangeFrame") == 1 and "Join FullOuter" not in plan

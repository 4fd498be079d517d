"""Checks on broken records, ranks, components and statistics against plain versions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lesionflow.operators import cohort, contract, gram, nested, order, scan, timeline, validate, voxel


def test_broken_records_are_told(spark):
    rows = [(1, [0.0, 4.0], 4.0, 10.0), (2, [4.0, 0.0], 8.0, 14.0), (3, [float("nan")], None, None), (4, [0.0], 10.0, 4.0), (5, None, None, None), (6, [], None, None)]
    records = spark.createDataFrame(rows, "patient int, surgeries array<double>, rt_start double, rt_end double")
    got = {(r.patient, r.violation) for r in validate.record_violations(records).collect()}
    assert got == {(2, "surgeries_not_ordered"), (3, "week_not_finite"), (4, "radiotherapy_ends_before_start")}
    assert {r.patient: len(r.assumptions) for r in contract.assumptions(records).collect()} == {1: 3, 2: 3, 3: 1, 4: 3, 5: 0, 6: 0}


def test_contract_of_odd_scans(spark):
    rows = [(1, 1, True, True, [1, 2], "PD", 500.0), (1, 2, False, True, [1], "SD", 1000.0), (1, 3, True, True, [], "PD", 1.0), (1, 4, True, True, None, None, None), (1, 5, True, True, [1, 9], "PD", 1.0), (2, 6, True, True, [3], "Post-Op", 0.0)]
    items = spark.createDataFrame(rows, "patient int, timepoint int, has_ct1 boolean, has_flair boolean, labels array<int>, rating string, enhancing_mm3 double")
    out = contract.contract(items)
    got = {r.timepoint: (r.readiness, r.assessable, r.enhancing_mm3, r.uncertainty_pp) for r in out.collect()}
    assert got == {1: ("usable", True, 500.0, 36.6), 2: ("needs_attention", True, 1000.0, 14.8), 3: ("unusable", False, None, None), 4: ("unusable", False, None, None), 5: ("unusable", False, None, None), 6: ("needs_attention", False, 0.0, 36.6)}
    nested = {r.patient: r for r in contract.patient_contracts(out).collect()}
    assert nested[1].ready and nested[1].n_usable == 2 and [s.timepoint for s in nested[1].scans] == [1, 2, 3, 4, 5] and not nested[2].ready


def test_orientation_codes(spark):
    affines = [([[1, 0, 0], [0, 1, 0], [0, 0, 1]], "RAS"), ([[-1, 0, 0.1], [0, -2, 0], [0, 0, 5]], "LPS"), ([[0, 0, 1], [-1, 0, 0], [0, -1, 0]], "PIR")]
    rows = spark.createDataFrame([(*[float(x) for row in a for x in row], code) for a, code in affines], ", ".join(f"a{i}{j} double" for i in range(3) for j in range(3)) + ", code string")
    from lesionflow.functions import scalars

    assert all(r.got == r.code for r in rows.select(contract.orientation(scalars.affine()).alias("got"), "code").collect())


def test_spread_ranks_equal_plain_ranks(spark):
    rng = np.random.default_rng(3)
    rows = spark.createDataFrame([(int(g), float(v)) for g, v in zip(rng.integers(0, 3, 500), rng.integers(0, 60, 500))], "g int, v double")
    got = order.with_rank(rows, "v", "g").withColumn("plain", cohort.average_rank(F.col("v"), "g"))
    assert got.count() == 500 and got.where("rank <> plain").count() == 0
    assert order.with_rank(rows, "v").withColumn("plain", cohort.average_rank(F.col("v"))).where("rank <> plain").count() == 0


def test_components_of_scans_equal_a_walk(spark, monkeypatch):
    monkeypatch.setattr(scan, "TOGETHER", 40)
    rng = np.random.default_rng(8)
    cells = {(int(p), int(v), int(x), int(y), int(z)) for p, v, x, y, z in zip(*(rng.integers(0, n, 900) for n in (3, 3, 6, 6, 5)))}
    frame = spark.createDataFrame(list(cells), "patient bigint, visit bigint, x int, y int, z int")
    for offsets in (voxel.HALF_26, voxel.HALF_6):
        whole = {o for d in offsets for o in (d, tuple(-c for c in d))}
        want, seen = {}, set()
        for start in sorted(cells):
            if start in seen:
                continue
            stack = [start]
            seen.add(start)
            while stack:
                p, v, x, y, z = at = stack.pop()
                want[at] = (start[2] * 4096 + start[3]) * 4096 + start[4]
                for dx, dy, dz in whole:
                    near = (p, v, x + dx, y + dy, z + dz)
                    if near in cells and near not in seen:
                        seen.add(near)
                        stack.append(near)
        assert {tuple(r)[:5]: r.root for r in voxel.label_components(frame, offsets).collect()} == want
    assert voxel.label_components(frame.limit(0)).count() == 0


def test_lesion_ids_follow_heirs(spark):
    links = spark.createDataFrame([(1, 1, 10, None, "new"), (1, 1, 20, None, "new"), (1, 2, 11, 10, "kept"), (1, 2, 12, 10, "split"), (1, 4, 13, 11, "kept"), (1, 4, 30, None, "new"), (2, 4, 13, None, "new")], "patient bigint, visit bigint, root bigint, parent bigint, state string")
    assert {(r.patient, r.visit, r.root): r.lesion for r in voxel.lesion_ids(links).collect()} == {
        (1, 1, 10): "1:10", (1, 1, 20): "1:20", (1, 2, 11): "1:10", (1, 2, 12): "2:12", (1, 4, 13): "1:10", (1, 4, 30): "4:30", (2, 4, 13): "4:13"}


def test_principal_components_equal_numpy(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 5)) @ rng.normal(size=(5, 5))
    x[:, 4] = 3.0
    rows = spark.createDataFrame([(i, (row + 1e6).tolist()) for i, row in enumerate(x)], "k int, v array<double>").repartition(5)
    shares, loadings, mean, weights = gram.components(rows, "v", 3)
    sd = x.std(0)
    z = (x - x.mean(0)) / np.where(sd > 1e-9, sd, 1.0)
    _, values, turn = np.linalg.svd(z, full_matrices=False)
    turn = turn * np.sign(turn[np.arange(len(turn)), np.abs(turn).argmax(axis=1)])[:, None]
    assert [r.explained for r in shares.orderBy("component").collect()] == pytest.approx((values**2 / (values**2).sum())[:3].tolist(), abs=1e-8)
    assert [r.loading for r in loadings.orderBy("component", "feature").collect()] == pytest.approx(turn[:3].ravel().tolist(), abs=1e-6)
    got = gram.scores(rows, "k", "v", mean, weights).orderBy("k", "component").collect()
    assert [r.score for r in got] == pytest.approx((z @ turn[:3].T).ravel().tolist(), abs=1e-5)


def test_tail_of_chi_square(spark):
    xs = [0.0, 1e-9, 0.01, 0.5, 1.0, 3.841458820694124, 6.0, 7.999, 8.0, 8.001, 10.83, 30.0, 200.0, 1400.0]
    rows = spark.createDataFrame([(x,) for x in xs] + [(None,), (-1.0,)], "x double")
    got = [r.p for r in rows.select("x", cohort.chi_square_tail(F.col("x")).alias("p")).collect()]
    for x, p in zip(xs, got):
        want = math.erfc(math.sqrt(x / 2))
        assert abs(p - want) < 1e-14 + 1e-12 * want
    assert got[-2:] == [None, None] or (got[-2] is None and (got[-1] is None or math.isnan(got[-1])))


def test_pieces_hang_under_their_lesion(spark):
    """Both levels of the forest against plain walks."""
    rng = np.random.default_rng(12)
    cells = {(p, v, *map(int, c)) for p in (1, 2) for v in (1, 2) for c in rng.integers(0, 7, (110, 3))}
    rows = spark.createDataFrame([(*c,) for c in cells], "patient bigint, visit bigint, x int, y int, z int")

    def walk(own, near):
        left, out = set(own), []
        while left:
            group, todo = set(), [min(left)]
            while todo:
                c = todo.pop()
                if c in left:
                    left.discard(c)
                    group.add(c)
                    todo += [d for d in left if near(c, d)]
            out.append(group)
        return out

    close = lambda c, d: max(abs(a - b) for a, b in zip(c, d)) <= 1
    number = lambda c: (c[0] * 4096 + c[1]) * 4096 + c[2]
    pieces = {(r.patient, r.visit, r.root, r.z): r.pieces for r in nested.pieces(rows).collect()}
    records = {(r.patient, r.visit): r for r in nested.records(rows).collect()}
    want = {}
    for p, v in records:
        own = {c[2:] for c in cells if c[:2] == (p, v)}
        lesions = sorted(walk(own, close), key=lambda g: (-len(g), min(g)))
        flat = [{z: len(walk([c for c in g if c[2] == z], close)) for z in {c[2] for c in g}} for g in lesions]
        want |= {(p, v, number(min(g)), z): n for g, f in zip(lesions, flat) for z, n in f.items()}
        faces = walk(own, lambda c, d: sum(abs(a - b) for a, b in zip(c, d)) == 1)
        r = records[p, v]
        assert (r.total, r.sizes, r.sizes_6) == (len(own), [len(g) for g in lesions], sorted(map(len, faces), reverse=True))
        assert (r.slices, r.fragmented) == (len(flat[0]), sum(n > 1 for n in flat[0].values()))
    assert pieces == want


def test_bootstrap_equals_a_plain_one_with_the_same_draws(spark):
    rng = np.random.default_rng(4)
    rows = [(i, *(int(n) for n in rng.integers(0, 4, 2)), *(0, 0), *(0, 0)) for i in range(30)]
    rows = [(i, n1, n2, min(n1, i % 2), min(n2, i % 3), min(n1, i % 3), n2) for i, n1, n2, *_ in rows]
    per = spark.createDataFrame(rows, "patient bigint, n_x bigint, n_y bigint, a_x bigint, a_y bigint, b_x bigint, b_y bigint")
    got = {r.draw: r.difference for r in cohort.bootstrap_difference(per, ["x", "y"], 40).collect()}
    u = {(r.draw, r.patient): r.u for r in per.select("patient", F.explode(F.sequence(F.lit(1), F.lit(40))).alias("draw")).select("draw", "patient", (F.pmod(F.xxhash64("draw", "patient"), F.lit(1 << 30)) / float(1 << 30)).alias("u")).collect()}
    from math import exp, factorial

    for draw in range(1, 41):
        total = np.zeros(6)
        for row in rows:
            copies, mass = 0, exp(-1)
            while u[draw, row[0]] >= mass - 1e-8 and copies < 7:
                copies += 1
                mass += exp(-1) / factorial(copies)
            total += copies * np.array(row[1:])
        recalls = [(total[4 + k] - total[2 + k]) / total[k] for k in (0, 1) if total[k]]
        assert got[draw] == pytest.approx(sum(recalls) / len(recalls))


def test_scans_after_radiotherapy(spark):
    rows = [(1, 1, 0.0, "Pre-Op"), (1, 2, 1.0, "Post-Op"), (1, 3, 12.0, "SD"), (1, 4, 16.0, "PD"), (1, 5, 30.0, "SD"), (2, 6, 0.0, "SD"), (2, 7, 40.0, "PD")]
    scans = spark.createDataFrame([(p, t, w, r, 0) for p, t, w, r in rows], "patient int, timepoint int, week double, rating string, rn int").withColumn("weeks_since_rt", F.lit(0.0))
    records = timeline.treatments(timeline.surgical_labels(scans))
    got = {r.timepoint: (r.rn, r.weeks_since_rt) for r in timeline.scans_after_radiotherapy(scans, records, 10.0).collect()}
    assert got == {4: (1, 5.0), 5: (2, 19.0)}  # radiotherapy ends at week 11; patient 2 has no operation

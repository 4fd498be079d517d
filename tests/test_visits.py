"""Distance fields, nearest cells and measures of two visits against plain versions."""

import numpy as np
import pytest

from lesionflow.operators import distance, order, visits


def plain_distance(points, seeds, most, steps):
    out = []
    for p in points:
        d = np.abs(seeds - p)
        d = d.max(axis=1) if steps == "cube" else d.sum(axis=1)
        out.append(min(int(d.min()), most + 1) if len(seeds) else most + 1)
    return out


@pytest.mark.parametrize("steps", ["cube", "face"])
def test_distance_fields(steps):
    rng = np.random.default_rng(4)
    for _ in range(60):
        seeds, points = (rng.integers(0, rng.integers(2, 40), (rng.integers(1, 30), 3)) for _ in range(2))
        most = int(rng.integers(0, 26))
        assert distance.distances(points, seeds, most, steps).tolist() == plain_distance(points, seeds, most, steps)
    none = np.zeros((0, 3), np.int64)
    assert distance.distances(points, none, 3).tolist() == [4] * len(points) and len(distance.distances(none, points, 3)) == 0


def test_nearest_cell_of_all_pairs():
    rng = np.random.default_rng(5)
    for _ in range(60):
        cells = rng.integers(0, rng.integers(1, 60), (rng.integers(1, 80), 3))
        index = distance.Near(cells)
        for p in rng.uniform(-30, 90, (5, 3)):
            assert index.distance(p) == pytest.approx(float(np.sqrt(((cells - p) ** 2).sum(axis=1)).min()))
    assert distance.Near(np.zeros((0, 3), np.int64)).distance(np.zeros(3)) is None


def table(spark, cells):
    return spark.createDataFrame(cells, "patient bigint, visit bigint, x int, y int, z int, label int")


def test_two_visits(spark):
    rng = np.random.default_rng(6)
    cells = [(p, v, *map(int, c), 1) for p in (1, 2) for v in (1, 3, 4) for c in rng.integers(0, 6, (60, 3))] + [(3, 1, 0, 0, 0, 1), (3, 2, 0, 0, 0, 2), (3, 3, 9, 0, 0, 1), (3, 3, 9, 0, 0, 1), (4, 1, 1, 1, 1, 3), (4, 2, 1, 1, 1, 3)]
    sets = {}
    for p, v, x, y, z, label in cells:
        sets.setdefault((p, v), set()).update({(x, y, z)} if label == 1 else set())
    rows = {(r.patient, r.visit): r for r in visits.compared(table(spark, cells)).collect()}
    assert rows.keys() == {(1, 3), (1, 4), (2, 3), (2, 4), (3, 2), (3, 3)}
    for (p, v), r in rows.items():
        now, old = sets[p, v], sets[p, r.previous]
        assert (r.n, r.n_previous, r.kept, r.gained, r.lost) == (len(now), len(old), len(now & old), len(now - old), len(old - now))
        if now - old and old - now:
            assert r.centre_shift == pytest.approx(float(np.linalg.norm(np.mean(list(now - old), axis=0) - np.mean(list(old - now), axis=0))))
        moves = sorted(((a, b, c) for a in range(-2, 3) for b in range(-2, 3) for c in range(-2, 3)), key=lambda m: (sum(map(abs, m)), m))
        common = [len({(x + a, y + b, z + c) for x, y, z in now} & old) for a, b, c in moves]
        best = common.index(max(common)) if max(common) else None
        assert (r.dx, r.dy, r.dz, r.moved_common) == ((*moves[best], common[best]) if best is not None else (None,) * 4)
    assert visits.compared(table(spark, [])).count() == 0


def test_coordinates_out_of_range_raise(spark):
    with pytest.raises(Exception, match="coordinates"):
        visits.compared(table(spark, [(1, 1, 0, 0, 4095, 1), (1, 2, 0, 0, 0, 1)])).count()


def test_treated_zone_of_a_patient(spark):
    bar = lambda v, x0, x1, label=1: [(1, v, x, 0, 0, label) for x in range(x0, x1)]
    cells = bar(1, 0, 3) + bar(2, 0, 4) + bar(2, 4, 5, 2) + bar(3, 0, 12) + bar(4, 20, 22) + bar(5, 0, 30) + bar(6, 29, 40)
    seeds = spark.createDataFrame([(1, 2), (1, 4)], "patient bigint, visit bigint")
    rows = {(r.visit, r.margin): (r.gained, r.outside, r.largest, r.lumps) for r in visits.treated_zone(table(spark, cells), seeds, (0, 2, 25), floor=2).collect()}
    assert {v for v, _ in rows} == {3, 5, 6}
    assert rows[3, 0] == (8, 7, 7, 1) and rows[3, 2] == (8, 5, 5, 1) and rows[3, 25] == (8, 0, 0, 0)
    assert rows[5, 0] == (28, 28, 20, 2) and rows[5, 2] == (28, 24, 18, 2) and rows[6, 2] == (10, 10, 10, 1)


def test_exact_order_statistics(spark):
    rng = np.random.default_rng(8)
    values = [*(float(v) for v in rng.normal(size=400)), *[0.25] * 900, *map(float, rng.integers(0, 5, 300))]
    rows = [(int(k % 2 + (k % 3 == 0)), v) for k, v in enumerate(values)] + [(0, None), (9, None), (7, 1.5)]
    held = spark.createDataFrame(rows, "g int, v double").repartition(7)
    got = {r.g: r for r in order.percentiles(held, "v", {"a": 0.0, "b": 0.1, "c": 0.5, "d": 0.977, "e": 1.0}, "g").collect()}
    near = {r.g: r for r in order.percentiles(held, "v", {"b": 0.1, "c": 0.5, "e": 1.0}, "g", nearest=True).collect()}
    assert got.keys() == {0, 1, 2, 7}
    for g, r in got.items():
        own = sorted(v for k, v in rows if k == g and v is not None)
        assert r.n == len(own) and [r.a, r.b, r.c, r.d, r.e] == pytest.approx(np.percentile(own, [0, 10, 50, 97.7, 100]).tolist())
        assert [near[g].b, near[g].c, near[g].e] == [own[min(int(p * len(own)), len(own) - 1)] for p in (0.1, 0.5, 1.0)]
    whole = order.percentiles(held, "v", {"m": 0.5}).first()
    assert whole.m == pytest.approx(np.median([v for _, v in rows if v is not None]))
    ranks = order.with_rank(held, "v", "g").collect()
    for r in ranks:
        own = [v for k, v in rows if k == r.g and v is not None]
        assert r["rank"] == (None if r.v is None else sum(v < r.v for v in own) + (own.count(r.v) + 1) / 2)
    assert len(ranks) == len(rows)


def test_fits_are_judged_by_overlap(spark):
    cube = lambda v, x0, y0=0: [(1, v, x0 + x, y0 + y, z, 1) for x in range(4) for y in range(5) for z in range(3)]
    cells = cube(1, 10, 10) + cube(2, 12, 10) + cube(3, 13, 10) + cube(4, 10, 10) + cube(5, 11, 11) + [(2, 1, 1, 1, 1, 2), (2, 7, 1, 1, 1, 3)]
    none, far = [0.0] * 9, [0.0, 0.0, 0.0, 30.0, 0.0, 0.0, 0.0, 0.0, 0.0]
    fits = [(1, 1, none), (1, 2, [0.0, 0.0, 0.0, 2.0, 0.0, 0.0, 5.0, 5.0, 5.0]), (1, 3, far), (1, 4, far), (2, 7, [np.pi / 2, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0, 1.0, 1.0])]
    fits = spark.createDataFrame([(p, v, [float(x) for x in f]) for p, v, f in fits], "patient bigint, visit bigint, fit array<double>")
    rows = {(r.patient, r.visit): r for r in visits.registered(table(spark, cells), fits, (0, 0, 0), (40, 40, 40)).collect()}
    assert {k: r.status for k, r in rows.items()} == {(1, 1): "anchor", (1, 2): "registered", (1, 3): "fell back to translation", (1, 4): "REJECTED - left unregistered", (2, 1): "anchor", (2, 7): "registered"}
    assert rows[1, 2].overlap_before == pytest.approx(100 / 3) and rows[1, 2].overlap_after == 100 and rows[1, 2].centre_before == 2 and rows[1, 2].centre_after == 0
    assert rows[1, 3].overlap_before == pytest.approx(100 / 7) and rows[1, 3].overlap_after == 100 and rows[1, 4].overlap_after == 100

"""Work on scans that once went through joins of grids or shifted cells: results against plain versions, and that tasks keep it to themselves."""

import math

import duckdb
import numpy as np

from lesionflow.operators import audit, ruler, scan, visits, volumetry, voxel
from lesionflow.plans import catalog_more
from lesionflow.sources import readers
from lesionflow.sources.fixtures import frame

KEYS = "patient bigint, visit bigint, x int, y int, z int, label int"


def planned(rows) -> str:
    return rows._jdf.queryExecution().optimizedPlan().toString()


def test_a_transform_is_looked_up_inside_the_scans_task(spark):
    rng = np.random.default_rng(11)
    cells = sorted({(p, v, *map(int, c)) for p in (1, 2) for v in (1, 2) for c in rng.integers(0, 8, (150, 3))})
    cells = [(*c, 1 + i % 3) for i, c in enumerate(cells)]
    turns = [(p, v, 0.11 * p, -0.13, 0.17 * v, 1.0, 0.0, -1.0, 3.7, 4.1, 3.9) for p in (1, 2) for v in (1, 2)] + [(9, 1, *[0.0] * 9)]
    rows = voxel.resampled(spark.createDataFrame(cells, KEYS), spark.createDataFrame(turns, "patient bigint, visit bigint, " + ", ".join(f"{c} double" for c in voxel.FIT)), (0, 0, 1), (7, 7, 7))
    held, out = {c[:5]: c[5] for c in cells}, []
    for p, v, rx, ry, rz, tx, ty, tz, cx, cy, cz in turns:
        for x, y, z in np.ndindex(8, 8, 7):
            a, b, c = x - cx, y - cy, z + 1 - cz
            a, c = math.cos(ry) * a + math.sin(ry) * c, -math.sin(ry) * a + math.cos(ry) * c
            b, c = math.cos(rx) * b - math.sin(rx) * c, math.sin(rx) * b + math.cos(rx) * c
            a, b = math.cos(rz) * a - math.sin(rz) * b, math.sin(rz) * a + math.cos(rz) * b
            there = tuple(int(math.copysign(math.floor(abs(q) + 0.5), q)) for q in (a + cx + tx, b + cy + ty, c + cz + tz))
            if (p, v, *there) in held:
                out.append((p, v, x, y, z + 1, held[p, v, *there]))
    assert sorted(map(tuple, rows.collect())) == sorted(out) and len(out) > 100
    assert "Generate" not in planned(rows) and "Join" not in planned(rows)  # the grids of all scans once met in a broadcast


def test_ends_of_a_stack_interpolate_as_the_sql_does(spark):
    con, rng = duckdb.connect(), np.random.default_rng(12)
    for n, share, a, b in [(9, 0.05, 1, 6), (13, 0.05, 2, 7), (29, 0.05, 2, 7), (33, 0.05, 2, 7), (37, 0.05, 1, 6)] + [(int(rng.integers(2, 60)), s, 1, int(rng.integers(2, 8))) for s in (0.05, 0.95) for _ in range(40)]:
        k = math.floor((n - 1) * share) + 1
        values = [a] * k + [b] * (n - k)
        assert visits.between(np.array(values), share) == con.execute(f"SELECT quantile_cont(z, {share}) FROM (SELECT unnest({values}) AS z)").fetchone()[0]
    # of nine shared cells one lies at 1, the rest at 6: the lower end comes out a bit above 3, so that a cell at 3 lies beyond it
    shared = [(0, 0, 1)] + [(0, y, 6) for y in range(8)]
    cells = [(1, v, *c, 2) for v in (1, 2) for c in shared] + [(1, 2, 5, 5, 3, 2)]
    assert visits.mismatch(spark.createDataFrame(cells, KEYS)).first().at_ends == 1


def test_dilation_and_erosion_stay_in_the_scans_task(spark, sf_dir):
    rng = np.random.default_rng(13)
    cells = {(p, v, *map(int, c)) for p in (1, 2) for v in (1, 2) for c in rng.integers(0, 6, (150, 3))}
    rows = spark.createDataFrame([(*c, 1) for c in [*cells, *cells]], KEYS)
    cube = {(p, v, x + a, y + b, z + c) for p, v, x, y, z in cells for a in (-2, -1, 0, 1, 2) for b in (-2, -1, 0, 1, 2) for c in (-2, -1, 0, 1, 2)}
    wide = voxel.dilate(rows, 2, (0, 0, 1), (6, 6, 7))
    assert sorted(map(tuple, wide.collect())) == sorted(c for c in cube if max(c[2:4]) <= 6 and min(c[2:4]) >= 0 and 1 <= c[4] <= 7)
    inner = {c for c in cells if all((*c[:2], c[2] + a, c[3] + b, c[4] + d) in cells for a, b, d in voxel.FACES)}
    thin = voxel.erode(rows)
    assert sorted(map(tuple, thin.collect())) == sorted(inner) and inner
    assert all("Generate" not in planned(q) and "Join" not in planned(q) for q in (wide, thin))
    assert "Join" not in planned(catalog_more.QUERIES["j15_new_focus_cells"](spark, sf_dir))  # dilated cells once met in joins


def test_suppliers_are_dealt_out_before_grids_are_laid_out(spark, sf_dir):
    for view in ("plates", "cores", "solids"):
        assert frame(spark, sf_dir, view).rdd.getNumPartitions() >= int(spark.conf.get("spark.sql.shuffle.partitions"))  # one small file, so one task laid out all grids


def test_cells_that_repeat_are_dropped_inside_the_task(spark):
    cells = [(1, 1, x, y, 1, 1) for x in range(6) for y in range(5)]
    rows = spark.createDataFrame([*cells, *cells], KEYS)
    for found in (ruler.lesion_slices(rows), ruler.calipers(rows), ruler.slice_variants(rows, {"one": (1,)}), scan.label_components(rows, voxel.HALF_26)):
        assert "Aggregate" not in planned(found)  # a whole aggregation of all cells came before
    assert ruler.lesion_slices(rows).first().n == 30 and scan.label_components(rows, voxel.HALF_26).count() == 30
    assert {r.area for r in ruler.slice_variants(rows, {"one": (1,)}).collect()} == {30} and ruler.calipers(rows).count() == 1


def test_volumes_of_a_scans_masks_from_one_shuffle(spark):
    rows = [(1, 10, "atlas", 1.0, 1.0, 1.0, 1, 30), (1, 10, "atlas", 1.0, 1.0, 1.0, 2, 5), (1, 10, "T1", 1.0, 1.0, 2.0, 1, 12), (1, 10, "T1", 1.0, 1.0, 2.0, 1, 2), (1, 10, "T2", 1.0, 1.0, 4.0, 9, 7), (1, 10, "T2", 1.0, 1.0, 4.0, 1, 7)]
    rows += [(1, 11, "T1", 1.0, 1.0, 1.0, 1, 4), (2, 12, "atlas", 1.0, 1.0, 1.0, 9, 4), (2, 12, "T1", 1.0, 1.0, 1.0, 1, 4), (3, 13, "atlas", 1.0, 1.0, 1.0, 0, 8), (3, 13, "CT1", 0.5, 0.5, 0.5, 3, 8)]
    counts = spark.createDataFrame(rows, "patient bigint, timepoint bigint, modality string, s0 double, s1 double, s2 double, label int, n bigint")
    scans = counts.select("patient", "timepoint").distinct()
    names = {label: name for source, label, name in volumetry.LABELS if source == "deepbratumia"}
    found = audit.scan_volumes(counts, names)
    tidy = sorted(map(tuple, audit.tidy_of(found).collect()))
    plain = audit.tidy_volumes(counts, volumetry.label_schema(spark, "deepbratumia"), audit.mask_warnings(scans, counts, ["CT1", "T1", "T2", "FLAIR"], list(names)))
    assert tidy == sorted(map(tuple, plain.select(*audit.TIDY).collect())) and len(tidy) == 12
    assert sorted(map(tuple, audit.scan_deviations(found, 1.0).collect())) == sorted(map(tuple, audit.deviations(plain, 1.0).collect()))
    assert "Join" not in planned(found)  # masks were joined with their warnings, labels and counts
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") <= 2


def test_folders_do_not_grow_with_the_patients(spark, tmp_path):
    rows = spark.range(700).selectExpr("id AS patient", "id % 3 AS timepoint", "'atlas' AS space", "'edema' AS compartment", "1.5D AS volume_mm3")
    readers.write_tidy_volumes(rows.union(rows), str(tmp_path / "v"))
    assert len(list((tmp_path / "v").glob("folder=*"))) <= readers.FOLDERS  # was 700
    back = spark.read.parquet(str(tmp_path / "v"))
    assert sorted(map(tuple, back.drop("folder").collect())) == sorted(map(tuple, rows.union(rows).collect()))
    assert back.groupBy("patient").agg({"folder": "min", "*": "count"}).where("`count(1)` <> 2").count() == 0 and back.select("patient", "folder").distinct().count() == 700


def test_lumps_of_many_visits_together_are_those_of_each_pair(spark, monkeypatch):
    rng = np.random.default_rng(14)
    cells = {(p, v, *map(int, c)) for p in range(1, 9) for v in (1, 2, 4) for c in rng.integers(0, 9, (60, 3))} - {(3, 1, x, y, z) for x, y, z in np.ndindex(9, 9, 9)}
    rows = spark.createDataFrame([(*c, 1 + (sum(c) + k) % 3) for k in (0, 1) for c in sorted(cells)] + [(3, 1, 0, 0, 0, 2)], KEYS)  # labels that clash, a visit without old tissue
    apart = rows.union(spark.createDataFrame([(50, 1, 0, 0, 0, 1), (50, 2, 4090, 4094 // 2, 1, 1)], KEYS))

    def plain(rows):
        return sorted((r.patient, r.visit, r.previous, x.root, x.n, None if x.distance is None else round(x.distance, 9)) for r in visits.followed(rows).collect() for x in r.lumps)

    def together(rows):
        return sorted(((*r[:5], None if r.distance is None else round(r.distance, 9)) for r in visits.gained_lumps(rows).collect()), key=lambda r: r[:4])

    assert together(apart) == plain(apart) and any(r[-1] is None for r in together(apart))
    # more rows than are held together: visits of one patient meet across tables
    wide = spark.range(3 * 30_000).selectExpr("1L AS patient", "id DIV 30000 AS visit", "CAST(id % 30 AS INT) AS x", "CAST(id DIV 30 % 30 AS INT) AS y", "CAST(id % 30000 DIV 900 + id DIV 30000 * 10 AS INT) AS z", "1 AS label")
    assert together(wide) == plain(wide) and len(together(wide)) == 2
    # many lumps and old cells ask the grid index
    far = spark.range(2 * 2000).selectExpr("1L AS patient", "id DIV 2000 AS visit", "CAST(id % 20 * 2 + id DIV 2000 AS INT) AS x", "CAST(id DIV 20 % 20 * 2 AS INT) AS y", "CAST(id % 2000 DIV 400 * 2 AS INT) AS z", "1 AS label")
    assert together(far) == plain(far) and len(together(far)) == 2000

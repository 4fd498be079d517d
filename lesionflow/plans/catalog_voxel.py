"""Queries over voxel tables: volumes, components, growth, tracking, registration checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import volumetry, voxel
from ..sources.fixtures import frame, oracle

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
#: The grid of the derived voxel view.
LO, HI = (0, 0, 1), (7, 7, 7)


def query(name: str, sql: str | None = None, *views: str):
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = oracle(sql, *views)
        return fn

    return keep


def cells(spark, sf_dir: str, *labels: int) -> DataFrame:
    rows = frame(spark, sf_dir, "voxels")
    return rows.where(F.col("label").isin(*labels)) if labels else rows


def unit(spark, sf_dir: str) -> DataFrame:
    return frame(spark, sf_dir, "geometry").where("role = 'mask'").select("patient", scalars.voxel_volume(scalars.affine()).alias("voxel_mm3"))


DET = "abs(a00::DOUBLE * (a11::DOUBLE * a22::DOUBLE - a12::DOUBLE * a21::DOUBLE) - a01::DOUBLE * (a10::DOUBLE * a22::DOUBLE - a12::DOUBLE * a20::DOUBLE) + a02::DOUBLE * (a10::DOUBLE * a21::DOUBLE - a11::DOUBLE * a20::DOUBLE))"


@query("d01_label_histogram", "SELECT patient, visit, label, count(*) AS n FROM voxels GROUP BY ALL", "voxels")
def d01(spark, sf_dir):
    return volumetry.histogram(cells(spark, sf_dir))


@query("c02_compartment_volumes", f"WITH u AS (SELECT patient, {DET} AS mm3 FROM geometry WHERE role = 'mask'), l AS (SELECT * FROM (VALUES (1, 'enhancing'), (2, 'necrosis_nonenhancing'), (3, 'edema')) t(label, compartment)) SELECT s.patient, s.visit, l.compartment, round(mm3 * (SELECT count(*) FROM voxels v WHERE v.patient = s.patient AND v.visit = s.visit AND v.label = l.label), 6) AS volume_mm3 FROM (SELECT DISTINCT patient, visit FROM voxels) s CROSS JOIN l JOIN u USING (patient)", "voxels", "geometry")
def c02(spark, sf_dir):
    rows = volumetry.compartment_volumes(volumetry.histogram(cells(spark, sf_dir)), volumetry.label_schema(spark, "deepbratumia"), unit(spark, sf_dir))
    return rows.select("patient", "visit", "compartment", F.round("volume_mm3", 6).alias("volume_mm3"))


@query("c01_undocumented_labels", "SELECT patient, visit, array_to_string(list_sort(list(DISTINCT label)), ',') AS labels FROM voxels WHERE label NOT IN (1, 2) GROUP BY patient, visit", "voxels")
def c01(spark, sf_dir):
    rows = volumetry.undocumented(volumetry.histogram(cells(spark, sf_dir)), volumetry.label_schema(spark, "hdglio"))
    return rows.select("patient", "visit", F.array_join(F.transform("labels", lambda x: x.cast("string")), ",").alias("labels"))


@query("c03_region_volumes", f"WITH u AS (SELECT patient, {DET} AS mm3 FROM geometry WHERE role = 'mask') SELECT patient, visit, region, round(mm3 * count(*) FILTER (label <= k), 6) AS volume_mm3 FROM voxels JOIN u USING (patient) CROSS JOIN (VALUES ('ET', 1), ('TC', 2), ('WT', 3)) r(region, k) GROUP BY patient, visit, region, mm3", "voxels", "geometry")
def c03(spark, sf_dir):
    rows = volumetry.region_volumes(volumetry.histogram(cells(spark, sf_dir)), volumetry.region_members(spark, "deepbratumia"), unit(spark, sf_dir))
    return rows.select("patient", "visit", "region", F.round("volume_mm3", 6).alias("volume_mm3"))


STATS = "count(value) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 4) AS std, min(value) AS min, max(value) AS max, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.005), 6) AS p0_5, round(quantile_cont(value, 0.995), 6) AS p99_5"


def stats_out(rows: DataFrame, *by: str) -> DataFrame:
    return rows.select(*by, "n", F.round("mean", 6).alias("mean"), F.round("std", 4).alias("std"), "min", "max", *(F.round(c, 6).alias(c) for c in ("median", "p0_5", "p99_5")))


@query("d02_intensity_stats", f"SELECT patient, visit, {STATS} FROM (SELECT patient, visit, CAST(CASE WHEN value <> 0 THEN value END AS DOUBLE) AS value FROM intensities) GROUP BY patient, visit", "intensities")
def d02(spark, sf_dir):
    rows = frame(spark, sf_dir, "intensities").withColumn("value", F.when(F.col("value") != 0, F.col("value").cast("double")))
    return stats_out(volumetry.intensity_stats(rows, "patient", "visit"), "patient", "visit")


@query("d03_intensity_by_label", f"SELECT patient, label, {STATS} FROM (SELECT v.patient, v.label, CAST(value AS DOUBLE) AS value FROM voxels v JOIN intensities i USING (patient, visit, x, y, z)) GROUP BY patient, label", "voxels", "intensities")
def d03(spark, sf_dir):
    rows = cells(spark, sf_dir).join(frame(spark, sf_dir, "intensities").withColumn("value", F.col("value").cast("double")), voxel.CELL)
    return stats_out(volumetry.intensity_stats(rows, "patient", "label"), "patient", "label")


@query("d05_face_voxels", "SELECT patient, visit, CAST(sum((x = 0)::INT + (x = 7)::INT + (y = 0)::INT + (y = 7)::INT + (z = 1)::INT + (z = 7)::INT) AS BIGINT) AS on_faces FROM voxels GROUP BY ALL", "voxels")
def d05(spark, sf_dir):
    return volumetry.face_voxels(cells(spark, sf_dir), LO, HI)


ONE = "c AS (SELECT DISTINCT patient, visit, x, y, z FROM voxels WHERE label = 1)"
FACES = "(VALUES (1,0,0),(-1,0,0),(0,1,0),(0,-1,0),(0,0,1),(0,0,-1)) o(dx,dy,dz)"
ERODED = f"e AS (SELECT c.patient, c.visit, c.x, c.y, c.z FROM c CROSS JOIN {FACES} JOIN c n ON n.patient = c.patient AND n.visit = c.visit AND n.x = c.x + dx AND n.y = c.y + dy AND n.z = c.z + dz GROUP BY ALL HAVING count(*) = 6)"
ROOTS = """RECURSIVE {one}, k AS (SELECT *, (x * 4096 + y) * 4096 + z AS cell FROM c),
n AS (SELECT a.patient, a.visit, a.cell, b.cell AS other FROM k a JOIN k b ON a.patient = b.patient AND a.visit = b.visit AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 AND abs(a.z - b.z) <= 1 {near}),
walk AS (SELECT patient, visit, cell, cell AS root FROM k UNION SELECT n.patient, n.visit, n.other, walk.root FROM walk JOIN n ON n.patient = walk.patient AND n.visit = walk.visit AND n.cell = walk.cell WHERE walk.root < n.other),
roots AS (SELECT patient, visit, cell, CAST(min(root) AS BIGINT) AS root FROM walk GROUP BY ALL)"""
R26 = ROOTS.format(one=ONE, near="")
R6 = ROOTS.format(one=ONE, near="AND abs(a.x - b.x) + abs(a.y - b.y) + abs(a.z - b.z) <= 1")


def recursive(sql: str) -> str:
    """oracle() puts views first; RECURSIVE belongs right after WITH."""
    return sql.replace("RECURSIVE ", "", 1)


def query_recursive(name: str, sql: str):
    def keep(fn):
        QUERIES[name] = fn
        ORACLE[name] = oracle(recursive(sql), "voxels").replace("WITH ", "WITH RECURSIVE ", 1)
        return fn

    return keep


@query_recursive("j01_components", f"WITH {R26} SELECT patient, visit, root, count(*) AS n FROM roots GROUP BY ALL")
def j01(spark, sf_dir):
    return voxel.label_components(cells(spark, sf_dir, 1)).groupBy("patient", "visit", "root").agg(F.count(F.lit(1)).alias("n"))


@query_recursive("j01_components_6", f"WITH {R6} SELECT patient, visit, root, count(*) AS n FROM roots GROUP BY ALL")
def j01_6(spark, sf_dir):
    return voxel.label_components(cells(spark, sf_dir, 1), voxel.HALF_6).groupBy("patient", "visit", "root").agg(F.count(F.lit(1)).alias("n"))


@query_recursive("f01_lesions_top5", f"WITH {R26}, l AS (SELECT patient, visit, root, count(*) AS n FROM roots GROUP BY ALL HAVING count(*) >= 5) SELECT *, CAST(row_number() OVER (PARTITION BY patient, visit ORDER BY n DESC, root) AS INTEGER) AS rank FROM l QUALIFY rank <= 5")
def f01(spark, sf_dir):
    return voxel.lesions(cells(spark, sf_dir, 1), floor=5).where("rank <= 5")


@query_recursive("c14_component_overlaps", f"""WITH {R26}, kk AS (SELECT k.*, root FROM k JOIN roots USING (patient, visit, cell)), vp AS (SELECT patient, visit, lag(visit) OVER (PARTITION BY patient ORDER BY visit) AS previous FROM (SELECT DISTINCT patient, visit FROM c))
SELECT a.patient, a.visit, a.root, previous, b.root AS parent, count(*) AS n FROM kk a JOIN vp ON vp.patient = a.patient AND vp.visit = a.visit JOIN kk b ON b.patient = a.patient AND b.visit = previous AND b.cell = a.cell GROUP BY ALL""")
def c14(spark, sf_dir):
    return voxel.overlaps(voxel.label_components(cells(spark, sf_dir, 1)))


@query_recursive("j13_tracking", f"""WITH {R26}, kk AS (SELECT k.*, root FROM k JOIN roots USING (patient, visit, cell)), vp AS (SELECT patient, visit, lag(visit) OVER (PARTITION BY patient ORDER BY visit) AS previous FROM (SELECT DISTINCT patient, visit FROM c)),
s AS (SELECT a.patient, a.visit, a.root, previous, b.root AS parent, count(*) AS n FROM kk a JOIN vp ON vp.patient = a.patient AND vp.visit = a.visit JOIN kk b ON b.patient = a.patient AND b.visit = previous AND b.cell = a.cell GROUP BY ALL),
p AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY patient, visit, root ORDER BY n DESC, parent DESC) = 1),
h AS (SELECT *, row_number() OVER (PARTITION BY patient, previous, parent ORDER BY n DESC, root DESC) AS turn FROM p)
SELECT r.patient, r.visit, r.root, h.parent, CASE WHEN h.parent IS NULL THEN 'new' WHEN turn = 1 THEN 'kept' ELSE 'split' END AS state FROM (SELECT DISTINCT patient, visit, root FROM roots) r LEFT JOIN h USING (patient, visit, root)""")
def j13(spark, sf_dir):
    return voxel.tracked(voxel.label_components(cells(spark, sf_dir, 1)))


@query_recursive("j13_lesion_ids", f"""WITH {R26}, kk AS (SELECT k.*, root FROM k JOIN roots USING (patient, visit, cell)), vp AS (SELECT patient, visit, lag(visit) OVER (PARTITION BY patient ORDER BY visit) AS previous FROM (SELECT DISTINCT patient, visit FROM c)),
s AS (SELECT a.patient, a.visit, a.root, previous, b.root AS parent, count(*) AS n FROM kk a JOIN vp ON vp.patient = a.patient AND vp.visit = a.visit JOIN kk b ON b.patient = a.patient AND b.visit = previous AND b.cell = a.cell GROUP BY ALL),
p AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY patient, visit, root ORDER BY n DESC, parent DESC) = 1),
h AS (SELECT *, row_number() OVER (PARTITION BY patient, previous, parent ORDER BY n DESC, root DESC) AS turn FROM p),
t AS (SELECT r.patient, r.visit, r.root, h.previous, h.parent, CASE WHEN h.parent IS NULL THEN 'new' WHEN turn = 1 THEN 'kept' ELSE 'split' END AS state FROM (SELECT DISTINCT patient, visit, root FROM roots) r LEFT JOIN h USING (patient, visit, root)),
chain AS (SELECT patient, visit, root, concat(visit, ':', root) AS lesion FROM t WHERE state <> 'kept' UNION ALL SELECT t.patient, t.visit, t.root, chain.lesion FROM chain JOIN t ON t.patient = chain.patient AND t.previous = chain.visit AND t.parent = chain.root AND t.state = 'kept')
SELECT patient, visit, root, lesion FROM chain""")
def j13_ids(spark, sf_dir):
    """The lesion of each component, handed down along heirs from visit to visit."""
    return voxel.lesion_ids(voxel.tracked(voxel.label_components(cells(spark, sf_dir, 1))))


@query("j03_dilation", f"WITH {ONE} SELECT patient, visit, count(*) AS n FROM (SELECT DISTINCT patient, visit, x + dx AS x, y + dy AS y, z + dz AS z FROM c, (SELECT unnest([-1, 0, 1]) AS dx), (SELECT unnest([-1, 0, 1]) AS dy), (SELECT unnest([-1, 0, 1]) AS dz) WHERE x + dx BETWEEN 0 AND 7 AND y + dy BETWEEN 0 AND 7 AND z + dz BETWEEN 1 AND 7) GROUP BY ALL", "voxels")
def j03(spark, sf_dir):
    return voxel.dilate(cells(spark, sf_dir, 1), 1, LO, HI).groupBy("patient", "visit").agg(F.count(F.lit(1)).alias("n"))


@query("j04_erosion", f"WITH c AS (SELECT patient, visit, x, y, z FROM solids), {ERODED} SELECT * FROM e", "solids")
def j04(spark, sf_dir):
    return voxel.erode(frame(spark, sf_dir, "solids"))


@query("j05_surface", f"WITH c AS (SELECT patient, visit, x, y, z FROM solids), {ERODED} SELECT patient, visit, count(*) AS n FROM (SELECT * FROM c EXCEPT SELECT * FROM e) GROUP BY ALL", "solids")
def j05(spark, sf_dir):
    return voxel.surface(frame(spark, sf_dir, "solids")).groupBy("patient", "visit").agg(F.count(F.lit(1)).alias("n"))


GROWTH = f"""WITH {ONE}, vp AS (SELECT patient, visit, lag(visit) OVER (PARTITION BY patient ORDER BY visit) AS previous FROM (SELECT DISTINCT patient, visit FROM c)),
s AS (SELECT patient, visit, previous, (SELECT count(*) FROM c WHERE c.patient = vp.patient AND c.visit = vp.visit) AS a, (SELECT count(*) FROM c WHERE c.patient = vp.patient AND c.visit = vp.previous) AS b,
  (SELECT count(*) FROM c n JOIN c o USING (patient, x, y, z) WHERE n.patient = vp.patient AND n.visit = vp.visit AND o.visit = vp.previous) AS kept FROM vp WHERE previous IS NOT NULL)"""


@query("c13_kept_gained_lost", f"{GROWTH} SELECT CAST(sum(kept) AS BIGINT) AS kept, CAST(sum(a - kept) AS BIGINT) AS gained, CAST(sum(b - kept) AS BIGINT) AS lost FROM s", "voxels")
def c13(spark, sf_dir):
    return voxel.growth(cells(spark, sf_dir, 1)).agg(*(F.sum(c).alias(c) for c in ("kept", "gained", "lost")))


@query("d29_overlap_measures", f"{GROWTH} SELECT patient, visit, round(100.0 * kept / (a + b - kept), 6) AS jaccard_pct, round(2.0 * kept / (a + b), 6) AS dice FROM s", "voxels")
def d29(spark, sf_dir):
    return voxel.growth(cells(spark, sf_dir, 1)).select("patient", "visit", F.round("jaccard_pct", 6).alias("jaccard_pct"), F.round("dice", 6).alias("dice"))


@query("d29_centroids", "SELECT patient, visit, count(*) AS n, round(avg(x), 6) AS cx, round(avg(y), 6) AS cy, round(avg(z), 6) AS cz FROM voxels WHERE label = 1 GROUP BY ALL", "voxels")
def d29c(spark, sf_dir):
    return voxel.centroids(cells(spark, sf_dir, 1)).select("patient", "visit", "n", *(F.round(c, 6).alias(c) for c in ("cx", "cy", "cz")))


@query("c12_consecutive_visits", "SELECT * FROM (SELECT patient, visit, lag(visit) OVER (PARTITION BY patient ORDER BY visit) AS previous FROM (SELECT DISTINCT patient, visit FROM voxels)) WHERE previous IS NOT NULL", "voxels")
def c12(spark, sf_dir):
    return voxel.visit_pairs(cells(spark, sf_dir))


@query("d30_peak_slice", "WITH s AS (SELECT patient, visit, z, count(*) FILTER (label = 1) AS n FROM voxels GROUP BY ALL) SELECT patient, visit, arg_max(z, n * 1000 - z) AS peak_z, max(n) AS n FROM s GROUP BY ALL", "voxels")
def d30(spark, sf_dir):
    per = cells(spark, sf_dir).groupBy("patient", "visit", "z").agg(F.count(F.when(F.col("label") == 1, 1)).alias("n"))
    return per.groupBy("patient", "visit").agg(F.max_by("z", F.struct("n", -F.col("z"))).alias("peak_z"), F.max("n").alias("n"))


@query("d31_extent_change", "WITH e AS (SELECT patient, visit, min(z) AS z_min, max(z) AS z_max FROM voxels GROUP BY ALL) SELECT *, z_min - lag(z_min) OVER w AS low_moved, z_max - lag(z_max) OVER w AS high_moved FROM e WINDOW w AS (PARTITION BY patient ORDER BY visit)", "voxels")
def d31(spark, sf_dir):
    w = Window.partitionBy("patient").orderBy("visit")
    rows = cells(spark, sf_dir).groupBy("patient", "visit").agg(F.min("z").alias("z_min"), F.max("z").alias("z_max"))
    return rows.withColumns({"low_moved": F.col("z_min") - F.lag("z_min").over(w), "high_moved": F.col("z_max") - F.lag("z_max").over(w)})


@query("g01_symmetric_difference", f"{GROWTH} SELECT patient, visit, (a - kept) + (b - kept) AS n FROM s", "voxels")
def g01(spark, sf_dir):
    return voxel.growth(cells(spark, sf_dir, 1)).select("patient", "visit", (F.col("gained") + F.col("lost")).alias("n"))


@query("g03_label_sets", "SELECT patient, visit, count(*) FILTER (label IN (1)) AS et, count(*) FILTER (label IN (1, 2)) AS tc, count(*) AS wt FROM voxels GROUP BY ALL", "voxels")
def g03(spark, sf_dir):
    sets = {"et": (1,), "tc": (1, 2), "wt": (1, 2, 3)}
    return cells(spark, sf_dir).groupBy("patient", "visit").agg(*(F.count(F.when(F.col("label").isin(*s), 1)).alias(k) for k, s in sets.items()))


@query("j22_outside_lesion", f"WITH {ONE} SELECT v.patient, v.visit, count(*) AS n FROM (SELECT DISTINCT patient, visit, x, y, z FROM voxels) v WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.patient = v.patient AND c.visit = v.visit AND abs(c.x - v.x) <= 1 AND abs(c.y - v.y) <= 1 AND abs(c.z - v.z) <= 1) GROUP BY ALL", "voxels")
def j22(spark, sf_dir):
    near = voxel.dilate(cells(spark, sf_dir, 1), 1, LO, HI)
    return cells(spark, sf_dir).select(*voxel.CELL).distinct().join(near, voxel.CELL, "left_anti").groupBy("patient", "visit").agg(F.count(F.lit(1)).alias("n"))


@query("j27_touching_labels", f"WITH {ONE} SELECT v.label, count(*) AS n FROM voxels v WHERE v.label <> 1 AND EXISTS (SELECT 1 FROM c WHERE c.patient = v.patient AND c.visit = v.visit AND abs(c.x - v.x) <= 1 AND abs(c.y - v.y) <= 1 AND abs(c.z - v.z) <= 1) GROUP BY ALL", "voxels")
def j27(spark, sf_dir):
    near = voxel.dilate(cells(spark, sf_dir, 1), 1, LO, HI)
    return cells(spark, sf_dir, 2, 3).join(near, voxel.CELL, "left_semi").groupBy("label").agg(F.count(F.lit(1)).alias("n"))

"""Further queries: sources and joins, windows, set checks, single-signal rules, voxel distances and transforms."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import cohort, evaluate, order, rule, ruler, timeline, visits, voxel
from ..sources.fixtures import frame, oracle
from . import catalog_rule
from .catalog_cohort import BAND
from .catalog_voxel import FACES, HI, LO, ONE, R6, R26, cells, recursive
from .shared import stash

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None, *views: str):
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = oracle(recursive(sql), *views).replace("WITH ", "WITH RECURSIVE ", 1) if "RECURSIVE" in sql else oracle(sql, *views)
        return fn

    return keep


def scans(spark, sf_dir):
    return frame(spark, sf_dir, "scans")


def by_rn():
    return Window.partitionBy("patient").orderBy("rn")


def earlier():
    return by_rn().rowsBetween(Window.unboundedPreceding, -1)


W = "OVER (PARTITION BY patient ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


@query("a06_surgical_labels", "SELECT patient, count(DISTINCT week) FILTER (rating = 'Pre-Op') AS pre, count(DISTINCT week) FILTER (rating = 'Post-Op') AS post, count(DISTINCT week) AS all_weeks FROM scans WHERE week IS NOT NULL GROUP BY patient", "scans")
def a06(spark, sf_dir):
    rows = timeline.surgical_labels(scans(spark, sf_dir))
    return rows.select("patient", *(F.size(c).cast("long").alias(c) for c in ("pre", "post", "all_weeks")))


@query("b18_flagged_progression", "SELECT s.timepoint FROM scans s JOIN rationale r USING (timepoint) WHERE s.rating = 'PD' AND (contains(lower(r.rationale), 'less than 3 months') OR contains(lower(r.rationale), 'irradiated'))", "scans", "rationale")
def b18(spark, sf_dir):
    told = F.lower("rationale")
    text = frame(spark, sf_dir, "rationale").where(F.contains(told, F.lit("less than 3 months")) | F.contains(told, F.lit("irradiated"))).select("timepoint")
    return scans(spark, sf_dir).where("rating = 'PD'").join(text, "timepoint", "left_semi").select("timepoint")


@query("c05_rated_without_volume", "SELECT patient, timepoint FROM scans WHERE rating IN ('CR', 'PR', 'SD', 'PD') AND timepoint NOT IN (SELECT timepoint FROM methods)", "scans", "methods")
def c05(spark, sf_dir):
    rated = scans(spark, sf_dir).where(F.col("rating").isin(*evaluate.CLASSES))
    return rated.join(frame(spark, sf_dir, "methods").select("timepoint"), "timepoint", "left_anti").select("patient", "timepoint")


@query("c09_first_later_scan", "SELECT s.timepoint, (SELECT min_by(q.timepoint, q.rn) FROM scans q WHERE q.patient = s.patient AND q.rn > s.rn AND q.week - s.week >= 4) AS later FROM scans s", "scans")
def c09(spark, sf_dir):
    rows = scans(spark, sf_dir).withColumn("me", F.when(F.col("week").isNotNull(), F.struct("rn", "timepoint")))
    ahead = F.expr("min(me) OVER (PARTITION BY patient ORDER BY week RANGE BETWEEN 4.0D FOLLOWING AND UNBOUNDED FOLLOWING)")
    return rows.select("timepoint", F.when(F.col("week").isNotNull(), ahead)["timepoint"].alias("later"))


@query("c08_operations_between", f"WITH {catalog_rule.RECORDS}, p AS (SELECT *, last_value(week IGNORE NULLS) {W} AS pw FROM scans) SELECT p.timepoint, min(surg.week) AS operated FROM p JOIN surg ON surg.patient = p.patient AND surg.week > p.pw AND surg.week <= p.week GROUP BY p.timepoint", "scans")
def c08(spark, sf_dir):
    rows = scans(spark, sf_dir).withColumn("pw", F.last("week", ignorenulls=True).over(earlier()))
    surgeries = catalog_rule.records(spark, sf_dir).select("patient", F.explode("surgeries").alias("at"))
    return rows.join(surgeries, "patient").where("at > pw AND at <= week").groupBy("timepoint").agg(F.min("at").alias("operated"))


@query("c11_operations_since_nadir", f"WITH n AS (SELECT *, min(enhancing_mm3) {W} AS nadir FROM scans), k AS (SELECT n.timepoint, n.patient, n.week, (SELECT min_by(q.week, q.rn) FROM scans q WHERE q.patient = n.patient AND q.rn < n.rn AND q.enhancing_mm3 = n.nadir) AS nadir_week FROM n) SELECT k.timepoint, count(DISTINCT s.week) AS postops FROM k JOIN scans s ON s.patient = k.patient AND s.rating = 'Post-Op' AND s.week > nadir_week AND s.week < k.week GROUP BY k.timepoint", "scans")
def c11(spark, sf_dir):
    low = F.min(F.when(F.col("enhancing_mm3").isNotNull(), F.struct("enhancing_mm3", "rn", "week"))).over(earlier())
    rows = scans(spark, sf_dir).select("patient", "timepoint", "week", low["week"].alias("nadir_week"))
    post = scans(spark, sf_dir).where("rating = 'Post-Op' AND week IS NOT NULL").select("patient", F.col("week").alias("at")).distinct()
    return rows.join(post, "patient").where("at > nadir_week AND at < week").groupBy("timepoint").agg(F.countDistinct("at").alias("postops"))


@query("c15_nearest_point", f"WITH {ONE}, vp AS (SELECT patient, visit, lag(visit) OVER (PARTITION BY patient ORDER BY visit) AS previous FROM (SELECT DISTINCT patient, visit FROM c)), k AS (SELECT patient, visit, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz FROM c GROUP BY ALL) SELECT k.patient, k.visit, round(min(sqrt((o.x - cx) ** 2 + (o.y - cy) ** 2 + (o.z - cz) ** 2)), 6) AS distance FROM k JOIN vp USING (patient, visit) JOIN c o ON o.patient = k.patient AND o.visit = previous GROUP BY ALL", "voxels")
def c15(spark, sf_dir):
    own = cells(spark, sf_dir, 1).select(*voxel.CELL).distinct()
    here = voxel.centroids(own).join(voxel.visit_pairs(own), voxel.SCAN)
    old = own.withColumnRenamed("visit", "previous")
    d = F.sqrt(sum((F.pow(F.col(c) - F.col(f"c{c}"), 2) for c in "xyz"), F.lit(0.0)))
    return here.join(old, ["patient", "previous"]).groupBy("patient", "visit").agg(F.round(F.min(d), 6).alias("distance"))


@query("c17_two_methods", "SELECT timepoint, tool_a, enhancing_mm3, rating FROM methods JOIN scans USING (timepoint) WHERE enhancing_mm3 IS NOT NULL", "methods", "scans")
def c17(spark, sf_dir):
    return frame(spark, sf_dir, "methods").join(scans(spark, sf_dir).where("enhancing_mm3 IS NOT NULL"), "timepoint").select("timepoint", "tool_a", "enhancing_mm3", "rating")


@query("d17_deviation_by_size", f"SELECT pp, count(*) AS n, round(quantile_cont(d, 0.9) - quantile_cont(d, 0.1), 6) AS spread FROM (SELECT CAST({BAND} AS DOUBLE) AS pp, 100.0 * (tool_b - tool_a) / tool_a AS d FROM methods JOIN scans USING (timepoint) WHERE tool_a > 0 AND enhancing_mm3 IS NOT NULL) GROUP BY pp HAVING count(*) >= 20", "methods", "scans")
def d17(spark, sf_dir):
    rows = frame(spark, sf_dir, "methods").where("tool_a > 0").join(scans(spark, sf_dir).where("enhancing_mm3 IS NOT NULL"), "timepoint")
    rows = rows.select(scalars.uncertainty_pp(F.col("enhancing_mm3")).alias("pp"), (100.0 * (F.col("tool_b") - F.col("tool_a")) / F.col("tool_a")).alias("d"))
    return order.percentiles(rows, "d", {"p10": 0.1, "p90": 0.9}, "pp").where("n >= 20").select("pp", "n", F.round(F.col("p90") - F.col("p10"), 6).alias("spread"))


@query("d18_availability", "SELECT arm, round(avg((week IS NOT NULL)::INT), 6) AS dated, round(avg((enhancing_mm3 IS NOT NULL)::INT), 6) AS measured, round(avg((rating IS NOT NULL)::INT), 6) AS rated FROM scans GROUP BY arm", "scans")
def d18(spark, sf_dir):
    share = lambda c, n: F.round(F.avg(F.col(c).isNotNull().cast("int")), 6).alias(n)
    return scans(spark, sf_dir).groupBy("arm").agg(share("week", "dated"), share("enhancing_mm3", "measured"), share("rating", "rated"))


@query("d21_pivot_compartments", "SELECT patient, visit, count(*) FILTER (label = 1) AS enhancing, count(*) FILTER (label = 2) AS necrosis, count(*) FILTER (label = 3) AS edema FROM voxels GROUP BY ALL", "voxels")
def d21(spark, sf_dir):
    names = F.element_at(F.array(F.lit("enhancing"), F.lit("necrosis"), F.lit("edema")), F.col("label"))
    return cells(spark, sf_dir).withColumn("c", names).groupBy("patient", "visit").pivot("c", ["enhancing", "necrosis", "edema"]).agg(F.count(F.lit(1))).fillna(0)


AFFINE = [f"a{i}{j}" for i in range(3) for j in range(3)] + ["t0", "t1", "t2"]  # the last row of an affine is 0 0 0 1


@query("d26_grid_consistency", f"WITH r AS (SELECT * FROM geometry ORDER BY patient, role LIMIT 1) SELECT g.patient, g.role, g.nx <> r.nx OR g.ny <> r.ny OR g.nz <> r.nz AS other_shape, round(greatest({', '.join(f'abs(g.{a}::DOUBLE - r.{a}::DOUBLE)' for a in AFFINE)}), 6) AS most FROM geometry g, r WHERE other_shape OR most > 1e-4", "geometry")
def d26(spark, sf_dir):
    """Grids that differ from the first one in shape or in any entry of the affine."""
    grids = frame(spark, sf_dir, "geometry")
    first = grids.agg(F.min_by(F.struct("nx", "ny", "nz", *AFFINE), F.struct("patient", "role")).alias("r"))
    rows = grids.crossJoin(F.broadcast(first)).withColumn("most", F.round(F.greatest(*(F.abs(F.col(a).cast("double") - F.col(f"r.{a}").cast("double")) for a in AFFINE)), 6))
    rows = rows.withColumn("other_shape", (F.col("nx") != F.col("r.nx")) | (F.col("ny") != F.col("r.ny")) | (F.col("nz") != F.col("r.nz")))
    return rows.where("other_shape OR most > 1e-4").select("patient", "role", "other_shape", "most")


@query("d28_label_set_check", "SELECT patient, visit, len(list_filter(list(DISTINCT label), lambda l: l NOT IN (1, 2))) AS undocumented FROM voxels GROUP BY ALL", "voxels")
def d28(spark, sf_dir):
    return cells(spark, sf_dir).groupBy("patient", "visit").agg(F.size(F.array_except(F.collect_set("label"), F.array(F.lit(1), F.lit(2)))).cast("long").alias("undocumented"))


@query("d32_median_volumes", "SELECT rating, median(enhancing_mm3) AS enhancing, median(necrosis_mm3) AS necrosis, median(t2_flair_mm3) AS t2 FROM scans WHERE rating IS NOT NULL GROUP BY rating", "scans")
def d32(spark, sf_dir):
    rows = scans(spark, sf_dir).where("rating IS NOT NULL")
    return order.medians(stash(rows), {"enhancing": "enhancing_mm3", "necrosis": "necrosis_mm3", "t2": "t2_flair_mm3"}, "rating")


@query("d35_missed_progression_reasons", f"WITH {catalog_rule.CALLS}, {catalog_rule.PAIRS} SELECT count(*) AS missed, count(*) FILTER (contains(lower(rationale), 'new')) AS new_lesion, count(*) FILTER (contains(lower(rationale), 't2')) AS t2 FROM pairs JOIN rationale USING (timepoint) WHERE profile = 'mrano_volumetric' AND expert = 'PD' AND predicted <> 'PD'", "scans", "rationale")
def d35(spark, sf_dir):
    rows = evaluate.scorable(catalog_rule.rule_calls(spark, sf_dir, [rule.profile("mrano_volumetric")])).where("expert = 'PD' AND predicted <> 'PD'").join(frame(spark, sf_dir, "rationale").select("timepoint", F.lower("rationale").alias("t")), "timepoint")
    return rows.agg(F.count(F.lit(1)).alias("missed"), F.count(F.when(F.contains("t", F.lit("new")), 1)).alias("new_lesion"), F.count(F.when(F.contains("t", F.lit("t2")), 1)).alias("t2"))


@query("e01_chronological_order", "SELECT timepoint, CAST(row_number() OVER (PARTITION BY patient ORDER BY week NULLS LAST, timepoint) AS INTEGER) AS place FROM scans", "scans")
def e01(spark, sf_dir):
    return timeline.chronological(scans(spark, sf_dir).drop("rn")).select("timepoint", F.col("rn").alias("place"))


@query("e02_running_nadir", f"SELECT timepoint, min(enhancing_mm3) {W} AS nadir, min(t2_flair_mm3) {W} AS t2_nadir, last_value(week IGNORE NULLS) {W} AS previous_week FROM scans", "scans")
def e02(spark, sf_dir):
    return scans(spark, sf_dir).select("timepoint", F.min("enhancing_mm3").over(earlier()).alias("nadir"), F.min("t2_flair_mm3").over(earlier()).alias("t2_nadir"), F.last("week", ignorenulls=True).over(earlier()).alias("previous_week"))


@query("e06_segments", f"WITH {catalog_rule.CALLS} SELECT timepoint, CAST(sum(CASE WHEN call = 'BASELINE' AND n > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY patient ORDER BY n) AS BIGINT) AS segment FROM (SELECT * FROM calls WHERE profile = 'mrano_volumetric')", "scans")
def e06(spark, sf_dir):
    return rule.references(catalog_rule.rule_inputs(spark, sf_dir), True).select("timepoint", "segment")


@query("e10_change_since_last", "SELECT timepoint, round(CASE WHEN p > 0 THEN 100 * (enhancing_mm3 - p) / p END, 6) AS pct FROM (SELECT *, lag(enhancing_mm3) OVER (PARTITION BY patient ORDER BY rn) AS p FROM scans)", "scans")
def e10(spark, sf_dir):
    rows = scans(spark, sf_dir).withColumn("p", F.lag("enhancing_mm3").over(by_rn()))
    return rows.select("timepoint", F.round(F.when(F.col("p") > 0, 100 * (F.col("enhancing_mm3") - F.col("p")) / F.col("p")), 6).alias("pct"))


@query("e16_average_ranks", "SELECT timepoint, rank() OVER (PARTITION BY patient ORDER BY enhancing_mm3) + (count(*) OVER (PARTITION BY patient, enhancing_mm3) - 1) / 2.0 AS place FROM scans WHERE enhancing_mm3 IS NOT NULL", "scans")
def e16(spark, sf_dir):
    rows = scans(spark, sf_dir).where("enhancing_mm3 IS NOT NULL")
    return rows.select("timepoint", cohort.average_rank(F.col("enhancing_mm3"), "patient").alias("place"))


POSTOP = f"p AS (SELECT *, last_value(CASE WHEN rating = 'Post-Op' THEN enhancing_mm3 END IGNORE NULLS) OVER (PARTITION BY patient ORDER BY rn) AS base, min(enhancing_mm3) {W} AS low FROM scans)"


@query("i13_last_postop_rule", f"WITH {POSTOP}, q AS (SELECT *, least(base, low) AS nadir FROM p) SELECT timepoint, CASE WHEN base IS NULL OR enhancing_mm3 IS NULL OR rating = 'Post-Op' THEN NULL WHEN enhancing_mm3 = 0 THEN 'CR' WHEN nadir > 0 AND enhancing_mm3 >= 1.4 * nadir THEN 'PD' WHEN base > 0 AND enhancing_mm3 <= 0.35 * base THEN 'PR' ELSE 'SD' END AS call FROM q", "scans")
def i13(spark, sf_dir):
    rows = scans(spark, sf_dir).withColumns({"base": F.last(F.when(F.col("rating") == "Post-Op", F.col("enhancing_mm3")), ignorenulls=True).over(by_rn().rowsBetween(Window.unboundedPreceding, 0)), "low": F.min("enhancing_mm3").over(earlier())})
    rows = rows.withColumn("nadir", F.least("base", "low"))
    v = F.col("enhancing_mm3")
    call = F.when(F.col("base").isNull() | v.isNull() | F.col("rating").eqNullSafe("Post-Op"), None).when(v == 0, "CR").when((F.col("nadir") > 0) & (v >= 1.4 * F.col("nadir")), "PD").when((F.col("base") > 0) & (v <= 0.35 * F.col("base")), "PR").otherwise("SD")
    return rows.select("timepoint", call.alias("call"))


@query("f02_top_patients", "SELECT patient, count(*) AS n FROM scans GROUP BY patient ORDER BY n DESC, patient LIMIT 9", "scans")
def f02(spark, sf_dir):
    return scans(spark, sf_dir).groupBy("patient").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "patient").limit(9)


@query("g02_key_sets", "SELECT (SELECT count(*) FROM (SELECT timepoint FROM scans WHERE week IS NOT NULL INTERSECT SELECT timepoint FROM methods)) AS both_n, (SELECT count(*) FROM (SELECT timepoint FROM scans WHERE week IS NOT NULL EXCEPT SELECT timepoint FROM methods)) AS only_dated", "scans", "methods")
def g02(spark, sf_dir):
    dated, measured = scans(spark, sf_dir).where("week IS NOT NULL").select("timepoint"), frame(spark, sf_dir, "methods").select("timepoint")
    one = lambda rows, n: rows.agg(F.count(F.lit(1)).alias(n))
    return one(dated.intersect(measured), "both_n").crossJoin(one(dated.exceptAll(measured), "only_dated"))


@query("j02_size_floor", f"WITH {R26} SELECT t AS floor, count(*) AS lesions FROM (SELECT patient, visit, root, count(*) AS n FROM roots GROUP BY ALL), (SELECT unnest([1, 5, 20]) AS t) WHERE n >= t GROUP BY t", "voxels")
def j02(spark, sf_dir):
    sizes = voxel.label_components(cells(spark, sf_dir, 1)).groupBy("patient", "visit", "root").agg(F.count(F.lit(1)).alias("n"))
    floors = spark.createDataFrame([(1,), (5,), (20,)], "floor int")
    return sizes.crossJoin(F.broadcast(floors)).where("n >= floor").groupBy("floor").agg(F.count(F.lit(1)).alias("lesions"))


@query("j07_caliper", f"WITH {R26}, kk AS (SELECT k.*, root FROM k JOIN roots USING (patient, visit, cell)), p AS (SELECT DISTINCT patient, visit, root, x + i AS x, y + j AS y, z + l AS z FROM kk, (SELECT unnest([0, 1]) AS i), (SELECT unnest([0, 1]) AS j), (SELECT unnest([0, 1]) AS l)) SELECT a.patient, a.visit, a.root, round(max(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2)), 6) AS caliper FROM p a JOIN p b USING (patient, visit, root) GROUP BY ALL", "voxels")
def j07(spark, sf_dir):
    return ruler.calipers(cells(spark, sf_dir, 1)).withColumn("caliper", F.round("caliper", 6))


@query("j26_pieces_by_connectivity", f"WITH {R6} SELECT patient, visit, count(DISTINCT root) AS pieces FROM roots GROUP BY ALL", "voxels")
def j26(spark, sf_dir):
    return voxel.label_components(cells(spark, sf_dir, 1), voxel.HALF_6).groupBy("patient", "visit").agg(F.countDistinct("root").alias("pieces"))


@query("j15_new_focus_cells", f"WITH {ONE}, vp AS (SELECT patient, visit, lag(visit) OVER (PARTITION BY patient ORDER BY visit) AS previous FROM (SELECT DISTINCT patient, visit FROM c)) SELECT c.patient, c.visit, count(*) AS n FROM c JOIN vp USING (patient, visit) WHERE previous IS NOT NULL AND NOT EXISTS (SELECT 1 FROM c o WHERE o.patient = c.patient AND o.visit = previous AND abs(o.x - c.x) <= 3 AND abs(o.y - c.y) <= 3 AND abs(o.z - c.z) <= 3) GROUP BY ALL", "voxels")
def j15(spark, sf_dir):
    """Cells more than three cube steps from the visit before, from one distance field a pair."""
    rows = visits.overlap_within(cells(spark, sf_dir, 1), (3,))
    return rows.select("patient", "visit", (F.col("n") - F.col("near")).alias("n")).where("n > 0")


@query("j19_translation", f"WITH {ONE}, k AS (SELECT patient, visit, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz FROM c GROUP BY ALL) SELECT patient, visit, round(cx - lag(cx) OVER w, 6) AS dx, round(cy - lag(cy) OVER w, 6) AS dy, round(cz - lag(cz) OVER w, 6) AS dz FROM k WINDOW w AS (PARTITION BY patient ORDER BY visit)", "voxels")
def j19(spark, sf_dir):
    w = Window.partitionBy("patient").orderBy("visit")
    rows = voxel.centroids(cells(spark, sf_dir, 1))
    return rows.select("patient", "visit", *(F.round(F.col(f"c{c}") - F.lag(f"c{c}").over(w), 6).alias(f"d{c}") for c in "xyz"))


#: A solid is a box A, on visit 2 also a box B and in some a neck of single voxels between them: pieces by number of erosions in closed form.
#: Where the neck meets a B of two layers, it gives one cell of B its sixth neighbour.
PIECES = """WITH k AS (SELECT patient, visit, 2 + patient % 3 + visit AS a1, 2 + patient % 5 AS a2, 2 + patient % 4 AS a3, visit = 2 AND patient % 4 <> 3 AS has_b, visit = 2 AND patient % 4 <> 3 AND patient % 5 = 0 AS neck,
  1 + patient % 4 AS b1, 3 + patient % 2 AS b2, 3 + patient % 3 AS b3 FROM (SELECT DISTINCT patient, visit FROM solids)), s AS (SELECT unnest([0, 1, 2]) AS steps)"""


@query("j25_erosion_steps", f"{PIECES} SELECT patient, visit, CAST(steps AS INTEGER) AS steps, CASE WHEN steps = 0 THEN CASE WHEN has_b AND NOT neck THEN 2 ELSE 1 END ELSE (least(a1, a2, a3) > 2 * steps)::INT + (has_b AND (least(b1, b2, b3) > 2 * steps OR (neck AND b1 = 2 AND steps = 1)))::INT END AS pieces FROM k, s", "solids")
def j25(spark, sf_dir):
    """Components of each scan after no, one and two erosions; scans that vanish have 0."""
    own = frame(spark, sf_dir, "solids").select(*voxel.CELL)
    every, out = own.select(*voxel.SCAN).distinct(), None
    for steps in range(3):
        pieces = voxel.label_components(own).groupBy(*voxel.SCAN).agg(F.countDistinct("root").alias("pieces"))
        part = every.join(pieces, voxel.SCAN, "left").select(*voxel.SCAN, F.lit(steps).alias("steps"), F.coalesce("pieces", F.lit(0)).alias("pieces"))
        out = part if out is None else out.union(part)
        own = voxel.erode(own)
    return out


@query("j15_new_foci", """SELECT patient, 1 + patient % 4 AS width, (1 + patient % 4) * (3 + patient % 2) * (3 + patient % 3) + CASE WHEN patient % 5 = 0 THEN 3 - patient % 3 ELSE 0 END AS n
FROM (SELECT DISTINCT patient FROM solids) WHERE (patient % 4 = 2 OR (patient % 4 = 1 AND patient % 5 = 0)) AND (1 + patient % 4) * (3 + patient % 2) * (3 + patient % 3) + CASE WHEN patient % 5 = 0 THEN 3 - patient % 3 ELSE 0 END >= 20""", "solids")
def j15_foci(spark, sf_dir):
    """New foci: gained more than 3 cells from the visit before, 20 cells or more, with a cell that survives one erosion."""
    own = frame(spark, sf_dir, "solids")
    found = voxel.new_foci(own, slack=3, floor=20, lo=(1, 1, 1), hi=(14, 7, 7))
    return found.select("patient", (F.col("patient") % 4 + 1).alias("width"), "n")


@query("j18_rigid_resample", """WITH g AS (SELECT patient, visit, x, y, z, (patient % 5 - 2) * 0.11 AS ax, (patient % 3 - 1) * 0.13 AS ay, (visit % 4 - 1) * 0.17 AS az, visit % 3 - 1 AS t
  FROM (SELECT DISTINCT patient, visit FROM voxels), range(0, 8) a(x), range(0, 8) b(y), range(1, 8) c(z)),
r AS (SELECT *, cos(az) * cos(ay) - sin(az) * sin(ax) * sin(ay) AS m00, -sin(az) * cos(ax) AS m01, cos(az) * sin(ay) + sin(az) * sin(ax) * cos(ay) AS m02,
  sin(az) * cos(ay) + cos(az) * sin(ax) * sin(ay) AS m10, cos(az) * cos(ax) AS m11, sin(az) * sin(ay) - cos(az) * sin(ax) * cos(ay) AS m12,
  -cos(ax) * sin(ay) AS m20, sin(ax) AS m21, cos(ax) * cos(ay) AS m22 FROM g),
m AS (SELECT patient, visit, CAST(round(m00 * (x - 3.7) + m01 * (y - 4.1) + m02 * (z - 3.9) + 3.7 + t) AS INTEGER) AS mx, CAST(round(m10 * (x - 3.7) + m11 * (y - 4.1) + m12 * (z - 3.9) + 4.1 + t) AS INTEGER) AS my,
  CAST(round(m20 * (x - 3.7) + m21 * (y - 4.1) + m22 * (z - 3.9) + 3.9 + t) AS INTEGER) AS mz FROM r)
SELECT m.patient, m.visit, v.label, count(*) AS n FROM m JOIN voxels v ON v.patient = m.patient AND v.visit = m.visit AND v.x = mx AND v.y = my AND v.z = mz GROUP BY ALL""", "voxels")
def j18(spark, sf_dir):
    """All three angles; the SQL has the product of the three rotations Z X Y written out."""
    shift = (F.col("visit") % 3 - 1).cast("double")
    turns = cells(spark, sf_dir).select(*voxel.SCAN).distinct().withColumns(
        {"rx": (F.col("patient") % 5 - 2) * 0.11, "ry": (F.col("patient") % 3 - 1) * 0.13, "rz": (F.col("visit") % 4 - 1) * 0.17, "tx": shift, "ty": shift, "tz": shift, "cx": F.lit(3.7), "cy": F.lit(4.1), "cz": F.lit(3.9)})
    return voxel.resampled(cells(spark, sf_dir), turns, LO, HI).groupBy("patient", "visit", "label").agg(F.count(F.lit(1)).alias("n"))


@query("c04_enriched_calls", f"WITH {catalog_rule.CALLS} SELECT c.profile, c.patient, c.timepoint, c.call, s.rating AS expert, coalesce(s.arm, 'unassigned') AS arm FROM (SELECT profile, patient, timepoint, call FROM calls) c LEFT JOIN scans s ON s.timepoint = c.timepoint", "scans")
def c04(spark, sf_dir):
    calls = catalog_rule.rule_calls(spark, sf_dir).select("profile", "patient", "timepoint", "call")
    expert = scans(spark, sf_dir).select("timepoint", F.col("rating").alias("expert"), "arm")
    return calls.join(expert, "timepoint", "left").withColumn("arm", F.coalesce("arm", F.lit("unassigned"))).select("profile", "patient", "timepoint", "call", "expert", "arm")


@query("d24_threshold_scoreboard", f"WITH p AS (SELECT *, lag(enhancing_mm3) OVER (PARTITION BY patient ORDER BY rn) AS before FROM scans), t AS (SELECT unnest([100, 500, 1000]) AS threshold) SELECT threshold, count(*) FILTER (new_lesion AND enhancing_mm3 - before >= threshold) AS tp, count(*) FILTER (NOT new_lesion AND enhancing_mm3 - before >= threshold) AS fp, count(*) FILTER (new_lesion AND enhancing_mm3 - before < threshold) AS fn, count(*) FILTER (NOT new_lesion AND enhancing_mm3 - before < threshold) AS tn FROM p, t GROUP BY threshold", "scans")
def d24(spark, sf_dir):
    rows = scans(spark, sf_dir).withColumn("gain", F.col("enhancing_mm3") - F.lag("enhancing_mm3").over(by_rn()))
    rows = rows.crossJoin(F.broadcast(spark.createDataFrame([(100,), (500,), (1000,)], "threshold int")))
    hit, new = F.col("gain") >= F.col("threshold"), F.col("new_lesion")
    return rows.groupBy("threshold").agg(*(F.count(F.when(c, 1)).alias(k) for k, c in (("tp", new & hit), ("fp", ~new & hit), ("fn", new & ~hit), ("tn", ~new & ~hit))))


@query("e18_first_postop_removed", "WITH f AS (SELECT patient, min(rn) AS first_rn FROM scans WHERE rating = 'Post-Op' GROUP BY patient) SELECT s.patient, s.timepoint FROM scans s JOIN f USING (patient) WHERE rn <> first_rn AND rating IS DISTINCT FROM 'Pre-Op'", "scans")
def e18(spark, sf_dir):
    rows = scans(spark, sf_dir).withColumn("first_rn", F.min(F.when(F.col("rating") == "Post-Op", F.col("rn"))).over(Window.partitionBy("patient")))
    return rows.where((F.col("rn") != F.col("first_rn")) & ~F.col("rating").eqNullSafe("Pre-Op")).select("patient", "timepoint")


@query("l07_audit_warnings", "WITH v AS (SELECT patient, bool_or(label = 1) AS has1, bool_or(label NOT IN (1, 2)) AS odd FROM voxels GROUP BY patient) SELECT c_patient AS patient, warning FROM (SELECT g.patient AS c_patient, unnest(list_filter([CASE WHEN v.patient IS NULL THEN 'no mask' END, CASE WHEN NOT has1 THEN 'no enhancing label' END, CASE WHEN odd THEN 'label without meaning' END], lambda x: x IS NOT NULL)) AS warning FROM (SELECT DISTINCT patient FROM geometry) g LEFT JOIN v USING (patient))", "geometry", "voxels")
def l07(spark, sf_dir):
    have = cells(spark, sf_dir).groupBy("patient").agg(F.bool_or(F.col("label") == 1).alias("has1"), F.bool_or(~F.col("label").isin(1, 2)).alias("odd"), F.lit(True).alias("mask"))
    rows = frame(spark, sf_dir, "geometry").select("patient").distinct().join(have, "patient", "left")
    found = F.array(F.when(F.col("mask").isNull(), "no mask"), F.when(~F.col("has1"), "no enhancing label"), F.when(F.col("odd"), "label without meaning"))
    return rows.select("patient", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("warning"))


@query("j21_fit_acceptance", f"""WITH {ONE}, vp AS (SELECT patient, visit, lag(visit) OVER (PARTITION BY patient ORDER BY visit) AS previous FROM (SELECT DISTINCT patient, visit FROM c)),
n AS (SELECT patient, visit, count(*) AS n FROM c GROUP BY ALL), m AS (SELECT c.patient, c.visit, previous, o.x - c.x AS dx, o.y - c.y AS dy, o.z - c.z AS dz, count(*) AS k FROM c JOIN vp USING (patient, visit) JOIN c o ON o.patient = c.patient AND o.visit = previous AND abs(o.x - c.x) <= 1 AND abs(o.y - c.y) <= 1 AND abs(o.z - c.z) <= 1 GROUP BY ALL),
j AS (SELECT m.patient, m.visit, max(100.0 * k / (a.n + b.n - k)) AS best, coalesce(max(100.0 * k / (a.n + b.n - k)) FILTER (dx = 0 AND dy = 0 AND dz = 0), 0) AS still FROM m JOIN n a ON a.patient = m.patient AND a.visit = m.visit JOIN n b ON b.patient = m.patient AND b.visit = m.previous GROUP BY ALL)
SELECT patient, visit, CASE WHEN best >= still + 1 THEN 'shifted' WHEN still > 0 THEN 'kept' ELSE 'rejected' END AS status FROM j""", "voxels")
def j21(spark, sf_dir):
    own = cells(spark, sf_dir, 1)
    best = voxel.best_shift(own, 1).select("patient", "visit", F.col("jaccard_pct").alias("best"))
    still = voxel.growth(own).select("patient", "visit", F.col("jaccard_pct").alias("still"))
    status = F.when(F.col("best") >= F.col("still") + 1, "shifted").when(F.col("still") > 0, "kept").otherwise("rejected")
    return best.join(still, ["patient", "visit"]).select("patient", "visit", status.alias("status"))

"""Queries of the data contract, the baseline after radiotherapy, adjudication and the reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rationale, scalars
from ..operators import contract, evaluate, order, rule, timeline, validate, visits, voxel
from ..sources.fixtures import frame, oracle
from . import catalog_rule
from .catalog_cohort import S
from .catalog_text import LABELLED, SHOWN
from .catalog_voxel import DET, HI, LO, ONE, R26, ROOTS, cells, recursive
from .shared import stash

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
#: Weeks after the first scan at which the cohort's radiotherapy ends, for patients whose own course is unknown.
COHORT_END = 10.0
DEFAULT = rule.profile("mrano_volumetric")


def query(name: str, sql: str, *views: str):
    def keep(fn):
        QUERIES[name] = fn
        made = oracle(recursive(sql), *views)
        ORACLE[name] = made.replace("WITH ", "WITH RECURSIVE ", 1) if "RECURSIVE " in sql else made
        return fn

    return keep


def scans(spark, sf_dir: str) -> DataFrame:
    return frame(spark, sf_dir, "scans")


# --- checks and the contract

ITEMS = """g AS (SELECT patient, timepoint, has_ct1, has_flair, count(label) AS n_labels, bool_or(label NOT IN (1, 2, 3)) AS odd FROM scan_items GROUP BY ALL),
h AS (SELECT g.*, s.rating, s.enhancing_mm3 FROM g JOIN (SELECT timepoint, rating, enhancing_mm3 FROM scans) s USING (timepoint)),
checks AS (SELECT patient, timepoint, 'modalities_present' AS code, CASE WHEN has_ct1 AND has_flair THEN 'pass' ELSE 'fail' END AS status FROM h
  UNION ALL SELECT patient, timepoint, 'mask_present', CASE WHEN n_labels > 0 THEN 'pass' ELSE 'fail' END FROM h
  UNION ALL SELECT patient, timepoint, 'label_schema_valid', CASE WHEN odd THEN 'fail' ELSE 'pass' END FROM h WHERE n_labels > 0
  UNION ALL SELECT patient, timepoint, 'expert_rating_present', CASE WHEN rating IN ('CR', 'PR', 'SD', 'PD') THEN 'pass' ELSE 'warn' END FROM h WHERE n_labels > 0 AND NOT odd),
ready AS (SELECT patient, timepoint, CASE WHEN bool_or(status = 'fail' AND code <> 'modalities_present') THEN 'unusable' WHEN bool_or(status <> 'pass') THEN 'needs_attention' ELSE 'usable' END AS readiness,
  string_agg(concat(code, ':', status), ',' ORDER BY concat(code, ':', status)) AS checks FROM checks GROUP BY ALL)"""
BAND = "CAST(CASE WHEN {v} >= 60000 THEN 1.5 WHEN {v} >= 20000 THEN 2.8 WHEN {v} >= 5000 THEN 5.3 WHEN {v} >= 1000 THEN 14.8 WHEN {v} >= 0 THEN 36.6 END AS DOUBLE)"


def items(spark, sf_dir: str) -> DataFrame:
    rows = frame(spark, sf_dir, "scan_items").groupBy("patient", "timepoint", "has_ct1", "has_flair").agg(F.collect_set("label").alias("labels"))
    return rows.join(scans(spark, sf_dir).select("timepoint", "rating", "enhancing_mm3"), "timepoint")


@query("l03_scan_checks", f"WITH {ITEMS} SELECT * FROM checks", "scans", "scan_items")
def l03(spark, sf_dir):
    return contract.scan_checks(items(spark, sf_dir))


@query("b16_readiness", f"WITH {ITEMS} SELECT timepoint, readiness, checks FROM ready", "scans", "scan_items")
def b16(spark, sf_dir):
    return contract.scan_readiness(contract.scan_checks(items(spark, sf_dir))).select("timepoint", "readiness", "checks")


CONTRACT = f"""{ITEMS}, contract AS (SELECT r.patient, r.timepoint, readiness, checks, rating, readiness <> 'unusable' AND coalesce(rating IN ('CR', 'PR', 'SD', 'PD'), FALSE) AS assessable,
  CASE WHEN readiness <> 'unusable' THEN round(enhancing_mm3, 2) END AS enhancing_mm3, CASE WHEN readiness <> 'unusable' THEN {BAND.format(v="enhancing_mm3")} END AS uncertainty_pp FROM ready r JOIN h USING (timepoint))"""


@query("l04_contract_scans", f"WITH {CONTRACT} SELECT * FROM contract", "scans", "scan_items")
def l04(spark, sf_dir):
    return contract.contract(items(spark, sf_dir))


@query("l04_contract_patients", f"WITH {CONTRACT} SELECT patient, count(*) AS n_scans, count(*) FILTER (readiness <> 'unusable') AS n_usable, count(*) FILTER (assessable) AS n_assessable, count(*) FILTER (assessable) >= 2 AS ready FROM contract GROUP BY patient", "scans", "scan_items")
def l04_patients(spark, sf_dir):
    rows = contract.patient_contracts(contract.contract(items(spark, sf_dir)))
    return rows.select("patient", F.size("scans").cast("long").alias("n_scans"), F.col("n_usable").cast("long").alias("n_usable"), F.col("n_assessable").cast("long").alias("n_assessable"), "ready")


CODE = " || ".join("CASE " + " ".join(f"WHEN abs(a{i}{j}) = greatest(abs(a0{j}), abs(a1{j}), abs(a2{j})) THEN CASE WHEN a{i}{j} >= 0 THEN '{p}' ELSE '{m}' END" for i, (p, m) in enumerate(("RL", "AP", "SI"))) + " END" for j in range(3))


@query(
    "d38_image_inventory",
    f"""SELECT patient, role, concat(nx, 'x', ny, 'x', nz) AS shape, round({S[0]}, 4) AS s0, round({S[1]}, 4) AS s1, round({S[2]}, 4) AS s2,
    round(greatest({', '.join(S)}) / least({', '.join(S)}), 4) AS anisotropy, round({DET}, 6) AS voxel_mm3, {CODE} AS orientation FROM geometry""",
    "geometry",
)
def d38(spark, sf_dir):
    rows = validate.geometry(frame(spark, sf_dir, "geometry"))
    return rows.select("patient", "role", F.concat_ws("x", "nx", "ny", "nz").alias("shape"), *(F.round(f"s{i}", 4).alias(f"s{i}") for i in range(3)), F.round("anisotropy", 4).alias("anisotropy"), F.round("voxel_mm3", 6).alias("voxel_mm3"), contract.orientation(scalars.affine()).alias("orientation"))


@query(
    "d06_tidy_volumes",
    f"""SELECT v.patient, v.visit, role AS space, CASE label WHEN 1 THEN 'enhancing' WHEN 2 THEN 'necrosis_nonenhancing' ELSE 'edema' END AS compartment, count(*) AS voxels, round(count(*) * max({DET}), 6) AS volume_mm3
    FROM voxels v JOIN geometry g ON g.patient = v.patient GROUP BY v.patient, v.visit, role, label""",
    "voxels", "geometry",
)
def d06(spark, sf_dir):
    """One row for each scan, grid and compartment."""
    counts = cells(spark, sf_dir).groupBy("patient", "visit", "label").agg(F.count(F.lit(1)).alias("voxels"))
    grids = frame(spark, sf_dir, "geometry").select("patient", F.col("role").alias("space"), scalars.voxel_volume(scalars.affine()).alias("unit"))
    name = F.element_at(F.array(F.lit("enhancing"), F.lit("necrosis_nonenhancing"), F.lit("edema")), F.col("label"))
    return counts.join(grids, "patient").select("patient", "visit", "space", name.alias("compartment"), "voxels", F.round(F.col("voxels") * F.col("unit"), 6).alias("volume_mm3"))


# --- treatment, and the baseline after radiotherapy

@query(
    "g04_assumptions",
    f"""WITH {catalog_rule.RECORDS} SELECT patient, CASE WHEN contradicted OR n_surgeries = 0 THEN '' ELSE concat('{contract.ASSUMED["surgery"]}; {contract.ASSUMED["rt_start"]}; {contract.ASSUMED["rt_end"]}') END AS assumptions FROM rec""",
    "scans",
)
def g04(spark, sf_dir):
    return contract.assumptions(catalog_rule.records(spark, sf_dir)).select("patient", F.array_join("assumptions", "; ").alias("assumptions"))


LATER = f"""kept AS (SELECT *, row_number() OVER (PARTITION BY patient ORDER BY week NULLS LAST, timepoint) AS place FROM scans WHERE rating IS DISTINCT FROM 'Pre-Op'),
staged AS (SELECT kept.*, CASE WHEN contradicted THEN NULL ELSE first_week + 10.0 END AS rt_end,
  coalesce(NOT contradicted AND kept.week - first_week - 10 >= 4 AND NOT coalesce((SELECT max(q.week) FROM surg q WHERE q.patient = kept.patient AND q.week <= kept.week) > first_week + 10, FALSE), FALSE) AS eligible
  FROM kept LEFT JOIN rec ON rec.patient = kept.patient),
post_rt AS (SELECT * EXCLUDE (weeks_since_rt), week - coalesce(rt_end, {COHORT_END}) AS weeks_since_rt FROM (SELECT *, min(CASE WHEN eligible THEN place END) OVER (PARTITION BY patient) AS begin_at FROM staged) WHERE place >= begin_at)"""


def later_scans(spark, sf_dir: str) -> DataFrame:
    rows = scans(spark, sf_dir)
    return timeline.scans_after_radiotherapy(rows, catalog_rule.records(spark, sf_dir, rows), COHORT_END)


@query("i09_scans_after_radiotherapy", f"WITH {catalog_rule.RECORDS}, {LATER} SELECT patient, timepoint, weeks_since_rt, CAST(place - begin_at + 1 AS INTEGER) AS rn FROM post_rt", "scans")
def i09(spark, sf_dir):
    return later_scans(spark, sf_dir).select("patient", "timepoint", "weeks_since_rt", "rn")


@query(
    "d37_baseline_mix",
    f"""WITH {catalog_rule.RECORDS}, {LATER} SELECT count(*) AS baselines, count(*) FILTER (weeks_since_rt > 5) AS late, count(*) FILTER (rating IS NULL) AS unrated,
    count(*) FILTER (rating = 'CR') AS cr, count(*) FILTER (rating = 'PR') AS pr, count(*) FILTER (rating = 'SD') AS sd, count(*) FILTER (rating = 'PD') AS pd FROM post_rt WHERE place = begin_at""",
    "scans",
)
def d37(spark, sf_dir):
    rows = later_scans(spark, sf_dir).where("rn = 1")
    count = lambda c, n: F.count(F.when(c, 1)).alias(n)
    return rows.agg(F.count(F.lit(1)).alias("baselines"), count(F.col("weeks_since_rt") > 5, "late"), count(F.col("rating").isNull(), "unrated"), *(count(F.col("rating") == c, c.lower()) for c in evaluate.CLASSES))


MARKS = "driver = 'confirmation' AND provisional = 'PD' AS soft, driver = 'confirmation' AND coalesce(provisional IN ('CR', 'PR'), FALSE) AS refuted, driver = 'reference' AND call = 'SD' AS gated"


@query(
    "b17_mechanisms",
    f"""WITH {catalog_rule.RECORDS}, {LATER}, old AS (SELECT timepoint, call, {MARKS} FROM ({catalog_rule.rule_sql(DEFAULT)})),
    new AS (SELECT timepoint, call, {MARKS} FROM ({catalog_rule.rule_sql(DEFAULT).replace("FROM scans WHERE rating IS DISTINCT FROM 'Pre-Op'", "FROM post_rt")}))
    SELECT timepoint, old.call AS before, new.call AS after, CASE WHEN coalesce(old.soft, FALSE) <> coalesce(new.soft, FALSE) THEN 'pseudoprogression window moved' WHEN old.gated <> new.gated THEN 'measurable gate on a different reference'
      WHEN old.refuted <> new.refuted THEN 'confirmation outcome changed' ELSE 'baseline/nadir moved' END AS mechanism
    FROM old JOIN new USING (timepoint) WHERE old.call IN ('CR','PR','SD','PD') AND new.call IN ('CR','PR','SD','PD') AND old.call <> new.call""",
    "scans",
)
def b17(spark, sf_dir):
    """Why a call changes when the reference is the first scan after radiotherapy."""
    def run(rows: DataFrame) -> DataFrame:
        calls = rule.trajectories(rows, rule.profiles(spark, [DEFAULT])).where(F.col("call").isin(*evaluate.CLASSES))
        soft = F.coalesce((F.col("driver") == "confirmation") & (F.col("provisional") == "PD"), F.lit(False))
        refuted = F.coalesce((F.col("driver") == "confirmation") & F.col("provisional").isin("CR", "PR"), F.lit(False))
        return calls.select("timepoint", F.struct("call", soft.alias("soft"), refuted.alias("refuted"), ((F.col("driver") == "reference") & (F.col("call") == "SD")).alias("gated")).alias("c"))

    both = run(catalog_rule.rule_inputs(spark, sf_dir)).withColumnRenamed("c", "a").join(run(later_scans(spark, sf_dir)).withColumnRenamed("c", "b"), "timepoint").where("a.call <> b.call")
    other = lambda m: F.col(f"a.{m}") != F.col(f"b.{m}")
    why = F.when(other("soft"), "pseudoprogression window moved").when(other("gated"), "measurable gate on a different reference").when(other("refuted"), "confirmation outcome changed").otherwise("baseline/nadir moved")
    return both.select("timepoint", F.col("a.call").alias("before"), F.col("b.call").alias("after"), why.alias("mechanism"))


@query(
    "b17_dropped_scans",
    f"""WITH {catalog_rule.RECORDS}, {LATER}, b AS (SELECT patient, min(begin_at) AS at_place FROM post_rt GROUP BY patient)
    SELECT timepoint, CASE WHEN b.at_place IS NULL THEN 'patient never gets a post-RT baseline' WHEN place = b.at_place THEN 'becomes the new baseline' WHEN place < b.at_place THEN 'before the new baseline' END AS reason
    FROM kept LEFT JOIN b USING (patient) WHERE b.at_place IS NULL OR place <= b.at_place""",
    "scans",
)
def b17_dropped(spark, sf_dir):
    """Why scans leave the exam when the reference is the first scan after radiotherapy."""
    kept = timeline.chronological(scans(spark, sf_dir).where(~F.col("rating").eqNullSafe("Pre-Op")).drop("rn"))
    seen = later_scans(spark, sf_dir).select("timepoint", F.col("rn").alias("new_rn"))
    rows = kept.join(seen, "timepoint", "left").withColumn("found", F.max(F.col("new_rn").isNotNull()).over(Window.partitionBy("patient")))
    reason = F.when(~F.col("found"), "patient never gets a post-RT baseline").when(F.col("new_rn") == 1, "becomes the new baseline").when(F.col("new_rn").isNull(), "before the new baseline")
    return rows.select("timepoint", reason.alias("reason")).where("reason IS NOT NULL")


# --- adjudication and text against calls


@query(
    "f03_worksheet_order",
    rf"""WITH {catalog_rule.CALLS}, {catalog_rule.PAIRS} SELECT patient, timepoint, bucket, row_number() OVER (PARTITION BY bucket, patient ORDER BY timepoint) AS place FROM (
      SELECT patient, timepoint, CASE WHEN enhancing_mm3 = 0 THEN 1 WHEN regexp_matches(lower(rationale), '\bnew\b') OR regexp_matches(lower(rationale), 't2[- ]?progr') THEN 2 ELSE 3 END AS bucket
      FROM pairs JOIN (SELECT timepoint, enhancing_mm3 FROM scans) USING (timepoint) JOIN (SELECT timepoint, rationale FROM rationale) USING (timepoint) WHERE profile = 'mrano_volumetric' AND expert <> predicted)""",
    "scans", "rationale",
)
def f03(spark, sf_dir):
    """The worksheet in reading order: by bucket, patient and scan, with the place of a scan among its patient's."""
    calls = catalog_rule.rule_calls(spark, sf_dir, [DEFAULT]).where(F.col("call").isin(*evaluate.CLASSES) & F.col("rating").isin(*evaluate.CLASSES) & (F.col("call") != F.col("rating")))
    rows = calls.join(frame(spark, sf_dir, "rationale").select("timepoint", "rationale"), "timepoint").withColumn("bucket", rationale.disagreement(F.col("enhancing_mm3"), F.col("rationale")))
    place = F.row_number().over(Window.partitionBy("bucket", "patient").orderBy("timepoint"))
    return rows.select("patient", "timepoint", "bucket", place.cast("long").alias("place")).orderBy("bucket", "patient", "timepoint")


VISIBLE = "['measured target lesion', 'resection status']"


@query(
    "d23_evidence_tiers",
    f"""WITH {catalog_rule.CALLS}, {catalog_rule.PAIRS}, {LABELLED}, e AS (SELECT predicted, CASE WHEN len(l) > 0 THEN l WHEN t = '' THEN ['none recorded'] ELSE ['other'] END AS l FROM pairs JOIN labelled USING (timepoint) WHERE profile = 'mrano_volumetric' AND expert = 'PD'),
    k AS (SELECT predicted, CASE WHEN list_has_all({VISIBLE}, l) THEN 'seen' WHEN list_has_any(l, {VISIBLE}) THEN 'mixed' ELSE 'unseen' END AS tier FROM e)
    SELECT tier, count(*) AS n, count(*) FILTER (predicted = 'PD') AS called FROM k GROUP BY tier""",
    "scans", "rationale",
)
def d23(spark, sf_dir):
    """The expert's progressions by whether the evidence cited is within a volume rule's sight, and how many the rule calls."""
    visible = F.array(*(F.lit(k) for k, _, seen in rationale.LABELS if seen))
    calls = evaluate.scorable(catalog_rule.rule_calls(spark, sf_dir, [DEFAULT])).where("expert = 'PD'")
    rows = calls.join(frame(spark, sf_dir, "rationale").select("timepoint", rationale.labels(F.col("rationale")).alias("l")), "timepoint")
    tier = F.when(F.size(F.array_except("l", visible)) == 0, "seen").when(F.arrays_overlap("l", visible), "mixed").otherwise("unseen")
    return rows.groupBy(tier.alias("tier")).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("predicted") == "PD", 1)).alias("called"))


# --- components: connectivity, lumps and notes, treated zone

def sizes_of(rows: DataFrame, offsets) -> DataFrame:
    return voxel.label_components(rows, offsets).groupBy(*voxel.SCAN, "root").agg(F.count(F.lit(1)).alias("n"))


GAINED = f"""{ONE}, vp AS (SELECT patient, visit, lag(visit) OVER (PARTITION BY patient ORDER BY visit) AS previous FROM (SELECT DISTINCT patient, visit FROM c)),
gained AS (SELECT c.patient, c.visit, c.x, c.y, c.z FROM c JOIN vp USING (patient, visit) WHERE previous IS NOT NULL AND NOT EXISTS (SELECT 1 FROM c o WHERE o.patient = c.patient AND o.visit = previous AND abs(o.x - c.x) <= 1 AND abs(o.y - c.y) <= 1 AND abs(o.z - c.z) <= 1))"""
LUMPS = ROOTS.format(one=GAINED, near="").replace("FROM c),", "FROM gained),", 1)


def lumps(spark, sf_dir: str) -> DataFrame:
    """(patient, visit, largest, cells): gained cells outside the visit before dilated by 1, and their largest component."""
    own = cells(spark, sf_dir, 1).select(*voxel.CELL).distinct()
    pairs = voxel.visit_pairs(own)
    near = voxel.dilate(own, 1, LO, HI).withColumnRenamed("visit", "previous").join(pairs, ["patient", "previous"]).select(*voxel.CELL)
    gained = own.join(pairs.select(*voxel.SCAN), voxel.SCAN, "left_semi").join(near, voxel.CELL, "left_anti")
    return sizes_of(gained, voxel.HALF_26).groupBy(*voxel.SCAN).agg(F.max("n").alias("largest"), F.sum("n").alias("cells"))


@query(
    "d24_lump_scoreboard",
    f"""WITH {LUMPS}, b AS (SELECT patient, visit, max(n) AS largest FROM (SELECT patient, visit, root, count(*) AS n FROM roots GROUP BY ALL) GROUP BY ALL), t AS (SELECT unnest([1, 2, 3, 5]) AS threshold),
    v AS (SELECT w.patient, w.visit, contains(lower(note), 'new') AS said, coalesce(largest, 0) AS largest FROM (SELECT patient, visit, rating, note FROM visits) w JOIN vp ON vp.patient = w.patient AND vp.visit = w.visit LEFT JOIN b ON b.patient = w.patient AND b.visit = w.visit WHERE previous IS NOT NULL AND rating IN ('CR','PR','SD','PD'))
    SELECT threshold, count(*) FILTER (said AND largest >= threshold) AS caught, count(*) FILTER (said AND largest < threshold) AS missed, count(*) FILTER (NOT said AND largest >= threshold) AS extra, count(*) FILTER (NOT said AND largest < threshold) AS quiet FROM v, t GROUP BY threshold""",
    "voxels", "visits",
)
def d24(spark, sf_dir):
    """New lesions that the notes tell of against new lumps of cells, for each least size."""
    v = told(spark, sf_dir).crossJoin(F.broadcast(spark.createDataFrame([(1,), (2,), (3,), (5,)], "threshold int")))
    hit = F.col("largest") >= F.col("threshold")
    return v.groupBy("threshold").agg(*(F.count(F.when(c, 1)).alias(k) for k, c in (("caught", F.col("said") & hit), ("missed", F.col("said") & ~hit), ("extra", ~F.col("said") & hit), ("quiet", ~F.col("said") & ~hit))))


def told(spark, sf_dir: str) -> DataFrame:
    """Rated visits after a visit with enhancing cells: rating, said (the note tells of something new), largest lump."""
    pairs = voxel.visit_pairs(cells(spark, sf_dir, 1))
    rows = frame(spark, sf_dir, "visits").where(F.col("rating").isin(*evaluate.CLASSES)).join(pairs, voxel.SCAN).join(lumps(spark, sf_dir), voxel.SCAN, "left")
    return rows.select(*voxel.SCAN, "rating", F.contains(F.lower("note"), F.lit("new")).alias("said"), F.coalesce("largest", F.lit(0)).alias("largest"))


@query(
    "d25_extras_by_rating",
    f"""WITH {LUMPS}, b AS (SELECT patient, visit, max(n) AS largest FROM (SELECT patient, visit, root, count(*) AS n FROM roots GROUP BY ALL) GROUP BY ALL),
    v AS (SELECT w.rating, contains(lower(note), 'new') AS said, coalesce(largest, 0) AS largest FROM (SELECT patient, visit, rating, note FROM visits) w JOIN vp ON vp.patient = w.patient AND vp.visit = w.visit LEFT JOIN b ON b.patient = w.patient AND b.visit = w.visit WHERE previous IS NOT NULL AND rating IN ('CR','PR','SD','PD'))
    SELECT rating, count(*) AS silent, count(*) FILTER (largest >= 2) AS fired, round(count(*) FILTER (largest >= 2) / count(*), 6) AS rate FROM v WHERE NOT said GROUP BY rating""",
    "voxels", "visits",
)
def d25(spark, sf_dir):
    """Among visits whose notes tell of nothing new, how often a lump is found, by rating."""
    rows = told(spark, sf_dir).where("NOT said")
    fired = F.count(F.when(F.col("largest") >= 2, 1))
    return rows.groupBy("rating").agg(F.count(F.lit(1)).alias("silent"), fired.alias("fired"), F.round(fired / F.count(F.lit(1)), 6).alias("rate"))


@query(
    "d33_registration_summary",
    f"""WITH {ONE}, vp AS (SELECT patient, visit, lag(visit) OVER (PARTITION BY patient ORDER BY visit) AS previous FROM (SELECT DISTINCT patient, visit FROM c)), n AS (SELECT patient, visit, count(*) AS n FROM c GROUP BY ALL),
    m AS (SELECT c.patient, c.visit, previous, o.x - c.x AS dx, o.y - c.y AS dy, o.z - c.z AS dz, count(*) AS k FROM c JOIN vp USING (patient, visit) JOIN c o ON o.patient = c.patient AND o.visit = previous AND abs(o.x - c.x) <= 1 AND abs(o.y - c.y) <= 1 AND abs(o.z - c.z) <= 1 GROUP BY ALL),
    j AS (SELECT m.patient, m.visit, max(100.0 * k / (a.n + b.n - k)) AS best, coalesce(max(100.0 * k / (a.n + b.n - k)) FILTER (dx = 0 AND dy = 0 AND dz = 0), 0) AS still FROM m JOIN n a ON a.patient = m.patient AND a.visit = m.visit JOIN n b ON b.patient = m.patient AND b.visit = m.previous GROUP BY ALL)
    SELECT count(*) AS visits, round(median(still), 6) AS median_before, round(median(best), 6) AS median_after, round(min(still), 6) AS worst_before, round(min(best), 6) AS worst_after, count(*) FILTER (best < still - 0.5) AS worsened, count(*) FILTER (best > still) AS registered FROM j""",
    "voxels",
)
def d33(spark, sf_dir):
    moved = visits.compared(cells(spark, sf_dir, 1), reach=1).where("moved_common IS NOT NULL")
    share = lambda c: 100.0 * F.col(c) / (F.col("n") + F.col("n_previous") - F.col(c))
    rows = stash(moved.select(share("moved_common").alias("best"), share("kept").alias("still")))
    out = rows.agg(F.count(F.lit(1)).alias("visits"), F.round(F.min("still"), 6).alias("worst_before"), F.round(F.min("best"), 6).alias("worst_after"), F.count(F.when(F.col("best") < F.col("still") - 0.5, 1)).alias("worsened"), F.count(F.when(F.col("best") > F.col("still"), 1)).alias("registered"))
    return out.crossJoin(order.medians(rows, {"median_before": "still", "median_after": "best"}).select(F.round("median_before", 6).alias("median_before"), F.round("median_after", 6).alias("median_after")))


#: What a measuring tool reports for each scan, its names in another order than the labels: off by a few voxels.
REPORTED = "SELECT patient, visit, count(*) FILTER (label = 3) + patient % 3 AS edema, count(*) FILTER (label = 1) + visit % 2 AS enhancing, greatest(count(*) FILTER (label = 2) - patient % 2, 0) AS necrosis FROM voxels GROUP BY patient, visit"


@query(
    "d27_label_tissue",
    f"""WITH r AS ({REPORTED}), n AS (SELECT patient, visit, label, count(*) AS n FROM voxels GROUP BY ALL),
    a AS (SELECT patient, visit, max(n) FILTER (label = 1) AS n1, max(n) FILTER (label = 2) AS n2, max(n) FILTER (label = 3) AS n3 FROM n GROUP BY ALL),
    c AS (SELECT *, [{{'k': 'edema', 'v': edema}}, {{'k': 'enhancing', 'v': enhancing}}, {{'k': 'necrosis', 'v': necrosis}}] AS l0 FROM a JOIN r USING (patient, visit)),
    d1 AS (SELECT *, CASE WHEN n1 IS NOT NULL THEN list_sort(list_transform(l0, lambda x: {{'d': abs(x.v - n1), 'k': x.k}}))[1].k END AS t1 FROM c),
    e1 AS (SELECT *, list_filter(l0, lambda x: x.k IS DISTINCT FROM t1) AS l1 FROM d1),
    d2 AS (SELECT *, CASE WHEN n2 IS NOT NULL THEN list_sort(list_transform(l1, lambda x: {{'d': abs(x.v - n2), 'k': x.k}}))[1].k END AS t2 FROM e1),
    e2 AS (SELECT *, list_filter(l1, lambda x: x.k IS DISTINCT FROM t2) AS l2 FROM d2)
    SELECT patient, visit, t1, t2, CASE WHEN n3 IS NOT NULL THEN list_sort(list_transform(l2, lambda x: {{'d': abs(x.v - n3), 'k': x.k}}))[1].k END AS t3 FROM e2""",
    "voxels",
)
def d27(spark, sf_dir):
    """Which tissue each label is: label by label the name, not yet used, whose reported number of voxels is nearest; ties by name."""
    wide = cells(spark, sf_dir).groupBy(*voxel.SCAN).agg(*(F.count(F.when(F.col("label") == i, 1)).alias(f"n{i}") for i in (1, 2, 3)))
    reported = (("edema", F.col("n3") + F.col("patient") % 3), ("enhancing", F.col("n1") + F.col("visit") % 2), ("necrosis", F.greatest(F.col("n2") - F.col("patient") % 2, F.lit(0))))
    rows = wide.withColumn("left", F.array(*(F.struct(F.lit(k).alias("k"), v.cast("long").alias("v")) for k, v in reported)))
    for i in (1, 2, 3):
        own, taken = F.col(f"n{i}"), F.col(f"t{i}")
        nearest = F.array_min(F.transform("left", lambda x: F.struct(F.abs(x["v"] - own).alias("d"), x["k"].alias("k"))))  # noqa: B023
        rows = rows.withColumn(f"t{i}", F.when(own > 0, nearest["k"]))
        rows = rows.withColumn("left", F.filter("left", lambda x: ~x["k"].eqNullSafe(taken)))  # noqa: B023
    return rows.select(*voxel.SCAN, "t1", "t2", "t3")


# --- further columns of the reports

@query("d09_incomplete", f"WITH {catalog_rule.CALLS} SELECT profile, count(*) AS n, count(*) FILTER (unknowns <> '') AS incomplete FROM calls WHERE call IN ('CR','PR','SD','PD') AND rating IN ('CR','PR','SD','PD') GROUP BY profile", "scans")
def d09_incomplete(spark, sf_dir):
    """Scored scans whose call a missing input could have changed."""
    rows = catalog_rule.rule_calls(spark, sf_dir).where(F.col("call").isin(*evaluate.CLASSES) & F.col("rating").isin(*evaluate.CLASSES))
    return rows.groupBy("profile").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.size("unknowns") > 0, 1)).alias("incomplete"))


@query(
    "d14_rating_mix",
    "WITH r AS (SELECT patient, rating, count(*) AS n FROM scans WHERE rating IN ('CR','PR','SD','PD') GROUP BY ALL) SELECT patient, string_agg(concat(rating, '=', n), ',' ORDER BY rating) AS mix, CAST(sum(n) AS BIGINT) AS assessable FROM r GROUP BY patient HAVING sum(n) >= 6",
    "scans",
)
def d14_mix(spark, sf_dir):
    """How the ratings of an eligible patient (six assessable scans or more) mix, as a map shown in one line."""
    per = scans(spark, sf_dir).where(F.col("rating").isin(*evaluate.CLASSES)).groupBy("patient", "rating").agg(F.count(F.lit(1)).alias("n"))
    rows = per.groupBy("patient").agg(F.array_sort(F.collect_list(F.struct("rating", "n"))).alias("mix"), F.sum("n").alias("assessable")).where("assessable >= 6")
    return rows.select("patient", F.array_join(F.transform("mix", lambda m: F.concat(m["rating"], F.lit("="), m["n"].cast("string"))), ",").alias("mix"), "assessable")


@query("d18_crosstab", "SELECT arm, count(*) FILTER (rating = 'CR') AS cr, count(*) FILTER (rating = 'PR') AS pr, count(*) FILTER (rating = 'SD') AS sd, count(*) FILTER (rating = 'PD') AS pd, count(*) FILTER (rating IS NULL) AS unrated FROM scans GROUP BY arm", "scans")
def d18_crosstab(spark, sf_dir):
    rows = scans(spark, sf_dir).withColumn("r", F.coalesce(F.lower("rating"), F.lit("unrated")))
    return rows.groupBy("arm").pivot("r", ["cr", "pr", "sd", "pd", "unrated"]).agg(F.count(F.lit(1))).fillna(0)


@query(
    "d22_t2_firing",
    "WITH p AS (SELECT *, lag(t2_flair_mm3) OVER (PARTITION BY patient ORDER BY rn) AS before FROM scans) SELECT rating, count(*) AS n, count(*) FILTER (before > 0 AND (t2_flair_mm3 - before) / before >= 0.4) AS fired, count(*) FILTER (enhancing_mm3 = 0) AS silent FROM p WHERE rating IN ('CR','PR','SD','PD') GROUP BY rating",
    "scans",
)
def d22(spark, sf_dir):
    """By the expert's class: scans whose T2 volume grew by 40 % or more over the scan before, and scans without enhancing tissue."""
    before = F.lag("t2_flair_mm3").over(Window.partitionBy("patient").orderBy("rn"))
    rows = scans(spark, sf_dir).withColumn("change", rule.ratio(F.col("t2_flair_mm3"), before)).where(F.col("rating").isin(*evaluate.CLASSES))
    return rows.groupBy("rating").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("change") >= 0.4, 1)).alias("fired"), F.count(F.when(F.col("enhancing_mm3") == 0, 1)).alias("silent"))


@query(
    "d32_resection_against_progression",
    r"""SELECT CASE WHEN regexp_matches(rationale, '\bCRET\b') THEN 'CRET' ELSE 'PD' END AS kind, count(*) AS n, median(enhancing_mm3) AS enhancing, median(necrosis_mm3) AS necrosis, median(t2_flair_mm3) AS t2
    FROM scans JOIN (SELECT timepoint, rationale FROM rationale) USING (timepoint) WHERE regexp_matches(rationale, '\bCRET\b') OR rating = 'PD' GROUP BY ALL""",
    "scans", "rationale",
)
def d32(spark, sf_dir):
    """Median volumes of scans after a complete resection and of other progressions."""
    rows = scans(spark, sf_dir).join(frame(spark, sf_dir, "rationale").select("timepoint", rationale.features(F.col("rationale"))["cret"].alias("cret")), "timepoint").where(F.col("cret") | (F.col("rating") == "PD"))
    rows = stash(rows.withColumn("kind", F.when(F.col("cret"), "CRET").otherwise("PD")))
    middle = order.medians(rows, {"enhancing": "enhancing_mm3", "necrosis": "necrosis_mm3", "t2": "t2_flair_mm3"}, "kind")
    return rows.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).join(middle, "kind")


@query(
    "d35_missed_reasons",
    rf"""WITH {catalog_rule.CALLS}, {catalog_rule.PAIRS}, m AS (SELECT regexp_matches(lower(rationale), 't2-?progr') AS t2, regexp_matches(lower(rationale), '\bnew\b') AS is_new, regexp_matches(lower(rationale), 'non-?target') AS non_target
      FROM pairs JOIN (SELECT timepoint, rationale FROM rationale) USING (timepoint) WHERE profile = 'mrano_volumetric' AND expert = 'PD' AND predicted <> 'PD')
    SELECT count(*) AS missed, count(*) FILTER (t2) AS t2_progression, count(*) FILTER (is_new) AS new_lesion, count(*) FILTER (non_target) AS non_target, round(count(*) FILTER (t2 OR is_new OR non_target) / count(*), 6) AS share_explained FROM m""",
    "scans", "rationale",
)
def d35(spark, sf_dir):
    """Progressions that the rule misses, by what the text cites that volumes do not show; a scan may count for several."""
    told = rationale.features(F.col("rationale"))
    texts = frame(spark, sf_dir, "rationale").select("timepoint", *(told[k].alias(k) for k in ("t2_progression", "new_lesion", "non_target")))
    rows = evaluate.scorable(catalog_rule.rule_calls(spark, sf_dir, [DEFAULT])).where("expert = 'PD' AND predicted <> 'PD'").select("timepoint").join(texts, "timepoint")
    count = lambda c: F.count(F.when(c, 1))
    return rows.agg(F.count(F.lit(1)).alias("missed"), *(count(F.col(k)).alias(k) for k in ("t2_progression", "new_lesion", "non_target")), F.round(count(F.expr("t2_progression OR new_lesion OR non_target")) / F.count(F.lit(1)), 6).alias("share_explained"))


@query(
    "b10_terms",
    "WITH t AS (SELECT lower(rationale) AS r FROM rationale WHERE timepoint NOT IN (SELECT timepoint FROM scans WHERE arm = 'held_out')), w AS (SELECT unnest(['target', 'non-target', 'new', 't2', 'cret', 'pret', 'measurable', 'irradiated', 'progr']) AS term) SELECT term, count(*) FILTER (contains(r, term)) AS n, count(*) FILTER (contains(r, term) AND contains(r, 'mm')) AS with_size FROM t, w GROUP BY term",
    "rationale", "scans",
)
def b10_terms(spark, sf_dir):
    """How many texts use each term, and use it beside a measurement; the held-out arm stays unseen."""
    held = scans(spark, sf_dir).where("arm = 'held_out'").select("timepoint")
    rows = frame(spark, sf_dir, "rationale").join(held, "timepoint", "left_anti").select(F.lower("rationale").alias("r"))
    terms = F.array(*map(F.lit, ("target", "non-target", "new", "t2", "cret", "pret", "measurable", "irradiated", "progr")))
    rows = rows.select("r", F.explode(terms).alias("term"))
    uses = F.contains("r", F.col("term"))
    return rows.groupBy("term").agg(F.count(F.when(uses, 1)).alias("n"), F.count(F.when(uses & F.contains("r", F.lit("mm")), 1)).alias("with_size"))


@query(
    "c18_neither",
    f"""WITH {catalog_rule.CALLS}, {catalog_rule.PAIRS}, a AS (SELECT * FROM pairs WHERE profile = 'enhancing_only'), b AS (SELECT * FROM pairs WHERE profile = 'mrano_volumetric'),
    j AS (SELECT a.timepoint IS NOT NULL AS in_a, b.timepoint IS NOT NULL AS in_b, a.predicted = a.expert AS right_a, b.predicted = b.expert AS right_b FROM a FULL JOIN b ON a.timepoint = b.timepoint)
    SELECT count(*) FILTER (in_a AND in_b AND NOT right_a AND NOT right_b) AS neither, round(avg(right_b::INT) FILTER (in_b) - avg(right_a::INT) FILTER (in_a), 6) AS headline,
      round(avg(right_b::INT) FILTER (in_a AND in_b) - avg(right_a::INT) FILTER (in_a AND in_b), 6) AS rule_part,
      round((avg(right_b::INT) FILTER (in_b) - avg(right_a::INT) FILTER (in_a)) - (avg(right_b::INT) FILTER (in_a AND in_b) - avg(right_a::INT) FILTER (in_a AND in_b)), 6) AS scan_set_part FROM j""",
    "scans",
)
def c18(spark, sf_dir):
    """Two rules on shared scans: scans that neither gets right, and how much of the difference in agreement is the rule's and how much that of the scans each one scores."""
    rows = evaluate.scorable(catalog_rule.rule_calls(spark, sf_dir, [rule.profile("enhancing_only"), DEFAULT])).select("profile", "timepoint", (F.col("predicted") == F.col("expert")).cast("int").alias("right"))
    side = lambda name, c: rows.where(F.col("profile") == name).select("timepoint", F.col("right").alias(c))
    j = side("enhancing_only", "a").join(side(DEFAULT["profile"], "b"), "timepoint", "full")
    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    headline, shared = F.avg("b") - F.avg("a"), F.avg(F.when(both, F.col("b"))) - F.avg(F.when(both, F.col("a")))
    return j.agg(F.count(F.when((F.col("a") == 0) & (F.col("b") == 0), 1)).alias("neither"), F.round(headline, 6).alias("headline"), F.round(shared, 6).alias("rule_part"), F.round(headline - shared, 6).alias("scan_set_part"))

"""Queries of the response rule, its inputs and its evaluation, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import evaluate, rule, timeline
from ..sources.fixtures import frame, oracle
from .shared import stash

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None, *views: str):
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = oracle(sql, *views) if views else sql
        return fn

    return keep


RECORDS = """
s AS (SELECT DISTINCT patient, week, rating FROM scans WHERE week IS NOT NULL),
pre AS (SELECT DISTINCT patient, week FROM s WHERE rating = 'Pre-Op'),
post AS (SELECT DISTINCT patient, week FROM s WHERE rating = 'Post-Op'),
nxt AS (SELECT pre.patient, pre.week AS p, min(s.week) AS f FROM pre JOIN s ON s.patient = pre.patient AND s.week > pre.week GROUP BY ALL),
bad AS (SELECT DISTINCT patient FROM nxt WHERE NOT EXISTS (SELECT 1 FROM post WHERE post.patient = nxt.patient AND post.week >= nxt.p AND post.week <= nxt.f)),
po AS (SELECT patient, week, lag(week) OVER (PARTITION BY patient ORDER BY week) AS pq FROM post),
surg AS (SELECT patient, week FROM po WHERE patient NOT IN (SELECT patient FROM bad)
  AND (pq IS NULL OR EXISTS (SELECT 1 FROM s WHERE s.patient = po.patient AND s.week > po.pq AND s.week < po.week))),
rec AS (SELECT p.patient, p.patient IN (SELECT patient FROM bad) AS contradicted, min(surg.week) AS first_week, count(surg.week) AS n_surgeries
  FROM (SELECT DISTINCT patient FROM s) p LEFT JOIN surg USING (patient) GROUP BY ALL)
"""


def records(spark: SparkSession, sf_dir: str, scans: DataFrame | None = None) -> DataFrame:
    scans = frame(spark, sf_dir, "scans") if scans is None else scans
    return timeline.treatments(timeline.surgical_labels(scans))


def rule_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    scans = frame(spark, sf_dir, "scans")
    return timeline.scored_scans(scans, records(spark, sf_dir, scans))


def rule_calls(spark: SparkSession, sf_dir: str, rows: list[dict] | None = None) -> DataFrame:
    """Calls under every parameter set; the scans with their surgeries are kept, as each way of resetting reads them."""
    return rule.trajectories(stash(rule_inputs(spark, sf_dir)), rule.profiles(spark, rows))


def flag(x) -> str:
    return "NULL" if x is None else str(x).upper() if isinstance(x, bool) else f"CAST({x} AS DOUBLE)" if isinstance(x, float) else f"'{x}'"


def rule_sql(p: dict) -> str:
    """The calls of one parameter set, as SQL."""
    c = {k: flag(v) for k, v in p.items()}
    return f"""
SELECT * FROM (WITH b AS (SELECT *, row_number() OVER (PARTITION BY patient ORDER BY week NULLS LAST, timepoint) - 1 AS n FROM scans WHERE rating IS DISTINCT FROM 'Pre-Op'),
w AS (SELECT *, last_value(week IGNORE NULLS) OVER (PARTITION BY patient ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pw FROM b),
r AS (SELECT w.*, n > 0 AND {c['reset_at_surgery']} AND EXISTS (SELECT 1 FROM surg WHERE surg.patient = w.patient AND surg.week > w.pw AND surg.week <= w.week) AS reset FROM w),
g AS (SELECT *, sum(CASE WHEN reset THEN 1 ELSE 0 END) OVER (PARTITION BY patient ORDER BY n ROWS UNBOUNDED PRECEDING) AS segment FROM r),
f AS (SELECT *, first_value(enhancing_mm3) OVER (PARTITION BY patient, segment ORDER BY n) AS baseline, first_value(measurable_disease) OVER (PARTITION BY patient, segment ORDER BY n) AS bm,
  min(enhancing_mm3) OVER (PARTITION BY patient, segment ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS nadir,
  min(t2_flair_mm3) OVER (PARTITION BY patient, segment ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS t2n FROM g),
v AS (SELECT *, CASE WHEN nadir > 0 THEN (enhancing_mm3 - nadir) / nadir END AS vn, CASE WHEN baseline > 0 THEN (enhancing_mm3 - baseline) / baseline END AS vb,
  CASE WHEN t2n > 0 THEN (t2_flair_mm3 - t2n) / t2n END AS vt FROM f),
d AS (SELECT *, CASE WHEN enhancing_mm3 IS NULL THEN NULL WHEN {c['use_new_lesion']} AND new_lesion IS TRUE THEN 'new_lesion'
    WHEN {c['use_clinical']} AND clinical_deterioration IS TRUE THEN 'clinical'
    WHEN vn >= {c['pd_increase']} AND abs(enhancing_mm3 - coalesce(nadir, 0)) >= {c['floor_mm3']} THEN 'enhancing'
    WHEN nadir = 0 AND enhancing_mm3 > 0 AND abs(enhancing_mm3) >= {c['floor_mm3']} THEN 'enhancing'
    WHEN {c['use_t2']} AND vt >= {c['t2_pd_increase']} THEN 't2_flair' END AS pd_by,
  coalesce(weeks_since_rt < {c['pseudo_weeks']}, FALSE) AS inw,
  coalesce(vb <= {c['pr_decrease']} AND abs(enhancing_mm3 - coalesce(baseline, 0)) >= {c['floor_mm3']}, FALSE) AS resp FROM v),
k AS (SELECT *, CASE WHEN n = 0 OR reset THEN 'BASELINE' WHEN enhancing_mm3 IS NULL THEN 'NE' WHEN pd_by IS NOT NULL AND inw AND {c['pseudo_policy']} = 'downgrade' THEN 'SD'
    WHEN pd_by IS NOT NULL THEN 'PD' WHEN enhancing_mm3 = 0 AND {c['block_cr_steroids']} AND steroids_increased IS TRUE THEN 'PR' WHEN enhancing_mm3 = 0 THEN 'CR'
    WHEN resp AND {c['measurable_baseline']} AND bm IS FALSE THEN 'SD' WHEN resp AND {c['block_non_measurable']} AND non_measurable_only IS TRUE THEN 'SD' WHEN resp THEN 'PR' ELSE 'SD' END AS c1,
  CASE WHEN n = 0 OR reset THEN 'reference' WHEN enhancing_mm3 IS NULL THEN 'missing' WHEN pd_by IS NOT NULL AND inw AND {c['pseudo_policy']} = 'downgrade' THEN 'confirmation'
    WHEN pd_by IS NOT NULL THEN pd_by WHEN enhancing_mm3 = 0 THEN 'enhancing'
    WHEN resp AND (({c['measurable_baseline']} AND bm IS FALSE) OR ({c['block_non_measurable']} AND non_measurable_only IS TRUE)) THEN 'reference' ELSE 'enhancing' END AS d1,
  CASE WHEN n = 0 OR reset OR enhancing_mm3 IS NULL THEN NULL WHEN pd_by IS NOT NULL AND inw AND {c['pseudo_policy']} = 'downgrade' THEN 'PD' WHEN pd_by IS NOT NULL OR enhancing_mm3 = 0 THEN NULL
    WHEN resp AND (({c['measurable_baseline']} AND bm IS FALSE) OR ({c['block_non_measurable']} AND non_measurable_only IS TRUE)) THEN 'PR' END AS p1,
  NOT (n = 0 OR reset) AND enhancing_mm3 IS NOT NULL AND pd_by IS NOT NULL AND inw AS risk FROM d),
l AS (SELECT k.*, (SELECT min(q.n) FROM k q WHERE q.patient = k.patient AND q.n > k.n AND q.week - k.week >= {c['confirm_weeks']}) AS ln FROM k),
j AS (SELECT l.*, q.week AS lw, q.c1 AS lc FROM l LEFT JOIN k q ON q.patient = l.patient AND q.n = l.ln),
x AS (SELECT *, {c['confirm']} AND c1 IN ('CR', 'PR') AS asks FROM j),
y AS (SELECT *, asks AND week IS NULL AS no_week, asks AND week IS NOT NULL AND coalesce(lw - week > {c['confirm_max_weeks']}, FALSE) AS late, asks AND week IS NOT NULL AND ln IS NULL AS at_end FROM x),
z AS (SELECT *, asks AND ((ln IS NOT NULL AND NOT late AND NOT (lc = 'CR' OR (lc = 'PR' AND c1 = 'PR'))) OR (at_end AND NOT {c['keep_at_end']})) AS refuted FROM y)
SELECT {c['profile']} AS profile, patient, timepoint, n, CASE WHEN refuted THEN 'SD' ELSE c1 END AS call, CASE WHEN refuted THEN 'confirmation' ELSE d1 END AS driver,
  CASE WHEN refuted THEN c1 ELSE p1 END AS provisional, risk,
  CASE WHEN c1 <> 'BASELINE' THEN round(vn, 6) END AS vs_nadir, CASE WHEN c1 <> 'BASELINE' THEN round(vb, 6) END AS vs_baseline,
  CASE WHEN c1 = 'BASELINE' THEN '' ELSE coalesce(array_to_string(list_sort(list_filter([
    CASE WHEN c1 <> 'PD' AND {c['use_new_lesion']} AND new_lesion IS NULL THEN 'new_lesion' END, CASE WHEN c1 <> 'PD' AND {c['use_clinical']} AND clinical_deterioration IS NULL THEN 'clinical' END,
    CASE WHEN c1 <> 'PD' AND {c['use_t2']} AND (t2_flair_mm3 IS NULL OR t2n IS NULL) THEN 't2_flair' END, CASE WHEN c1 = 'CR' AND {c['block_cr_steroids']} AND steroids_increased IS NULL THEN 'steroids' END,
    CASE WHEN c1 = 'PR' AND {c['block_non_measurable']} AND non_measurable_only IS NULL THEN 'non_measurable' END, CASE WHEN c1 = 'PR' AND {c['measurable_baseline']} AND bm IS NULL THEN 'baseline_measurable' END,
    CASE WHEN no_week THEN 'confirmation_week' WHEN late THEN 'confirmation_too_late' WHEN at_end AND {c['keep_at_end']} THEN 'confirmation_followup' END
  ], lambda u: u IS NOT NULL)), ','), '') END AS unknowns, rating, arm, week
FROM z)"""


def calls_sql(rows: list[dict]) -> str:
    return "calls AS (" + " UNION ALL ".join(map(rule_sql, rows)) + ")"


ALL = [rule.profile(n) for n in rule.PROFILES]
CALLS = f"{RECORDS}, {calls_sql(ALL)}"
PAIRS = "pairs AS (SELECT profile, patient, timepoint, arm, rating AS expert, call AS predicted FROM calls WHERE call IN ('CR','PR','SD','PD') AND rating IN ('CR','PR','SD','PD'))"
CONFUSION = """classes AS (SELECT unnest(['CR','PR','SD','PD']) AS c),
cells AS (SELECT k.profile, e.c AS expert, p.c AS predicted, (SELECT count(*) FROM pairs q WHERE q.profile = k.profile AND q.expert = e.c AND q.predicted = p.c) AS n
  FROM (SELECT DISTINCT profile FROM pairs) k, classes e, classes p)"""
FIGURES = """figures AS (SELECT profile, c AS class, sum(CASE WHEN expert = c THEN n ELSE 0 END) AS support, sum(CASE WHEN predicted = c THEN n ELSE 0 END) AS predicted,
  sum(CASE WHEN expert = c AND predicted = c THEN n ELSE 0 END) AS correct FROM cells, classes GROUP BY profile, c)"""


@query("i07_treatments", f"WITH {RECORDS} SELECT patient, CASE WHEN contradicted THEN NULL ELSE n_surgeries END AS n_surgeries, first_week + 4.0 AS rt_start, first_week + 10.0 AS rt_end, contradicted FROM rec", "scans")
def i07(spark, sf_dir):
    return records(spark, sf_dir).select("patient", F.when(F.col("surgeries").isNotNull(), F.size("surgeries").cast("long")).alias("n_surgeries"), "rt_start", "rt_end", "contradicted")


@query("i08_contradictions", f"WITH {RECORDS} SELECT patient FROM bad", "scans")
def i08(spark, sf_dir):
    return records(spark, sf_dir).where("contradicted").select("patient")


STAGE = """placed AS (SELECT scans.patient, timepoint, scans.week, scans.rn, last, CASE WHEN scans.week IS NULL THEN NULL WHEN rec.patient IS NULL OR contradicted THEN 'unknown' WHEN scans.week < first_week THEN 'before_surgery'
  WHEN first_week IS NULL THEN 'unknown' WHEN last > first_week + 10 THEN 'after_surgery' WHEN scans.week < first_week + 4 THEN 'after_surgery' WHEN scans.week <= first_week + 10 THEN 'during_radiotherapy'
  WHEN scans.week - first_week - 10 < 4 THEN 'too_soon_after_radiotherapy' ELSE 'after_radiotherapy' END AS stage, scans.week - first_week - 10 AS gap
FROM scans LEFT JOIN rec ON rec.patient = scans.patient LEFT JOIN (SELECT c.timepoint AS tp, max(surg.week) AS last FROM scans c JOIN surg ON surg.patient = c.patient AND surg.week <= c.week GROUP BY 1) m ON m.tp = scans.timepoint)"""


@query("i06_place_scan", f"WITH {RECORDS}, {STAGE} SELECT patient, timepoint, stage, CASE WHEN stage IN ('too_soon_after_radiotherapy', 'after_radiotherapy') THEN gap END AS weeks_after_rt, stage = 'after_radiotherapy' AND gap > 12 AS late FROM placed", "scans")
def i06(spark, sf_dir):
    scans = frame(spark, sf_dir, "scans")
    return timeline.placed(scans, records(spark, sf_dir, scans)).select("patient", "timepoint", "stage", "weeks_after_rt", "late")


@query("e15_first_eligible", f"WITH {RECORDS}, {STAGE} SELECT patient, min_by(timepoint, rn) FILTER (stage = 'after_radiotherapy') AS baseline_timepoint, count(*) FILTER (stage = 'after_radiotherapy') AS n_eligible FROM placed GROUP BY patient", "scans")
def e15(spark, sf_dir):
    scans = frame(spark, sf_dir, "scans")
    return timeline.first_eligible(timeline.placed(scans, records(spark, sf_dir, scans)))


OUT = "profile, patient, timepoint, call, driver, provisional, risk, vs_nadir, vs_baseline, unknowns"


@query("i04_trajectory", f"WITH {CALLS} SELECT {OUT} FROM calls", "scans")
def i04(spark, sf_dir):
    rows = rule_calls(spark, sf_dir)
    return rows.select("profile", "patient", "timepoint", "call", "driver", "provisional", "risk", F.round("vs_nadir", 6).alias("vs_nadir"), F.round("vs_baseline", 6).alias("vs_baseline"), F.array_join(F.array_sort("unknowns"), ",").alias("unknowns"))


BLIND = [rule.profile("mrano_volumetric", use_new_lesion=False, use_clinical=False)]


@query("i05_variant_volume_only", f"WITH {RECORDS}, {calls_sql(BLIND)} SELECT call, driver, count(*) AS n FROM calls GROUP BY call, driver", "scans")
def i05(spark, sf_dir):
    return rule_calls(spark, sf_dir, BLIND).groupBy("call", "driver").agg(F.count(F.lit(1)).alias("n"))


@query("i03_confirmation_outcomes", f"WITH {CALLS} SELECT profile, CASE WHEN driver = 'confirmation' AND provisional IN ('CR', 'PR') THEN 'refuted' WHEN contains(unknowns, 'confirmation_') THEN 'unconfirmable' ELSE 'kept' END AS outcome, count(*) AS n FROM calls WHERE call IN ('CR', 'PR') OR (driver = 'confirmation' AND provisional IN ('CR', 'PR')) GROUP BY ALL", "scans")
def i03(spark, sf_dir):
    rows = rule_calls(spark, sf_dir)
    demoted = (F.col("driver") == "confirmation") & F.col("provisional").isin("CR", "PR")
    outcome = F.when(demoted, "refuted").when(F.exists("unknowns", lambda u: F.startswith(u, F.lit("confirmation_"))), "unconfirmable").otherwise("kept")
    return rows.where(F.col("call").isin("CR", "PR") | F.coalesce(demoted, F.lit(False))).groupBy("profile", F.coalesce(outcome, F.lit("kept")).alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


@query("i02_unknowns", f"WITH {CALLS} SELECT profile, unknown, count(*) AS n FROM (SELECT profile, unnest(string_split(unknowns, ',')) AS unknown FROM calls WHERE unknowns <> '') GROUP BY ALL", "scans")
def i02(spark, sf_dir):
    return rule_calls(spark, sf_dir).select("profile", F.explode("unknowns").alias("unknown")).groupBy("profile", "unknown").agg(F.count(F.lit(1)).alias("n"))


@query("i10_reference_scans", f"WITH {CALLS} SELECT patient, timepoint FROM calls WHERE profile = 'mrano_volumetric' AND call = 'BASELINE'", "scans")
def i10(spark, sf_dir):
    return rule.references(rule_inputs(spark, sf_dir), True).where((F.col("n") == 0) | F.col("reset")).select("patient", "timepoint")


@query("d07_confusion", f"WITH {CALLS}, {PAIRS}, {CONFUSION} SELECT * FROM cells", "scans")
def d07(spark, sf_dir):
    return evaluate.confusion(evaluate.scorable(rule_calls(spark, sf_dir)), "profile")


@query("d08_class_figures", f"WITH {CALLS}, {PAIRS}, {CONFUSION}, {FIGURES}, r AS (SELECT *, CASE WHEN support > 0 THEN correct / support ELSE 0 END AS rec, CASE WHEN predicted > 0 THEN correct / predicted ELSE 0 END AS pre FROM figures) SELECT profile, class, CAST(support AS BIGINT) AS support, CAST(predicted AS BIGINT) AS predicted, round(rec, 6) AS recall, round(pre, 6) AS precision, round(CASE WHEN rec + pre > 0 THEN 2 * rec * pre / (rec + pre) ELSE 0 END, 6) AS f1 FROM r", "scans")
def d08(spark, sf_dir):
    figures = evaluate.class_figures(evaluate.confusion(evaluate.scorable(rule_calls(spark, sf_dir)), "profile"), "profile")
    return figures.select("profile", "class", "support", "predicted", *(F.round(c, 6).alias(c) for c in ("recall", "precision", "f1")))


SUMMARY = "SELECT {by}, CAST(sum(support) AS BIGINT) AS n, round(sum(correct) / sum(support), 6) AS agreement, round(max(support) / sum(support), 6) AS majority, round(avg(CASE WHEN support > 0 THEN correct / support END), 6) AS balanced FROM figures GROUP BY {by}"


def rounded_summary(figures: DataFrame, *by: str) -> DataFrame:
    return evaluate.summary(figures, *by).select(*by, "n", *(F.round(c, 6).alias(c) for c in ("agreement", "majority", "balanced")))


@query("d09_summary", f"WITH {CALLS}, {PAIRS}, {CONFUSION}, {FIGURES} {SUMMARY.format(by='profile')}", "scans")
def d09(spark, sf_dir):
    return rounded_summary(evaluate.class_figures(evaluate.confusion(evaluate.scorable(rule_calls(spark, sf_dir)), "profile"), "profile"), "profile")


@query("d10_summary_by_arm", f"WITH {CALLS}, {PAIRS}, classes AS (SELECT unnest(['CR','PR','SD','PD']) AS class), figures AS (SELECT profile, arm, class, count(*) FILTER (expert = class) AS support, count(*) FILTER (expert = class AND predicted = class) AS correct FROM pairs, classes GROUP BY ALL) {SUMMARY.format(by='profile, arm')}", "scans")
def d10(spark, sf_dir):
    by = ("profile", "arm")
    return rounded_summary(evaluate.class_figures(evaluate.confusion(evaluate.scorable(rule_calls(spark, sf_dir)), *by), *by), *by)


@query("d11_progression_vs_rest", f"WITH {CALLS}, {PAIRS} SELECT profile, count(*) FILTER (expert = 'PD' AND predicted = 'PD') AS tp, count(*) FILTER (expert <> 'PD' AND predicted = 'PD') AS fp, count(*) FILTER (expert = 'PD' AND predicted <> 'PD') AS fn, count(*) FILTER (expert <> 'PD' AND predicted <> 'PD') AS tn FROM pairs GROUP BY profile", "scans")
def d11(spark, sf_dir):
    e, p = F.col("expert") == "PD", F.col("predicted") == "PD"
    cells = {"tp": e & p, "fp": ~e & p, "fn": e & ~p, "tn": ~e & ~p}
    return evaluate.scorable(rule_calls(spark, sf_dir)).groupBy("profile").agg(*(F.count(F.when(c, 1)).alias(k) for k, c in cells.items()))


@query("d12_crosstab", f"WITH {CALLS}, {PAIRS} SELECT profile, expert, count(*) FILTER (predicted = 'CR') AS CR, count(*) FILTER (predicted = 'PR') AS PR, count(*) FILTER (predicted = 'SD') AS SD, count(*) FILTER (predicted = 'PD') AS PD FROM pairs GROUP BY profile, expert", "scans")
def d12(spark, sf_dir):
    return evaluate.scorable(rule_calls(spark, sf_dir)).groupBy("profile", "expert").pivot("predicted", evaluate.CLASSES).agg(F.count(F.lit(1))).fillna(0)


#: The whole grids of the survey: both one by one with the other guard as shipped, and floors by five limits; None is unlimited.
FLOORS, LIMITS, JOINT = (0.0, 1.0, 3.0, 5.0, 10.0, 25.0, 50.0, 100.0, 250.0, 524.0, 1000.0), (6.0, 8.0, 10.0, 12.0, 14.0, 16.0, 20.0, 26.0, 52.0, None), (8.0, 12.0, 16.0, 20.0, None)
SHIPPED = rule.profile("mrano_volumetric")
POINTS = dict.fromkeys([(f, SHIPPED["confirm_max_weeks"]) for f in FLOORS] + [(SHIPPED["floor_mm3"], w) for w in LIMITS] + [(f, w) for f in FLOORS for w in JOINT])
WHOLE_GRID = [{**SHIPPED, "profile": f"floor={f:g}, late={'unlimited' if w is None else format(w, 'g')}", "floor_mm3": f, "confirm_max_weeks": w} for f, w in POINTS]


def sweep_sql(points: list[tuple[float, float | None]]) -> str:
    """The calls of one parameter set at all points at once: patients are told apart by point, as 100 * patient + point."""
    values = ", ".join(f"({i}, CAST({f} AS DOUBLE), CAST({'NULL' if w is None else w} AS DOUBLE))" for i, (f, w) in enumerate(points))
    swept = rule_sql({**SHIPPED, "floor_mm3": 111.5, "confirm_max_weeks": 222.5}).replace("CAST(111.5 AS DOUBLE)", "floor_at").replace("CAST(222.5 AS DOUBLE)", "late_at")
    swept = swept.replace("FROM scans WHERE", "FROM many WHERE").replace("surg.patient = w.patient", "surg.patient = w.patient // 100").replace("'mrano_volumetric' AS profile", "patient % 100 AS profile")
    return f"many AS (SELECT s.* REPLACE (s.patient * 100 + p.id AS patient), floor_at, late_at FROM scans s, (VALUES {values}) p(id, floor_at, late_at)), calls AS ({swept})"


NAMES = ", ".join(f"({i}, '{g['profile']}')" for i, g in enumerate(WHOLE_GRID))


@query("i14_guard_sweep_whole", f"WITH {RECORDS}, {sweep_sql(list(POINTS))}, {PAIRS}, classes AS (SELECT unnest(['CR','PR','SD','PD']) AS class), figures AS (SELECT name AS profile, class, count(*) FILTER (expert = class) AS support, count(*) FILTER (expert = class AND predicted = class) AS correct FROM pairs JOIN (VALUES {NAMES}) v(id, name) ON id = profile, classes GROUP BY ALL) {SUMMARY.format(by='profile')}", "scans")
def i14_whole(spark, sf_dir):
    return rounded_summary(evaluate.class_figures(evaluate.confusion(evaluate.scorable(rule_calls(spark, sf_dir, WHOLE_GRID)), "profile"), "profile"), "profile")


# the whole grids too; a smaller form had this name before
QUERIES["i14_guard_sweep"], ORACLE["i14_guard_sweep"] = QUERIES["i14_guard_sweep_whole"], ORACLE["i14_guard_sweep_whole"]


@query("i15_run_profiles", f"WITH {CALLS}, {PAIRS} SELECT profile, expert, predicted, arm, count(*) AS n FROM pairs GROUP BY ALL", "scans")
def i15(spark, sf_dir):
    return evaluate.scorable(rule_calls(spark, sf_dir)).groupBy("profile", "expert", "predicted", "arm").agg(F.count(F.lit(1)).alias("n"))


@query("c18_shared_rows", f"""WITH {CALLS}, {PAIRS}, a AS (SELECT * FROM pairs WHERE profile = 'enhancing_only'), b AS (SELECT * FROM pairs WHERE profile = 'mrano_volumetric')
SELECT count(*) FILTER (b.patient IS NULL) AS only_old, count(*) FILTER (a.patient IS NULL) AS only_new, count(*) FILTER (a.patient IS NOT NULL AND b.patient IS NOT NULL) AS shared,
  count(*) FILTER (b.patient IS NOT NULL AND a.predicted = a.expert) AS old_right, count(*) FILTER (a.patient IS NOT NULL AND b.predicted = b.expert) AS new_right,
  count(*) FILTER (a.predicted = a.expert AND b.predicted <> b.expert) AS lost, count(*) FILTER (a.predicted <> a.expert AND b.predicted = b.expert) AS won
FROM a FULL JOIN b ON a.timepoint = b.timepoint AND a.patient = b.patient""", "scans")
def c18(spark, sf_dir):
    rows = evaluate.scorable(rule_calls(spark, sf_dir))
    return evaluate.shared_rows(rows.where("profile = 'enhancing_only'"), rows.where("profile = 'mrano_volumetric'"))


@query("e13_patient_ranking", f"WITH {CALLS}, {PAIRS}, r AS (SELECT patient, count(*) AS n, count(*) FILTER (expert = predicted) AS right_calls FROM pairs WHERE profile = 'mrano_volumetric' GROUP BY patient) SELECT *, row_number() OVER (ORDER BY right_calls / n, n DESC, patient) AS place FROM r QUALIFY place <= 20", "scans")
def e13(spark, sf_dir):
    rows = evaluate.scorable(rule_calls(spark, sf_dir)).where("profile = 'mrano_volumetric'").groupBy("patient").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("expert") == F.col("predicted"), 1)).alias("right_calls"))
    top = rows.orderBy(F.col("right_calls") / F.col("n"), F.desc("n"), "patient").limit(20)  # the ranking's own size
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.col("right_calls") / F.col("n"), F.desc("n"), "patient")).cast("long"))

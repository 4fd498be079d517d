"""Queries of the adjudicator's worksheet: reasons of calls, provenance of the nadir, disagreements."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import evaluate, rule, timeline, worksheet
from ..sources.fixtures import frame, oracle
from . import catalog_rule
from .shared import stash

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
DEFAULT = rule.profile("mrano_volumetric")
#: A set that takes the roads which the default does not: T2 counts, responses need a scan that confirms them.
STRICT = rule.profile("strict", use_t2=True, keep_at_end=False, pd_increase=0.25, pr_decrease=-0.5)


def query(name: str, sql: str, *views: str):
    def keep(fn):
        QUERIES[name] = fn
        ORACLE[name] = oracle(sql, *views)
        return fn

    return keep


BAND = "CAST(CASE WHEN {v} >= 60000 THEN 1.5 WHEN {v} >= 20000 THEN 2.8 WHEN {v} >= 5000 THEN 5.3 WHEN {v} >= 1000 THEN 14.8 WHEN {v} >= 0 THEN 36.6 END AS DOUBLE)"
MORE = "rating, arm, week, enhancing_mm3, necrosis_mm3, t2_flair_mm3, nadir, baseline, vn, vb, vt, bm, pd_by, inw, c1, d1, reset, pw, refuted, late, ln, lw, lc, ltp"


def percent(x: str) -> str:
    return f"concat(CASE WHEN {x} < 0 THEN '-' ELSE '+' END, CAST(round_even(abs({x}) * 100, 0) AS BIGINT), '%')"


def short(x: str) -> str:
    return f"CASE WHEN {x} = floor({x}) THEN CAST(CAST({x} AS BIGINT) AS VARCHAR) ELSE CAST({x} AS VARCHAR) END"


def number(x: float) -> str:
    return f"{x:g}"


def calls_with(p: dict) -> str:
    """The rule's SQL with what the reasons need, and unknowns in the rule's order, which is by name only where confirmation adds one."""
    sql = catalog_rule.rule_sql(p).replace("rating, arm, week\nFROM z", MORE + "\nFROM z").replace("q.c1 AS lc FROM l", "q.c1 AS lc, q.timepoint AS ltp FROM l")
    listed = re.search(r"list_sort\((list_filter\(.*?lambda u: u IS NOT NULL\))\)", sql, re.S)
    sql = sql.replace(listed[0], f"CASE WHEN no_week OR late OR (at_end AND {str(p['keep_at_end']).upper()}) THEN {listed[0]} ELSE {listed[1]} END")
    return sql.replace("CASE WHEN c1 <> 'BASELINE' THEN round(vn, 6) END AS vs_nadir, CASE WHEN c1 <> 'BASELINE' THEN round(vb, 6) END AS vs_baseline", "CASE WHEN c1 <> 'BASELINE' THEN vn END AS vs_nadir, CASE WHEN c1 <> 'BASELINE' THEN vb END AS vs_baseline")


def reason_sql(p: dict) -> str:
    t = worksheet.TEXTS
    up, down = percent(str(p["pd_increase"])), percent(str(p["pr_decrease"]))
    progression = f"""CASE WHEN pd_by = 'new_lesion' THEN '{t["new_lesion"]}' WHEN pd_by = 'clinical' THEN '{t["clinical"]}' WHEN pd_by = 'enhancing' AND vn >= {p["pd_increase"]} THEN concat('{t["enhancing"]}', {percent("vn")}, ' vs nadir (>= ', {up}, ')')
      WHEN pd_by = 'enhancing' THEN '{t["again"]}' ELSE concat('{t["t2_flair"]}', {percent("vt")}, ' vs nadir (>= ', {percent(str(p["t2_pd_increase"]))}, ')') END"""
    first = f"""CASE WHEN enhancing_mm3 IS NULL THEN '{t["missing"]}' WHEN pd_by IS NOT NULL AND c1 = 'SD' THEN concat({progression}, '{t["within"]}{number(p["pseudo_weeks"])}{t["radiotherapy"]}') WHEN pd_by IS NOT NULL THEN {progression}
      WHEN enhancing_mm3 = 0 AND c1 = 'PR' THEN '{t["steroids"]}' WHEN enhancing_mm3 = 0 THEN '{t["none"]}' WHEN c1 = 'SD' AND d1 = 'reference' AND bm IS FALSE THEN '{t["unmeasurable"]}' WHEN c1 = 'SD' AND d1 = 'reference' THEN '{t["no_target"]}'
      WHEN c1 = 'PR' THEN concat('{t["enhancing"]}', {percent("vb")}, ' vs baseline (<= ', {down}, ')') ELSE concat('{t["stable"]}', CASE WHEN vn IS NULL THEN '{t["no_ratio"]}' ELSE concat({percent("vn")}, ' vs nadir') END, ')') END"""
    return f"""CASE WHEN n = 0 THEN '{t["reference"]}' WHEN reset THEN concat('{t["reset"]}', {short("(SELECT min(surg.week) FROM surg WHERE surg.patient = c.patient AND surg.week > c.pw AND surg.week <= c.week)")})
      WHEN refuted AND ln IS NULL THEN concat(c1, '{t["unconfirmed"]}{number(p["confirm_weeks"])} weeks later') WHEN refuted THEN concat(c1, '{t["refuted"]}', ltp, ' (+', {short("(lw - week)")}, ' wk, scored ', lc, ')')
      ELSE concat({first}, CASE WHEN late THEN concat('{t["unconfirmable"]}', ltp, ' at +', {short("(lw - week)")}, ' wk (> {number(p["confirm_max_weeks"])}{t["too_late"]}') ELSE '' END) END"""


REASONS = f"{catalog_rule.RECORDS}, " + ", ".join(f"{k} AS (SELECT c.*, {reason_sql(p)} AS reason FROM ({calls_with(p)}) c)" for k, p in (("plain", DEFAULT), ("strict", STRICT)))


@query("i01_reasons", f"WITH {REASONS} SELECT profile, timepoint, reason FROM plain UNION ALL SELECT profile, timepoint, reason FROM strict", "scans")
def i01(spark, sf_dir):
    """Why each call was made, in words."""
    return worksheet.with_reason(catalog_rule.rule_calls(spark, sf_dir, [DEFAULT, STRICT])).select("profile", "timepoint", "reason")


SHEET = rf"""{REASONS}, k AS (SELECT p.*, min(enhancing_mm3) OVER before AS nadir_mm3, first_value(timepoint) OVER own AS baseline_tp, first_value(week) OVER own AS baseline_week FROM plain p
  WINDOW own AS (PARTITION BY patient ORDER BY n), before AS (PARTITION BY patient ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
m AS (SELECT k.*, trim(coalesce(r.rationale, '')) AS said, (SELECT min_by(q.timepoint, q.n) FROM plain q WHERE q.patient = k.patient AND q.n < k.n AND q.enhancing_mm3 = k.nadir_mm3) AS nadir_from,
  {BAND.format(v="k.enhancing_mm3")} + {BAND.format(v="k.nadir_mm3")} AS band FROM k LEFT JOIN (SELECT timepoint, rationale FROM rationale) r USING (timepoint) WHERE k.call IN ('CR', 'PR', 'SD', 'PD') AND k.rating IN ('CR', 'PR', 'SD', 'PD') AND k.call <> k.rating),
w AS (SELECT m.*, q.week AS nadir_week FROM m LEFT JOIN plain q ON q.timepoint = m.nadir_from),
sheet AS (SELECT CASE WHEN enhancing_mm3 = 0 THEN 1 WHEN regexp_matches(lower(said), '\bnew\b') OR regexp_matches(lower(said), 't2[- ]?progr') THEN 2 ELSE 3 END AS bucket, patient, timepoint, week, arm, rating AS expert, call AS calc, concat(rating, '->', call) AS shape,
  enhancing_mm3, necrosis_mm3, t2_flair_mm3, vs_nadir AS change_vs_nadir, vs_baseline AS change_vs_baseline, nadir_mm3, nadir_from, nadir_week,
  coalesce((SELECT string_agg(concat('week-', lpad(CAST(CAST(post.week AS BIGINT) AS VARCHAR), 3, '0')), '|' ORDER BY post.week) FROM post WHERE post.patient = w.patient AND post.week > w.nadir_week AND post.week < w.week), '') AS postop_between,
  baseline_tp, baseline_week, round(band, 1) AS noise_band_pp, round(abs(vs_nadir) * 100 - band, 4) AS margin_pp, coalesce(vs_baseline <= -0.5 AND vs_nadir >= 0.4, FALSE) AS rebound, lower(said) IN ('', 'none') AS rationale_blank,
  contains(lower(said), 'less than 3 months') AS less_than_3_months, driver, coalesce(provisional, '') AS provisional, replace(unknowns, ',', '|') AS unknowns, reason AS calc_reason, said AS expert_rationale, '' AS verdict, '' AS ruling FROM w)"""


def sheet(spark, sf_dir: str) -> DataFrame:
    scans = stash(frame(spark, sf_dir, "scans"))
    labels = timeline.surgical_labels(scans)
    inputs = stash(timeline.scored_scans(scans, timeline.treatments(labels)))
    return worksheet.disagreements(rule.trajectories(inputs, rule.profiles(spark, [DEFAULT])), frame(spark, sf_dir, "rationale"), labels, evaluate.CLASSES)


def shown(rows: DataFrame) -> DataFrame:
    return rows.withColumns({c: F.round(c, 6) for c in ("change_vs_nadir", "change_vs_baseline")})


@query("a12_worksheet", f"WITH {SHEET} SELECT * REPLACE (round(change_vs_nadir, 6) AS change_vs_nadir, round(change_vs_baseline, 6) AS change_vs_baseline) FROM sheet", "scans", "rationale")
def a12(spark, sf_dir):
    """The adjudicator's worksheet as a whole."""
    return shown(sheet(spark, sf_dir))


@query("i16_adjudication", f"WITH {SHEET} SELECT timepoint, expert, calc, bucket, nadir_mm3, nadir_from, postop_between, noise_band_pp, margin_pp, rebound, rationale_blank FROM sheet", "scans", "rationale")
def i16(spark, sf_dir):
    """What is needed to judge each disagreement: bucket, the nadir and its scan, operations between, noise of both volumes, margin beyond it, rebound after response, blank text."""
    return sheet(spark, sf_dir).select("timepoint", "expert", "calc", "bucket", "nadir_mm3", "nadir_from", "postop_between", "noise_band_pp", "margin_pp", "rebound", "rationale_blank")


@query("i16_shapes", f"WITH {SHEET} SELECT bucket, shape, count(*) AS n, count(*) FILTER (postop_between <> '') AS after_surgery, count(*) FILTER (margin_pp < 0) AS within_noise FROM sheet GROUP BY ALL", "scans", "rationale")
def i16_shapes(spark, sf_dir):
    """How the disagreements fall: by bucket and kind, those with an operation since the nadir, those within the noise of the volumes."""
    count = lambda c: F.count(F.when(c, 1))
    return sheet(spark, sf_dir).groupBy("bucket", "shape").agg(F.count(F.lit(1)).alias("n"), count(F.col("postop_between") != "").alias("after_surgery"), count(F.col("margin_pp") < 0).alias("within_noise"))

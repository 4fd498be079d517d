"""Queries of what expert texts say, each with SQL written out from the cases."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rationale
from ..operators import evaluate, rule
from ..sources.fixtures import frame, oracle
from . import catalog_rule

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str, *views: str):
    def keep(fn):
        QUERIES[name] = fn
        ORACLE[name] = oracle(sql, *views)
        return fn

    return keep


SHOWN = """CASE WHEN lower(trim(rationale)) IN ('', 'none') THEN '' ELSE replace(replace(replace(trim(rationale),
  'CRET', 'complete resection of the enhancing tumour'), 'PRET', 'partial resection of the enhancing tumour'), 'T2-Progr.', 'T2 progression') END"""


@query(
    "b03_clean_ratings",
    """SELECT timepoint, CASE raw WHEN 'Post-Op/PD' THEN 'PD' WHEN 'None' THEN NULL WHEN 'nan' THEN NULL ELSE raw END AS rating
    FROM (SELECT timepoint, trim(CASE WHEN timepoint % 40 = 0 THEN ' Post-Op/PD' WHEN timepoint % 40 = 1 THEN 'nan ' ELSE coalesce(rating, 'None') END) AS raw FROM scans)""",
    "scans",
)
def b03(spark, sf_dir):
    entered = F.when(F.col("timepoint") % 40 == 0, " Post-Op/PD").when(F.col("timepoint") % 40 == 1, "nan ").otherwise(F.coalesce("rating", F.lit("None")))
    return frame(spark, sf_dir, "scans").select("timepoint", rationale.cleaned_rating(entered).alias("rating"))


@query(
    "b03_clean_demographics",
    """SELECT patient,
      CASE WHEN contains(i, 'r132') OR contains(i, 'mut') THEN 'mutant' WHEN contains(i, 'wt') OR contains(i, 'wild') THEN 'wildtype'
        WHEN contains(i, 'neg') THEN 'IDH1-neg (seq. required)' ELSE 'unknown' END AS idh,
      CASE WHEN m IN ('na', 'nan', '') THEN NULL ELSE m END AS mgmt, lower(trim(sex)) AS sex, try_cast(nullif(trim(weeks), '') AS DOUBLE) AS weeks
    FROM (SELECT *, trim(lower(coalesce(idh, ''))) AS i, trim(lower(mgmt)) AS m FROM demographics)""",
    "demographics",
)
def b03_demographics(spark, sf_dir):
    rows = frame(spark, sf_dir, "demographics")
    return rows.select("patient", rationale.idh_status(F.col("idh")).alias("idh"), rationale.mgmt_status(F.col("mgmt")).alias("mgmt"), F.lower(F.trim("sex")).alias("sex"), rationale.number(F.col("weeks")).alias("weeks"))


@query("b04_rationale_display", f"SELECT timepoint, {SHOWN} AS shown FROM rationale", "rationale")
def b04(spark, sf_dir):
    return frame(spark, sf_dir, "rationale").select("timepoint", rationale.shown(F.col("rationale")).alias("shown"))


@query(
    "b05_largest_pair",
    r"""WITH p AS (SELECT timepoint, unnest(regexp_extract_all(rationale, '(\d+(?:\.\d+)?)\s*(?:mm)?\s*[x×X]\s*(\d+(?:\.\d+)?)\s*(?:mm)?', 1))::DOUBLE AS a,
      unnest(regexp_extract_all(rationale, '(\d+(?:\.\d+)?)\s*(?:mm)?\s*[x×X]\s*(\d+(?:\.\d+)?)\s*(?:mm)?', 2))::DOUBLE AS b FROM rationale)
    SELECT timepoint, max(a * b) AS product, max_by(greatest(a, b), a * b) AS long_mm, max_by(least(a, b), a * b) AS short_mm, count(*) AS pairs FROM p GROUP BY timepoint""",
    "rationale",
)
def b05(spark, sf_dir):
    rows = frame(spark, sf_dir, "rationale").select("timepoint", rationale.pairs(F.col("rationale"), rationale.LOOSE_PAIR).alias("p")).where(F.size("p") > 0)
    rows = rows.select("timepoint", F.size("p").cast("long").alias("pairs"), F.array_max("p").alias("most"))
    return rows.select("timepoint", "most.product", F.greatest("most.a", "most.b").alias("long_mm"), F.least("most.a", "most.b").alias("short_mm"), "pairs")


@query(
    "b06_rationale_features",
    r"""WITH p AS (SELECT timepoint, unnest(regexp_extract_all(rationale, '(?i)(\d+(?:\.\d+)?)\s*mm\s*[x×]\s*(\d+(?:\.\d+)?)\s*mm', 1))::DOUBLE AS a,
      unnest(regexp_extract_all(rationale, '(?i)(\d+(?:\.\d+)?)\s*mm\s*[x×]\s*(\d+(?:\.\d+)?)\s*mm', 2))::DOUBLE AS b FROM rationale),
    s AS (SELECT timepoint, sum(a * b) AS products, count(*) AS n FROM p GROUP BY timepoint)
    SELECT timepoint, coalesce(n, 0) AS n_pairs, products,
      regexp_matches(rationale, '\bCRET\b') AS cret, regexp_matches(rationale, '\bPRET\b') AS pret,
      contains(lower(rationale), 't2progr') OR contains(lower(rationale), 't2-progr') AS t2_progression,
      regexp_matches(lower(rationale), '\bnew\b') AS new_lesion, contains(lower(rationale), 'nontarget') OR contains(lower(rationale), 'non-target') AS non_target,
      contains(lower(rationale), 'avastin') OR contains(lower(rationale), 'bevacizu') AS avastin, contains(lower(rationale), 'temodal') OR contains(lower(rationale), 'temozolo') AS temodal
    FROM rationale LEFT JOIN s USING (timepoint)""",
    "rationale",
)
def b06(spark, sf_dir):
    rows = frame(spark, sf_dir, "rationale").withColumn("p", rationale.pairs(F.col("rationale"), rationale.STRICT_PAIR))
    products = F.when(F.size("p") > 0, F.aggregate("p", F.lit(0.0), lambda s, x: s + x["product"]))
    return rows.select("timepoint", F.size("p").cast("long").alias("n_pairs"), products.alias("products"), *(c.alias(k) for k, c in rationale.features(F.col("rationale")).items()))


LABELLED = f"""shown AS (SELECT timepoint, lower({SHOWN}) AS t FROM rationale),
labelled AS (SELECT timepoint, t, list_filter([
  CASE WHEN contains(replace(replace(t, 'non-target', '#'), 'non target', '#'), 'target l') THEN 'measured target lesion' END,
  CASE WHEN contains(t, 'non-target') OR contains(t, 'nontarget') OR contains(t, 'non target') OR contains(t, 'non- target') THEN 'non-target lesion' END,
  CASE WHEN regexp_matches(t, '\\bnew\\b') THEN 'new lesion' END,
  CASE WHEN contains(t, 't2 progression') OR contains(t, 't2-progr') THEN 'T2/FLAIR progression' END,
  CASE WHEN contains(t, 'non-measurable') OR contains(t, 'nonmeasurable') THEN 'non-measurable lesion' END,
  CASE WHEN contains(t, 'irradiated') THEN 'in irradiated field' END,
  CASE WHEN contains(t, 'resection of the enhancing') THEN 'resection status' END], lambda x: x IS NOT NULL) AS l FROM shown)"""


@query(
    "b07_rationale_buckets",
    f"WITH {LABELLED} SELECT timepoint, unnest(CASE WHEN len(l) > 0 THEN l WHEN t = '' THEN ['none recorded'] ELSE ['other'] END) AS label FROM labelled",
    "rationale",
)
def b07(spark, sf_dir):
    return frame(spark, sf_dir, "rationale").select("timepoint", F.explode(rationale.labels(F.col("rationale"))).alias("label"))


@query(
    "b08_new_lesion_kind",
    r"""SELECT timepoint, CASE WHEN contains(t, 'new target l') THEN 'new target' WHEN contains(t, 'new non-measurable l') THEN 'new non-measurable'
      WHEN contains(t, 'new non-target l') THEN 'new non-target' WHEN t LIKE '%new %l.%' THEN 'new (other)' ELSE '' END AS kind,
      CASE WHEN contains(t, 'new target') THEN 'target' WHEN contains(t, 'new non-target') THEN 'non-target' WHEN contains(t, 'new non-meas') THEN 'non-measurable'
      WHEN contains(t, 'new') THEN 'other' ELSE '' END AS loose_kind FROM (SELECT timepoint, lower(rationale) AS t FROM rationale)""",
    "rationale",
)
def b08(spark, sf_dir):
    return frame(spark, sf_dir, "rationale").select("timepoint", rationale.new_lesion_kind(F.col("rationale")).alias("kind"), rationale.any_new_kind(F.col("rationale")).alias("loose_kind"))


@query(
    "b09_disagreements",
    rf"""WITH {catalog_rule.CALLS}, {catalog_rule.PAIRS}
    SELECT timepoint, expert, predicted, CASE WHEN enhancing_mm3 = 0 THEN 1 WHEN regexp_matches(lower(rationale), '\bnew\b') OR contains(lower(rationale), 't2progr')
      OR contains(lower(rationale), 't2-progr') OR contains(lower(rationale), 't2 progr') THEN 2 ELSE 3 END AS bucket
    FROM pairs JOIN (SELECT timepoint, enhancing_mm3 FROM scans) USING (timepoint) JOIN (SELECT timepoint, rationale FROM rationale) USING (timepoint)
    WHERE profile = 'mrano_volumetric' AND expert <> predicted""",
    "scans", "rationale",
)
def b09(spark, sf_dir):
    calls = catalog_rule.rule_calls(spark, sf_dir, [rule.profile("mrano_volumetric")])
    rows = evaluate.scorable(calls.select("profile", "patient", "timepoint", "arm", "rating", "call")).where("expert <> predicted")
    rows = rows.join(frame(spark, sf_dir, "scans").select("timepoint", "enhancing_mm3"), "timepoint").join(frame(spark, sf_dir, "rationale").select("timepoint", "rationale"), "timepoint")
    return rows.select("timepoint", "expert", "predicted", rationale.disagreement(F.col("enhancing_mm3"), F.col("rationale")).alias("bucket"))


def percent(x: str) -> str:
    return f"concat(CASE WHEN {x} < 0 THEN '-' ELSE '+' END, CAST(CAST(round_even(abs({x}) * 100, 0) AS BIGINT) AS VARCHAR), '%')"


@query(
    "b15_detail_text",
    f"""WITH {catalog_rule.RECORDS}, calls AS ({catalog_rule.rule_sql(rule.profile("mrano_volumetric")).replace("round(vn, 6)", "vn").replace("round(vb, 6)", "vb")})
    SELECT timepoint, CASE WHEN enhancing_mm3 IS NULL THEN 'no enhancing measurement' ELSE concat(format('{{:,}}', CAST(round_even(enhancing_mm3, 0) AS BIGINT)), ' mm3',
      CASE WHEN vs_nadir IS NOT NULL THEN concat('   ', {percent("vs_nadir")}, ' vs nadir') WHEN enhancing_mm3 > 0 THEN '   nadir was 0' ELSE '' END,
      CASE WHEN vs_baseline IS NOT NULL THEN concat('   ', {percent("vs_baseline")}, ' vs baseline') ELSE '' END) END AS detail
    FROM calls JOIN (SELECT timepoint, enhancing_mm3 FROM scans) USING (timepoint) WHERE call <> 'BASELINE'""",
    "scans",
)
def b15(spark, sf_dir):
    calls = catalog_rule.rule_calls(spark, sf_dir, [rule.profile("mrano_volumetric")]).where("call <> 'BASELINE'")
    return calls.select("timepoint", rationale.detail(F.col("enhancing_mm3"), F.col("vs_nadir"), F.col("vs_baseline")).alias("detail"))

"""Queries of scalars, text, validation, cohort tables and statistics."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import cohort, evaluate, gram, order, rule, validate
from ..sources.fixtures import frame, oracle
from . import catalog_rule
from .catalog_voxel import DET

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None, *views: str):
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = oracle(sql, *views) if views else sql
        return fn

    return keep


@query("b01_week_labels", "WITH l AS (SELECT timepoint, CASE WHEN week IS NULL THEN 'undated' WHEN timepoint % 3 = 0 THEN concat('week-', lpad(CAST(CAST(week AS BIGINT) AS VARCHAR), 3, '0'), '-', CAST(timepoint % 4 AS VARCHAR)) ELSE concat('week-', lpad(CAST(CAST(week AS BIGINT) AS VARCHAR), 3, '0')) END AS label FROM scans) SELECT timepoint, label, try_cast(nullif(regexp_extract(label, '^week-(\\d+)(-\\d+)?$', 1), '') AS DOUBLE) AS week, CASE WHEN label LIKE 'week-%' THEN coalesce(try_cast(nullif(regexp_extract(label, '^week-\\d+-(\\d+)$', 1), '') AS INTEGER), 0) END AS sub FROM l", "scans")
def b01(spark, sf_dir):
    number = F.lpad(F.col("week").cast("long").cast("string"), 3, "0")
    label = F.when(F.col("week").isNull(), "undated").when(F.col("timepoint") % 3 == 0, F.concat(F.lit("week-"), number, F.lit("-"), (F.col("timepoint") % 4).cast("string"))).otherwise(F.concat(F.lit("week-"), number))
    rows = frame(spark, sf_dir, "scans").select("timepoint", label.alias("label"))
    week, sub = scalars.week_label(F.col("label"))
    return rows.select("timepoint", "label", week.alias("week"), sub.alias("sub"))


@query("b02_fractional_change", "SELECT timepoint, round(CASE WHEN p > 0 THEN (enhancing_mm3 - p) / p END, 6) AS change FROM (SELECT timepoint, enhancing_mm3, lag(enhancing_mm3) OVER (PARTITION BY patient ORDER BY rn) AS p FROM scans)", "scans")
def b02(spark, sf_dir):
    from ..operators.rule import ratio

    rows = frame(spark, sf_dir, "scans").withColumn("p", F.lag("enhancing_mm3").over(Window.partitionBy("patient").orderBy("rn")))
    return rows.select("timepoint", F.round(ratio(F.col("enhancing_mm3"), F.col("p")), 6).alias("change"))


@query("b10_phrase_counts", r"SELECT count(*) AS scans, count(*) FILTER (contains(lower(rationale), 'target')) AS target, count(*) FILTER (contains(lower(rationale), 't2')) AS t2, count(*) FILTER (contains(lower(rationale), 'target') AND contains(lower(rationale), 't2')) AS both_terms FROM rationale WHERE timepoint NOT IN (SELECT timepoint FROM scans WHERE arm = 'held_out')", "rationale", "scans")
def b10(spark, sf_dir):
    rows = frame(spark, sf_dir, "rationale").join(frame(spark, sf_dir, "scans").where("arm = 'held_out'").select("timepoint"), "timepoint", "left_anti")
    t = F.lower("rationale")
    a, b = F.contains(t, F.lit("target")), F.contains(t, F.lit("t2"))
    return rows.agg(F.count(F.lit(1)).alias("scans"), F.count(F.when(a, 1)).alias("target"), F.count(F.when(b, 1)).alias("t2"), F.count(F.when(a & b, 1)).alias("both_terms"))


BAND = "CASE WHEN enhancing_mm3 >= 60000 THEN 1.5 WHEN enhancing_mm3 >= 20000 THEN 2.8 WHEN enhancing_mm3 >= 5000 THEN 5.3 WHEN enhancing_mm3 >= 1000 THEN 14.8 WHEN enhancing_mm3 >= 0 THEN 36.6 END"


@query("b11_uncertainty_bands", f"SELECT timepoint, enhancing_mm3, CAST({BAND} AS DOUBLE) AS pp FROM scans", "scans")
def b11(spark, sf_dir):
    return frame(spark, sf_dir, "scans").select("timepoint", "enhancing_mm3", scalars.uncertainty_pp(F.col("enhancing_mm3")).alias("pp"))


S = [f"sqrt(a0{j}::DOUBLE * a0{j}::DOUBLE + a1{j}::DOUBLE * a1{j}::DOUBLE + a2{j}::DOUBLE * a2{j}::DOUBLE)" for j in range(3)]


@query("b13_grid_geometry", f"WITH g AS (SELECT patient, role, nx, ny, nz, {DET} AS v, {S[0]} AS s0, {S[1]} AS s1, {S[2]} AS s2 FROM geometry) SELECT patient, role, round(v, 6) AS voxel_mm3, round(greatest(s0, s1, s2) / least(s0, s1, s2), 4) AS anisotropy, greatest(s0, s1, s2) / least(s0, s1, s2) <= 1.01 AS isotropic, CAST(nx AS BIGINT) * ny * nz AS n_voxels FROM g", "geometry")
def b13(spark, sf_dir):
    return validate.geometry(frame(spark, sf_dir, "geometry")).select("patient", "role", F.round("voxel_mm3", 6).alias("voxel_mm3"), F.round("anisotropy", 4).alias("anisotropy"), "isotropic", "n_voxels")


C = {f"c{i}{j}": f"a{i}{j}::DOUBLE / {S[j]}" for i in range(3) for j in range(3)}


@query("l01_grid_alignment", f"""WITH g AS (SELECT *, {', '.join(f'{S[j]} AS s{j}' for j in range(3))}, {', '.join(f'{e} AS {k}' for k, e in C.items())} FROM geometry),
k AS (SELECT m.patient, CASE WHEN m.nx <> r.nx OR m.ny <> r.ny OR m.nz <> r.nz THEN 'shape_mismatch' WHEN greatest({', '.join(f'abs(m.s{j} - r.s{j})' for j in range(3))}) > 1e-4 THEN 'spacing_mismatch'
  WHEN greatest({', '.join(f'abs(m.{k} - r.{k})' for k in C)}) > 1e-3 THEN 'direction_mismatch' WHEN greatest({', '.join(f'abs(m.t{j}::DOUBLE - r.t{j}::DOUBLE)' for j in range(3))}) > 1e-3 THEN 'translation_mismatch' ELSE 'aligned' END AS code
  FROM g m JOIN g r ON m.patient = r.patient AND m.role = 'mask' AND r.role = 'mask_reference') SELECT patient, code, CASE WHEN code = 'aligned' THEN 'pass' ELSE 'fail' END AS status FROM k""", "geometry")
def l01(spark, sf_dir):
    return validate.grid_alignment(frame(spark, sf_dir, "geometry"))


@query("l06_chronology", "SELECT patient, timepoint, week, ahead FROM (SELECT *, last_value(week IGNORE NULLS) OVER (PARTITION BY patient ORDER BY timepoint ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ahead FROM scans) WHERE week < ahead", "scans")
def l06(spark, sf_dir):
    """The order of ids stands for an order that somebody claims; scans that break it are listed."""
    return validate.chronology_violations(frame(spark, sf_dir, "scans").withColumn("rn", F.col("timepoint")))


@query(
    "l05_record_invariants",
    f"""WITH {catalog_rule.RECORDS}, k AS (SELECT * FROM rec WHERE NOT contradicted) SELECT patient, 'radiotherapy_ends_before_start' AS violation FROM k WHERE n_surgeries > 0 AND patient % 13 = 0
    UNION ALL SELECT patient, 'surgeries_not_ordered' FROM k WHERE n_surgeries > 1 AND patient % 17 = 0 UNION ALL SELECT patient, 'week_not_finite' FROM k WHERE patient % 19 = 0 AND patient % 17 <> 0""",
    "scans",
)
def l05(spark, sf_dir):
    """The records that the scans give hold all invariants; here some were written down wrong: courses that end before they start, operations out of order, weeks that are no number."""
    p, told = F.col("patient"), F.col("surgeries")
    wrong = F.when(p % 17 == 0, F.reverse(told)).when(p % 19 == 0, F.concat(told, F.array(F.lit(float("nan"))))).otherwise(told)
    rows = catalog_rule.records(spark, sf_dir).withColumns({"rt_end": F.when(p % 13 == 0, F.col("rt_start") - 1).otherwise(F.col("rt_end")), "surgeries": wrong})
    return validate.record_violations(rows)


@query("d13_patient_rollup", "SELECT *, assessable >= 2 AS ready FROM (SELECT patient, count(*) AS n_scans, count(enhancing_mm3) AS usable, count(*) FILTER (enhancing_mm3 IS NOT NULL AND week IS NOT NULL AND rating IS NOT NULL) AS assessable FROM scans GROUP BY patient)", "scans")
def d13(spark, sf_dir):
    return validate.readiness(frame(spark, sf_dir, "scans"))


@query("d14_cohort_eligibility", "SELECT count(*) AS patients, count(*) FILTER (a >= 6) AS eligible, CAST(coalesce(sum(a) FILTER (a >= 6), 0) AS BIGINT) AS scans, round(avg(span) FILTER (a >= 6), 6) AS mean_span FROM (SELECT patient, count(*) FILTER (enhancing_mm3 IS NOT NULL AND week IS NOT NULL AND rating IS NOT NULL) AS a, max(week) - min(week) AS span FROM scans GROUP BY patient)", "scans")
def d14(spark, sf_dir):
    scans = frame(spark, sf_dir, "scans")
    rows = validate.readiness(scans).join(scans.groupBy("patient").agg((F.max("week") - F.min("week")).alias("span")), "patient")
    ok = F.col("assessable") >= 6
    return rows.agg(F.count(F.lit(1)).alias("patients"), F.count(F.when(ok, 1)).alias("eligible"), F.coalesce(F.sum(F.when(ok, F.col("assessable"))), F.lit(0)).alias("scans"), F.round(F.avg(F.when(ok, F.col("span"))), 6).alias("mean_span"))


@query("e14_stratified_stride", "WITH p AS (SELECT patient, count(*) AS n, bool_or(coalesce(rating = 'CR', FALSE)) AS has_cr FROM scans GROUP BY patient) SELECT patient, has_cr, CASE WHEN (row_number() OVER (PARTITION BY has_cr ORDER BY n DESC, patient) - 1) % 4 = 0 THEN 'practice' ELSE 'held_out' END AS arm FROM p", "scans")
def e14(spark, sf_dir):
    rows = frame(spark, sf_dir, "scans").groupBy("patient").agg(F.count(F.lit(1)).alias("n"), F.bool_or(F.coalesce(F.col("rating") == "CR", F.lit(False))).alias("has_cr"))
    # places from the sizes of (stratum, number of scans) with a running total, so that only patients with as many scans are ordered together
    more = Window.partitionBy("has_cr").orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy("has_cr", "n").agg(F.count(F.lit(1)).alias("m")).withColumn("offset", F.coalesce(F.sum("m").over(more), F.lit(0)))
    rows = rows.join(sizes, ["has_cr", "n"])
    turn = F.col("offset") + F.row_number().over(Window.partitionBy("has_cr", "n").orderBy("patient")) - 1
    return rows.select("patient", "has_cr", F.when(turn % 4 == 0, "practice").otherwise("held_out").alias("arm"))


@query("e08_nadir_provenance", "SELECT timepoint, nadir_mm3, (SELECT min_by(q.timepoint, q.rn) FROM scans q WHERE q.patient = s.patient AND q.rn < s.rn AND q.enhancing_mm3 = nadir_mm3) AS nadir_timepoint FROM (SELECT *, min(enhancing_mm3) OVER (PARTITION BY patient ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS nadir_mm3 FROM scans) s", "scans")
def e08(spark, sf_dir):
    w = Window.partitionBy("patient").orderBy("rn").rowsBetween(Window.unboundedPreceding, -1)
    low = F.min(F.when(F.col("enhancing_mm3").isNotNull(), F.struct("enhancing_mm3", "rn", "timepoint"))).over(w)
    return frame(spark, sf_dir, "scans").select("timepoint", low.alias("low")).select("timepoint", F.col("low.enhancing_mm3").alias("nadir_mm3"), F.col("low.timepoint").alias("nadir_timepoint"))


@query("e09_visit_gaps", "SELECT quantile_cont(gap, 0.25) AS q1, quantile_cont(gap, 0.5) AS median, quantile_cont(gap, 0.75) AS q3, count(*) AS n FROM (SELECT week - lag(week) OVER (PARTITION BY patient ORDER BY week) AS gap FROM (SELECT DISTINCT patient, week FROM scans WHERE week IS NOT NULL)) WHERE gap IS NOT NULL", "scans")
def e09(spark, sf_dir):
    rows = frame(spark, sf_dir, "scans").where("week IS NOT NULL").select("patient", "week").distinct()
    gaps = rows.select((F.col("week") - F.lag("week").over(Window.partitionBy("patient").orderBy("week"))).alias("gap")).where("gap IS NOT NULL")
    return order.percentiles(gaps, "gap", {"q1": 0.25, "median": 0.5, "q3": 0.75})


@query("e11_transitions", "SELECT a, b, count(*) AS n FROM (SELECT rating AS a, lead(rating) OVER (PARTITION BY patient ORDER BY rn) AS b FROM scans WHERE rating IN ('CR', 'PR', 'SD', 'PD', 'Post-Op')) WHERE b IS NOT NULL GROUP BY ALL", "scans")
def e11(spark, sf_dir):
    rows = frame(spark, sf_dir, "scans").where(F.col("rating").isin("CR", "PR", "SD", "PD", "Post-Op"))
    return rows.select(F.col("rating").alias("a"), F.lead("rating").over(Window.partitionBy("patient").orderBy("rn")).alias("b")).where("b IS NOT NULL").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


@query("e12_time_to_progression", "WITH p AS (SELECT patient, min(week) FILTER (rating = 'Post-Op') AS start, bool_or(rating = 'CR') AS cr, bool_or(rating = 'PR') AS pr, bool_or(rating = 'SD') AS sd, bool_or(rating = 'PD') AS pd FROM scans GROUP BY patient) SELECT p.patient, min(s.week) - any_value(start) AS weeks_to_progression, any_value(CASE WHEN cr THEN 'CR' WHEN pr THEN 'PR' WHEN sd THEN 'SD' WHEN pd THEN 'PD' END) AS best FROM p LEFT JOIN scans s ON s.patient = p.patient AND s.rating = 'PD' AND s.week >= start GROUP BY p.patient", "scans")
def e12(spark, sf_dir):
    scans = frame(spark, sf_dir, "scans")
    w = Window.partitionBy("patient")
    rows = scans.withColumn("start", F.min(F.when(F.col("rating") == "Post-Op", F.col("week"))).over(w))
    best = F.lit(None).cast("string")
    for c in ("PD", "SD", "PR", "CR"):
        best = F.when(F.bool_or(F.col("rating") == c), c).otherwise(best)
    return rows.groupBy("patient").agg((F.min(F.when((F.col("rating") == "PD") & (F.col("week") >= F.col("start")), F.col("week"))) - F.first("start")).alias("weeks_to_progression"), best.alias("best"))


@query("c10_latest_postop", "SELECT timepoint, last_value(CASE WHEN rating = 'Post-Op' THEN timepoint END IGNORE NULLS) OVER (PARTITION BY patient ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS latest_postop FROM scans", "scans")
def c10(spark, sf_dir):
    w = Window.partitionBy("patient").orderBy("rn").rowsBetween(Window.unboundedPreceding, -1)
    return frame(spark, sf_dir, "scans").select("timepoint", F.last(F.when(F.col("rating") == "Post-Op", F.col("timepoint")), ignorenulls=True).over(w).alias("latest_postop"))


@query("d19_follow_up", "SELECT n, count(*) AS patients, round(avg(span), 6) AS mean_span FROM (SELECT patient, count(*) AS n, max(week) - min(week) AS span FROM scans GROUP BY patient) GROUP BY n", "scans")
def d19(spark, sf_dir):
    rows = frame(spark, sf_dir, "scans").groupBy("patient").agg(F.count(F.lit(1)).alias("n"), (F.max("week") - F.min("week")).alias("span"))
    return rows.groupBy("n").agg(F.count(F.lit(1)).alias("patients"), F.round(F.avg("span"), 6).alias("mean_span"))


@query("d22_silent_scans", "SELECT rating, arm, count(*) AS n, count(*) FILTER (enhancing_mm3 = 0) AS no_enhancing FROM scans WHERE rating IN ('CR', 'PR', 'SD', 'PD') GROUP BY ALL", "scans")
def d22(spark, sf_dir):
    return frame(spark, sf_dir, "scans").where(F.col("rating").isin(*evaluate.CLASSES)).groupBy("rating", "arm").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("enhancing_mm3") == 0, 1)).alias("no_enhancing"))


@query("d34_size_histogram", f"SELECT CAST({BAND} AS DOUBLE) AS pp, rating, count(*) AS n FROM scans GROUP BY ALL", "scans")
def d34(spark, sf_dir):
    return frame(spark, sf_dir, "scans").groupBy(scalars.uncertainty_pp(F.col("enhancing_mm3")).alias("pp"), "rating").agg(F.count(F.lit(1)).alias("n"))


KM = "e AS (SELECT grp, weeks, count(*) AS deaths FROM survival GROUP BY ALL), r AS (SELECT *, sum(deaths) OVER (PARTITION BY grp ORDER BY weeks DESC) AS at_risk FROM e), k AS (SELECT *, CASE WHEN deaths < at_risk THEN exp(sum(CASE WHEN deaths < at_risk THEN ln(1 - deaths / at_risk) END) OVER (PARTITION BY grp ORDER BY weeks)) ELSE 0.0 END AS survival FROM r)"


@query("k01_kaplan_meier", f"WITH {KM} SELECT grp, weeks, deaths, CAST(at_risk AS BIGINT) AS at_risk, round(survival, 6) AS survival FROM k", "survival")
def k01(spark, sf_dir):
    return cohort.kaplan_meier(frame(spark, sf_dir, "survival")).withColumn("survival", F.round("survival", 6))


@query("k01_median_survival", f"WITH {KM} SELECT grp, min(weeks) FILTER (survival <= 0.5 + 1e-12) AS median_weeks FROM k GROUP BY grp", "survival")
def k01m(spark, sf_dir):
    return cohort.median_survival(cohort.kaplan_meier(frame(spark, sf_dir, "survival")))


@query("k02_log_rank", "WITH p AS (SELECT weeks, count(*) AS d, count(*) FILTER (grp = 'BUILDING') AS da FROM survival WHERE grp IN ('BUILDING', 'MACHINERY') GROUP BY weeks), n AS (SELECT *, sum(d) OVER (ORDER BY weeks DESC) AS n, sum(da) OVER (ORDER BY weeks DESC) AS na FROM p), s AS (SELECT sum(da) AS observed, sum(d * na / n) AS expected, sum(CASE WHEN n > 1 THEN d * (na / n) * (1 - na / n) * (n - d) / (n - 1) ELSE 0 END) AS variance FROM n), x AS (SELECT *, (observed - expected) * (observed - expected) / variance AS chi2 FROM s), e AS (SELECT sqrt(chi2 / 2) AS z, 0 AS k, sqrt(chi2 / 2) AS term, sqrt(chi2 / 2) AS total FROM x UNION ALL SELECT z, k + 1, term * 2 * z * z / (2 * k + 3), total + term * 2 * z * z / (2 * k + 3) FROM e WHERE k < 300) SELECT CAST(observed AS BIGINT) AS observed, round(expected, 6) AS expected, round((observed - expected) * (observed - expected) / variance, 6) AS chi2, round(1 - 2 / sqrt(pi()) * exp(-chi2 / 2) * (SELECT max(total) FROM e), 9) AS p FROM x", "survival")
def k02(spark, sf_dir):
    return cohort.log_rank(frame(spark, sf_dir, "survival"), "BUILDING", "MACHINERY").select("observed", F.round("expected", 6).alias("expected"), F.round("chi2", 6).alias("chi2"), F.round("p", 9).alias("p"))


ORACLE["k02_log_rank"] = ORACLE["k02_log_rank"].replace("WITH ", "WITH RECURSIVE ", 1)


@query("k03_spearman", "WITH r AS (SELECT rank() OVER (ORDER BY tool_a) + (count(*) OVER (PARTITION BY tool_a) - 1) / 2.0 AS a, rank() OVER (ORDER BY tool_b) + (count(*) OVER (PARTITION BY tool_b) - 1) / 2.0 AS b FROM methods) SELECT count(*) AS n, round(corr(a, b), 6) AS rho FROM r", "methods")
def k03(spark, sf_dir):
    return cohort.spearman(frame(spark, sf_dir, "methods"), "tool_a", "tool_b").withColumn("rho", F.round("rho", 6))


@query("k04_bland_altman", "SELECT count(d) AS n, round(avg(d), 6) AS bias, round(avg(d) - 1.96 * stddev_samp(d), 6) AS low, round(avg(d) + 1.96 * stddev_samp(d), 6) AS high FROM (SELECT tool_a - tool_b AS d FROM methods)", "methods")
def k04(spark, sf_dir):
    return cohort.bland_altman(frame(spark, sf_dir, "methods"), "tool_a", "tool_b").select("n", *(F.round(c, 6).alias(c) for c in ("bias", "low", "high")))


@query("k05_feature_auc", "WITH v AS (SELECT label = 1 AS pos, unnest(embedding) AS value, generate_subscripts(embedding, 1) - 1 AS feature FROM embeddings), r AS (SELECT *, rank() OVER (PARTITION BY feature ORDER BY value) + (count(*) OVER (PARTITION BY feature, value) - 1) / 2.0 AS k FROM v), a AS (SELECT feature, count(*) FILTER (pos) AS n_pos, count(*) FILTER (NOT pos) AS n_neg, sum(k) FILTER (pos) AS s FROM r GROUP BY feature) SELECT CAST(feature AS INTEGER) AS feature, n_pos, n_neg, round((s - n_pos * (n_pos + 1) / 2) / (n_pos * n_neg), 6) AS auc FROM a WHERE n_pos >= 6 AND n_neg >= 6")
def k05(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return cohort.feature_auc(rows, "embedding", F.col("label") == 1).withColumn("auc", F.round("auc", 6))


@query("k06_correlations_whole", "SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, round(abs(corr(embedding[i + 1]::DOUBLE, embedding[j + 1]::DOUBLE)), 6) AS abs_corr FROM embeddings, range(0, (SELECT max(len(embedding)) FROM embeddings)) a(i), range(0, (SELECT max(len(embedding)) FROM embeddings)) b(j) WHERE i < j GROUP BY ALL")
def k06_whole(spark, sf_dir):
    return gram.all_correlations(embedded(spark, sf_dir), "embedding").withColumn("abs_corr", F.round("abs_corr", 6))


# all pairs too; a smaller form had this name before
QUERIES["k06_correlations"], ORACLE["k06_correlations"] = QUERIES["k06_correlations_whole"], ORACLE["k06_correlations_whole"]


def embedded(spark, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


@query("k07_pca")
def k07(spark, sf_dir):
    return gram.components(embedded(spark, sf_dir), "embedding")[0]


@query("k07_loadings")
def k07_loadings(spark, sf_dir):
    return gram.components(embedded(spark, sf_dir), "embedding")[1]


@query("k07_scores")
def k07_scores(spark, sf_dir):
    rows = embedded(spark, sf_dir)
    _, _, mean, weights = gram.components(rows, "embedding")
    return gram.scores(rows, "vec_id", "embedding", mean, weights)


@query("k08_sign_test", f"WITH {catalog_rule.CALLS}, {catalog_rule.PAIRS}, d AS (SELECT count(*) FILTER (a.predicted = a.expert AND b.predicted <> b.expert) AS lost, count(*) FILTER (a.predicted <> a.expert AND b.predicted = b.expert) AS won FROM pairs a JOIN pairs b ON a.timepoint = b.timepoint AND a.profile = 'mrano_volumetric' AND b.profile = 'rano_classic_ported') SELECT lost, won, round(least(1.0, 2 * (SELECT sum(exp(lgamma(lost + won + 1) - lgamma(i + 1) - lgamma(lost + won - i + 1) - (lost + won) * ln(2))) FROM range(0, least(lost, won) + 1) r(i))), 6) AS p FROM d", "scans")
def k08(spark, sf_dir):
    old, new = "mrano_volumetric", "rano_classic_ported"
    rows = evaluate.scorable(catalog_rule.rule_calls(spark, sf_dir, [rule.profile(old), rule.profile(new)]))
    return evaluate.disagreements(rows, old, new).select("lost", "won", F.round(evaluate.sign_test(F.col("won"), F.col("won") + F.col("lost")), 6).alias("p"))


def patient_counts(rows: DataFrame) -> DataFrame:
    """Per patient and class: scans that both rules score, and the right calls of mrano_volumetric (a) and rano_classic_ported (b) on them."""
    def of(name: str) -> Column:
        return F.max(F.when(F.col("profile") == name, F.col("predicted")))

    both = rows.groupBy("patient", "timepoint").agg(F.max("expert").alias("expert"), of("mrano_volumetric").alias("a"), of("rano_classic_ported").alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    right = {"n": F.lit(True), "a": F.col("a") == F.col("expert"), "b": F.col("b") == F.col("expert")}
    return both.groupBy("patient").agg(*(F.count(F.when((F.col("expert") == c) & hit, 1)).alias(f"{x}_{c}") for x, hit in right.items() for c in evaluate.CLASSES))


@query("k09_bootstrap")
def k09(spark, sf_dir):
    per = patient_counts(evaluate.scorable(catalog_rule.rule_calls(spark, sf_dir)))
    return cohort.bootstrap_difference(per, evaluate.CLASSES).agg(F.avg("difference").alias("mean"), F.percentile("difference", 0.025).alias("low"), F.percentile("difference", 0.975).alias("high"))

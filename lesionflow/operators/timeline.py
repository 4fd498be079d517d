"""Treatment timelines: surgeries from rating labels, radiotherapy from the first of them, scan placement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Weeks from the first operation to the start of radiotherapy, and its length; weeks after it that a starting scan needs, and from which it is late.
RECOVERY_WEEKS, COURSE_WEEKS, MIN_AFTER, LATE_AFTER = 4.0, 6.0, 4.0, 12.0


def surgical_labels(scans: DataFrame) -> DataFrame:
    """patient, pre, post, all_weeks: sorted distinct weeks of dated scans by label; response calls are not kept."""
    def weeks(c: Column) -> Column:
        return F.array_sort(F.collect_set(c))

    rows = scans.where(F.col("week").isNotNull())
    return rows.groupBy("patient").agg(
        weeks(F.when(F.col("rating") == "Pre-Op", F.col("week"))).alias("pre"), weeks(F.when(F.col("rating") == "Post-Op", F.col("week"))).alias("post"), weeks(F.col("week")).alias("all_weeks"))


def treatments(labels: DataFrame) -> DataFrame:
    """patient, surgeries, rt_start, rt_end, contradicted. A Pre-Op scan whose next scan comes without a Post-Op label
    between them contradicts the record, which is then unknown (NULL), not empty. Post-Op labels with no other
    scan between them are one operation."""
    def unlabelled(p: Column) -> Column:
        following = F.array_min(F.filter("all_weeks", lambda w: w > p))
        return following.isNotNull() & ~F.exists("post", lambda q: (q >= p) & (q <= following))

    def starts(q: Column, i: Column) -> Column:
        return (i == 0) | F.exists("all_weeks", lambda w: (w > F.get(F.col("post"), i - 1)) & (w < q))

    rows = labels.withColumn("contradicted", F.exists("pre", unlabelled))
    rows = rows.withColumn("surgeries", F.when(~F.col("contradicted"), F.filter("post", starts)))
    start = F.get(F.col("surgeries"), F.lit(0)) + RECOVERY_WEEKS
    return rows.select("patient", "surgeries", start.alias("rt_start"), (start + COURSE_WEEKS).alias("rt_end"), "contradicted")


def placed(scans: DataFrame, records: DataFrame) -> DataFrame:
    """Adds stage, weeks_after_rt and late to scans (patient, timepoint, week): where on the treatment timeline each dated scan lies."""
    rows = scans.join(records, "patient", "left")
    week = F.col("week")
    last = F.array_max(F.filter("surgeries", lambda s: s <= week))
    known = F.col("surgeries").isNotNull()
    gap = week - F.col("rt_end")
    stage = (
        F.when(week.isNull(), F.lit(None).cast("string")).when(~known, "unknown")
        .when((F.size("surgeries") > 0) & (week < F.get(F.col("surgeries"), F.lit(0))), "before_surgery")
        .when(F.col("rt_start").isNull(), "unknown").when(last > F.col("rt_end"), "after_surgery").when(week < F.col("rt_start"), "after_surgery")
        .when(week <= F.col("rt_end"), "during_radiotherapy").when(gap < MIN_AFTER, "too_soon_after_radiotherapy").otherwise("after_radiotherapy")
    )
    rows = rows.withColumn("stage", stage)
    after = F.col("stage").isin("too_soon_after_radiotherapy", "after_radiotherapy")
    return rows.withColumns({"weeks_after_rt": F.when(after, gap), "late": (F.col("stage") == "after_radiotherapy") & (gap > LATE_AFTER)})


def first_eligible(scans: DataFrame) -> DataFrame:
    """patient, timepoint of the first scan (by rn) after radiotherapy; patients without one have NULL."""
    return scans.groupBy("patient").agg(F.min_by("timepoint", F.when(F.col("stage") == "after_radiotherapy", F.col("rn"))).alias("baseline_timepoint"), F.count(F.when(F.col("stage") == "after_radiotherapy", 1)).alias("n_eligible"))


def chronological(scans: DataFrame) -> DataFrame:
    """Adds rn per patient: by week, undated last, then by timepoint."""
    return scans.withColumn("rn", F.row_number().over(Window.partitionBy("patient").orderBy(F.col("week").asc_nulls_last(), "timepoint")))


def scored_scans(scans: DataFrame, records: DataFrame) -> DataFrame:
    """Scans that the rule sees: Pre-Op studies leave, order is renumbered, surgeries join by patient."""
    kept = scans.where(~F.col("rating").eqNullSafe("Pre-Op"))
    return chronological(kept.drop("rn")).join(records.select("patient", "surgeries"), "patient", "left")


def since_radiotherapy(scans: DataFrame, records: DataFrame, cohort_end: float) -> DataFrame:
    """``weeks_since_rt`` after the patient's own course where its end is known, else after the cohort's (none where that is negative)."""
    end = F.coalesce(F.col("rt_end"), F.lit(cohort_end) if cohort_end >= 0 else F.lit(None).cast("double"))
    return scans.drop("weeks_since_rt").join(records.select("patient", "rt_end"), "patient", "left").withColumn("weeks_since_rt", F.col("week") - end).drop("rt_end")


def scans_after_radiotherapy(scans: DataFrame, records: DataFrame, cohort_end: float) -> DataFrame:
    """Scans that the rule sees when the reference is each patient's first scan far enough past radiotherapy: that one and all later ones;
    patients without one are left out. Pre-Op studies leave first."""
    kept = chronological(scans.where(~F.col("rating").eqNullSafe("Pre-Op")).drop("rn"))
    first = Window.partitionBy("patient")
    rows = placed(kept, records).withColumn("from", F.min(F.when(F.col("stage") == "after_radiotherapy", F.col("rn"))).over(first)).where(F.col("rn") >= F.col("from"))
    rows = since_radiotherapy(rows.drop("from", "stage", "weeks_after_rt", "late", "rt_start", "rt_end", "contradicted", "surgeries"), records, cohort_end)
    return chronological(rows.drop("rn")).join(records.select("patient", "surgeries"), "patient", "left")

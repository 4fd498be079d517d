"""What an adjudicator reads: why the rule made a call, where its references come from, and one row with all of it for each disagreement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rationale, scalars

#: The texts of reasons.
TEXTS = {
    "reference": "reference scan for this trajectory",
    "reset": "reference reset: operation at week ",
    "missing": "no enhancing volume measured",
    "new_lesion": "new lesion",
    "clinical": "definite clinical deterioration",
    "again": "enhancing disease re-emerged after a complete response",
    "enhancing": "enhancing volume ",
    "t2_flair": "T2/FLAIR volume ",
    "within": ", but within ",
    "radiotherapy": " weeks of radiotherapy -- not callable as PD without histology or an out-of-field lesion",
    "steroids": "no enhancing disease, but steroids increased",
    "none": "no enhancing disease",
    "unmeasurable": "response threshold met, but the reference scan held no lesion big enough to measure (>= 10 x 10 mm); PR is not available",
    "no_target": "response threshold met but disease is non-measurable; PR is not available",
    "stable": "neither response nor progression (",
    "no_ratio": "no usable nadir ratio",
    "unconfirmable": "; unconfirmable -- nearest later scan is ",
    "too_late": " wk, too late to confirm)",
    "unconfirmed": " unconfirmed -- no scan >= ",
    "refuted": " not confirmed at ",
}


def signed(share: Column) -> Column:
    """A share as a whole percentage with its sign."""
    return F.concat(F.when(share < 0, "-").otherwise("+"), F.bround(F.abs(share) * 100, 0).cast("bigint").cast("string"), F.lit("%"))


def short(number: Column) -> Column:
    """A number without needless decimals."""
    return F.when(number == F.floor(number), number.cast("bigint").cast("string")).otherwise(number.cast("string"))


def with_reason(calls: DataFrame) -> DataFrame:
    """Adds ``reason`` to the rows of ``rule.trajectories``."""
    t = {k: F.lit(v) for k, v in TEXTS.items()}
    v, nadir, vs_nadir, vs_base = F.col("enhancing_mm3"), F.col("nadir"), F.col("vs_nadir"), F.col("vs_baseline")
    c = F.col
    progression = (
        F.when(c("pd_by") == "new_lesion", t["new_lesion"]).when(c("pd_by") == "clinical", t["clinical"])
        .when((c("pd_by") == "enhancing") & (vs_nadir >= c("pd_increase")), F.concat(t["enhancing"], signed(vs_nadir), F.lit(" vs nadir (>= "), signed(c("pd_increase")), F.lit(")")))
        .when(c("pd_by") == "enhancing", t["again"])
        .when(c("pd_by") == "t2_flair", F.concat(t["t2_flair"], signed(c("t2_vs_nadir")), F.lit(" vs nadir (>= "), signed(c("t2_pd_increase")), F.lit(")")))
    )
    stable = F.concat(t["stable"], F.coalesce(F.concat(signed(vs_nadir), F.lit(" vs nadir")), t["no_ratio"]), F.lit(")"))
    blocked = (c("first_call") == "SD") & (c("driver") == "reference")
    base = c("measurable_baseline") & F.coalesce(~c("baseline_measurable"), F.lit(False))
    first = (
        F.when(v.isNull(), t["missing"]).when(c("pd_by").isNotNull() & (c("first_call") == "SD"), F.concat(progression, t["within"], short(c("pseudo_weeks")), t["radiotherapy"]))
        .when(c("pd_by").isNotNull(), progression).when((v == 0) & (c("first_call") == "PR"), t["steroids"]).when(v == 0, t["none"])
        .when(blocked & base, t["unmeasurable"]).when(blocked, t["no_target"])
        .when(c("first_call") == "PR", F.concat(t["enhancing"], signed(vs_base), F.lit(" vs baseline (<= "), signed(c("pr_decrease")), F.lit(")"))).otherwise(stable)
    )
    later = c("confirming")
    gap = F.concat(F.lit("+"), short(later["week"] - c("week")), F.lit(" wk"))
    operation = F.array_min(F.filter("surgeries", lambda w: (w > c("previous_week")) & (w <= c("week"))))
    place = later["timepoint"].cast("string")
    reason = (
        F.when(c("n") == 0, t["reference"]).when(c("reset"), F.concat(t["reset"], short(operation)))
        .when(c("refuted") & later.isNull(), F.concat(c("first_call"), t["unconfirmed"], short(c("confirm_weeks")), F.lit(" weeks later")))
        .when(c("refuted"), F.concat(c("first_call"), t["refuted"], place, F.lit(" ("), gap, F.lit(", scored "), later["call"], F.lit(")")))
        .when(c("too_late"), F.concat(first, t["unconfirmable"], place, F.lit(" at "), gap, F.lit(" (> "), short(c("confirm_max_weeks")), t["too_late"])).otherwise(first)
    )
    return calls.withColumn("reason", reason)


def replayed(calls: DataFrame) -> DataFrame:
    """Adds nadir_mm3, nadir_from and nadir_week: the smallest volume of the patient's earlier scans, from the first scan on and over operations, and the first scan that has it; and the
    patient's first scan as baseline_tp and baseline_week."""
    own = Window.partitionBy("profile", "patient").orderBy("n")
    scan = F.when(F.col("enhancing_mm3").isNotNull(), F.struct("enhancing_mm3", "n", "timepoint", "week"))
    rows = calls.withColumn("low", F.min(scan).over(own.rowsBetween(Window.unboundedPreceding, -1)))
    start = F.first(F.struct("timepoint", "week")).over(own.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumns({"nadir_mm3": F.col("low.enhancing_mm3"), "nadir_from": F.col("low.timepoint"), "nadir_week": F.col("low.week"), "start": start}).withColumns({"baseline_tp": F.col("start.timepoint"), "baseline_week": F.col("start.week")}).drop("low", "start")


def disagreements(calls: DataFrame, texts: DataFrame, labels: DataFrame, classes: list[str]) -> DataFrame:
    """The worksheet: a row for each scan that the rule and the expert call differently, with verdict and ruling to be filled in.

    texts: timepoint, rationale. labels: patient, post (weeks labelled Post-Op, as ``timeline.surgical_labels`` has them). An operation strictly between the nadir's scan and this one voids the comparison;
    the bands of both volumes add up, as the relative errors of a ratio do."""
    rows = replayed(with_reason(calls)).where(F.col("call").isin(*classes) & F.col("rating").isin(*classes) & (F.col("call") != F.col("rating")))
    rows = rows.join(texts.select("timepoint", "rationale"), "timepoint", "left").join(labels.select("patient", "post"), "patient", "left")
    between = F.filter("post", lambda w: (w > F.col("nadir_week")) & (w < F.col("week")))
    shown = F.coalesce(F.array_join(F.transform(between, lambda w: F.concat(F.lit("week-"), F.lpad(w.cast("bigint").cast("string"), 3, "0"))), "|"), F.lit(""))
    band = scalars.uncertainty_pp(F.col("enhancing_mm3")) + scalars.uncertainty_pp(F.col("nadir_mm3"))
    text = F.trim(F.coalesce("rationale", F.lit("")))
    rebound = F.coalesce((F.col("vs_baseline") <= -0.5) & (F.col("vs_nadir") >= 0.4), F.lit(False))
    soon = F.contains(F.lower(text), F.lit("less than 3 months"))
    return rows.select(
        rationale.disagreement(F.col("enhancing_mm3"), text).alias("bucket"), "patient", "timepoint", "week", "arm", F.col("rating").alias("expert"), F.col("call").alias("calc"), F.concat("rating", F.lit("->"), "call").alias("shape"),
        "enhancing_mm3", "necrosis_mm3", "t2_flair_mm3", F.col("vs_nadir").alias("change_vs_nadir"), F.col("vs_baseline").alias("change_vs_baseline"), "nadir_mm3", "nadir_from", "nadir_week", shown.alias("postop_between"),
        "baseline_tp", "baseline_week", F.round(band, 1).alias("noise_band_pp"), F.round(F.abs("vs_nadir") * 100 - band, 4).alias("margin_pp"), rebound.alias("rebound"), F.lower(text).isin("", "none").alias("rationale_blank"),
        soon.alias("less_than_3_months"), "driver", F.coalesce("provisional", F.lit("")).alias("provisional"), F.array_join("unknowns", "|").alias("unknowns"), F.col("reason").alias("calc_reason"), text.alias("expert_rationale"),
        F.lit("").alias("verdict"), F.lit("").alias("ruling"),
    )

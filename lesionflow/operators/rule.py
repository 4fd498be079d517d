"""The response rule as window expressions: references, single-scan calls, confirmation, trajectories.

Rows are scans (patient, timepoint, week, enhancing_mm3, ...). Unknown is NULL, never FALSE: flags count
only where they equal TRUE (or FALSE) null-safely. Progression is judged against the smallest earlier
volume of the segment (the nadir, never the scan's own), response against the segment's first scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The named parameter sets. Thresholds are fractions, windows are weeks, the floor is in mm3.
DEFAULTS = {
    "pd_increase": 0.40, "pr_decrease": -0.65, "use_t2": False, "t2_pd_increase": 0.40, "use_new_lesion": True, "use_clinical": True, "confirm": True,
    "confirm_weeks": 4.0, "confirm_max_weeks": 16.0, "keep_at_end": True, "pseudo_weeks": 12.0, "pseudo_policy": "downgrade", "floor_mm3": 10.0,
    "block_non_measurable": True, "measurable_baseline": True, "reset_at_surgery": True, "block_cr_steroids": True,
}
PROFILES = {
    "mrano_volumetric": {},
    "rano_classic_ported": {"pd_increase": 0.25, "pr_decrease": -0.50},
    "mrano_with_t2": {"use_t2": True},
    "enhancing_only": {
        "use_new_lesion": False, "use_clinical": False, "confirm": False, "pseudo_weeks": None, "block_non_measurable": False,
        "measurable_baseline": False, "reset_at_surgery": False, "block_cr_steroids": False,
    },
}
SCHEMA = (
    "profile string, pd_increase double, pr_decrease double, use_t2 boolean, t2_pd_increase double, use_new_lesion boolean, use_clinical boolean, confirm boolean, "
    "confirm_weeks double, confirm_max_weeks double, keep_at_end boolean, pseudo_weeks double, pseudo_policy string, floor_mm3 double, "
    "block_non_measurable boolean, measurable_baseline boolean, reset_at_surgery boolean, block_cr_steroids boolean"
)


def profile(name: str, **changes) -> dict:
    """A named parameter set, with fields overridden for ablations."""
    return {"profile": name, **DEFAULTS, **PROFILES.get(name, {}), **changes}


def profiles(spark, rows: list[dict] | None = None) -> DataFrame:
    """One row per parameter set; a handful of rows that is broadcast."""
    rows = rows or [profile(n) for n in PROFILES]
    names = ["profile", *DEFAULTS]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], SCHEMA)


def ratio(value: Column, reference: Column) -> Column:
    """Fractional change; NULL where either side is missing or the reference is not positive."""
    return F.when(reference > 0, (value - reference) / reference)


def is_true(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def is_false(c: Column) -> Column:
    return F.coalesce(~c, F.lit(False))


def single_scan(rows: DataFrame) -> DataFrame:
    """Adds vs_nadir, vs_baseline, t2_vs_nadir, and first-pass call, driver, provisional, risk to rows that carry
    the scan, the references (nadir, baseline, t2_nadir, baseline_measurable) and the parameters."""
    v, nadir, base = F.col("enhancing_mm3"), F.col("nadir"), F.col("baseline")
    rows = rows.withColumns({"vs_nadir": ratio(v, nadir), "vs_baseline": ratio(v, base), "t2_vs_nadir": ratio(F.col("t2_flair_mm3"), F.col("t2_nadir"))})
    far_nadir = F.abs(v - F.coalesce(nadir, F.lit(0.0))) >= F.col("floor_mm3")
    far_base = F.abs(v - F.coalesce(base, F.lit(0.0))) >= F.col("floor_mm3")
    pd_by = (
        F.when(v.isNull(), F.lit(None).cast("string"))
        .when(F.col("use_new_lesion") & is_true(F.col("new_lesion")), "new_lesion")
        .when(F.col("use_clinical") & is_true(F.col("clinical_deterioration")), "clinical")
        .when(is_true((F.col("vs_nadir") >= F.col("pd_increase")) & far_nadir), "enhancing")
        .when(is_true((nadir == 0) & (v > 0) & far_nadir), "enhancing")
        .when(F.col("use_t2") & is_true(F.col("t2_vs_nadir") >= F.col("t2_pd_increase")), "t2_flair")
    )
    rows = rows.withColumns({"pd_by": pd_by, "in_window": is_true(F.col("weeks_since_rt") < F.col("pseudo_weeks"))})
    responds = is_true((F.col("vs_baseline") <= F.col("pr_decrease")) & far_base)
    no_base = F.col("measurable_baseline") & is_false(F.col("baseline_measurable"))
    no_target = F.col("block_non_measurable") & is_true(F.col("non_measurable_only"))
    softened = F.col("in_window") & (F.col("pseudo_policy") == "downgrade")

    def made(call: str, driver: Column | str, provisional: str | None = None, risk: Column | bool = False) -> Column:
        return F.struct(F.lit(call).alias("call"), (driver if isinstance(driver, Column) else F.lit(driver)).alias("driver"), F.lit(provisional).cast("string").alias("provisional"), (risk if isinstance(risk, Column) else F.lit(risk)).alias("risk"))

    first = (
        F.when(v.isNull(), made("NE", "missing"))
        .when(F.col("pd_by").isNotNull() & softened, made("SD", "confirmation", "PD", True))
        .when(F.col("pd_by").isNotNull(), made("PD", F.col("pd_by"), None, F.col("in_window")))
        .when((v == 0) & F.col("block_cr_steroids") & is_true(F.col("steroids_increased")), made("PR", "enhancing"))
        .when(v == 0, made("CR", "enhancing"))
        .when(responds & no_base, made("SD", "reference", "PR"))
        .when(responds & no_target, made("SD", "reference", "PR"))
        .when(responds, made("PR", "enhancing"))
        .otherwise(made("SD", "enhancing"))
    )
    return rows.withColumn("first", first).select("*", "first.*").drop("first")


def unknowns(call: Column) -> Column:
    """Missing inputs that could have changed this call, in fixed order."""
    def missing(c: Column, name: str) -> Column:
        return F.when(c, name)

    not_pd = call != "PD"
    return F.filter(F.array(
        missing(not_pd & F.col("use_new_lesion") & F.col("new_lesion").isNull(), "new_lesion"),
        missing(not_pd & F.col("use_clinical") & F.col("clinical_deterioration").isNull(), "clinical"),
        missing(not_pd & F.col("use_t2") & (F.col("t2_flair_mm3").isNull() | F.col("t2_nadir").isNull()), "t2_flair"),
        missing((call == "CR") & F.col("block_cr_steroids") & F.col("steroids_increased").isNull(), "steroids"),
        missing((call == "PR") & F.col("block_non_measurable") & F.col("non_measurable_only").isNull(), "non_measurable"),
        missing((call == "PR") & F.col("measurable_baseline") & F.col("baseline_measurable").isNull(), "baseline_measurable"),
    ), lambda x: x.isNotNull())


def references(scans: DataFrame, reset: bool) -> DataFrame:
    """Adds n (0 for the reference scan), reset, segment, baseline, baseline_measurable, nadir, t2_nadir.

    Needs rn (chronological, from 1) and surgeries (array of weeks, NULL when unknown). The nadir and the
    baseline do not depend on thresholds, so this runs once for each reset mode and serves all profiles."""
    by_patient = Window.partitionBy("patient").orderBy("rn")
    earlier = by_patient.rowsBetween(Window.unboundedPreceding, -1)
    rows = scans.withColumn("n", F.row_number().over(by_patient) - 1).withColumn("previous_week", F.last("week", ignorenulls=True).over(earlier))
    operated = F.exists(F.coalesce("surgeries", F.array().cast("array<double>")), lambda w: is_true((F.col("previous_week") < w) & (w <= F.col("week"))))
    rows = rows.withColumn("reset", (F.col("n") > 0) & operated if reset else F.lit(False))
    rows = rows.withColumn("segment", F.sum(F.col("reset").cast("int")).over(by_patient.rowsBetween(Window.unboundedPreceding, 0)))
    inside = Window.partitionBy("patient", "segment").orderBy("rn")
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    whole = inside.rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumns({
        "baseline": F.first("enhancing_mm3").over(whole), "baseline_measurable": F.first("measurable_disease").over(whole),
        "nadir": F.min("enhancing_mm3").over(before), "t2_nadir": F.min("t2_flair_mm3").over(before),
    })


#: Fields that only the confirmation reads: parameter sets that agree in all others share their first pass and the look ahead.
LAST = ("profile", "confirm", "confirm_max_weeks", "keep_at_end")


def trajectories(scans: DataFrame, params: DataFrame) -> DataFrame:
    """Every scan's call under every parameter set: references, resets, single-scan calls, confirmation.

    The first scan of a patient is the reference, and the first after an operation a new one; both are
    BASELINE and not scored. Confirmation looks at the first dated scan at least ``confirm_weeks`` on, by
    its first-pass call: later than ``confirm_max_weeks`` or none keeps the call and says so. All four
    parameter sets share one ``confirm_weeks``, which bounds a RANGE frame; sets that differ in it are
    run apart and united. Sets that differ in LAST only are told apart after the look ahead."""
    shared = [c for c in params.columns if c not in LAST]
    first = params.groupBy(*shared).agg(F.sort_array(F.collect_list(F.struct(*LAST))).alias("sets")).withColumn("pass", F.col("sets")[0]["profile"])
    out = None
    for reset in sorted(r[0] for r in params.select("reset_at_surgery").distinct().collect()):  # one or both, of a handful of rows
        rows = references(scans, reset).crossJoin(F.broadcast(first.where(F.col("reset_at_surgery") == reset)))
        out = rows if out is None else out.unionByName(rows)
    rows = single_scan(out)
    is_base = (F.col("n") == 0) | F.col("reset")
    for name, value in (("call", "BASELINE"), ("driver", "reference"), ("provisional", None), ("risk", False)):
        rows = rows.withColumn(name, F.when(is_base, F.lit(value)).otherwise(F.col(name)))
    gaps = [r[0] for r in params.select("confirm_weeks").distinct().collect()]
    done = None
    for weeks in gaps:
        part = looked_ahead(rows.where(F.col("confirm_weeks") == weeks) if len(gaps) > 1 else rows, weeks, "pass")
        part = judged(part.withColumn("set", F.explode("sets")).select("*", "set.*").drop("sets", "set", "pass"))
        done = part if done is None else done.unionByName(part)
    return done


def looked_ahead(rows: DataFrame, weeks: float, by: str) -> DataFrame:
    """Adds later, the first dated scan of the patient at least ``weeks`` on among the rows that agree in ``by``."""
    candidate = F.when(F.col("week").isNotNull() & (F.col("n") > 0), F.struct("n", "week", F.col("call").alias("call"), "timepoint"))
    # A RANGE frame over doubles exists in SQL only; undated scans, whose frame would hold every row, are guarded.
    ahead = F.expr(f"min(candidate) OVER (PARTITION BY {by}, patient ORDER BY week RANGE BETWEEN {weeks}D FOLLOWING AND UNBOUNDED FOLLOWING)")
    return rows.withColumn("candidate", candidate).withColumn("later", F.when(F.col("week").isNotNull(), ahead)).drop("candidate")


def confirmed(rows: DataFrame, weeks: float) -> DataFrame:
    """First-pass calls of each profile, confirmed or refuted."""
    return judged(looked_ahead(rows, weeks, "profile"))


def judged(rows: DataFrame) -> DataFrame:
    """The calls after the look ahead."""
    rows = rows.withColumn("call1", F.col("call"))
    call, later = F.col("call1"), F.col("later")
    asks = F.col("confirm") & call.isin("CR", "PR")
    no_week = asks & F.col("week").isNull()
    too_late = asks & is_true(later["week"] - F.col("week") > F.col("confirm_max_weeks"))
    at_end = asks & F.col("week").isNotNull() & later.isNull()
    holds = (later["call"] == "CR") | (later["call"] == "PR") & (call == "PR")
    refuted = asks & later.isNotNull() & ~too_late & ~holds | at_end & ~F.col("keep_at_end")
    note = F.when(no_week, "confirmation_week").when(too_late, "confirmation_too_late").when(at_end & F.col("keep_at_end"), "confirmation_followup")
    is_base = call == "BASELINE"
    own = F.when(is_base, F.array().cast("array<string>")).otherwise(unknowns(call))
    return rows.withColumns({
        "call": F.when(refuted, "SD").otherwise(call), "provisional": F.when(refuted, call).otherwise(F.col("provisional")), "driver": F.when(refuted, "confirmation").otherwise(F.col("driver")),
        "unknowns": F.when(note.isNotNull(), F.array_sort(F.concat(own, F.array(note)))).otherwise(own),
        "vs_nadir": F.when(~is_base, F.col("vs_nadir")), "vs_baseline": F.when(~is_base, F.col("vs_baseline")), "t2_vs_nadir": F.when(~is_base, F.col("t2_vs_nadir")),
        "refuted": refuted, "too_late": too_late,
    }).withColumnsRenamed({"later": "confirming", "call1": "first_call"})


def single_signal(scans: DataFrame, volume: str, pd_increase: float = 0.40, pr_decrease: float = -0.65) -> DataFrame:
    """Calls by one volume alone: adds n (0 for the first scan that has the volume, the BASELINE) and call to the scans that have it. Needs rn. A complete response comes first, then progression against the smallest
    earlier volume or out of nothing, then response against the first."""
    v, own = F.col(volume), Window.partitionBy("patient").orderBy("rn")
    rows = scans.where(v.isNotNull()).withColumns({"n": F.row_number().over(own) - 1, "base": F.first(volume).over(own), "low": F.min(volume).over(own.rowsBetween(Window.unboundedPreceding, -1))})
    call = (
        F.when(F.col("n") == 0, "BASELINE").when(v == 0, "CR").when(ratio(v, F.col("low")) >= pd_increase, "PD").when((F.col("low") == 0) & (v > 0), "PD")
        .when(ratio(v, F.col("base")) <= pr_decrease, "PR").otherwise("SD")
    )
    return rows.withColumn("call", call).drop("base", "low")

"""Checks and readiness of scans, the contract's rows, assumptions of treatment records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars

#: The responses that count as an expert's rating, and the labels that have a meaning.
RATED = ("CR", "PR", "SD", "PD")
DOCUMENTED = (1, 2, 3)
#: The assumptions of a treatment record that is read off labels, in order of the dates they belong to.
ASSUMED = {"surgery": "operation in the week of its first post-operative scan", "rt_start": "radiotherapy begins four weeks after the first operation", "rt_end": "radiotherapy lasts six weeks"}


def scan_checks(items: DataFrame) -> DataFrame:
    """(patient, timepoint, code, status) of scans (has_ct1, has_flair, labels, rating); ``labels`` NULL or empty: no mask.

    Without a mask nothing else of it is checked, and an undocumented label ends the checks of a scan."""
    masked = F.coalesce(F.size("labels") > 0, F.lit(False))
    known = masked & (F.size(F.array_except("labels", F.array(*map(F.lit, DOCUMENTED)))) == 0)

    def check(code: str, status: Column, made: Column) -> Column:
        return F.when(made, F.struct(F.lit(code).alias("code"), status.alias("status")))

    found = F.array(
        check("modalities_present", F.when(F.col("has_ct1") & F.col("has_flair"), "pass").otherwise("fail"), F.lit(True)),
        check("mask_present", F.when(masked, "pass").otherwise("fail"), F.lit(True)),
        check("label_schema_valid", F.when(known, "pass").otherwise("fail"), masked),
        check("expert_rating_present", F.when(F.coalesce(F.col("rating").isin(*RATED), F.lit(False)), "pass").otherwise("warn"), known),
    )
    return items.select("patient", "timepoint", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("c")).select("patient", "timepoint", "c.*")


def scan_readiness(checks: DataFrame) -> DataFrame:
    """(patient, timepoint, readiness, checks): a failed check makes a scan unusable, but missing modalities only ask for attention, as warnings do."""
    fatal = (F.col("status") == "fail") & (F.col("code") != "modalities_present")
    ready = F.when(F.bool_or(fatal), "unusable").when(F.bool_or(F.col("status") != "pass"), "needs_attention").otherwise("usable")
    shown = F.array_join(F.array_sort(F.collect_list(F.concat("code", F.lit(":"), "status"))), ",")
    return checks.groupBy("patient", "timepoint").agg(ready.alias("readiness"), shown.alias("checks"))


def contract(items: DataFrame) -> DataFrame:
    """Per scan: readiness, checks, rating, assessable, and the enhancing volume with its error, where the scan is usable."""
    rows = scan_readiness(scan_checks(items)).join(items.select("timepoint", "rating", "enhancing_mm3"), "timepoint")
    usable = F.col("readiness") != "unusable"
    volume = F.when(usable, F.round("enhancing_mm3", 2))
    return rows.select(
        "patient", "timepoint", "readiness", "checks", "rating", (usable & F.coalesce(F.col("rating").isin(*RATED), F.lit(False))).alias("assessable"),
        volume.alias("enhancing_mm3"), F.when(usable, scalars.uncertainty_pp(F.col("enhancing_mm3"))).alias("uncertainty_pp"),
    )


def patient_contracts(scans: DataFrame) -> DataFrame:
    """One nested record for each patient from ``contract``: its scans in order, counts, and whether it is ready (two assessable scans)."""
    own = F.struct(*(c for c in scans.columns if c != "patient"))
    rows = scans.groupBy("patient").agg(F.array_sort(F.collect_list(own)).alias("scans"))
    count = lambda f: F.size(F.filter("scans", f))
    rows = rows.withColumns({"n_usable": count(lambda s: s["readiness"] != "unusable"), "n_assessable": count(lambda s: s["assessable"])})
    return rows.withColumn("ready", F.col("n_assessable") >= 2)


def assumptions(records: DataFrame) -> DataFrame:
    """(patient, assumptions): what a record (surgeries, rt_start, rt_end) assumes, once each, in the order of its dates."""
    known = lambda date, text: F.when(date.isNotNull(), F.lit(text))
    dates = F.concat(
        F.transform(F.coalesce("surgeries", F.array().cast("array<double>")), lambda _: F.lit(ASSUMED["surgery"])),
        F.array(known(F.col("rt_start"), ASSUMED["rt_start"]), known(F.col("rt_end"), ASSUMED["rt_end"])),
    )
    return records.select("patient", F.array_distinct(F.filter(dates, lambda x: x.isNotNull())).alias("assumptions"))


def orientation(a: list[list[Column]]) -> Column:
    """The code of an affine's axes: for each column the direction, R or L, A or P, S or I, in which it is longest."""
    out = []
    for j in range(3):
        column = [a[i][j] for i in range(3)]
        most = F.greatest(*map(F.abs, column))
        code = F.lit(None).cast("string")
        for i, (plus, minus) in reversed(list(enumerate(("RL", "AP", "SI")))):
            code = F.when(F.abs(column[i]) == most, F.when(column[i] >= 0, plus).otherwise(minus)).otherwise(code)
        out.append(code)
    return F.concat(*out)

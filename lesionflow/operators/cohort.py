"""Cohort statistics: survival, ranks, correlation, agreement of two methods, bootstrap."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.shared import stash
from . import order


def average_rank(order: Column, *by: str) -> Column:
    """Rank of ``order`` within by, ties sharing the mean of their places."""
    peers = F.count(F.lit(1)).over(Window.partitionBy(*by, order))
    return F.rank().over(Window.partitionBy(*by).orderBy(order)) + (peers - 1) / 2


def scorecards(scans: DataFrame, fields: DataFrame) -> DataFrame:
    """One row a patient: n, span (weeks), has_baseline, ever_pd, flags (progressions that the text places within three months), coverage (share of scans with a mask), field_strengths, scanner_switch.

    scans: patient, week, rating, soon, masked (null without a mask). fields: patient, field_strengths. Patients without either are left out, as nothing is known of them."""
    is_ = lambda c: F.bool_or(F.coalesce(F.col("rating") == c, F.lit(False)))
    flagged = (F.col("rating") == "PD") & F.col("soon")
    rows = scans.groupBy("patient").agg(
        F.count(F.lit(1)).alias("n"), (F.max("week") - F.min("week")).alias("span"), is_("Post-Op").alias("has_baseline"), is_("PD").alias("ever_pd"), F.count(F.when(flagged, 1)).alias("flags"),
        (F.count("masked") / F.count(F.lit(1))).alias("coverage"))
    return rows.join(fields, "patient").withColumn("scanner_switch", F.col("field_strengths") > 1)


def event_table(rows: DataFrame, group: str = "grp", time: str = "weeks") -> DataFrame:
    """(group, time, deaths, at_risk): distinct times of a group, all events observed."""
    deaths = rows.groupBy(group, time).agg(F.count(F.lit(1)).alias("deaths"))
    onward = Window.partitionBy(group).orderBy(F.desc(time)).rowsBetween(Window.unboundedPreceding, 0)
    return deaths.withColumn("at_risk", F.sum("deaths").over(onward))


def kaplan_meier(rows: DataFrame, group: str = "grp", time: str = "weeks") -> DataFrame:
    """Adds survival to the event table; the last step, where all at risk die, is 0."""
    so_far = Window.partitionBy(group).orderBy(time).rowsBetween(Window.unboundedPreceding, 0)
    step = F.when(F.col("deaths") < F.col("at_risk"), F.log(1 - F.col("deaths") / F.col("at_risk")))
    out = event_table(rows, group, time)
    return out.withColumn("survival", F.when(F.col("deaths") < F.col("at_risk"), F.exp(F.sum(step).over(so_far))).otherwise(0.0))


def median_survival(curve: DataFrame, group: str = "grp", time: str = "weeks") -> DataFrame:
    return curve.groupBy(group).agg(F.min(F.when(F.col("survival") <= 0.5 + 1e-12, F.col(time))).alias("median_weeks"))


def log_rank(rows: DataFrame, a: str, b: str, group: str = "grp", time: str = "weeks") -> DataFrame:
    """One row: observed and expected deaths of group a against b, and the chi-square statistic with 1 degree of freedom."""
    two = rows.where(F.col(group).isin(a, b))
    per = two.groupBy(time).agg(F.count(F.lit(1)).alias("d"), F.count(F.when(F.col(group) == a, 1)).alias("d_a"))
    onward = Window.orderBy(F.desc(time)).rowsBetween(Window.unboundedPreceding, 0)  # one row per distinct week
    per = per.withColumns({"n": F.sum("d").over(onward), "n_a": F.sum("d_a").over(onward)})
    expected = F.col("d") * F.col("n_a") / F.col("n")
    variance = F.when(F.col("n") > 1, F.col("d") * (F.col("n_a") / F.col("n")) * (1 - F.col("n_a") / F.col("n")) * (F.col("n") - F.col("d")) / (F.col("n") - 1)).otherwise(0.0)
    out = per.agg(F.sum("d_a").alias("observed"), F.sum(expected).alias("expected"), F.sum(variance).alias("variance"))
    out = out.withColumn("chi2", (F.col("observed") - F.col("expected")) * (F.col("observed") - F.col("expected")) / F.col("variance"))
    return out.withColumn("p", chi_square_tail(F.col("chi2")))


def chi_square_tail(x: Column) -> Column:
    """The share of a chi-square distribution with 1 degree of freedom above x: the complementary error function of sqrt(x / 2), below 2 by the series of
    erf in rising powers, whose terms are all positive, above by its continued fraction from the inside out. Negative and null values give null."""
    z = F.sqrt(x / 2)
    term = F.struct(z.alias("term"), z.alias("sum"))

    def longer(s: Column, k: Column) -> Column:
        term = s["term"] * 2 * z * z / (2 * k + 1)
        return F.struct(term.alias("term"), (s["sum"] + term).alias("sum"))

    series = 1 - 2 / math.sqrt(math.pi) * F.exp(-z * z) * F.aggregate(F.sequence(F.lit(1), F.lit(60)), term, longer, lambda s: s["sum"])
    inner = F.aggregate(F.sequence(F.lit(80), F.lit(1), F.lit(-1)), z, lambda t, k: z + k / 2 / t)
    return F.when(z < 2, series).when(z >= 2, F.exp(-z * z) / (math.sqrt(math.pi) * inner))


def spearman(rows: DataFrame, a: str, b: str) -> DataFrame:
    """One row (n, rho) over rows that have both values."""
    both = stash(rows.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(a, b))
    ranked = order.with_rank(order.with_rank(both, a, name="rank_a"), b, name="rank_b")
    return ranked.agg(F.count(F.lit(1)).alias("n"), F.corr("rank_a", "rank_b").alias("rho"))


def bland_altman(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Bias and limits of agreement: mean difference and 1.96 sample standard deviations about it."""
    d = F.col(a) - F.col(b)
    out = rows.agg(F.count(d).alias("n"), F.avg(d).alias("bias"), F.stddev_samp(d).alias("sd"))
    return out.select("n", "bias", (F.col("bias") - 1.96 * F.col("sd")).alias("low"), (F.col("bias") + 1.96 * F.col("sd")).alias("high"))


def feature_auc(vectors: DataFrame, vector: str, positive: Column, least: int = 6) -> DataFrame:
    """(feature, n_pos, n_neg, auc) per place of a vector: Mann-Whitney with average ranks; features need ``least`` rows on both sides."""
    rows = vectors.select(positive.alias("pos"), F.posexplode(vector).alias("feature", "value"))
    marks = {"pos": F.count(F.when(F.col("pos"), 1)), "neg": F.count(F.when(~F.col("pos"), 1))}
    ranked = order.places(rows, "value", "feature", also=marks)  # the ranks are summed by value, no row gets its own
    out = ranked.groupBy("feature").agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"), F.sum(F.col("pos") * (F.col("before") + (F.col("m") + 1) / 2)).alias("r"))
    out = out.where((F.col("n_pos") >= least) & (F.col("n_neg") >= least))
    return out.select("feature", "n_pos", "n_neg", ((F.col("r") - F.col("n_pos") * (F.col("n_pos") + 1) / 2) / (F.col("n_pos") * F.col("n_neg"))).alias("auc"))


def bootstrap_difference(per_patient: DataFrame, classes: list[str], draws: int = 2000) -> DataFrame:
    """(draw, difference): the balanced accuracy of b less that of a, over patients drawn with replacement.

    per_patient: patient and, for each class c, n_c (its scans), a_c and b_c (those that a and b call so). Balanced
    accuracy averages recall over the classes of the draw. A draw gives each patient a Poisson(1) number of copies
    from a hash of (draw, patient), so draws are independent of how rows are spread and no patient list is gathered."""
    u = F.pmod(F.xxhash64("draw", "patient"), F.lit(1 << 30)) / float(1 << 30)
    cuts = (0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940582, 0.99991676)
    copies = sum((F.when(u >= c, 1).otherwise(0) for c in cuts), F.lit(0))
    rows = per_patient.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws)))).withColumn("copies", copies).where("copies > 0")
    drawn = rows.groupBy("draw").agg(*(F.sum(F.col("copies") * F.col(f"{x}_{c}")).alias(f"{x}_{c}") for x in "nab" for c in classes))
    gains = sum((F.when(F.col(f"n_{c}") > 0, (F.col(f"b_{c}") - F.col(f"a_{c}")) / F.col(f"n_{c}")).otherwise(0.0) for c in classes), F.lit(0.0))
    present = sum((F.when(F.col(f"n_{c}") > 0, 1).otherwise(0) for c in classes), F.lit(0))
    return drawn.where(present > 0).select("draw", (gains / present).alias("difference"))

"""Compartment and region volumes from label histograms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The meaning of labels by source, and the regions that they form.
LABELS = [("deepbratumia", 1, "enhancing"), ("deepbratumia", 2, "necrosis_nonenhancing"), ("deepbratumia", 3, "edema"), ("hdglio", 1, "t2_flair_nonenhancing"), ("hdglio", 2, "enhancing")]
REGIONS = [("deepbratumia", "ET", 1), ("deepbratumia", "TC", 1), ("deepbratumia", "TC", 2), ("deepbratumia", "WT", 1), ("deepbratumia", "WT", 2), ("deepbratumia", "WT", 3), ("hdglio", "ET", 2), ("hdglio", "WT", 1), ("hdglio", "WT", 2)]


def label_schema(spark, source: str) -> DataFrame:
    return spark.createDataFrame([(label, name) for s, label, name in LABELS if s == source], "label int, compartment string")


def region_members(spark, source: str) -> DataFrame:
    return spark.createDataFrame([(r, label) for s, r, label in REGIONS if s == source], "region string, label int")


def histogram(voxels: DataFrame) -> DataFrame:
    return voxels.groupBy("patient", "visit", "label").agg(F.count(F.lit(1)).alias("n"))


def undocumented(counts: DataFrame, schema: DataFrame) -> DataFrame:
    """Scans with labels that the schema lacks: (patient, visit, labels)."""
    return counts.join(F.broadcast(schema), "label", "left_anti").groupBy("patient", "visit").agg(F.array_sort(F.collect_set("label")).alias("labels"))


def compartment_volumes(counts: DataFrame, schema: DataFrame, unit: DataFrame) -> DataFrame:
    """(patient, visit, compartment, volume_mm3): an absent compartment is 0; scans with undocumented labels fail and are left out.
    unit: (patient, voxel_mm3)."""
    scans = counts.select("patient", "visit").distinct().join(undocumented(counts, schema), ["patient", "visit"], "left_anti")
    grid = scans.crossJoin(F.broadcast(schema))
    rows = grid.join(counts, ["patient", "visit", "label"], "left").join(unit, "patient")
    return rows.select("patient", "visit", "compartment", (F.coalesce("n", F.lit(0)) * F.col("voxel_mm3")).alias("volume_mm3"))


def region_volumes(counts: DataFrame, members: DataFrame, unit: DataFrame) -> DataFrame:
    """(patient, visit, region, volume_mm3): counts are summed first, then scaled."""
    scans = counts.select("patient", "visit").distinct().crossJoin(F.broadcast(members.select("region").distinct()))
    sums = counts.join(F.broadcast(members), "label").groupBy("patient", "visit", "region").agg(F.sum("n").alias("n"))
    return scans.join(sums, ["patient", "visit", "region"], "left").join(unit, "patient").select("patient", "visit", "region", (F.coalesce("n", F.lit(0)) * F.col("voxel_mm3")).alias("volume_mm3"))


def face_voxels(voxels: DataFrame, lo: tuple[int, int, int], hi: tuple[int, int, int]) -> DataFrame:
    """(patient, visit, on_faces): voxels on the grid's six faces, an edge voxel once for each of its faces."""
    hits = sum((F.when(F.col(c) == v, 1).otherwise(0) for c, a, b in zip("xyz", lo, hi) for v in (a, b)), F.lit(0))
    return voxels.groupBy("patient", "visit").agg(F.sum(hits).alias("on_faces"))


def intensity_stats(values: DataFrame, *by: str) -> DataFrame:
    """n, mean, population sd, min, max, median, p0.5 and p99.5 of ``value``; percentiles interpolate."""
    v = F.col("value")
    return values.groupBy(*by).agg(
        F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"),
        F.percentile(v, 0.5).alias("median"), F.percentile(v, 0.005).alias("p0_5"), F.percentile(v, 0.995).alias("p99_5"))


def fingerprints(values: DataFrame, grids: DataFrame) -> DataFrame:
    """(patient, n_scans, scans): a patient's scans in order of visit, each with its grid, its intensities over values other than 0, and each label's voxels and intensities.

    values: patient, visit, label, value. grids: a row for each patient as ``validate.geometry`` gives it. A patient's scans meet in one row, which their number bounds."""
    some = values.withColumn("value", F.when(F.col("value") != 0, F.col("value")))
    whole = some.groupBy("patient", "visit").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"), F.min("value").alias("least"), F.max("value").alias("most"), F.percentile("value", 0.5).alias("median"))
    each = values.groupBy("patient", "visit", "label").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"))
    labels = each.groupBy("patient", "visit").agg(F.array_sort(F.collect_list(F.struct("label", "n", "mean", "sd"))).alias("labels"))
    grid = grids.select("patient", F.array("nx", "ny", "nz").alias("shape"), F.array("s0", "s1", "s2").alias("spacing"), "anisotropy", "voxel_mm3")
    scan = F.struct("visit", "shape", "spacing", "anisotropy", "voxel_mm3", "mean", "sd", "least", "most", "median", "labels")
    rows = whole.join(labels, ["patient", "visit"]).join(grid, "patient")
    return rows.groupBy("patient").agg(F.count(F.lit(1)).alias("n_scans"), F.array_sort(F.collect_list(scan)).alias("scans"))

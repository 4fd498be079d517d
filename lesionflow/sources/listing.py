"""Listings of image files: what an archive holds, without reading the files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The modalities that a visit's folder may hold, and where the masks of the segmentation tools lie.
MODALITIES = ("CT1", "T1", "T2", "FLAIR")  # in order of preference
MASKS = {"DeepBraTumIA": r"/DeepBraTumIA-segmentation/atlas/segmentation/seg_mask\.nii\.gz$", "HD-GLIO-AUTO": r"/HD-GLIO-AUTO-segmentation/registered/segmentation\.nii\.gz$", "brain": r"/DeepBraTumIA-segmentation/atlas/skull_strip/brain_mask\.nii\.gz$"}


def files(spark: SparkSession, folder: str, pattern: str = "*.nii.gz") -> DataFrame:
    """(path, length, modified) of all files below the folder whose names match. The contents are no part of the plan, so no file is opened.
    Spark leaves out files without a byte: to an audit they are missing. Other listings may have them."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    return rows.select("path", "length", F.col("modificationTime").alias("modified"))


def item_of(path: Column) -> Column:
    """The item that a path holds: a modality, a tool's mask, or null."""
    modality = F.regexp_extract(path, rf"/({'|'.join(MODALITIES)})\.nii\.gz$", 1)
    out = F.when(modality != "", modality)
    for name, place in MASKS.items():
        out = out.when(F.regexp_like(path, F.lit(place)), name)
    return out


def items(listed: DataFrame) -> DataFrame:
    """(patient, timepoint, item, path, length, source, space) of the files (path, length) .../<patient>/<timepoint>/... that hold an item; of several files of an item the first by path."""
    path = F.col("path")
    rows = listed.select(F.regexp_extract(path, r"([^/]+)/(week-[^/]+)/", 1).alias("patient"), F.regexp_extract(path, r"([^/]+)/(week-[^/]+)/", 2).alias("timepoint"), item_of(path).alias("item"), "path", "length")
    rows = rows.where(F.col("item").isNotNull() & (F.col("timepoint") != "")).groupBy("patient", "timepoint", "item").agg(F.min_by(F.struct("path", "length"), "path").alias("f"))
    mask = F.col("item").isin(*MASKS)
    tool = F.when(F.col("item") == "brain", "DeepBraTumIA").otherwise(F.col("item"))
    return rows.select("patient", "timepoint", "item", "f.path", "f.length", F.when(mask, tool).otherwise("raw").alias("source"), F.when(mask, "atlas").otherwise("native").alias("space"))


def reference_image(held: DataFrame) -> DataFrame:
    """(patient, timepoint, item, path): of each scan's modalities the first in order of preference that is there."""
    rank = F.array_position(F.array(*map(F.lit, MODALITIES)), F.col("item"))
    return held.where(F.col("item").isin(*MODALITIES)).groupBy("patient", "timepoint").agg(F.min_by(F.struct("item", "path"), rank).alias("f")).select("patient", "timepoint", "f.*")


def usable_scans(held: DataFrame, mask: str = "DeepBraTumIA") -> DataFrame:
    """(patient, timepoint) of the scans that have the mask, the brain mask and an image to refer to."""
    has = lambda *names: F.bool_or(F.col("item").isin(*names))
    rows = held.groupBy("patient", "timepoint").agg(has(mask).alias("mask"), has("brain").alias("brain"), has(*MODALITIES).alias("image"))
    return rows.where("mask AND brain AND image").select("patient", "timepoint")


def missing_items(scans: DataFrame, held: DataFrame, required: tuple[str, ...]) -> DataFrame:
    """(patient, timepoint, missing) of every scan: the required items that it lacks, by name."""
    have = held.groupBy("patient", "timepoint").agg(F.collect_set("item").alias("have"))
    rows = scans.select("patient", "timepoint").distinct().join(have, ["patient", "timepoint"], "left")
    lacking = F.array_except(F.array(*map(F.lit, sorted(required))), F.coalesce("have", F.array().cast("array<string>")))
    return rows.select("patient", "timepoint", lacking.alias("missing"))

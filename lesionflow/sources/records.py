"""Nested records of patients: one JSON record a patient with its visits in order of week, of seven kinds with typed fields, and the cohort lock, whose arms
have two shapes in one document."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: The fields of a visit in each kind of record.
VISITS = {
    "fingerprint": "timepoint string, week double, shape array<int>, spacing array<double>, anisotropy double, voxel_mm3 double, histogram map<string, bigint>, mean double, sd double, least double, most double",
    "contract": "timepoint string, week double, compartment_volumes map<string, double>, region_volumes map<string, double>, expert_rating string, checks array<struct<code: string, status: string>>, readiness string",
    "lock": "timepoint string, week double, rating string, assessable boolean",
    "transforms": "timepoint string, week double, rotation array<double>, translation array<double>, center array<double>, status string, overlap_before_pct double, overlap_after_pct double, centre_before_mm double, centre_after_mm double",
    "connectivity": "timepoint string, week double, enhancing_mm3 bigint, n_components_26 bigint, n_components_6 bigint, largest_mm3 bigint, largest_volume_fraction double, counts_by_floor_26 map<string, bigint>, counts_by_floor_6 map<string, bigint>, largest_n_slices bigint, largest_slices_fragmented bigint",
    "ruler": "timepoint string, week double, status string, expert_long_mm double, expert_short_mm double, n_lesions int, best_long_mm double, best_perp_mm double, caliper_excess_mm double, measurable boolean, best_is_biggest boolean",
    "single_signal": "timepoint string, week double, variant string, expert string, predicted string",
}


def fields(kind: str) -> StructType:
    return StructType.fromDDL(VISITS[kind])


def nested(rows: DataFrame, kind: str) -> DataFrame:
    """(patient, n_visits, visits): the rows' fields of the kind, cast to its types, absent ones null; visits by week (unknown weeks last), then timepoint. A patient's visits meet
    in one row, which its number of scans bounds."""
    have = {c.lower() for c in rows.columns}
    visit = F.struct(*((F.col(f.name) if f.name.lower() in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields(kind)))
    placed = F.struct(F.coalesce(F.col("week").cast("double"), F.lit(float("inf"))).alias("at"), F.col("timepoint").cast("string").alias("label"), F.monotonically_increasing_id().alias("n"), F.to_json(visit).alias("v"))
    held = rows.select(F.col("patient").cast("string").alias("patient"), placed.alias("p")).groupBy("patient").agg(F.sort_array(F.collect_list("p")).alias("p"))
    parsed = F.transform("p", lambda x: F.from_json(x["v"], fields(kind)))
    return held.select("patient", F.size("p").alias("n_visits"), parsed.alias("visits"))


def write_records(rows: DataFrame, path: str, kind: str) -> None:
    """Rows of (patient, fields of a visit) as one JSON record a patient."""
    nested(rows, kind).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def read_records(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """The rows that ``write_records`` was given, in the kind's fields."""
    schema = StructType.fromDDL(f"patient string, n_visits int, visits array<struct<{', '.join(f'{f.name}: {f.dataType.simpleString()}' for f in fields(kind))}>>")
    return spark.read.schema(schema).json(path).select("patient", F.inline("visits"))


#: The arms in the order in which they are read: of a patient in both, the later counts.
ARMS = ("practice", "held_out")


def arms_of(documents: DataFrame) -> DataFrame:
    """(patient, arm) of lock documents (document: JSON text). An arm lists ``patients``, each a record with its patient_id or a bare id, and ``patient_ids``; either may be absent.
    The document is read as a variant, as no one schema fits both shapes."""
    lock = documents.select(F.parse_json("document").alias("d"))
    out = None
    for order, arm in enumerate(ARMS):
        listed = F.coalesce(F.try_variant_get("d", f"$.{arm}.patients", "array<variant>"), F.array().cast("array<variant>"))
        bare = F.coalesce(F.try_variant_get("d", f"$.{arm}.patient_ids", "array<string>"), F.array().cast("array<string>"))
        one = lock.select(F.explode(listed).alias("e")).select(F.coalesce(F.try_variant_get("e", "$.patient_id", "string"), F.when(F.schema_of_variant("e").isin("STRING", "BIGINT"), F.try_variant_get("e", "$", "string"))).alias("patient"))
        both = one.unionByName(lock.select(F.explode(bare).alias("patient"))).where("patient IS NOT NULL").select("patient", F.lit(order).alias("n"))
        out = both if out is None else out.unionByName(both)
    name = F.element_at(F.array(*map(F.lit, ARMS)), F.max("n") + 1)
    return out.groupBy("patient").agg(name.alias("arm"))


def arms(spark: SparkSession, path: str) -> DataFrame:
    """(patient, arm) of a cohort lock file; none where there is no file."""
    try:
        documents = spark.read.text(path, wholetext=True).select(F.col("value").alias("document"))
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "patient string, arm string")
    return arms_of(documents)


def with_arm(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Adds the arm of each patient, ``unassigned`` where the lock has none."""
    return rows.join(found, "patient", "left").withColumn("arm", F.coalesce("arm", F.lit("unassigned")))

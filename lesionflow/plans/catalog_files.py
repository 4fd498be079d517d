"""Queries that write cohort files in their own formats and read them back: what comes out must be what the tables hold."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import readers, records
from ..sources.cache import ResultCache
from ..sources.fixtures import frame, oracle
from . import catalog_audit, catalog_rule
from .shared import shared_dir, stash

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
ITEMS = ["CT1", "T1", "T2", "FLAIR", "DeepBraTumIA"]


def query(name: str, sql: str, *views: str):
    def keep(fn):
        QUERIES[name] = fn
        ORACLE[name] = oracle(sql, *views) if views else sql
        return fn

    return keep


def folder(spark) -> str:
    return f"{shared_dir(spark)}/files-{uuid.uuid4().hex}"


def to_csv(rows: DataFrame, path: str, compression: str = "none") -> str:
    rows.write.option("compression", compression).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).option("escape", '"').csv(path, header=True)
    return path


def named(rows: DataFrame) -> DataFrame:
    """Keys as files have them."""
    return rows.withColumns({"patient": F.concat(F.lit("Patient-"), F.col("patient").cast("string")), "timepoint": F.concat(F.lit("week-"), F.col("timepoint").cast("string"))})


NAMED = "concat('Patient-', patient) AS patient, concat('week-', timepoint) AS timepoint"


@query("a01_manifest", f"SELECT {NAMED}, item, coalesce(present, FALSE) AS present FROM claims", "claims")
def a01(spark, sf_dir):
    """A completeness file whose cells hold an x, in any case and with blanks around it."""
    cell = F.when(F.col("present"), F.element_at(F.array(F.lit("x"), F.lit(" X"), F.lit("x ")), (F.col("timepoint") % 3 + 1).cast("int"))).otherwise(F.when(F.col("timepoint") % 2 == 0, "").otherwise("n"))
    wide = frame(spark, sf_dir, "claims").withColumn("cell", cell).groupBy("patient", "timepoint").pivot("item", ITEMS).agg(F.first("cell"))
    path = to_csv(named(wide).withColumnsRenamed({"patient": "Patient", "timepoint": "Timepoint"}), folder(spark))
    return readers.manifest(spark, path, ITEMS).unpivot(["patient", "timepoint"], ITEMS, "item", "present")


RATED = "SELECT s.patient, s.timepoint, s.rating, r.rationale FROM scans s JOIN (SELECT timepoint, rationale FROM rationale) r USING (timepoint)"


@query("a02_ratings", f"SELECT {NAMED}, CASE WHEN timepoint % 20 = 3 THEN 'PD' ELSE rating END AS rating, trim(rationale) AS rationale FROM ({RATED})", "scans", "rationale")
def a02(spark, sf_dir):
    """A rating file with rows that repeat, and a later file that corrects some ratings."""
    rows = named(frame(spark, sf_dir, "scans").select("patient", "timepoint", "rating").join(frame(spark, sf_dir, "rationale").select("timepoint", "rationale"), "timepoint").withColumn("k", F.col("timepoint")))
    rows = stash(rows.select("k", F.col("patient").alias("Patient"), F.col("timepoint").alias("Date"), F.col("rating").alias("Rating (as the response criteria have it)"), F.col("rationale").alias("Rating rationale (free text)")))
    top = folder(spark)
    to_csv(rows.union(rows.where("k % 10 = 0")).drop("k"), f"{top}/first")
    to_csv(rows.where("k % 20 = 3").withColumn("Rating (as the response criteria have it)", F.lit("PD")).drop("k"), f"{top}/second")
    return readers.ratings(spark, f"{top}/*")[0]


@query("a04_tidy_volumes", f"WITH {catalog_audit.TIDY} SELECT {NAMED}, modality, compartment, volume_mm3 FROM tidy WHERE space = 'native' QUALIFY row_number() OVER (PARTITION BY patient, timepoint, compartment ORDER BY modality, volume_mm3) = 1", "native_masks")
def a04(spark, sf_dir):
    """A tidy volume file of which one space is read, the first modality of each compartment."""
    rows = named(catalog_audit.volumes(spark, sf_dir)).select("patient", "timepoint", "space", "modality", "compartment", "volume_mm3")
    return readers.tidy_volumes(spark, to_csv(rows, folder(spark), "gzip"), "native").select("patient", "timepoint", "modality", "compartment", "volume_mm3")


@query(
    "a05_arms",
    "SELECT CAST(c_custkey AS VARCHAR) AS patient, CASE WHEN c_custkey % 7 IN (2, 3) OR (c_custkey % 7 = 1 AND c_custkey % 11 = 0) THEN 'held_out' WHEN c_custkey % 7 < 2 THEN 'practice' ELSE 'unassigned' END AS arm FROM customer",
)
def a05(spark, sf_dir):
    """Lock documents (one a nation) whose practice arm lists records and bare ids, whose held-out arm only ids; some patients are in both."""
    people = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_nationkey", F.col("c_custkey").alias("k"), F.col("c_custkey").cast("string").alias("patient"))
    held = (F.col("k") % 7).isin(2, 3) | (F.col("k") % 7 == 1) & (F.col("k") % 11 == 0)
    entry = F.when(F.col("k") % 5 == 0, F.concat(F.lit('"'), "patient", F.lit('"'))).otherwise(F.to_json(F.struct(F.col("patient").alias("patient_id"), (F.col("k") % 9).alias("n_assessable"))))
    listed = people.groupBy("c_nationkey").agg(F.array_join(F.collect_list(F.when(F.col("k") % 7 < 2, entry)), ",").alias("a"), F.to_json(F.collect_list(F.when(held, F.col("patient")))).alias("b"))
    text = F.concat(F.lit('{"criterion": {"deterministic": true}, "practice": {"patients": ['), "a", F.lit(']}, "held_out": {"patient_ids": '), "b", F.lit("}}"))
    return records.with_arm(people.select("patient"), records.arms_of(listed.select(text.alias("document"))))


@query("a07_cache_increment", "SELECT patient, timepoint, measurable_disease AS measurable FROM scans", "scans")
def a07(spark, sf_dir):
    """A cache that has some results: those of the keys that it lacks are appended, twice, and every key is there once."""
    rows = stash(frame(spark, sf_dir, "scans").select("patient", "timepoint", F.col("measurable_disease").alias("measurable")))
    cache = ResultCache(spark, folder(spark), ["patient", "timepoint"], "patient bigint, timepoint bigint, measurable boolean")
    cache.append(rows.where("timepoint % 3 < 2"))
    for _ in range(2):
        cache.append(rows.join(cache.missing(rows), ["patient", "timepoint"], "left_semi"))
    cache.append(rows.where("timepoint % 5 = 0").withColumn("measurable", F.lit(None).cast("boolean")))
    return cache.rows()


@query("a08_cohort_file", "SELECT CAST(patient AS VARCHAR) AS patient, nullif(idh, '') AS idh, nullif(mgmt, '') AS mgmt, nullif(sex, '') AS sex, nullif(weeks, '') AS weeks FROM demographics", "demographics")
def a08(spark, sf_dir):
    """A demographics file, all of it as text, blanks as they are; an empty cell is null."""
    rows = frame(spark, sf_dir, "demographics")
    return readers.cohort_file(spark, to_csv(rows.select("patient", "idh", "mgmt", "sex", "weeks"), folder(spark)))


@query("a09_call_table", f"WITH {catalog_rule.CALLS} SELECT profile, timepoint, call FROM calls", "scans")
def a09(spark, sf_dir):
    """The table of calls, one folder for each parameter set."""
    path = folder(spark)
    readers.write_calls(catalog_rule.rule_calls(spark, sf_dir).select("profile", "timepoint", "call"), path)
    return spark.read.schema("timepoint bigint, call string, profile string").parquet(path).select("profile", "timepoint", "call")


@query("a10_volume_folders", f"WITH {catalog_audit.TIDY} SELECT patient, space, compartment, count(*) AS n, round(sum(volume_mm3), 3) AS total FROM tidy GROUP BY ALL", "native_masks")
def a10(spark, sf_dir):
    """Tidy volumes written in folders of patients, each patient in one of them."""
    path = folder(spark)
    readers.write_tidy_volumes(catalog_audit.volumes(spark, sf_dir).select("patient", "timepoint", "space", "compartment", "volume_mm3"), path)
    rows = spark.read.schema("patient bigint, timepoint bigint, space string, compartment string, volume_mm3 double").parquet(path)
    return rows.groupBy("patient", "space", "compartment").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("volume_mm3"), 3).alias("total"))


@query("a11_patient_records", f"WITH {catalog_audit.SIGNALLED} SELECT concat('Patient-', s.patient) AS patient, concat('week-', b.timepoint) AS timepoint, s.week, b.variant, b.rating AS expert, b.call AS predicted FROM both_ b JOIN (SELECT patient, timepoint, week FROM scans) s USING (timepoint) WHERE b.call <> 'BASELINE'", "scans")
def a11(spark, sf_dir):
    """One nested JSON record for each patient, its visits in order of week, read back with typed fields."""
    weeks = frame(spark, sf_dir, "scans").select("patient", "timepoint", "week")
    rows = catalog_audit.signals(spark, sf_dir).where("call <> 'BASELINE'").join(weeks, "timepoint")
    path = folder(spark)
    records.write_records(named(rows.select("patient", "timepoint", "week", "variant", F.col("rating").alias("expert"), F.col("call").alias("predicted"))), path, "single_signal")
    return records.read_records(spark, path, "single_signal")

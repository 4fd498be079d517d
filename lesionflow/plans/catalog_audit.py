"""Queries of audits and inventories: manifest against archive, native masks against the atlas, items of scans, scanners, scorecards, fingerprints, and the single-signal check."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import audit, cohort, evaluate, order, rule, validate, volumetry
from ..sources import listing
from ..sources.fixtures import frame, oracle
from . import catalog_rule
from .catalog_cohort import S
from .catalog_reports import BAND
from .catalog_voxel import DET
from .shared import stash

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
NATIVE = list(listing.MODALITIES)
DEFAULT = rule.profile("mrano_volumetric")


def query(name: str, sql: str, *views: str):
    def keep(fn):
        QUERIES[name] = fn
        ORACLE[name] = oracle(sql, *views)
        return fn

    return keep


HELD = r"""held AS (SELECT CAST(regexp_extract(path, 'Patient-(\d+)/', 1) AS BIGINT) AS patient, CAST(regexp_extract(path, '/week-(\d+)/', 1) AS BIGINT) AS timepoint,
  CASE WHEN contains(path, 'DeepBraTumIA-segmentation/atlas/segmentation/seg_mask.nii.gz') THEN 'DeepBraTumIA' WHEN contains(path, 'skull_strip/brain_mask.nii.gz') THEN 'brain' ELSE regexp_extract(path, '/([A-Z0-9]+)\.nii\.gz$', 1) END AS item, path, length FROM archive WHERE path LIKE '%.nii.gz')"""
AUDIT = f"""{HELD}, j AS (SELECT coalesce(c.patient, h.patient) AS patient, coalesce(c.timepoint, h.timepoint) AS timepoint, coalesce(c.item, h.item) AS item, c.present AS manifest, h.path IS NOT NULL AS archive, h.path,
  CASE WHEN c.present AND h.path IS NULL THEN 'missing' WHEN c.patient IS NULL THEN 'unlisted' WHEN h.path IS NOT NULL AND NOT coalesce(c.present, FALSE) THEN 'unclaimed' WHEN c.present AND h.length = 0 THEN 'empty' END AS finding
  FROM (SELECT patient, timepoint, item, present FROM claims) c FULL JOIN (SELECT * FROM held WHERE item <> 'brain') h ON h.patient = c.patient AND h.timepoint = c.timepoint AND h.item = c.item)"""


def held(spark, sf_dir: str) -> DataFrame:
    number = lambda c, cut: F.regexp_extract(c, cut, 1).cast("bigint").alias(c)
    rows = listing.items(frame(spark, sf_dir, "archive"))
    return rows.select(number("patient", r"(\d+)$"), number("timepoint", r"(\d+)$"), "item", "path", "length", "source", "space")


def claimable(spark, sf_dir: str) -> DataFrame:
    """What a manifest speaks of: all items but brain masks."""
    return held(spark, sf_dir).where("item <> 'brain'")


@query("c06_manifest_audit", f"WITH {AUDIT} SELECT * FROM j WHERE finding IS NOT NULL", "claims", "archive")
def c06(spark, sf_dir):
    """Items that the manifest and the listing of the archive tell differently, both ways."""
    return audit.manifest_audit(frame(spark, sf_dir, "claims"), claimable(spark, sf_dir))


@query("c06_audit_counts", f"WITH {AUDIT} SELECT item, finding, count(*) AS n FROM j WHERE finding IS NOT NULL GROUP BY ALL", "claims", "archive")
def c06_counts(spark, sf_dir):
    return audit.manifest_audit(frame(spark, sf_dir, "claims"), claimable(spark, sf_dir)).groupBy("item", "finding").agg(F.count(F.lit(1)).alias("n"))


@query("d38_listed_items", f"WITH {HELD} SELECT patient, timepoint, item, CASE WHEN item IN ('DeepBraTumIA', 'brain') THEN 'DeepBraTumIA' ELSE 'raw' END AS source, CASE WHEN item IN ('DeepBraTumIA', 'brain') THEN 'atlas' ELSE 'native' END AS space, length FROM held", "archive")
def d38_listed(spark, sf_dir):
    """The inventory's side of the archive: which items each scan has, from what source and in what space."""
    return held(spark, sf_dir).select("patient", "timepoint", "item", "source", "space", "length")


WARNED = """w AS (SELECT o.o_custkey AS patient, o.o_orderkey AS timepoint, m.modality, list_sort(list(DISTINCT label) FILTER (label NOT IN (0, 1, 2, 3))) AS odd, count(label) AS held FROM orders o
  CROSS JOIN (SELECT unnest(['atlas', 'CT1', 'T1', 'T2', 'FLAIR']) AS modality) m LEFT JOIN native_masks n ON n.timepoint = o.o_orderkey AND n.modality = m.modality GROUP BY ALL),
warned AS (SELECT patient, timepoint, modality, CASE WHEN held = 0 AND modality = 'atlas' THEN 'no atlas mask' WHEN held = 0 THEN concat('native ', modality, ' mask absent') WHEN odd IS NOT NULL THEN concat('label without meaning: ', array_to_string(odd, ',')) END AS warning FROM w),
stopped AS (SELECT DISTINCT timepoint FROM warned WHERE modality = 'atlas' AND warning IS NOT NULL),
warnings AS (SELECT * FROM warned WHERE warning IS NOT NULL AND (modality = 'atlas' OR timepoint NOT IN (SELECT timepoint FROM stopped)))"""
TIDY = f"""{WARNED}, masks AS (SELECT DISTINCT patient, timepoint, modality, s0, s1, s2 FROM native_masks n WHERE timepoint NOT IN (SELECT timepoint FROM stopped) AND NOT EXISTS (SELECT 1 FROM warnings w WHERE w.timepoint = n.timepoint AND w.modality = n.modality)),
tidy AS (SELECT m.patient, m.timepoint, CASE WHEN m.modality = 'atlas' THEN 'atlas' ELSE 'native' END AS space, m.modality, m.s0, m.s1, m.s2, m.s0 * m.s1 * m.s2 AS voxel_mm3, greatest(m.s0, m.s1, m.s2) / least(m.s0, m.s1, m.s2) AS anisotropy, compartment,
  coalesce(n, 0) AS n_voxels, coalesce(n, 0) * (m.s0 * m.s1 * m.s2) AS volume_mm3 FROM masks m CROSS JOIN (VALUES (1, 'enhancing'), (2, 'necrosis_nonenhancing'), (3, 'edema')) l(label, compartment) LEFT JOIN native_masks n ON n.timepoint = m.timepoint AND n.modality = m.modality AND n.label = l.label)"""
DEVIATED = TIDY + ", dev AS (SELECT n.compartment, a.volume_mm3 AS atlas_mm3, n.anisotropy, (n.volume_mm3 / a.volume_mm3 - 1) * 100 AS deviation FROM tidy n JOIN tidy a USING (patient, timepoint, compartment) WHERE n.space = 'native' AND a.space = 'atlas')"


def warnings(spark, sf_dir: str, counts: DataFrame) -> DataFrame:
    scans = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey").alias("patient"), F.col("o_orderkey").alias("timepoint"))
    return audit.mask_warnings(scans, counts, NATIVE, [label for source, label, _ in volumetry.LABELS if source == "deepbratumia"])


def measured(spark, sf_dir: str) -> DataFrame:
    """The volumes of each scan's masks."""
    return audit.scan_volumes(frame(spark, sf_dir, "native_masks"), {label: name for source, label, name in volumetry.LABELS if source == "deepbratumia"})


def volumes(spark, sf_dir: str) -> DataFrame:
    return audit.tidy_of(measured(spark, sf_dir))


@query("l07_native_warnings", f"WITH {WARNED} SELECT patient, timepoint, modality, warning FROM warnings", "native_masks")
def l07_native(spark, sf_dir):
    """Why masks cannot be measured: no atlas mask, a native mask that is absent, a label without meaning."""
    return warnings(spark, sf_dir, frame(spark, sf_dir, "native_masks"))


@query("d06_native_volumes", f"WITH {TIDY} SELECT patient, timepoint, space, modality, s0, s1, s2, round(voxel_mm3, 6) AS voxel_mm3, round(anisotropy, 4) AS anisotropy, compartment, n_voxels, round(volume_mm3, 3) AS volume_mm3 FROM tidy", "native_masks")
def d06_native(spark, sf_dir):
    """Volumes of every compartment on the atlas grid and on each native grid."""
    return volumes(spark, sf_dir).select("patient", "timepoint", "space", "modality", "s0", "s1", "s2", F.round("voxel_mm3", 6).alias("voxel_mm3"), F.round("anisotropy", 4).alias("anisotropy"), "compartment", "n_voxels", F.round("volume_mm3", 3).alias("volume_mm3"))


def cases(value: str, bins: tuple) -> str:
    return f"(VALUES {', '.join(f'(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE))' for a, b in bins)}) b(low, high) WHERE {value} >= low AND {value} < high"


@query(
    "d17_deviation_by_anisotropy",
    f"WITH {DEVIATED} SELECT compartment, low, high, count(*) AS n, round(quantile_cont(deviation, 0.1), 6) AS p10, round(quantile_cont(deviation, 0.5), 6) AS median, round(quantile_cont(deviation, 0.9), 6) AS p90 FROM dev, {cases('anisotropy', audit.ANISOTROPY)} AND atlas_mm3 >= {audit.LEAST_VOLUME} GROUP BY compartment, low, high HAVING count(*) >= {audit.LEAST_POINTS}",
    "native_masks",
)
def d17_anisotropy(spark, sf_dir):
    """How far native volumes lie from the atlas by compartment and anisotropy of the native grid."""
    return audit.deviation_by_anisotropy(audit.scan_deviations(measured(spark, sf_dir), audit.LEAST_VOLUME)).select("compartment", "low", "high", "n", *(F.round(c, 6).alias(c) for c in ("p10", "median", "p90")))


@query(
    "d17_spread_by_size",
    f"""WITH {DEVIATED}, s AS (SELECT 'all' AS series, * FROM dev UNION ALL SELECT 'even', * FROM dev WHERE anisotropy < {audit.ANISOTROPY[0][1]} UNION ALL SELECT 'uneven', * FROM dev WHERE anisotropy >= {audit.UNEVEN})
    SELECT series, CAST(low AS BIGINT) AS low, count(*) AS n, round(quantile_cont(deviation, 0.9) - quantile_cont(deviation, 0.1), 6) AS spread FROM s, {cases('atlas_mm3', audit.SIZES)} AND atlas_mm3 >= {audit.LEAST_BAND_VOLUME} GROUP BY series, low HAVING count(*) >= {audit.LEAST_POINTS}""",
    "native_masks",
)
def d17_size(spark, sf_dir):
    """The spread of the deviations by the size of the compartment."""
    return audit.spread_by_size(audit.scan_deviations(measured(spark, sf_dir), audit.LEAST_BAND_VOLUME)).select("series", "low", "n", F.round("spread", 6).alias("spread"))


FIRST = "CASE item " + " ".join(f"WHEN '{m}' THEN {k}" for k, m in enumerate(listing.MODALITIES)) + " END"


@query("c07_preferred_item", f"WITH {HELD} SELECT patient, timepoint, min_by(item, {FIRST}) AS item, min_by(path, {FIRST}) AS path FROM held WHERE item IN ({', '.join(map(repr, listing.MODALITIES))}) GROUP BY ALL", "archive")
def c07(spark, sf_dir):
    """The image in the masks' space that a scan is referred to."""
    return listing.reference_image(held(spark, sf_dir))


@query("c20_usable_visits", f"WITH {HELD} SELECT patient, timepoint FROM held GROUP BY ALL HAVING bool_or(item = 'DeepBraTumIA') AND bool_or(item = 'brain') AND bool_or(item IN ({', '.join(map(repr, listing.MODALITIES))}))", "archive")
def c20(spark, sf_dir):
    """Scans for which mask, brain mask and reference image are all there."""
    return listing.usable_scans(held(spark, sf_dir))


@query("l02_required_items", f"WITH {HELD} SELECT o_custkey AS patient, o_orderkey AS timepoint, concat_ws(',', CASE WHEN NOT coalesce(bool_or(item = 'CT1'), FALSE) THEN 'CT1' END, CASE WHEN NOT coalesce(bool_or(item = 'FLAIR'), FALSE) THEN 'FLAIR' END) AS missing FROM orders LEFT JOIN held ON timepoint = o_orderkey GROUP BY ALL", "archive")
def l02(spark, sf_dir):
    """The required modalities that a scan lacks."""
    scans = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey").alias("patient"), F.col("o_orderkey").alias("timepoint"))
    return listing.missing_items(scans, held(spark, sf_dir), ("CT1", "FLAIR")).withColumn("missing", F.array_join("missing", ","))


SCANNED = "sc AS (SELECT patient, timepoint, field_strength, trim(vendor) AS vendor, slice_thickness FROM scanners)"


def scanned(spark, sf_dir: str) -> DataFrame:
    return frame(spark, sf_dir, "scanners").withColumn("vendor", F.trim("vendor"))


@query("d18_field_by_vendor", f"WITH {SCANNED} SELECT field_strength, " + ", ".join(f"count(*) FILTER (vendor = '{v}') AS {v.lower()}" for v in ("GE", "Philips", "SIEMENS")) + " FROM sc WHERE field_strength IS NOT NULL GROUP BY field_strength", "scanners")
def d18_fields(spark, sf_dir):
    """Scans by field strength and vendor."""
    rows = scanned(spark, sf_dir).where("field_strength IS NOT NULL").groupBy("field_strength").pivot("vendor", ["GE", "Philips", "SIEMENS"]).count().na.fill(0)
    return rows.select("field_strength", *(F.col(v).alias(v.lower()) for v in ("GE", "Philips", "SIEMENS")))


@query("d18_slice_thickness", f"WITH {SCANNED} SELECT count(slice_thickness) AS n, min(slice_thickness) AS least, median(slice_thickness) AS median, max(slice_thickness) AS most FROM sc", "scanners")
def d18_slices(spark, sf_dir):
    rows = stash(scanned(spark, sf_dir).select("slice_thickness"))
    return rows.agg(F.count("slice_thickness").alias("n"), F.min("slice_thickness").alias("least"), F.max("slice_thickness").alias("most")).crossJoin(order.medians(rows, {"median": "slice_thickness"}))


CARDS = f"""{HELD}, {SCANNED}, r AS (SELECT s.patient, s.timepoint, s.week, s.rating, contains(lower(coalesce(q.rationale, '')), 'less than 3 months') AS soon FROM scans s LEFT JOIN (SELECT timepoint, rationale FROM rationale) q USING (timepoint)),
cover AS (SELECT s.patient, avg(CASE WHEN h.timepoint IS NULL THEN 0 ELSE 1 END) AS coverage FROM scans s LEFT JOIN (SELECT DISTINCT timepoint FROM held WHERE item = 'DeepBraTumIA') h ON h.timepoint = s.timepoint GROUP BY s.patient),
fields AS (SELECT patient, count(DISTINCT field_strength) AS field_strengths FROM sc GROUP BY patient),
cards AS (SELECT r.patient, count(*) AS n, max(week) - min(week) AS span, bool_or(coalesce(rating = 'Post-Op', FALSE)) AS has_baseline, bool_or(coalesce(rating = 'PD', FALSE)) AS ever_pd, count(*) FILTER (rating = 'PD' AND soon) AS flags,
  any_value(coverage) AS coverage, any_value(field_strengths) AS field_strengths, any_value(field_strengths) > 1 AS scanner_switch FROM r JOIN cover USING (patient) JOIN fields USING (patient) GROUP BY r.patient)"""


def cards(spark, sf_dir: str) -> DataFrame:
    scans = frame(spark, sf_dir, "scans").select("patient", "timepoint", "week", "rating")
    texts = frame(spark, sf_dir, "rationale").select("timepoint", F.contains(F.lower("rationale"), F.lit("less than 3 months")).alias("soon"))
    masks = held(spark, sf_dir).where("item = 'DeepBraTumIA'").select("timepoint", F.lit(1).alias("masked"))
    fields = scanned(spark, sf_dir).groupBy("patient").agg(F.countDistinct("field_strength").alias("field_strengths"))
    return cohort.scorecards(scans.join(texts, "timepoint", "left").join(masks, "timepoint", "left"), fields)


@query("d20_patient_scorecard", f"WITH {CARDS} SELECT patient, n, span, has_baseline, ever_pd, flags, round(coverage, 6) AS coverage, field_strengths, scanner_switch FROM cards", "scans", "rationale", "archive", "scanners")
def d20(spark, sf_dir):
    """What matters for following a patient: baseline, span, progression, early-progression flags, masks, changes of scanner."""
    return cards(spark, sf_dir).withColumn("coverage", F.round("coverage", 6))


@query("d20_trackability", f"WITH {CARDS} SELECT count(*) AS patients, count(*) FILTER (has_baseline) AS with_baseline, count(*) FILTER (ever_pd) AS progressed, count(*) FILTER (coverage = 1) AS covered, count(*) FILTER (scanner_switch) AS switched FROM cards", "scans", "rationale", "archive", "scanners")
def d20_summary(spark, sf_dir):
    count = lambda c: F.count(F.when(c, 1))
    return cards(spark, sf_dir).agg(F.count(F.lit(1)).alias("patients"), count(F.col("has_baseline")).alias("with_baseline"), count(F.col("ever_pd")).alias("progressed"), count(F.col("coverage") == 1).alias("covered"), count(F.col("scanner_switch")).alias("switched"))


@query("d34_size_by_calls", f"WITH {catalog_rule.RECORDS}, calls AS ({catalog_rule.rule_sql(DEFAULT).replace('rating, arm, week', 'rating, arm, week, enhancing_mm3')}) SELECT {BAND.format(v='enhancing_mm3')} AS pp, rating AS expert, call, count(*) AS n FROM calls WHERE rating IN ('CR', 'PR', 'SD', 'PD') GROUP BY ALL", "scans")
def d34_calls(spark, sf_dir):
    """Scans by the noise of their size, the expert's call and the rule's."""
    rows = catalog_rule.rule_calls(spark, sf_dir, [DEFAULT]).where(F.col("rating").isin(*evaluate.CLASSES))
    return rows.groupBy(scalars.uncertainty_pp(F.col("enhancing_mm3")).alias("pp"), F.col("rating").alias("expert"), "call").agg(F.count(F.lit(1)).alias("n"))


#: The single-signal rule under both readings of the labels: as it is, and with the two labels swapped.
SIGNALS = {"corrected": "enhancing_mm3", "swapped": "necrosis_mm3"}
SIGNAL = ", ".join(f"""{k} AS (SELECT '{k}' AS variant, timepoint, rating, CASE WHEN n = 1 THEN 'BASELINE' WHEN v = 0 THEN 'CR' WHEN nadir > 0 AND (v - nadir) / nadir >= 0.4 THEN 'PD' WHEN nadir = 0 AND v > 0 THEN 'PD' WHEN base > 0 AND (v - base) / base <= -0.65 THEN 'PR' ELSE 'SD' END AS call
  FROM (SELECT timepoint, rating, {c} AS v, row_number() OVER w AS n, first_value({c}) OVER w AS base, min({c}) OVER (PARTITION BY patient ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS nadir FROM scans WHERE {c} IS NOT NULL WINDOW w AS (PARTITION BY patient ORDER BY rn)))""" for k, c in SIGNALS.items())
SIGNALLED = SIGNAL + ", both_ AS (SELECT * FROM corrected UNION ALL SELECT * FROM swapped), judged AS (SELECT variant, rating AS expert, call FROM both_ WHERE call <> 'BASELINE' AND rating IN ('CR', 'PR', 'SD', 'PD'))"


def signals(spark, sf_dir: str) -> DataFrame:
    scans, out = frame(spark, sf_dir, "scans"), None
    for name, column in SIGNALS.items():
        part = rule.single_signal(scans, column).select(F.lit(name).alias("variant"), "timepoint", "rating", "call")
        out = part if out is None else out.union(part)
    return out


def judged(spark, sf_dir: str) -> DataFrame:
    return signals(spark, sf_dir).where(F.col("rating").isin(*evaluate.CLASSES) & (F.col("call") != "BASELINE")).withColumnRenamed("rating", "expert")


@query("i12_single_signal", f"WITH {SIGNALLED} SELECT variant, timepoint, call FROM both_", "scans")
def i12(spark, sf_dir):
    """Calls by one volume alone, under both readings of the labels."""
    return signals(spark, sf_dir).select("variant", "timepoint", "call")


@query("i12_variants", f"WITH {SIGNALLED}, k AS (SELECT variant, expert, count(*) AS n, count(*) FILTER (expert = call) AS hit FROM judged GROUP BY ALL) SELECT variant, CAST(sum(n) AS BIGINT) AS n, CAST(sum(hit) AS BIGINT) AS n_agree, round(100.0 * sum(hit) / sum(n), 6) AS agreement_pct, round(100.0 * avg(hit / n), 6) AS balanced_pct FROM k GROUP BY variant", "scans")
def i12_variants(spark, sf_dir):
    """How far each reading agrees with the expert, plainly and balanced over the classes."""
    k = judged(spark, sf_dir).groupBy("variant", "expert").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("expert") == F.col("call"), 1)).alias("hit"))
    return k.groupBy("variant").agg(F.sum("n").alias("n"), F.sum("hit").alias("n_agree"), F.round(100.0 * F.sum("hit") / F.sum("n"), 6).alias("agreement_pct"), F.round(100.0 * F.avg(F.col("hit") / F.col("n")), 6).alias("balanced_pct"))


@query("i12_confusion", f"WITH {SIGNALLED} SELECT variant, expert, call, count(*) AS n FROM judged GROUP BY ALL", "scans")
def i12_confusion(spark, sf_dir):
    return judged(spark, sf_dir).groupBy("variant", "expert", "call").agg(F.count(F.lit(1)).alias("n"))


PRINTS = f"""u AS (SELECT patient, nx, ny, nz, {S[0]} AS s0, {S[1]} AS s1, {S[2]} AS s2, {DET} AS voxel_mm3 FROM geometry WHERE role = 'mask'),
w AS (SELECT v.patient, v.visit, v.label, CAST(i.value AS DOUBLE) AS value FROM voxels v LEFT JOIN intensities i USING (patient, visit, x, y, z)),
l AS (SELECT patient, visit, label, count(*) AS n, avg(value) AS mean, stddev_pop(value) AS sd FROM w GROUP BY ALL),
m AS (SELECT patient, visit, avg(value) FILTER (value <> 0) AS mean, stddev_pop(value) FILTER (value <> 0) AS sd, min(value) FILTER (value <> 0) AS least, max(value) FILTER (value <> 0) AS most, quantile_cont(value, 0.5) FILTER (value <> 0) AS median FROM w GROUP BY ALL)"""


def prints(spark, sf_dir: str) -> DataFrame:
    values = frame(spark, sf_dir, "voxels").join(frame(spark, sf_dir, "intensities").withColumn("value", F.col("value").cast("double")), ["patient", "visit", "x", "y", "z"], "left")
    return volumetry.fingerprints(values, validate.geometry(frame(spark, sf_dir, "geometry").where("role = 'mask'")))


@query(
    "d04_fingerprints",
    f"""WITH {PRINTS} SELECT m.patient, count(*) OVER (PARTITION BY m.patient) AS n_scans, m.visit, concat(nx, 'x', ny, 'x', nz) AS shape, round(greatest(s0, s1, s2) / least(s0, s1, s2), 4) AS anisotropy, round(voxel_mm3, 6) AS voxel_mm3,
    (SELECT string_agg(concat(label, '=', n), ',' ORDER BY label) FROM l WHERE l.patient = m.patient AND l.visit = m.visit) AS histogram, round(mean, 6) AS mean, round(sd, 4) AS sd, least, most, round(median, 6) AS median FROM m JOIN u USING (patient)""",
    "geometry", "voxels", "intensities",
)
def d04(spark, sf_dir):
    """The nested record of a patient, laid out again: each scan in order with its grid, label histogram and intensities."""
    rows = prints(spark, sf_dir).select("patient", "n_scans", F.inline("scans"))
    text = F.array_join(F.transform("labels", lambda x: F.concat(x["label"].cast("string"), F.lit("="), x["n"].cast("string"))), ",")
    return rows.select("patient", "n_scans", "visit", F.concat_ws("x", "shape").alias("shape"), F.round("anisotropy", 4).alias("anisotropy"), F.round("voxel_mm3", 6).alias("voxel_mm3"), text.alias("histogram"), F.round("mean", 6).alias("mean"), F.round("sd", 4).alias("sd"), "least", "most", F.round("median", 6).alias("median"))


@query("d04_compartment_intensities", f"WITH {PRINTS} SELECT patient, visit, label, n, round(mean, 6) AS mean, round(sd, 4) AS sd FROM l", "geometry", "voxels", "intensities")
def d04_labels(spark, sf_dir):
    """The same record's intensities of each label."""
    rows = prints(spark, sf_dir).select("patient", F.inline("scans")).select("patient", "visit", F.inline("labels"))
    return rows.select("patient", "visit", "label", "n", F.round("mean", 6).alias("mean"), F.round("sd", 4).alias("sd"))

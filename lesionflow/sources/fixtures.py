"""Derived views over the given tables, in SQL that Spark and DuckDB both accept."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = "lineitem|orders|customer|supplier|embeddings|events|documents"

VIEWS: dict[str, str] = {
    "scans": """
WITH vol AS (
  SELECT l_orderkey AS timepoint,
    40.0 * sum(CASE WHEN l_returnflag = 'A' OR (l_returnflag = 'R' AND l_linestatus = 'F') THEN l_quantity ELSE 0 END) AS enhancing_mm3,
    40.0 * sum(CASE WHEN l_returnflag = 'R' AND l_linestatus = 'O' THEN l_quantity ELSE 0 END) AS necrosis_mm3,
    40.0 * sum(CASE WHEN l_returnflag = 'N' THEN l_quantity ELSE 0 END) AS t2_flair_mm3,
    max(l_quantity) AS longest
  FROM lineitem GROUP BY l_orderkey),
ord AS (
  SELECT o_custkey AS patient, o_orderkey AS timepoint, o_orderstatus AS st, o_orderpriority AS pr,
    year(o_orderdate) * 360 + month(o_orderdate) * 30 + day(o_orderdate) AS d
  FROM orders),
wk AS (
  SELECT *, CASE WHEN timepoint % 97 = 0 THEN NULL
    ELSE CAST(floor((d - min(d) OVER (PARTITION BY patient)) / 28.0) AS DOUBLE) END AS week
  FROM ord),
rn AS (
  SELECT *, row_number() OVER (PARTITION BY patient ORDER BY week ASC NULLS LAST, timepoint) AS rn FROM wk)
SELECT rn.patient, rn.timepoint, rn.week, rn.rn,
  vol.enhancing_mm3, vol.necrosis_mm3, vol.t2_flair_mm3,
  CASE WHEN rn.timepoint % 20 = 0 THEN true WHEN rn.timepoint % 20 < 10 THEN false ELSE NULL END AS new_lesion,
  CASE WHEN rn.timepoint % 50 = 7 THEN true WHEN rn.timepoint % 2 = 0 THEN false ELSE NULL END AS clinical_deterioration,
  CASE WHEN rn.timepoint % 3 = 0 THEN true WHEN rn.timepoint % 3 = 1 THEN false ELSE NULL END AS steroids_increased,
  CASE WHEN rn.timepoint % 11 = 0 THEN true WHEN rn.timepoint % 11 < 6 THEN false ELSE NULL END AS non_measurable_only,
  CASE WHEN rn.timepoint % 5 = 0 THEN NULL ELSE vol.longest >= 20 END AS measurable_disease,
  rn.week - 10.0 AS weeks_since_rt,
  CASE WHEN rn.rn = 1 AND rn.st = 'F' THEN 'Pre-Op'
       WHEN (rn.rn <= 2 AND rn.st = 'O') OR (rn.st = 'O' AND rn.pr = '5-LOW') THEN 'Post-Op'
       WHEN rn.pr = '5-LOW' THEN NULL
       WHEN rn.pr = '1-URGENT' OR (rn.pr = '4-NOT SPECIFIED' AND rn.st <> 'P') THEN 'PD'
       WHEN rn.pr = '2-HIGH' THEN 'SD'
       WHEN rn.pr = '3-MEDIUM' AND rn.st = 'F' THEN 'CR'
       WHEN rn.pr = '3-MEDIUM' THEN 'SD'
       ELSE 'PR' END AS rating,
  CASE WHEN rn.patient % 7 < 2 THEN 'practice' WHEN rn.patient % 7 < 4 THEN 'held_out' ELSE 'unassigned' END AS arm
FROM rn LEFT JOIN vol ON rn.timepoint = vol.timepoint
""",
    "voxels": """
SELECT l_suppkey AS patient, CAST(year(l_shipdate) AS BIGINT) AS visit, l_partkey % 8 AS x, l_orderkey % 8 AS y,
  l_linenumber AS z, min(CASE l_returnflag WHEN 'A' THEN 1 WHEN 'R' THEN 2 ELSE 3 END) AS label
FROM lineitem GROUP BY l_suppkey, year(l_shipdate), l_partkey % 8, l_orderkey % 8, l_linenumber
""",
    "intensities": """
SELECT l_suppkey AS patient, CAST(year(l_shipdate) AS BIGINT) AS visit, l_partkey % 8 AS x, l_orderkey % 8 AS y,
  l_linenumber AS z, CASE WHEN min(l_orderkey) % 9 = 0 THEN 0.0 ELSE max(l_extendedprice) END AS value
FROM lineitem GROUP BY l_suppkey, year(l_shipdate), l_partkey % 8, l_orderkey % 8, l_linenumber
""",
    "geometry": """
SELECT s_suppkey AS patient, role, 8 AS nx, CASE WHEN role = 'mask_reference' AND s_suppkey % 25 = 0 THEN 9 ELSE 8 END AS ny, 7 AS nz,
  1.0 + CASE WHEN role = 'mask_reference' AND s_suppkey % 10 = 1 THEN 0.0005 ELSE 0.0 END AS a00,
  CASE WHEN s_suppkey % 10 = 2 AND role = 'mask_reference' THEN 0.01 ELSE 0.0 END AS a01,
  0.0 AS a02, 0.0 AS a10, 1.0 AS a11, 0.0 AS a12, 0.0 AS a20, 0.0 AS a21,
  CASE WHEN s_suppkey % 4 = 0 THEN 5.0 ELSE 1.0 END AS a22,
  s_nationkey + CASE WHEN role = 'mask_reference' AND s_suppkey % 10 = 3 THEN 0.002 ELSE 0.0 END AS t0, 0.0 AS t1, 0.0 AS t2
FROM supplier CROSS JOIN (SELECT 'mask' AS role UNION ALL SELECT 'mask_reference' AS role) r
""",
    "solids": """
SELECT s_suppkey AS patient, v.visit, g.x, g.y, h.y AS z, 1 AS label
FROM supplier
CROSS JOIN (SELECT CAST(1 AS BIGINT) AS visit UNION ALL SELECT CAST(2 AS BIGINT) AS visit) v
CROSS JOIN (SELECT a.x, b.y FROM (SELECT DISTINCT CAST(l_quantity AS BIGINT) AS x FROM lineitem WHERE l_quantity <= 14) a CROSS JOIN (SELECT DISTINCT CAST(l_quantity AS BIGINT) AS y FROM lineitem WHERE l_quantity <= 7) b) g
CROSS JOIN (SELECT DISTINCT CAST(l_quantity AS BIGINT) AS y FROM lineitem WHERE l_quantity <= 7) h
WHERE (g.x <= 2 + s_suppkey % 3 + v.visit AND g.y <= 2 + s_suppkey % 5 AND h.y <= 2 + s_suppkey % 4)
  OR (v.visit = 2 AND s_suppkey % 4 <> 3 AND g.x >= 10 AND g.x <= 10 + s_suppkey % 4 AND g.y <= 3 + s_suppkey % 2 AND h.y <= 3 + s_suppkey % 3)
  OR (v.visit = 2 AND s_suppkey % 4 <> 3 AND s_suppkey % 5 = 0 AND g.y = 2 AND h.y = 2 AND g.x <= 10)
""",
    "plates": """
SELECT s_suppkey AS patient, CAST(1 AS BIGINT) AS visit, g.x, h.y, z.z, 1 AS label
FROM supplier
CROSS JOIN (SELECT DISTINCT CAST(l_quantity AS BIGINT) AS x FROM lineitem WHERE l_quantity <= 9) g
CROSS JOIN (SELECT DISTINCT CAST(l_quantity AS BIGINT) AS y FROM lineitem WHERE l_quantity <= 10) h
CROSS JOIN (SELECT DISTINCT CAST(l_quantity AS BIGINT) AS z FROM lineitem WHERE l_quantity <= 2) z
WHERE g.x <= 6 + s_suppkey % 4 - (CASE WHEN z.z = 1 THEN 1 ELSE 0 END) AND h.y <= 6 + s_suppkey % 5
  AND NOT (s_suppkey % 7 < 2 AND g.x BETWEEN 3 AND 4 AND h.y BETWEEN 3 AND 4)
  AND NOT (s_suppkey % 7 = 2 AND g.x = 3 AND h.y <= 4)
  AND NOT (s_suppkey % 7 = 3 AND g.x <= 3 AND h.y <= 3)
  AND NOT (s_suppkey % 7 = 4 AND g.x BETWEEN 3 AND 4 AND h.y >= 3)
""",
    "cores": """
SELECT s_suppkey AS patient, CAST(1 AS BIGINT) AS visit, g.x, h.y, z.z, CASE WHEN (s_suppkey % 7 < 2 AND g.x BETWEEN 3 AND 4 AND h.y BETWEEN 3 AND 4)
    OR (s_suppkey % 7 = 2 AND g.x = 3 AND h.y <= 4)
    OR (s_suppkey % 7 = 3 AND g.x <= 3 AND h.y <= 3)
    OR (s_suppkey % 7 = 4 AND g.x BETWEEN 3 AND 4 AND h.y >= 3) THEN 2 ELSE 1 END AS label
FROM supplier
CROSS JOIN (SELECT DISTINCT CAST(l_quantity AS BIGINT) AS x FROM lineitem WHERE l_quantity <= 9) g
CROSS JOIN (SELECT DISTINCT CAST(l_quantity AS BIGINT) AS y FROM lineitem WHERE l_quantity <= 10) h
CROSS JOIN (SELECT DISTINCT CAST(l_quantity AS BIGINT) AS z FROM lineitem WHERE l_quantity <= 2) z
WHERE g.x <= 6 + s_suppkey % 4 - (CASE WHEN z.z = 1 THEN 1 ELSE 0 END) AND h.y <= 6 + s_suppkey % 5
""",
    "visits": """
SELECT patient, visit, CASE (patient + visit) % 6 WHEN 0 THEN 'Post-Op' WHEN 1 THEN 'CR' WHEN 2 THEN 'PR' WHEN 3 THEN 'SD' ELSE 'PD' END AS rating,
  CASE (patient * 3 + visit) % 5 WHEN 0 THEN 'new target L. seen' WHEN 1 THEN 'New L. frontal' WHEN 2 THEN '' ELSE 'stable' END AS note
FROM (SELECT DISTINCT l_suppkey AS patient, CAST(year(l_shipdate) AS BIGINT) AS visit FROM lineitem) v
""",
    "scan_items": """
SELECT o_custkey AS patient, o_orderkey AS timepoint, o_orderkey % 13 <> 0 AS has_ct1, o_orderkey % 17 <> 0 AS has_flair,
  label, n
FROM orders LEFT JOIN (SELECT l_orderkey, CASE WHEN l_linenumber = 7 AND l_orderkey % 10 = 0 THEN 9 WHEN l_returnflag = 'A' THEN 1 WHEN l_returnflag = 'R' THEN 2 ELSE 3 END AS label, count(*) AS n
  FROM lineitem WHERE l_orderkey % 29 <> 0 GROUP BY l_orderkey, CASE WHEN l_linenumber = 7 AND l_orderkey % 10 = 0 THEN 9 WHEN l_returnflag = 'A' THEN 1 WHEN l_returnflag = 'R' THEN 2 ELSE 3 END) l ON l.l_orderkey = o_orderkey
""",
    "rationale": """
SELECT o_custkey AS patient, o_orderkey AS timepoint,
  CASE o_orderkey % 18 WHEN 0 THEN '' WHEN 1 THEN 'None' WHEN 2 THEN '  none  '
       WHEN 3 THEN concat('Target L.: 1 ', CAST(5 + o_orderkey % 31 AS VARCHAR(9)), 'mm x ', CAST(4 + o_orderkey % 23 AS VARCHAR(9)), 'mm')
       WHEN 4 THEN concat('new non-target L., T2-Progr. ', CAST(5 + o_orderkey % 17 AS VARCHAR(9)), ' x ', CAST(9 + o_orderkey % 7 AS VARCHAR(9)), ' mm')
       WHEN 5 THEN 'CRET, irradiated area, less than 3 months'
       WHEN 6 THEN concat('PRET; new target L. 12mm x 10mm and ', CAST(6 + o_orderkey % 19 AS VARCHAR(9)), 'mm x 8mm, target L. 10mm x 12mm')
       WHEN 7 THEN concat('Target L. ', CAST(5 + o_orderkey % 11 AS VARCHAR(9)), '.5mm x 8.25mm')
       WHEN 8 THEN '10mm × 9mm, 10 MM X 9 MM' WHEN 9 THEN '12 X 13, Non-measurable L.'
       WHEN 10 THEN 'new non-measurable L. seen, Avastin started' WHEN 11 THEN 'New L. frontal; bevacizumab given'
       WHEN 12 THEN 'Temodal, non target L. stable' WHEN 13 THEN 'temozolomide; T2 Progr., nontarget l. larger'
       WHEN 14 THEN 'stable' WHEN 15 THEN 'renewed imaging, PRETX, t2progr'
       WHEN 16 THEN concat('newly nonmeasurable focus; target L. 1: ', CAST(4 + o_orderkey % 5 AS VARCHAR(9)), ' x ', CAST(3 + o_orderkey % 4 AS VARCHAR(9)))
       ELSE 'non-target L. and target L., new target lump' END AS rationale
FROM orders
""",
    "demographics": """
SELECT c_custkey AS patient,
  CASE c_custkey % 7 WHEN 0 THEN 'WT' WHEN 1 THEN 'IDH1 R132H positive' WHEN 2 THEN ' wild type' WHEN 3 THEN 'IDH1 neg.' WHEN 4 THEN 'Mutated' WHEN 5 THEN 'n/a' END AS idh,
  CASE c_custkey % 5 WHEN 0 THEN 'NA' WHEN 1 THEN ' Methylated' WHEN 2 THEN 'not methylated ' WHEN 3 THEN '' END AS mgmt,
  CASE c_custkey % 3 WHEN 0 THEN ' Male' WHEN 1 THEN 'female ' ELSE 'F' END AS sex,
  CASE c_custkey % 4 WHEN 0 THEN 'unknown' WHEN 1 THEN '' ELSE concat(' ', CAST(c_custkey % 180 AS VARCHAR(9)), '.5') END AS weeks
FROM customer
""",
    "survival": """
SELECT c_custkey AS patient, c_mktsegment AS grp, CAST(1 + (c_custkey * 7919) % 180 AS DOUBLE) AS weeks, 1 AS event FROM customer
""",
    "native_masks": """
SELECT g.patient, g.timepoint, g.modality, g.s0, g.s1, g.s2, CASE WHEN (g.timepoint + g.k) % 37 = 0 AND c.label = 3 THEN 9 ELSE c.label END AS label,
  CAST(floor(c.mm3 * (1.0E0 + g.k * (g.timepoint % 21 - 10) / 400.0E0) / (g.s0 * g.s1 * g.s2)) AS BIGINT) AS n
FROM (SELECT o_orderkey AS timepoint, o_custkey AS patient, modality, k,
    CASE WHEN k = 0 THEN 1.0E0 ELSE 0.5E0 + 0.25E0 * (o_orderkey % 3) END AS s0, CASE WHEN k = 0 THEN 1.0E0 ELSE 0.5E0 + 0.25E0 * (o_orderkey % 3) END AS s1,
    CASE WHEN k = 0 THEN 1.0E0 WHEN (o_orderkey + k) % 5 = 0 THEN 0.5E0 + 0.25E0 * (o_orderkey % 3) WHEN (o_orderkey + k) % 5 = 1 THEN 2.0E0 WHEN (o_orderkey + k) % 5 = 2 THEN 4.0E0 WHEN (o_orderkey + k) % 5 = 3 THEN 5.5E0 ELSE 7.0E0 END AS s2
  FROM orders CROSS JOIN (SELECT 'atlas' AS modality, 0 AS k UNION ALL SELECT 'CT1', 1 UNION ALL SELECT 'T1', 2 UNION ALL SELECT 'T2', 3 UNION ALL SELECT 'FLAIR', 4) m
  WHERE NOT (k = 0 AND o_orderkey % 29 = 0) AND NOT (k > 0 AND (o_orderkey + k) % 23 = 0)) g
JOIN (SELECT l_orderkey AS timepoint, CASE l_returnflag WHEN 'A' THEN 1 WHEN 'R' THEN 2 ELSE 3 END AS label, 40.0E0 * CAST(sum(l_quantity) AS DOUBLE) AS mm3
  FROM lineitem GROUP BY l_orderkey, CASE l_returnflag WHEN 'A' THEN 1 WHEN 'R' THEN 2 ELSE 3 END) c ON c.timepoint = g.timepoint
""",
    "claims": """
SELECT o_custkey AS patient, o_orderkey AS timepoint, item, CASE WHEN (o_orderkey * 7 + k) % 53 = 0 THEN NULL ELSE (o_orderkey * 7 + k) % 13 <> 0 END AS present
FROM orders CROSS JOIN (SELECT 'CT1' AS item, 1 AS k UNION ALL SELECT 'T1', 2 UNION ALL SELECT 'T2', 3 UNION ALL SELECT 'FLAIR', 4 UNION ALL SELECT 'DeepBraTumIA', 5) m
WHERE o_orderkey % 43 <> 0
""",
    "archive": """
SELECT concat('Imaging/Patient-', CAST(o_custkey AS VARCHAR(20)), '/week-', CAST(o_orderkey AS VARCHAR(20)), CASE WHEN k = 5 THEN '/DeepBraTumIA-segmentation/atlas/segmentation/seg_mask.nii.gz' WHEN k = 6 THEN '/DeepBraTumIA-segmentation/atlas/skull_strip/brain_mask.nii.gz' ELSE concat('/', item, '.nii.gz') END) AS path,
  CASE WHEN (o_orderkey + k) % 61 = 0 THEN 0 ELSE 1000 + o_orderkey END AS length
FROM orders CROSS JOIN (SELECT 'CT1' AS item, 1 AS k UNION ALL SELECT 'T1', 2 UNION ALL SELECT 'T2', 3 UNION ALL SELECT 'FLAIR', 4 UNION ALL SELECT 'DeepBraTumIA', 5 UNION ALL SELECT 'brain', 6) m
WHERE ((o_orderkey * 7 + k) % 13 <> 0) <> ((o_orderkey + 3 * k) % 41 = 0)
UNION ALL SELECT concat('Imaging/Patient-', CAST(o_custkey AS VARCHAR(20)), '/week-', CAST(o_orderkey AS VARCHAR(20)), '/notes.txt'), 10 FROM orders WHERE o_orderkey % 10 = 0
""",
    "scanners": """
SELECT o_custkey AS patient, o_orderkey AS timepoint, CASE WHEN o_orderkey % 19 = 0 THEN NULL WHEN (o_orderkey + o_custkey) % 7 < 5 THEN 1.5E0 ELSE 3.0E0 END AS field_strength,
  CASE o_orderkey % 4 WHEN 0 THEN ' SIEMENS' WHEN 1 THEN 'Philips ' WHEN 2 THEN 'GE' ELSE 'SIEMENS' END AS vendor, CASE WHEN o_orderkey % 23 = 0 THEN NULL ELSE 0.9E0 + 0.5E0 * (o_orderkey % 11) END AS slice_thickness
FROM orders
""",
    "methods": """
SELECT l_orderkey AS timepoint, sum(l_quantity) AS tool_a, sum(l_extendedprice) / 1500.0 AS tool_b FROM lineitem GROUP BY l_orderkey
""",
}


def sql_over(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """The query with its table names replaced by the Parquet files of ``sf_dir``. Suppliers lie in one small file, which views cross with whole grids: they are dealt out first and
    the few rows of an axis broadcast, so that not one task lays out all the grids."""
    if re.search(r"\bFROM supplier\s+CROSS JOIN", sql):
        dealt = f"FROM (SELECT /*+ REPARTITION({spark.conf.get('spark.sql.shuffle.partitions')}) */ * FROM supplier) supplier CROSS JOIN"
        sql = re.sub(r"\bFROM supplier\s+CROSS JOIN", dealt, sql).replace("SELECT s_suppkey AS patient", "SELECT /*+ BROADCAST(v, g, h, z, r) */ s_suppkey AS patient", 1)
    return spark.sql(re.sub(rf"\b(FROM|JOIN)\s+({TABLES})\b", lambda m: f"{m[1]} parquet.`{sf_dir}/{m[2]}.parquet`", sql))


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One derived view as a DataFrame."""
    return sql_over(spark, sf_dir, VIEWS[name])


def oracle(sql: str, *names: str) -> str:
    """DuckDB SQL that begins with the named views."""
    first = ", ".join(f"{n} AS ({VIEWS[n]})" for n in names)
    return f"WITH {first}{', ' + sql.strip()[5:] if sql.strip()[:5].upper() == 'WITH ' else ' ' + sql}"

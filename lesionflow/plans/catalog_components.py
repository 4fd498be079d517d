"""Queries on components: connectivity, floors, dominance of the largest lesion, pieces on slices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import nested, order
from ..sources.fixtures import oracle
from .catalog_voxel import R26, cells
from .shared import stash

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
#: Lesion floors of the connectivity study, in cells; most lesions told apart; the share from which one lesion dominates.
FLOORS, MOST, DOMINATES = (0, 1, 2, 5, 10, 20, 33, 50, 100), 8, 0.9


def query(name: str, sql: str):
    def keep(fn):
        QUERIES[name] = fn
        ORACLE[name] = oracle(sql.replace("RECURSIVE ", "", 1), "voxels").replace("WITH ", "WITH RECURSIVE ", 1)
        return fn

    return keep


def rooted(tag: str, near: str) -> str:
    """Roots under other neighbours of the cells k."""
    return f"""n{tag} AS (SELECT a.patient, a.visit, a.cell, b.cell AS other FROM k a JOIN k b ON a.patient = b.patient AND a.visit = b.visit AND {near}),
    walk{tag} AS (SELECT patient, visit, cell, cell AS root FROM k UNION SELECT e.patient, e.visit, e.other, w.root FROM walk{tag} w JOIN n{tag} e ON e.patient = w.patient AND e.visit = w.visit AND e.cell = w.cell WHERE w.root < e.other),
    roots{tag} AS (SELECT patient, visit, cell, CAST(min(root) AS BIGINT) AS root FROM walk{tag} GROUP BY ALL)"""


FLAT = "a.z = b.z AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1"
FACES = "abs(a.x - b.x) + abs(a.y - b.y) + abs(a.z - b.z) <= 1"
BOTH = f"{R26}, {rooted('6', FACES)}, s26 AS (SELECT patient, visit, root, count(*) AS n FROM roots GROUP BY ALL), s6 AS (SELECT patient, visit, root, count(*) AS n FROM roots6 GROUP BY ALL)"
PIECES = f"{rooted('8', FLAT)}, pieces AS (SELECT k.patient, k.visit, r.root, k.z, count(DISTINCT p.root) AS pieces FROM k JOIN roots r USING (patient, visit, cell) JOIN roots8 p USING (patient, visit, cell) GROUP BY ALL)"
RECORD = f"""{BOTH}, {PIECES}, big AS (SELECT patient, visit, root FROM s26 QUALIFY row_number() OVER (PARTITION BY patient, visit ORDER BY n DESC, root) = 1),
cut AS (SELECT patient, visit, count(*) AS slices, count(*) FILTER (pieces > 1) AS fragmented FROM pieces JOIN big USING (patient, visit, root) GROUP BY ALL),
record AS (SELECT a.patient, a.visit, a.total, a.n26, b.n6, a.largest, round(a.largest / a.total, 4) AS largest_share, slices, fragmented FROM (SELECT patient, visit, CAST(sum(n) AS BIGINT) AS total, count(*) AS n26, max(n) AS largest FROM s26 GROUP BY ALL) a
  JOIN (SELECT patient, visit, count(*) AS n6 FROM s6 GROUP BY ALL) b USING (patient, visit) JOIN cut USING (patient, visit))"""


def records(spark, sf_dir: str) -> DataFrame:
    rows = nested.records(cells(spark, sf_dir, 1))
    return rows.withColumns({"n26": F.size("sizes").cast("long"), "n6": F.size("sizes_6").cast("long"), "largest": F.col("sizes")[0]}).withColumn("largest_share", F.round(F.col("largest") / F.col("total"), 4))


def count(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


@query("j26_pieces_by_slice", f"WITH {R26}, {PIECES} SELECT patient, visit, root, CAST(z AS INTEGER) AS z, pieces FROM pieces")
def j26_slices(spark, sf_dir):
    return nested.pieces(cells(spark, sf_dir, 1))


@query("d16_connectivity_record", f"WITH {RECORD} SELECT * FROM record")
def d16(spark, sf_dir):
    return records(spark, sf_dir).select("patient", "visit", "total", "n26", "n6", "largest", "largest_share", "slices", "fragmented")


AT_FLOORS = f"""f AS (SELECT unnest([{', '.join(map(str, FLOORS))}]) AS floor), a AS (SELECT patient, visit, floor, count(*) FILTER (n >= floor) AS k26, sum(n) AS total, coalesce(sum(n) FILTER (n < floor), 0) AS lost FROM s26, f GROUP BY ALL),
b AS (SELECT patient, visit, floor, count(*) FILTER (n >= floor) AS k6 FROM s6, f GROUP BY ALL), j AS (SELECT * FROM a JOIN b USING (patient, visit, floor))"""


def at_floors(spark, sf_dir: str) -> DataFrame:
    """For each scan and floor: lesions under both kinds of neighbours, and cells that the floor throws away."""
    rows = records(spark, sf_dir).select("patient", "visit", "total", "sizes", "sizes_6", F.explode(F.array(*map(F.lit, FLOORS))).alias("floor"))
    above = lambda c: F.size(F.filter(c, lambda n: n >= F.col("floor"))).cast("long")
    lost = F.aggregate("sizes", F.lit(0).cast("long"), lambda s, n: s + F.when(n < F.col("floor"), n).otherwise(0))
    return rows.select("patient", "visit", "total", "floor", above("sizes").alias("k26"), above("sizes_6").alias("k6"), lost.alias("lost"))


@query(
    "d15_connectivity_by_floor",
    f"""WITH {BOTH}, {AT_FLOORS}
    SELECT floor, count(*) AS scans, count(*) FILTER (k26 = k6) AS agree, count(*) FILTER (k26 > k6) AS more_26, count(*) FILTER (k6 > k26) AS more_6, max(abs(k26 - k6)) AS widest, CAST(sum(lost) AS BIGINT) AS discarded, round(sum(lost) / sum(total), 6) AS discarded_share,
      round(max(lost / total), 6) AS worst_share, list_sort(list(k26))[count(*) // 2 + 1] AS median_lesions, count(*) FILTER (k26 = 1) AS single, count(*) FILTER (k26 = 2) AS two, count(*) FILTER (k26 = 3) AS three, count(*) FILTER (k26 IN (4, 5)) AS four_five, count(*) FILTER (k26 >= 6) AS six_more, max(k26) AS most FROM j GROUP BY floor""",
)
def d15(spark, sf_dir):
    """For each floor: how often the lesion counts of both connectivities agree, what the floor throws away, and how many lesions scans have."""
    rows = stash(at_floors(spark, sf_dir))
    a, b = F.col("k26"), F.col("k6")
    out = rows.groupBy("floor").agg(
        F.count(F.lit(1)).alias("scans"), count(a == b).alias("agree"), count(a > b).alias("more_26"), count(b > a).alias("more_6"), F.max(F.abs(a - b)).alias("widest"), F.sum("lost").alias("discarded"), F.round(F.sum("lost") / F.sum("total"), 6).alias("discarded_share"),
        F.round(F.max(F.col("lost") / F.col("total")), 6).alias("worst_share"), count(a == 1).alias("single"), count(a == 2).alias("two"), count(a == 3).alias("three"), count(a.isin(4, 5)).alias("four_five"), count(a >= 6).alias("six_more"), F.max(a).alias("most"))
    return out.join(order.percentiles(rows, "k26", {"median_lesions": 0.5}, "floor", nearest=True).drop("n"), "floor")


@query(
    "d15_dominance",
    f"""WITH {RECORD}, s AS (SELECT list_sort(list(largest_share)) AS v, count(*) AS n FROM record)
    SELECT n AS scans, v[1] AS least, {', '.join(f'v[least(CAST(floor({p} * n) AS BIGINT), n - 1) + 1] AS {k}' for k, p in (('p10', 0.1), ('median', 0.5), ('p90', 0.9)))}, v[n] AS most, len(list_filter(v, lambda x: x >= {DOMINATES})) AS dominated FROM s""",
)
def d15_dominance(spark, sf_dir):
    """The share of the largest lesion over all scans, at nearest ranks, and the scans that it dominates."""
    rows = stash(records(spark, sf_dir).select("largest_share"))
    ranks = order.percentiles(rows, "largest_share", {"p10": 0.1, "median": 0.5, "p90": 0.9}, nearest=True).select("p10", "median", "p90")
    return rows.agg(F.count(F.lit(1)).alias("scans"), F.min("largest_share").alias("least"), F.max("largest_share").alias("most"), count(F.col("largest_share") >= DOMINATES).alias("dominated")).crossJoin(ranks)


@query(
    "d15_fragmentation",
    f"""WITH {RECORD} SELECT CAST(sum(slices) AS BIGINT) AS slices, CAST(sum(fragmented) AS BIGINT) AS fragmented, round(100.0 * sum(fragmented) / sum(slices), 6) AS fragmented_pct, count(*) FILTER (fragmented = slices) AS all_fragmented, count(*) FILTER (fragmented = 0) AS none_fragmented FROM record""",
)
def d15_fragmentation(spark, sf_dir):
    """On how many of its slices the largest lesion falls into several pieces."""
    own, all_slices = F.col("fragmented"), F.col("slices")
    return records(spark, sf_dir).agg(F.sum("slices").alias("slices"), F.sum("fragmented").alias("fragmented"), F.round(100.0 * F.sum("fragmented") / F.sum("slices"), 6).alias("fragmented_pct"), count(own == all_slices).alias("all_fragmented"), count(own == 0).alias("none_fragmented"))


@query("d39_floor_trade_off", f"WITH {BOTH}, {AT_FLOORS} SELECT floor, least(k26, {MOST}) AS lesions, count(*) AS scans FROM j GROUP BY ALL")
def d39(spark, sf_dir):
    """How many lesions scans have at each floor, MOST or more told together."""
    return at_floors(spark, sf_dir).groupBy("floor", F.least("k26", F.lit(MOST).cast("long")).alias("lesions")).agg(F.count(F.lit(1)).alias("scans"))


@query("d39_emptied_scans", f"WITH {BOTH}, {AT_FLOORS} SELECT floor, count(*) AS scans, count(*) FILTER (k26 = 0) AS emptied, round(100.0 * count(*) FILTER (k26 = 0) / count(*), 6) AS emptied_pct, round(100.0 * count(*) FILTER (k26 = k6) / count(*), 6) AS agree_pct FROM j GROUP BY floor")
def d39_emptied(spark, sf_dir):
    """What a floor costs and gains: scans left without a lesion against agreement of the connectivities."""
    share = lambda c: 100.0 * count(c) / F.count(F.lit(1))
    empty, agree = F.col("k26") == 0, F.col("k26") == F.col("k6")
    return at_floors(spark, sf_dir).groupBy("floor").agg(F.count(F.lit(1)).alias("scans"), count(empty).alias("emptied"), F.round(share(empty), 6).alias("emptied_pct"), F.round(share(agree), 6).alias("agree_pct"))


@query("d39_sorted_dominance", f"WITH {RECORD} SELECT largest_share, count(*) AS scans, CAST(sum(count(*)) OVER (ORDER BY largest_share) AS BIGINT) - count(*) AS below FROM record GROUP BY largest_share")
def d39_dominance(spark, sf_dir):
    """The shares of the largest lesion in order: how many scans have each, and how many have less."""
    return order.places(records(spark, sf_dir), "largest_share").select("largest_share", F.col("m").alias("scans"), F.col("before").cast("long").alias("below"))

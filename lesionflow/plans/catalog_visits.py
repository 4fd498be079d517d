"""Queries that look at a visit and the one before together: growth, moves, new lesions and the notes, margins around old tissue, mismatch of masks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import evaluate, order, visits, voxel
from ..sources.fixtures import frame, oracle
from .catalog_voxel import HI, LO, ONE, R26, ROOTS, cells, recursive
from .shared import stash

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
#: A cell of the derived voxel view in mm3, and the length of its side.
CELL_MM3 = 40
CELL_MM = CELL_MM3 ** (1 / 3)
#: Fixed values of the studies: least lesion in mm3, cells of slack, sizes from which a new lesion is reported, tolerances, size bands (mm3), a far shift (mm), margins of the treated zone.
FLOOR, SLACK, SIZES, TOLERANCES, BANDS, FAR_MM, MARGINS = 20, 2, (20, 50, 100, 200, 500), (0, 1, 2, 3, 5), ((0, "under 500"), (500, "500 to 3000"), (3000, "over 3000")), 15.0, tuple(range(26))


def query(name: str, sql: str, *views: str):
    def keep(fn):
        QUERIES[name] = fn
        made = oracle(recursive(sql), *views)
        ORACLE[name] = made.replace("WITH ", "WITH RECURSIVE ", 1) if "RECURSIVE " in sql else made
        return fn

    return keep


def notes(spark, sf_dir: str) -> DataFrame:
    """Rated visits: said (the note tells of something new) and kind, what it calls new."""
    text = F.lower("note")
    kind = F.when(F.contains(text, F.lit("new target")), "target").when(F.contains(text, F.lit("new non-target")), "non-target").when(F.contains(text, F.lit("new non-meas")), "non-measurable").when(F.contains(text, F.lit("new")), "other")
    return frame(spark, sf_dir, "visits").where(F.col("rating").isin(*evaluate.CLASSES)).select("patient", "visit", "rating", kind.isNotNull().alias("said"), kind.alias("kind"))


def count(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


# visits with enhancing cells and the one before of them; all visits and the one before
VP = "vp AS (SELECT patient, visit, lag(visit) OVER (PARTITION BY patient ORDER BY visit) AS previous FROM (SELECT DISTINCT patient, visit FROM c))"
VA = "va AS (SELECT patient, visit, lag(visit) OVER (PARTITION BY patient ORDER BY visit) AS previous FROM (SELECT DISTINCT patient, visit FROM voxels))"
NEAR = "abs(o.x - {a}.x) <= {r} AND abs(o.y - {a}.y) <= {r} AND abs(o.z - {a}.z) <= {r}"

PAIRED = f"""{ONE}, {VA}, s AS (SELECT patient, visit, previous, (SELECT count(*) FROM c WHERE c.patient = va.patient AND c.visit = va.visit) AS a, (SELECT count(*) FROM c WHERE c.patient = va.patient AND c.visit = va.previous) AS b,
  (SELECT count(*) FROM c n JOIN c o USING (patient, x, y, z) WHERE n.patient = va.patient AND n.visit = va.visit AND o.visit = va.previous) AS kept FROM va WHERE previous IS NOT NULL),
g AS (SELECT c.patient, c.visit, avg(c.x) AS x, avg(c.y) AS y, avg(c.z) AS z FROM c JOIN va USING (patient, visit) WHERE previous IS NOT NULL AND NOT EXISTS (SELECT 1 FROM c o WHERE o.patient = c.patient AND o.visit = previous AND o.x = c.x AND o.y = c.y AND o.z = c.z) GROUP BY ALL),
l AS (SELECT va.patient, va.visit, avg(c.x) AS x, avg(c.y) AS y, avg(c.z) AS z FROM c JOIN va ON va.patient = c.patient AND va.previous = c.visit WHERE NOT EXISTS (SELECT 1 FROM c o WHERE o.patient = va.patient AND o.visit = va.visit AND o.x = c.x AND o.y = c.y AND o.z = c.z) GROUP BY ALL),
p AS (SELECT s.patient, s.visit, previous, kept, a - kept AS gained, b - kept AS lost, 100.0 * kept / greatest(a, b, 1) AS stable_pct, sqrt((g.x - l.x) ** 2 + (g.y - l.y) ** 2 + (g.z - l.z) ** 2) AS centre_shift
  FROM s LEFT JOIN g USING (patient, visit) LEFT JOIN l USING (patient, visit) WHERE a + b > 0)"""


def growth(spark, sf_dir: str) -> DataFrame:
    stable = 100.0 * F.col("kept") / F.greatest("n", "n_previous", F.lit(1))
    return visits.compared(cells(spark, sf_dir)).withColumn("stable_pct", stable)


@query("j16_growth", f"WITH {PAIRED} SELECT patient, visit, previous, kept, gained, lost, round(stable_pct, 6) AS stable_pct, round(centre_shift, 6) AS centre_shift FROM p", "voxels")
def j16(spark, sf_dir):
    """The share that stays put is taken of the larger of both visits."""
    return growth(spark, sf_dir).select("patient", "visit", "previous", "kept", "gained", "lost", F.round("stable_pct", 6).alias("stable_pct"), F.round("centre_shift", 6).alias("centre_shift"))


@query(
    "j16_growth_summary",
    f"WITH {PAIRED} SELECT count(*) AS pairs, count(centre_shift) AS moved, " + ", ".join(f"round(quantile_cont({c}, {q}), 6) AS {n}_{c}" for c in ("stable_pct", "centre_shift") for n, q in (("p10", 0.1), ("median", 0.5), ("p90", 0.9))) + f", count(*) FILTER (centre_shift * {CELL_MM!r} > {FAR_MM}) AS far FROM p",
    "voxels",
)
def j16_summary(spark, sf_dir):
    rows = stash(growth(spark, sf_dir).select("stable_pct", "centre_shift"))
    shares = {"p10": 0.1, "median": 0.5, "p90": 0.9}
    out = rows.agg(F.count(F.lit(1)).alias("pairs"), F.count("centre_shift").alias("moved"), count(F.col("centre_shift") * CELL_MM > FAR_MM).alias("far"))
    for c in ("stable_pct", "centre_shift"):
        out = out.crossJoin(order.percentiles(rows, c, shares).select(*(F.round(k, 6).alias(f"{k}_{c}") for k in shares)))
    return out


@query("j20_best_shift", f"""WITH {ONE}, {VP},
m AS (SELECT c.patient, c.visit, previous, o.x - c.x AS dx, o.y - c.y AS dy, o.z - c.z AS dz, count(*) AS both_n FROM c JOIN vp USING (patient, visit) JOIN c o ON o.patient = c.patient AND o.visit = previous AND {NEAR.format(a='c', r=2)} GROUP BY ALL),
n AS (SELECT patient, visit, count(*) AS n FROM c GROUP BY ALL), j AS (SELECT m.*, 100.0 * both_n / (a.n + b.n - both_n) AS jaccard_pct FROM m JOIN n a ON a.patient = m.patient AND a.visit = m.visit JOIN n b ON b.patient = m.patient AND b.visit = m.previous)
SELECT patient, visit, previous, CAST(dx AS INTEGER) AS dx, CAST(dy AS INTEGER) AS dy, CAST(dz AS INTEGER) AS dz, round(jaccard_pct, 6) AS jaccard_pct FROM j QUALIFY row_number() OVER (PARTITION BY patient, visit ORDER BY jaccard_pct DESC, abs(dx) + abs(dy) + abs(dz), dx, dy, dz) = 1""", "voxels")
def j20(spark, sf_dir):
    """All 125 moves of each pair of visits in one task."""
    rows = visits.compared(cells(spark, sf_dir, 1), reach=2).where("moved_common IS NOT NULL")
    share = 100.0 * F.col("moved_common") / (F.col("n") + F.col("n_previous") - F.col("moved_common"))
    return rows.select("patient", "visit", "previous", "dx", "dy", "dz", F.round(share, 6).alias("jaccard_pct"))


@query("j14_new_by_overlap", f"""WITH {R26}, kk AS (SELECT k.*, root FROM k JOIN roots USING (patient, visit, cell)), {VP}
SELECT kk.patient, kk.visit, kk.root, count(*) AS n FROM kk JOIN vp ON vp.patient = kk.patient AND vp.visit = kk.visit AND previous IS NOT NULL GROUP BY kk.patient, kk.visit, kk.root, previous
HAVING NOT bool_or(EXISTS (SELECT 1 FROM c o WHERE o.patient = kk.patient AND o.visit = previous AND {NEAR.format(a='kk', r=1)}))""", "voxels")
def j14(spark, sf_dir):
    rows = visits.followed(cells(spark, sf_dir, 1), slack=1).select("patient", "visit", F.explode("lesions").alias("l"))
    return rows.where("l.gap > 1").select("patient", "visit", "l.root", "l.n")


LUMPS = ROOTS.format(one=f"{ONE}, {VA}, gained AS (SELECT c.patient, c.visit, previous, c.x, c.y, c.z FROM c JOIN va USING (patient, visit) WHERE previous IS NOT NULL AND NOT EXISTS (SELECT 1 FROM c o WHERE o.patient = c.patient AND o.visit = previous AND o.x = c.x AND o.y = c.y AND o.z = c.z))", near="").replace("AS cell FROM c)", "AS cell FROM gained)", 1)


@query(
    "c15_lump_distance",
    f"""WITH {LUMPS}, u AS (SELECT k.patient, k.visit, k.previous, root, count(*) AS n, avg(k.x) AS cx, avg(k.y) AS cy, avg(k.z) AS cz FROM k JOIN roots USING (patient, visit, cell) GROUP BY ALL)
    SELECT u.patient, u.visit, root, any_value(n) AS n, round(min(sqrt((o.x - cx) ** 2 + (o.y - cy) ** 2 + (o.z - cz) ** 2)), 6) AS distance FROM u LEFT JOIN c o ON o.patient = u.patient AND o.visit = u.previous GROUP BY ALL""",
    "voxels",
)
def c15_lumps(spark, sf_dir):
    """Each lump of gained tissue with the distance from its centre to the nearest old cell."""
    return visits.gained_lumps(cells(spark, sf_dir)).select("patient", "visit", "root", "n", F.round("distance", 6).alias("distance"))


OURS = f"""{R26}, kk AS (SELECT k.*, root FROM k JOIN roots USING (patient, visit, cell)), {VA},
apart AS (SELECT kk.patient, kk.visit, root, count(*) AS n FROM kk JOIN va ON va.patient = kk.patient AND va.visit = kk.visit AND previous IS NOT NULL GROUP BY kk.patient, kk.visit, root, previous
  HAVING NOT bool_or(EXISTS (SELECT 1 FROM c o WHERE o.patient = kk.patient AND o.visit = previous AND {NEAR.format(a='kk', r=SLACK)}))),
told AS (SELECT w.patient, w.visit, contains(lower(note), 'new') AS said, CASE WHEN contains(lower(note), 'new target') THEN 'target' WHEN contains(lower(note), 'new non-target') THEN 'non-target' WHEN contains(lower(note), 'new non-meas') THEN 'non-measurable' WHEN contains(lower(note), 'new') THEN 'other' END AS kind,
  coalesce((SELECT max(n) * {CELL_MM3} FROM apart WHERE apart.patient = w.patient AND apart.visit = w.visit AND n * {CELL_MM3} >= {FLOOR}), 0) AS largest
  FROM (SELECT patient, visit, rating, note FROM visits) w JOIN va ON va.patient = w.patient AND va.visit = w.visit WHERE previous IS NOT NULL AND rating IN ('CR', 'PR', 'SD', 'PD'))"""


def told(spark, sf_dir: str) -> DataFrame:
    """Rated visits after another: said, kind, and the largest lesion (mm3, 0 without one) that no old tissue dilated by SLACK touches."""
    apart = F.filter("lesions", lambda l: (l["gap"] > SLACK) & (l["n"] * CELL_MM3 >= FLOOR))
    largest = F.coalesce(F.array_max(F.transform(apart, lambda l: l["n"] * CELL_MM3)), F.lit(0))
    return visits.followed(cells(spark, sf_dir), slack=SLACK).select("patient", "visit", largest.alias("largest")).join(notes(spark, sf_dir), voxel.SCAN)


@query(
    "d24_new_lesion_scoreboard",
    f"""WITH {OURS}, t AS (SELECT unnest([{', '.join(map(str, SIZES))}]) AS least)
    SELECT least, count(*) FILTER (largest >= least) AS reported, count(*) FILTER (said AND largest >= least) AS confirmed, count(*) FILTER (said AND largest < least) AS missed, count(*) FILTER (NOT said AND largest < least) AS quiet,
      round(100.0 * count(*) FILTER (said AND largest >= least) / greatest(count(*) FILTER (largest >= least), 1), 6) AS precision_pct, round(100.0 * count(*) FILTER (said AND largest >= least) / greatest(count(*) FILTER (said), 1), 6) AS recall_pct FROM told, t GROUP BY least""",
    "voxels", "visits",
)
def d24_scoreboard(spark, sf_dir):
    """New lesions found against those that the notes tell of, for each least size in mm3."""
    rows = told(spark, sf_dir).crossJoin(F.broadcast(spark.createDataFrame([(t,) for t in SIZES], "least int")))
    hit, said = F.col("largest") >= F.col("least"), F.col("said")
    out = rows.groupBy("least").agg(count(hit).alias("reported"), count(said & hit).alias("confirmed"), count(said & ~hit).alias("missed"), count(~said & ~hit).alias("quiet"))
    share = lambda of, n: F.round(100.0 * F.col("confirmed") / F.greatest(of, F.lit(1)), 6).alias(n)
    return out.select("*", share(F.col("reported"), "precision_pct"), share(F.col("confirmed") + F.col("missed"), "recall_pct"))


def caught(rows: DataFrame, by: str) -> DataFrame:
    return rows.where("said").groupBy(by).agg(F.count(F.lit(1)).alias("flagged"), count(F.col("largest") > 0).alias("caught"))


@query("d24_by_kind", f"WITH {OURS} SELECT kind, count(*) AS flagged, count(*) FILTER (largest > 0) AS caught FROM told WHERE said GROUP BY kind", "voxels", "visits")
def d24_kind(spark, sf_dir):
    return caught(told(spark, sf_dir), "kind")


@query("d24_by_patient", f"WITH {OURS} SELECT patient, count(*) AS flagged, count(*) FILTER (largest > 0) AS caught FROM told WHERE said GROUP BY patient", "voxels", "visits")
def d24_patient(spark, sf_dir):
    return caught(told(spark, sf_dir), "patient")


WITHIN = f"""{ONE}, {VP}, away AS (SELECT c.patient, c.visit, previous, min(greatest(abs(o.x - c.x), abs(o.y - c.y), abs(o.z - c.z))) AS cube, min(abs(o.x - c.x) + abs(o.y - c.y) + abs(o.z - c.z)) AS face FROM c JOIN vp USING (patient, visit) JOIN c o ON o.patient = c.patient AND o.visit = previous GROUP BY c.patient, c.visit, previous, c.x, c.y, c.z),
sizes AS (SELECT patient, visit, count(*) AS n FROM c GROUP BY ALL)"""


@query(
    "j17_overlap_by_tolerance",
    f"""WITH {WITHIN}, t AS (SELECT unnest([{', '.join(map(str, TOLERANCES))}]) AS tolerance), s AS (SELECT patient, visit, tolerance, count(*) AS n, count(*) FILTER (cube <= tolerance) AS near FROM away, t GROUP BY ALL)
    SELECT tolerance, count(*) AS scans, round(quantile_cont(near / n, 0.5), 6) AS median_share, round(quantile_cont(near / n, 0.25), 6) AS p25_share, count(*) FILTER (near / n > 0.5) AS over_half FROM s GROUP BY tolerance""",
    "voxels",
)
def j17(spark, sf_dir):
    """The share of a visit that lies within each tolerance of the visit before, from one distance field a pair."""
    rows = stash(visits.overlap_within(cells(spark, sf_dir, 1), TOLERANCES).select("tolerance", (F.col("near") / F.col("n")).alias("share")))
    middle = order.percentiles(rows, "share", {"median_share": 0.5, "p25_share": 0.25}, "tolerance")
    half = rows.groupBy("tolerance").agg(count(F.col("share") > 0.5).alias("over_half"))
    return middle.join(half, "tolerance").select("tolerance", F.col("n").alias("scans"), F.round("median_share", 6).alias("median_share"), F.round("p25_share", 6).alias("p25_share"), "over_half")


def band(size: str) -> str:
    return "CASE " + " ".join(f"WHEN {size} >= {low} THEN '{name}'" for low, name in reversed(BANDS)) + " END"


@query(
    "j17_size_bands",
    f"""WITH {WITHIN}, s AS (SELECT w.patient, w.visit, least(any_value(a.n), any_value(b.n)) * {CELL_MM3} AS size, 100.0 * count(*) FILTER (cube <= 3) / count(*) AS cube, 100.0 * count(*) FILTER (face <= 3) / count(*) AS face
      FROM away w JOIN sizes a ON a.patient = w.patient AND a.visit = w.visit JOIN sizes b ON b.patient = w.patient AND b.visit = w.previous GROUP BY w.patient, w.visit)
    SELECT {band('size')} AS band, count(*) AS pairs, round(quantile_cont(cube, 0.5), 6) AS median_cube, round(quantile_cont(face, 0.5), 6) AS median_face FROM s GROUP BY ALL""",
    "voxels",
)
def j17_bands(spark, sf_dir):
    """The share within three cells of the visit before by the size of the smaller visit, by cube steps and by face steps."""
    out = None
    for steps in ("cube", "face"):
        rows = visits.overlap_within(cells(spark, sf_dir, 1), (3,), steps).select(F.expr(band(f"smaller * {CELL_MM3}")).alias("band"), (100.0 * F.col("near") / F.col("n")).alias("share"))
        part = order.percentiles(rows, "share", {"m": 0.5}, "band").select("band", F.col("n").alias("pairs"), F.round("m", 6).alias(f"median_{steps}"))
        out = part if out is None else out.join(part.drop("pairs"), "band")
    return out


ZONE = f"""{ONE}, {VA}, seed AS (SELECT v.patient, v.visit, (SELECT max(q.visit) FROM visits q WHERE q.patient = v.patient AND q.visit < v.visit AND q.rating = 'Post-Op') AS seeded FROM visits v WHERE v.rating IN ('CR', 'PR', 'SD', 'PD')),
scored AS (SELECT seed.patient, seed.visit, seeded, previous FROM seed JOIN va USING (patient, visit) WHERE previous IS NOT NULL AND seeded IS NOT NULL),
fresh AS (SELECT c.patient, c.visit, seeded, c.x, c.y, c.z FROM c JOIN scored USING (patient, visit) WHERE NOT EXISTS (SELECT 1 FROM c o WHERE o.patient = c.patient AND o.visit = previous AND o.x = c.x AND o.y = c.y AND o.z = c.z)),
away AS (SELECT f.patient, f.visit, f.x, f.y, f.z, coalesce(min(greatest(abs(o.x - f.x), abs(o.y - f.y), abs(o.z - f.z))), 999) AS away FROM fresh f LEFT JOIN (SELECT patient, visit, x, y, z FROM voxels WHERE label IN (1, 2)) o ON o.patient = f.patient AND o.visit = f.seeded GROUP BY ALL),
margins AS (SELECT CAST(unnest(range(0, {len(MARGINS)})) AS INTEGER) AS margin),
k AS (SELECT patient, visit, margin, x, y, z, (x * 4096 + y) * 4096 + z AS cell FROM away, margins WHERE away > margin),
n AS (SELECT a.patient, a.visit, a.margin, a.cell, b.cell AS other FROM k a JOIN k b ON a.patient = b.patient AND a.visit = b.visit AND a.margin = b.margin AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 AND abs(a.z - b.z) <= 1),
walk AS (SELECT patient, visit, margin, cell, cell AS root FROM k UNION SELECT n.patient, n.visit, n.margin, n.other, walk.root FROM walk JOIN n ON n.patient = walk.patient AND n.visit = walk.visit AND n.margin = walk.margin AND n.cell = walk.cell WHERE walk.root < n.other),
roots AS (SELECT patient, visit, margin, cell, min(root) AS root FROM walk GROUP BY ALL), lumps AS (SELECT patient, visit, margin, root, count(*) AS n FROM roots GROUP BY ALL),
found AS (SELECT s.patient, s.visit, margin, (SELECT count(*) FROM fresh f WHERE f.patient = s.patient AND f.visit = s.visit) AS gained, (SELECT count(*) FROM away a WHERE a.patient = s.patient AND a.visit = s.visit AND a.away > margin) AS outside,
  coalesce((SELECT max(n) FROM lumps l WHERE l.patient = s.patient AND l.visit = s.visit AND l.margin = m.margin AND n >= 2), 0) AS largest, (SELECT count(*) FROM lumps l WHERE l.patient = s.patient AND l.visit = s.visit AND l.margin = m.margin AND n >= 2) AS lumps FROM scored s, margins m)"""


def zone(spark, sf_dir: str) -> DataFrame:
    seeds = frame(spark, sf_dir, "visits").where("rating = 'Post-Op'")
    return visits.treated_zone(cells(spark, sf_dir), seeds, MARGINS, floor=2).join(notes(spark, sf_dir), voxel.SCAN)


@query("j23_treated_zone", f"WITH RECURSIVE {ZONE} SELECT patient, visit, margin, gained, outside, largest, lumps FROM found", "voxels", "visits")
def j23(spark, sf_dir):
    """Gained cells outside the approximate treated zone (labels 1 and 2 at the latest Post-Op visit, dilated by each margin) and the largest lump of two cells or more there, from one distance field."""
    return zone(spark, sf_dir).select("patient", "visit", "margin", "gained", "outside", "largest", "lumps")


@query(
    "j23_zone_verdict",
    f"""WITH RECURSIVE {ZONE}, told AS (SELECT found.*, contains(lower(note), 'new') AS said FROM found JOIN (SELECT patient, visit, note FROM visits) w USING (patient, visit))
    SELECT margin, count(*) FILTER (said) AS new_visits, count(*) FILTER (said AND largest > 0) AS new_with_lump, count(*) FILTER (NOT said) AS other_visits, count(*) FILTER (NOT said AND largest > 0) AS other_with_lump, round(sum(outside) / greatest(sum(gained), 1), 6) AS outside_share FROM told GROUP BY margin""",
    "voxels", "visits",
)
def j23_verdict(spark, sf_dir):
    """Whether lumps outside the zone tell visits that the notes call new from others, for each margin."""
    said, lump = F.col("said"), F.col("largest") > 0
    share = F.round(F.sum("outside") / F.greatest(F.sum("gained"), F.lit(1)), 6).alias("outside_share")
    return zone(spark, sf_dir).groupBy("margin").agg(count(said).alias("new_visits"), count(said & lump).alias("new_with_lump"), count(~said).alias("other_visits"), count(~said & lump).alias("other_with_lump"), share)


@query(
    "j24_mismatch",
    f"""WITH b AS (SELECT DISTINCT patient, visit, x, y, z FROM voxels), {VA},
    u AS (SELECT patient, visit, previous, x, y, z, max(now) AS now, max(old) AS old FROM (SELECT b.patient, b.visit, previous, x, y, z, 1 AS now, 0 AS old FROM b JOIN va USING (patient, visit) WHERE previous IS NOT NULL
      UNION ALL SELECT b.patient, va.visit, previous, x, y, z, 0, 1 FROM b JOIN va ON va.patient = b.patient AND va.previous = b.visit) GROUP BY ALL),
    q AS (SELECT patient, visit, quantile_cont(z, 0.05) FILTER (now = 1 AND old = 1) AS lo, quantile_cont(z, 0.95) FILTER (now = 1 AND old = 1) AS hi, greatest(sum(now), sum(old)) / greatest(least(sum(now), sum(old)), 1) AS volume_ratio FROM u GROUP BY ALL),
    w AS (SELECT u.patient, u.visit, u.x, u.y, u.z, min(abs(l.x - u.x) + abs(l.y - u.y) + abs(l.z - u.z)) AS away FROM u JOIN voxels l ON l.patient = u.patient AND l.visit IN (u.visit, u.previous) AND l.label = 1 WHERE now <> old GROUP BY ALL)
    SELECT u.patient, u.visit, round(max(volume_ratio), 6) AS volume_ratio, count(*) FILTER (now <> old) AS mismatch, count(*) FILTER (now <> old AND (z < lo OR z > hi)) AS at_ends, count(away) FILTER (away <= 2) AS near_two, count(away) FILTER (away <= 10) AS near_lesion
    FROM u JOIN q USING (patient, visit) LEFT JOIN w USING (patient, visit, x, y, z) GROUP BY ALL""",
    "voxels",
)
def j24(spark, sf_dir):
    """Where the masks of consecutive visits differ: ratio of volumes, cells beyond the middle 90 % of the stack, cells within two and within ten face steps of a lesion."""
    rows = visits.mismatch(cells(spark, sf_dir), (2, 10))
    return rows.select("patient", "visit", F.round("volume_ratio", 6).alias("volume_ratio"), "mismatch", "at_ends", F.col("near")[0].alias("near_two"), F.col("near")[1].alias("near_lesion"))


def j24_summary(spark, sf_dir):
    rows = stash(j24(spark, sf_dir))
    some = rows.where("mismatch > 0").select((100.0 * F.col("at_ends") / F.col("mismatch")).alias("ends"), (100.0 * F.col("near_lesion") / F.col("mismatch")).alias("near"))
    out = rows.agg(F.count(F.lit(1)).alias("pairs"), F.max("volume_ratio").alias("worst_ratio"))
    for source, column, name in ((rows, "volume_ratio", "median_ratio"), (some, "ends", "median_at_ends"), (some, "near", "median_near")):
        out = out.crossJoin(order.percentiles(source, column, {"m": 0.5}).select(F.round("m", 6).alias(name)))
    return out


QUERIES["j24_mismatch_summary"] = j24_summary
ORACLE["j24_mismatch_summary"] = f"""WITH j AS ({ORACLE['j24_mismatch']}) SELECT count(*) AS pairs, max(volume_ratio) AS worst_ratio, round(quantile_cont(volume_ratio, 0.5), 6) AS median_ratio,
round(quantile_cont(100.0 * at_ends / mismatch, 0.5) FILTER (mismatch > 0), 6) AS median_at_ends, round(quantile_cont(100.0 * near_lesion / mismatch, 0.5) FILTER (mismatch > 0), 6) AS median_near FROM j"""


#: Every visit against its patient's first one under a given fit: the three rotations written out as one matrix, the slide as the difference of the centres.
REGISTERED = """b AS (SELECT DISTINCT patient, visit, x, y, z FROM voxels), a AS (SELECT patient, min(visit) AS anchor FROM b GROUP BY ALL), n AS (SELECT patient, visit, count(*) AS n, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz FROM b GROUP BY ALL),
v AS (SELECT n.patient, n.visit, anchor, n.n, k.n AS k, n.cx - k.cx AS sx, n.cy - k.cy AS sy, n.cz - k.cz AS sz, (n.patient % 5 - 2) * 0.11 AS ax, (n.patient % 3 - 1) * 0.13 AS ay, (n.visit % 4 - 1) * 0.17 AS az, n.visit % 3 - 1 AS t
  FROM n JOIN a ON a.patient = n.patient JOIN n k ON k.patient = n.patient AND k.visit = anchor WHERE n.visit <> anchor),
g AS (SELECT v.*, x, y, z FROM v, range(0, 8) p(x), range(0, 8) q(y), range(1, 8) r(z)),
f AS (SELECT patient, visit, anchor, x, y, z, CAST(round((cos(az) * cos(ay) - sin(az) * sin(ax) * sin(ay)) * (x - 3.7) - sin(az) * cos(ax) * (y - 4.1) + (cos(az) * sin(ay) + sin(az) * sin(ax) * cos(ay)) * (z - 3.9) + 3.7 + t) AS BIGINT) AS fx,
  CAST(round((sin(az) * cos(ay) + cos(az) * sin(ax) * sin(ay)) * (x - 3.7) + cos(az) * cos(ax) * (y - 4.1) + (sin(az) * sin(ay) - cos(az) * sin(ax) * cos(ay)) * (z - 3.9) + 4.1 + t) AS BIGINT) AS fy,
  CAST(round(-cos(ax) * sin(ay) * (x - 3.7) + sin(ax) * (y - 4.1) + cos(ax) * cos(ay) * (z - 3.9) + 3.9 + t) AS BIGINT) AS fz, CAST(round(x + sx) AS BIGINT) AS tx, CAST(round(y + sy) AS BIGINT) AS ty, CAST(round(z + sz) AS BIGINT) AS tz FROM g),
w AS (SELECT f.patient, f.visit, f.x, f.y, f.z, m.patient IS NOT NULL AS fitted, s.patient IS NOT NULL AS slid, o.patient IS NOT NULL AS fixed, h.patient IS NOT NULL AS here FROM f LEFT JOIN b m ON m.patient = f.patient AND m.visit = f.visit AND m.x = fx AND m.y = fy AND m.z = fz
  LEFT JOIN b s ON s.patient = f.patient AND s.visit = f.visit AND s.x = tx AND s.y = ty AND s.z = tz LEFT JOIN b o ON o.patient = f.patient AND o.visit = f.anchor AND o.x = f.x AND o.y = f.y AND o.z = f.z LEFT JOIN b h ON h.patient = f.patient AND h.visit = f.visit AND h.x = f.x AND h.y = f.y AND h.z = f.z),
e AS (SELECT patient, visit, 100.0 * count(*) FILTER (fixed AND here) / count(*) FILTER (fixed OR here) AS still, 100.0 * count(*) FILTER (fixed AND fitted) / count(*) FILTER (fixed OR fitted) AS fit, 100.0 * count(*) FILTER (fixed AND slid) / count(*) FILTER (fixed OR slid) AS slide FROM w GROUP BY ALL),
s AS (SELECT patient, visit, still, CASE WHEN fit >= still THEN 'registered' WHEN slide > still THEN 'fell back to translation' ELSE 'REJECTED - left unregistered' END AS status, CASE WHEN fit >= still THEN fit WHEN slide > still THEN slide ELSE still END AS after FROM e),
c AS (SELECT w.patient, w.visit, avg(w.x) AS mx, avg(w.y) AS my, avg(w.z) AS mz FROM w JOIN s USING (patient, visit) WHERE CASE status WHEN 'registered' THEN fitted WHEN 'fell back to translation' THEN slid ELSE here END GROUP BY ALL),
j AS (SELECT s.patient, s.visit, status, still AS overlap_before, after AS overlap_after, sqrt(sx ** 2 + sy ** 2 + sz ** 2) AS centre_before, sqrt((mx - k.cx) ** 2 + (my - k.cy) ** 2 + (mz - k.cz) ** 2) AS centre_after FROM s JOIN v USING (patient, visit) JOIN n k ON k.patient = s.patient AND k.visit = v.anchor LEFT JOIN c USING (patient, visit)
  UNION ALL SELECT patient, anchor, 'anchor', 100, 100, 0, 0 FROM a)"""
FIGURES = ("overlap_before", "overlap_after", "centre_before", "centre_after")


def fits(spark, sf_dir: str) -> DataFrame:
    """A fit of each visit, as a registration would hand it over: some bring the masks closer together, some apart."""
    shift = (F.col("visit") % 3 - 1).cast("double")
    numbers = [(F.col("patient") % 5 - 2) * 0.11, (F.col("patient") % 3 - 1) * 0.13, (F.col("visit") % 4 - 1) * 0.17, shift, shift, shift, F.lit(3.7), F.lit(4.1), F.lit(3.9)]
    return cells(spark, sf_dir).select(*voxel.SCAN).distinct().withColumn("fit", F.array(*(n.cast("double") for n in numbers)))


@query("j21_registration", f"WITH {REGISTERED} SELECT patient, visit, status, {', '.join(f'round({c}, 6) AS {c}' for c in FIGURES)} FROM j", "voxels")
def j21_registration(spark, sf_dir):
    """Each visit's fit judged by whether the masks line up better, with a slide to fall back to."""
    rows = visits.registered(cells(spark, sf_dir), fits(spark, sf_dir), LO, HI)
    return rows.select("patient", "visit", "status", *(F.round(c, 6).alias(c) for c in FIGURES))


@query(
    "d33_registration_status",
    f"WITH {REGISTERED} SELECT status, count(*) AS n, round(median(overlap_before), 6) AS median_before, round(median(overlap_after), 6) AS median_after, round(min(overlap_before), 6) AS worst_before, round(min(overlap_after), 6) AS worst_after, count(*) FILTER (overlap_after < overlap_before - 0.5) AS worsened FROM j GROUP BY status",
    "voxels",
)
def d33_status(spark, sf_dir):
    """How the fits came out, by status."""
    rows = stash(visits.registered(cells(spark, sf_dir), fits(spark, sf_dir), LO, HI))
    out = rows.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.round(F.min("overlap_before"), 6).alias("worst_before"), F.round(F.min("overlap_after"), 6).alias("worst_after"), count(F.col("overlap_after") < F.col("overlap_before") - 0.5).alias("worsened"))
    middle = order.medians(rows, {"median_before": "overlap_before", "median_after": "overlap_after"}, "status")
    return out.join(middle.select("status", F.round("median_before", 6).alias("median_before"), F.round("median_after", 6).alias("median_after")), "status")

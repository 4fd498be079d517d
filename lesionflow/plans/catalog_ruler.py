"""Queries of diameters; their SQL tries every pair of corners and every line."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rationale
from ..operators import order, ruler
from ..sources.fixtures import frame, oracle
from .shared import stash

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
#: The caliper's excess from which a shape is awkward (mm); the label sets that diameters are taken of.
AWKWARD, SETS = 3.0, {"enhancing": (1,), "merged": (1, 2)}

#: Plates are single pieces on each slice; coordinates count from the corner of the box. Holes: free cells that no walk over faces from the border of the box reaches.
TISSUE = """RECURSIVE own AS (SELECT patient, z, x - min(x) OVER w AS i, y - min(y) OVER w AS j FROM plates WINDOW w AS (PARTITION BY patient, z)),
box AS (SELECT patient, z, max(i) AS w, max(j) AS h FROM own GROUP BY ALL),
free AS (SELECT b.patient, b.z, b.w, b.h, p.i, q.j FROM box b JOIN range(0, 12) p(i) ON p.i <= b.w JOIN range(0, 12) q(j) ON q.j <= b.h WHERE NOT EXISTS (SELECT 1 FROM own o WHERE o.patient = b.patient AND o.z = b.z AND o.i = p.i AND o.j = q.j)),
outside AS (SELECT patient, z, i, j FROM free WHERE i IN (0, w) OR j IN (0, h) UNION SELECT f.patient, f.z, f.i, f.j FROM outside o JOIN free f ON f.patient = o.patient AND f.z = o.z AND abs(f.i - o.i) + abs(f.j - o.j) = 1),
tissue AS (SELECT patient, z, i, j FROM own UNION ALL SELECT patient, z, i, j FROM free f WHERE NOT EXISTS (SELECT 1 FROM outside o WHERE o.patient = f.patient AND o.z = f.z AND o.i = f.i AND o.j = f.j)),
areas AS (SELECT patient, z, (SELECT count(*) FROM own o WHERE o.patient = t.patient AND o.z = t.z) AS area, count(*) AS filled FROM tissue t GROUP BY ALL),
d AS (SELECT * FROM (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) v(di, dj)),
inner_cells AS (SELECT t.patient, t.z, t.i, t.j FROM tissue t JOIN tissue n ON n.patient = t.patient AND n.z = t.z AND abs(n.i - t.i) + abs(n.j - t.j) = 1 GROUP BY ALL HAVING count(*) = 4),
ends AS (SELECT DISTINCT patient, z, i + di AS i, j + dj AS j FROM (SELECT * FROM tissue EXCEPT SELECT * FROM inner_cells) e, d)"""
CHORDS = f"""{TISSUE}, pairs AS (SELECT a.patient, a.z, a.i AS ai, a.j AS aj, b.i AS bi, b.j AS bj, (a.i - b.i) ** 2 + (a.j - b.j) ** 2 AS square FROM ends a JOIN ends b ON a.patient = b.patient AND a.z = b.z AND (a.i < b.i OR (a.i = b.i AND a.j < b.j))),
u AS (SELECT *, sqrt(square) AS len, (bi - ai) / sqrt(square) AS ux, (bj - aj) / sqrt(square) AS uy, greatest(CAST(floor(sqrt(square) / 0.25) AS INTEGER), 2) AS n FROM pairs),
samples AS (SELECT u.*, unnest(range(n)) AS k FROM u),
kept AS (SELECT s.patient, s.z, ai, aj, bi, bj, max(square) AS square, max(len) AS len, max(ux) AS ux, max(uy) AS uy FROM samples s
  LEFT JOIN tissue t ON t.patient = s.patient AND t.z = s.z AND t.i = CAST(floor(ai + ux * 0.5 + k / (n - 1)::DOUBLE * ((bi - ux * 0.5) - (ai + ux * 0.5))) AS BIGINT) AND t.j = CAST(floor(aj + uy * 0.5 + k / (n - 1)::DOUBLE * ((bj - uy * 0.5) - (aj + uy * 0.5))) AS BIGINT)
  GROUP BY s.patient, s.z, ai, aj, bi, bj HAVING count(*) = count(t.i)),
chord AS (SELECT *, -uy AS wx, ux AS wy FROM kept QUALIFY row_number() OVER (PARTITION BY patient, z ORDER BY square DESC, ai, aj, bi, bj) = 1),
calipers AS (SELECT patient, z, sqrt(max(square)) AS caliper FROM pairs GROUP BY ALL)"""
RUNS = f"""{CHORDS}, lattice AS (SELECT DISTINCT patient, z, i + di AS i, j + dj AS j FROM tissue, d),
reach AS (SELECT c.*, min(l.i * ux + l.j * uy) AS u0, max(l.i * ux + l.j * uy) AS u1, min(l.i * wx + l.j * wy) AS w0, max(l.i * wx + l.j * wy) AS w1 FROM chord c JOIN lattice l ON l.patient = c.patient AND l.z = c.z GROUP BY ALL),
lines AS (SELECT *, u0 + 0.5 * unnest(range(CAST(ceil((u1 - u0) / 0.5) AS INTEGER))) AS t FROM reach),
marks AS (SELECT *, unnest(range(CAST(ceil((w1 + 0.25 - w0) / 0.25) AS INTEGER))) AS k FROM lines),
hits AS (SELECT m.* FROM marks m JOIN tissue c ON c.patient = m.patient AND c.z = m.z AND c.i = CAST(floor(t * ux + (w0 + 0.25 * k) * wx) AS BIGINT) AND c.j = CAST(floor(t * uy + (w0 + 0.25 * k) * wy) AS BIGINT)),
islands AS (SELECT *, k - row_number() OVER (PARTITION BY patient, z, t ORDER BY k) AS island FROM hits),
runs AS (SELECT patient, z, t, island, min(k) AS first_k, max(k) + 1 AS stop_k, max(w0) AS w0, max(CAST(ceil((w1 + 0.25 - w0) / 0.25) AS INTEGER)) AS ks, max(ai * wx + aj * wy) AS axis FROM islands GROUP BY patient, z, t, island),
perps AS (SELECT patient, z, max(stop_k - first_k) * 0.25 AS perp FROM runs WHERE w0 + 0.25 * first_k - 0.25 <= axis AND axis <= w0 + 0.25 * least(stop_k, ks - 1) + 0.25 GROUP BY ALL),
slices AS (SELECT patient, z, len AS long, coalesce(perp, 0) AS perp, caliper, area, filled FROM chord JOIN calipers USING (patient, z) JOIN areas USING (patient, z) LEFT JOIN perps USING (patient, z)),
best AS (SELECT *, long * perp AS product FROM slices QUALIFY row_number() OVER (PARTITION BY patient ORDER BY long * perp DESC, z) = 1)"""


def query(name: str, sql: str, *views: str):
    def keep(fn):
        QUERIES[name] = fn
        ORACLE[name] = oracle(sql.replace("RECURSIVE ", "", 1), *views).replace("WITH ", "WITH RECURSIVE ", 1)
        return fn

    return keep


def slices(spark, sf_dir: str) -> DataFrame:
    return ruler.lesion_slices(frame(spark, sf_dir, "plates"))


def best(spark, sf_dir: str) -> DataFrame:
    return ruler.lesions(slices(spark, sf_dir))


@query("j06_filled_holes", f"WITH {TISSUE} SELECT patient, CAST(z AS INTEGER) AS z, area, filled FROM areas", "plates")
def j06(spark, sf_dir):
    return slices(spark, sf_dir).select("patient", "z", "area", "filled")


@query("j08_longest_chord", f"WITH {RUNS} SELECT patient, CAST(z AS INTEGER) AS z, round(long, 6) AS long FROM slices", "plates")
def j08(spark, sf_dir):
    return slices(spark, sf_dir).select("patient", "z", F.round("long", 6).alias("long"))


@query("j09_perpendicular", f"WITH {RUNS} SELECT patient, CAST(z AS INTEGER) AS z, CAST(perp AS DOUBLE) AS perp FROM slices", "plates")
def j09(spark, sf_dir):
    return slices(spark, sf_dir).select("patient", "z", "perp")


@query("j10_lesion_measures", f"WITH {RUNS} SELECT patient, CAST(z AS INTEGER) AS z, round(long, 6) AS long, CAST(perp AS DOUBLE) AS perp, round(product, 6) AS product FROM best", "plates")
def j10(spark, sf_dir):
    return best(spark, sf_dir).select("patient", "z", F.round("long", 6).alias("long"), "perp", F.round("product", 6).alias("product"))


@query("j11_measurable", f"WITH {RUNS} SELECT patient, long >= 10 AND perp >= 10 AS measurable FROM best", "plates")
def j11(spark, sf_dir):
    return ruler.measurable_scans(best(spark, sf_dir)).select("patient", "measurable")


@query("j12_caliper_excess", f"WITH {RUNS} SELECT patient, CAST(z AS INTEGER) AS z, round(caliper, 6) AS caliper, round(caliper - long, 6) AS excess FROM slices", "plates")
def j12(spark, sf_dir):
    return slices(spark, sf_dir).select("patient", "z", F.round("caliper", 6).alias("caliper"), F.round(F.col("caliper") - F.col("long"), 6).alias("excess"))


@query("i11_measurability_stamp", f"WITH {RUNS} SELECT s.patient, s.timepoint, CASE WHEN s.rn = 1 THEN b.long >= 10 AND b.perp >= 10 END AS measurable_disease FROM scans s LEFT JOIN best b ON b.patient = s.patient", "plates", "scans")
def i11(spark, sf_dir):
    """The flag on the scans that were measured (here each patient's first); all others stay unknown."""
    flags = ruler.measurable_scans(best(spark, sf_dir)).select("patient", F.lit(1).alias("rn"), F.col("measurable").alias("measurable_disease"))
    return frame(spark, sf_dir, "scans").select("patient", "timepoint", "rn").join(flags, ["patient", "rn"], "left").select("patient", "timepoint", "measurable_disease")


PAIR_SQL = r"""p AS (SELECT timepoint, patient, unnest(regexp_extract_all(rationale, '(\d+(?:\.\d+)?)\s*(?:mm)?\s*[x×X]\s*(\d+(?:\.\d+)?)\s*(?:mm)?', 1))::DOUBLE AS a,
  unnest(regexp_extract_all(rationale, '(\d+(?:\.\d+)?)\s*(?:mm)?\s*[x×X]\s*(\d+(?:\.\d+)?)\s*(?:mm)?', 2))::DOUBLE AS b FROM rationale),
e AS (SELECT timepoint, patient, max_by(greatest(a, b), a * b) AS e_long, max_by(least(a, b), a * b) AS e_short, count(*) AS n_pairs FROM p GROUP BY ALL),
m AS (SELECT e.*, s.z, s.long, s.perp, s.caliper, s.z = t.z AS is_biggest, round(s.long - e_long, 6) AS err_long, round(s.perp - e_short, 6) AS err_short FROM e JOIN slices s ON s.patient = e.patient JOIN best t ON t.patient = e.patient
  QUALIFY row_number() OVER (PARTITION BY e.timepoint ORDER BY round(abs(s.long - e_long) + abs(s.perp - e_short), 6), s.z) = 1)"""


def matches(spark, sf_dir: str) -> DataFrame:
    """For each text with a measurement the slice of the patient's lesions that is nearest to its largest pair on both axes, and whether it is the largest product."""
    texts = frame(spark, sf_dir, "rationale").select("timepoint", "patient", rationale.pairs(F.col("rationale"), rationale.LOOSE_PAIR).alias("p")).where(F.size("p") > 0)
    told = texts.select("timepoint", "patient", F.size("p").cast("long").alias("n_pairs"), F.array_max("p").alias("most"))
    told = told.select("timepoint", "patient", "n_pairs", F.greatest("most.a", "most.b").alias("e_long"), F.least("most.a", "most.b").alias("e_short"))
    ours = slices(spark, sf_dir)
    both = told.join(ours.select("patient", "z", "long", "perp", "caliper"), "patient").join(ruler.lesions(ours).select("patient", F.col("z").alias("best_z")), "patient")
    far = F.round(F.abs(F.col("long") - F.col("e_long")) + F.abs(F.col("perp") - F.col("e_short")), 6)
    own = F.struct(far.alias("far"), "z", "long", "perp", "caliper", (F.col("z") == F.col("best_z")).alias("is_biggest"))
    near = both.groupBy("timepoint", "patient", "n_pairs", "e_long", "e_short").agg(F.min(own).alias("m")).select("timepoint", "patient", "n_pairs", "e_long", "e_short", "m.*")
    return near.withColumns({"err_long": F.round(F.col("long") - F.col("e_long"), 6), "err_short": F.round(F.col("perp") - F.col("e_short"), 6)})


@query("c16_best_match", f"WITH {RUNS}, {PAIR_SQL} SELECT timepoint, CAST(z AS INTEGER) AS z, is_biggest, err_long, err_short FROM m", "plates", "rationale")
def c16(spark, sf_dir):
    return matches(spark, sf_dir).select("timepoint", "z", "is_biggest", "err_long", "err_short")


@query(
    "d36_ruler_against_expert",
    f"""WITH {RUNS}, {PAIR_SQL} SELECT CASE WHEN greatest(abs(err_long), abs(err_short)) <= 5 THEN 'close' WHEN n_pairs > 1 THEN 'several lesions' WHEN NOT is_biggest THEN 'not our biggest' WHEN err_long > 8 THEN 'ours is larger' ELSE 'ours is smaller' END AS outcome,
    count(*) AS n, round(median(err_long), 6) AS median_long, min(err_long) AS least_long, max(err_long) AS most_long, round(median(err_short), 6) AS median_short, min(err_short) AS least_short, max(err_short) AS most_short,
    count(*) FILTER ((long >= 10 AND perp >= 10) = (e_long >= 10 AND e_short >= 10)) AS gate_agrees FROM m GROUP BY ALL""",
    "plates", "rationale",
)
def d36(spark, sf_dir):
    """How our diameters agree with the written ones: close on both axes, else why not."""
    rows = matches(spark, sf_dir)
    outcome = F.when(F.greatest(F.abs("err_long"), F.abs("err_short")) <= 5, "close").when(F.col("n_pairs") > 1, "several lesions").when(~F.col("is_biggest"), "not our biggest").when(F.col("err_long") > 8, "ours is larger").otherwise("ours is smaller")
    gate = ((F.col("long") >= ruler.GATE) & (F.col("perp") >= ruler.GATE)) == ((F.col("e_long") >= ruler.GATE) & (F.col("e_short") >= ruler.GATE))
    rows = stash(rows.select(outcome.alias("outcome"), "err_long", "err_short", gate.alias("gate")))
    out = rows.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"), F.min("err_long").alias("least_long"), F.max("err_long").alias("most_long"), F.min("err_short").alias("least_short"), F.max("err_short").alias("most_short"), F.count(F.when(F.col("gate"), 1)).alias("gate_agrees"))
    middle = order.medians(rows, {"median_long": "err_long", "median_short": "err_short"}, "outcome")
    return out.join(middle.select("outcome", F.round("median_long", 6).alias("median_long"), F.round("median_short", 6).alias("median_short")), "outcome")


@query("d36_shape_warning", f"WITH {RUNS}, {PAIR_SQL} SELECT count(*) AS n, round(median(caliper - long), 6) AS median_excess, round(max(caliper - long), 6) AS most_excess, count(*) FILTER (caliper - long > {AWKWARD}) AS awkward, count(*) FILTER (greatest(abs(err_long), abs(err_short)) <= 5) AS close FROM m", "plates", "rationale")
def d36_shape(spark, sf_dir):
    """How much longer the caliper is than the chord inside the tissue, and how many shapes are awkward enough to flag."""
    rows = stash(matches(spark, sf_dir).withColumn("excess", F.col("caliper") - F.col("long")))
    close = F.greatest(F.abs("err_long"), F.abs("err_short")) <= 5
    out = rows.agg(F.count(F.lit(1)).alias("n"), F.round(F.max("excess"), 6).alias("most_excess"), F.count(F.when(F.col("excess") > AWKWARD, 1)).alias("awkward"), F.count(F.when(close, 1)).alias("close"))
    return out.crossJoin(order.medians(rows, {"m": "excess"}).select(F.round("m", 6).alias("median_excess")))


@query("j28_without_filling", f"WITH {RUNS} SELECT patient, CAST(z AS INTEGER) AS z, round(caliper, 6) AS caliper, area FROM slices", "plates")
def j28(spark, sf_dir):
    """The variant that leaves holes open: the caliper is the same, the area that of the cells alone."""
    rows = ruler.lesion_slices(frame(spark, sf_dir, "plates"), fill=False)
    return rows.select("patient", "z", F.round("caliper", 6).alias("caliper"), F.col("filled").alias("area"))


#: Every slice under both label sets, with and without its holes.
SHAPES = """RECURSIVE base AS (SELECT patient, z, x, y, 'enhancing' AS labels FROM cores WHERE label = 1 UNION ALL SELECT patient, z, x, y, 'merged' FROM cores),
own AS (SELECT patient, z, labels, x - min(x) OVER w AS i, y - min(y) OVER w AS j FROM base WINDOW w AS (PARTITION BY patient, z, labels)),
box AS (SELECT patient, z, labels, max(i) AS w, max(j) AS h FROM own GROUP BY ALL),
free AS (SELECT b.*, p.i, q.j FROM box b JOIN range(0, 12) p(i) ON p.i <= b.w JOIN range(0, 12) q(j) ON q.j <= b.h WHERE NOT EXISTS (SELECT 1 FROM own o WHERE o.patient = b.patient AND o.z = b.z AND o.labels = b.labels AND o.i = p.i AND o.j = q.j)),
outside AS (SELECT patient, z, labels, i, j FROM free WHERE i IN (0, w) OR j IN (0, h) UNION SELECT f.patient, f.z, f.labels, f.i, f.j FROM outside o JOIN free f ON f.patient = o.patient AND f.z = o.z AND f.labels = o.labels AND abs(f.i - o.i) + abs(f.j - o.j) = 1),
tissue AS (SELECT patient, z, labels, FALSE AS filled, i, j FROM own UNION ALL SELECT patient, z, labels, TRUE, i, j FROM own
  UNION ALL SELECT patient, z, labels, TRUE, i, j FROM free f WHERE NOT EXISTS (SELECT 1 FROM outside o WHERE o.patient = f.patient AND o.z = f.z AND o.labels = f.labels AND o.i = f.i AND o.j = f.j)),
areas AS (SELECT patient, z, labels, filled, count(*) AS area FROM tissue GROUP BY ALL),
inner_cells AS (SELECT t.patient, t.z, t.labels, t.filled, t.i, t.j FROM tissue t JOIN tissue n ON n.patient = t.patient AND n.z = t.z AND n.labels = t.labels AND n.filled = t.filled AND abs(n.i - t.i) + abs(n.j - t.j) = 1 GROUP BY ALL HAVING count(*) = 4),
ends AS (SELECT * FROM tissue EXCEPT SELECT * FROM inner_cells),
pairs AS (SELECT a.patient, a.z, a.labels, a.filled, a.i AS ai, a.j AS aj, b.i AS bi, b.j AS bj, (a.i - b.i) ** 2 + (a.j - b.j) ** 2 AS square, greatest(abs(a.i - b.i), abs(a.j - b.j)) * 2 AS steps FROM ends a JOIN ends b USING (patient, z, labels, filled) WHERE a.i < b.i OR (a.i = b.i AND a.j < b.j)),
samples AS (SELECT *, unnest(range(CAST(steps AS BIGINT) + 1)) AS k FROM pairs),
kept AS (SELECT s.patient, s.z, s.labels, s.filled, ai, aj, bi, bj, max(square) AS square FROM samples s LEFT JOIN tissue t ON t.patient = s.patient AND t.z = s.z AND t.labels = s.labels AND t.filled = s.filled
  AND t.i = CAST(round_even(ai + k * (1.0::DOUBLE / steps) * (bi - ai), 0) AS BIGINT) AND t.j = CAST(round_even(aj + k * (1.0::DOUBLE / steps) * (bj - aj), 0) AS BIGINT) GROUP BY s.patient, s.z, s.labels, s.filled, ai, aj, bi, bj HAVING count(*) = count(t.i)),
chords AS (SELECT patient, z, labels, filled, sqrt(max(square)) AS chord FROM kept GROUP BY ALL), centres AS (SELECT patient, z, labels, filled, sqrt(max(square)) AS centre_caliper FROM pairs GROUP BY ALL),
points AS (SELECT DISTINCT patient, z, labels, filled, i + di AS i, j + dj AS j FROM ends, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) v(di, dj)),
edges AS (SELECT patient, z, labels, filled, sqrt(max((a.i - b.i) ** 2 + (a.j - b.j) ** 2)) AS caliper FROM points a JOIN points b USING (patient, z, labels, filled) GROUP BY ALL)"""


@query("j28_diameter_variants", f"WITH {SHAPES} SELECT patient, CAST(z AS INTEGER) AS z, labels, filled, area, round(coalesce(chord, 0), 6) AS chord, round(coalesce(centre_caliper, 0), 6) AS centre_caliper, round(caliper, 6) AS caliper FROM areas LEFT JOIN chords USING (patient, z, labels, filled) LEFT JOIN centres USING (patient, z, labels, filled) JOIN edges USING (patient, z, labels, filled)", "cores")
def j28_variants(spark, sf_dir):
    """How the diameter depends on what is measured: between centres or corners, holes open or filled, enhancing tissue alone or merged with necrosis."""
    rows = ruler.slice_variants(frame(spark, sf_dir, "cores"), SETS)
    return rows.select("patient", "z", "labels", "filled", "area", *(F.round(c, 6).alias(c) for c in ("chord", "centre_caliper", "caliper")))

"""Set algebra on sparse voxel tables (patient, visit, x, y, z, label). Every join carries the scan's key, so
neighbours never meet across scans. Grids end at their bounds: shifted voxels outside are cut off."""

from __future__ import annotations

from collections.abc import Callable
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import scan

SCAN = ["patient", "visit"]
CELL = ["patient", "visit", "x", "y", "z"]

#: Half of the 26 (and of the 6) neighbours: each pair of neighbours is met once.
HALF_26 = [o for o in product((-1, 0, 1), repeat=3) if o > (0, 0, 0)]
HALF_6 = [o for o in HALF_26 if sum(map(abs, o)) == 1]
FACES = [o for o in product((-1, 0, 1), repeat=3) if sum(map(abs, o)) == 1]


def shifted(cells: DataFrame, offsets: list[tuple[int, int, int]]) -> DataFrame:
    """Cells moved by each offset, with (dx, dy, dz)."""
    each = F.explode(F.array(*(F.struct(F.lit(a).alias("dx"), F.lit(b).alias("dy"), F.lit(c).alias("dz")) for a, b, c in offsets))).alias("o")
    rows = cells.select("*", each)
    return rows.select(*cells.columns, "o.*")


def label_components(cells: DataFrame, offsets: list[tuple[int, int, int]] = HALF_26) -> DataFrame:
    """(scan, x, y, z, root) of distinct cells; root is the smallest cell number of the component in its scan. One shuffle by scan."""
    return scan.label_components(cells, offsets)


def lesions(cells: DataFrame, floor: int = 20, offsets: list[tuple[int, int, int]] = HALF_26) -> DataFrame:
    """(scan, root, n, rank): components of at least ``floor`` voxels, the biggest first, ties by root."""
    sizes = label_components(cells, offsets).groupBy(*SCAN, "root").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= floor)
    return sizes.withColumn("rank", F.row_number().over(Window.partitionBy(*SCAN).orderBy(F.desc("n"), "root")))


def in_scans(rows: DataFrame, work: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """The cells (scan, x, y, z) that ``work`` makes of the sorted distinct cell numbers of whole scans, each with its scan's number before it. One shuffle by scan."""
    kinds = dict(rows.dtypes)

    def run(table: pa.Table) -> pa.Table:
        number, cell = scan.numbered(table)
        first = np.flatnonzero(np.r_[True, number[1:] != number[:-1]])
        keys = work(np.unique(number * scan.SIDE**3 + cell))
        own = table.select(SCAN).take(pa.array(first[keys // scan.SIDE**3]))
        at = (keys // step % scan.SIDE for step in (scan.SIDE**2, scan.SIDE, 1))
        return pa.Table.from_arrays([*own.columns, *(pa.array(c, pa.int64()) for c in at)], CELL)

    found = scan.by_scan(rows.select(*CELL), run, ", ".join(f"{c} {kinds[c]}" for c in SCAN) + ", x bigint, y bigint, z bigint")
    return found.select(*SCAN, *(F.col(c).cast(kinds[c]).alias(c) for c in "xyz"))


def dilate(cells: DataFrame, r: int, lo: tuple[int, int, int], hi: tuple[int, int, int]) -> DataFrame:
    """The cube of radius r around each cell, as three passes of one axis each, cut at the grid's bounds."""
    if min(lo) < 0 or max(hi) > scan.SIDE - 2:
        raise ValueError(f"bounds of grids must lie between 0 and {scan.SIDE - 2}")

    def work(keys: np.ndarray) -> np.ndarray:
        for step, a, b in zip((scan.SIDE**2, scan.SIDE, 1), lo, hi):
            at = keys // step % scan.SIDE
            keys = np.unique(np.concatenate([keys[(at + d >= a) & (at + d <= b)] + d * step for d in range(-r, r + 1)]))
        return keys

    return in_scans(cells, work)


def erode(cells: DataFrame) -> DataFrame:
    """Cells whose six face neighbours are all there."""
    steps = scan.steps_of(FACES)

    def work(keys: np.ndarray) -> np.ndarray:
        for_all = np.ones(len(keys), bool)
        for step in steps:
            for_all &= keys[np.minimum(np.searchsorted(keys, keys + step), len(keys) - 1)] == keys + step
        return keys[for_all]

    return in_scans(cells, work)


def surface(cells: DataFrame) -> DataFrame:
    """Cells with an open face."""
    return cells.select(*CELL).distinct().join(erode(cells), CELL, "left_anti")


def visit_pairs(cells: DataFrame) -> DataFrame:
    """(patient, visit, previous) of consecutive visits."""
    visits = cells.select(*SCAN).distinct()
    return visits.withColumn("previous", F.lag("visit").over(Window.partitionBy("patient").orderBy("visit"))).where("previous IS NOT NULL")


def growth(cells: DataFrame) -> DataFrame:
    """(patient, visit, previous, kept, gained, lost, stable_pct, jaccard_pct, dice) between consecutive visits."""
    pairs = visit_pairs(cells)
    now = cells.select(*CELL).distinct().join(pairs, SCAN).select("patient", "visit", "previous", "x", "y", "z", F.lit(1).alias("now"))
    old = cells.select("patient", F.col("visit").alias("previous"), "x", "y", "z").distinct().join(pairs, ["patient", "previous"]).select("patient", "visit", "previous", "x", "y", "z", F.lit(1).alias("old"))
    both = now.join(old, ["patient", "visit", "previous", "x", "y", "z"], "full")
    kept, gained, lost = (F.count(F.when(c, 1)) for c in (F.col("now").isNotNull() & F.col("old").isNotNull(), F.col("old").isNull(), F.col("now").isNull()))
    rows = both.groupBy("patient", "visit", "previous").agg(kept.alias("kept"), gained.alias("gained"), lost.alias("lost"))
    all_cells = F.col("kept") + F.col("gained") + F.col("lost")
    return rows.withColumns({"stable_pct": 100.0 * F.col("kept") / (F.col("kept") + F.col("lost") + F.when(F.col("kept") + F.col("lost") == 0, 1).otherwise(0)), "jaccard_pct": 100.0 * F.col("kept") / all_cells, "dice": 2.0 * F.col("kept") / (all_cells + F.col("kept"))})


def overlaps(found: DataFrame) -> DataFrame:
    """(patient, visit, root, previous, parent, n): voxels that a component shares with one of the visit before. found: label_components."""
    pairs = visit_pairs(found)
    old = found.select("patient", F.col("visit").alias("previous"), "x", "y", "z", F.col("root").alias("parent"))
    return found.join(pairs, SCAN).join(old, ["patient", "previous", "x", "y", "z"]).groupBy("patient", "visit", "root", "previous", "parent").agg(F.count(F.lit(1)).alias("n"))


def tracked(found: DataFrame) -> DataFrame:
    """Adds to each component (patient, visit, root): parent (most shared voxels, then the larger root), and state:
    ``kept`` for its parent's heir (the same choice from the parent's side), ``split`` for other children, ``new`` without parent."""
    shared = overlaps(found)
    best = Window.partitionBy("patient", "visit", "root").orderBy(F.desc("n"), F.desc("parent"))
    heir = Window.partitionBy("patient", "previous", "parent").orderBy(F.desc("n"), F.desc("root"))
    chosen = shared.withColumn("b", F.row_number().over(best)).where("b = 1").withColumn("h", F.row_number().over(heir))
    every = found.select(*SCAN, "root").distinct().join(chosen.select("patient", "visit", "root", "parent", "h"), ["patient", "visit", "root"], "left")
    return every.select("patient", "visit", "root", "parent", F.when(F.col("parent").isNull(), "new").when(F.col("h") == 1, "kept").otherwise("split").alias("state"))


def lesion_ids(links: DataFrame) -> DataFrame:
    """(patient, visit, root, lesion) of tracked components: an heir takes over the lesion of its parent at the visit before, any other
    component begins a lesion ``visit:root``. A patient's components are followed inside one task."""
    rows = links.select("patient", "visit", "root", F.when(F.col("state") == "kept", F.col("parent")).alias("parent"))

    def run(batches):
        import pyarrow as pa

        at, before, now = None, {}, {}
        for batch in batches:
            patients, visits, roots, parents = (c.to_pylist() for c in batch.columns)
            out = []
            for p, v, r, parent in zip(patients, visits, roots, parents):
                if (p, v) != at:
                    before, now = (now if at and at[0] == p else {}), {}
                    at = p, v
                now[r] = before[parent] if parent is not None else f"{v}:{r}"
                out.append(now[r])
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(out, pa.string())], ["patient", "visit", "root", "lesion"])

    return rows.repartition("patient").sortWithinPartitions("patient", "visit").mapInArrow(run, "patient bigint, visit bigint, root bigint, lesion string")


def new_by_overlap(found: DataFrame, r: int, lo: tuple[int, int, int], hi: tuple[int, int, int]) -> DataFrame:
    """(patient, visit, root, n) of components that touch no cell of the visit before, dilated by r."""
    pairs = visit_pairs(found)
    near = dilate(found, r, lo, hi).withColumnRenamed("visit", "previous").join(pairs, ["patient", "previous"]).select(*CELL)
    touched = found.join(near, CELL, "left_semi").select(*SCAN, "root").distinct()
    later = found.join(pairs.select(*SCAN), SCAN, "left_semi")
    return later.groupBy(*SCAN, "root").agg(F.count(F.lit(1)).alias("n")).join(touched, [*SCAN, "root"], "left_anti")


def new_foci(cells: DataFrame, slack: int, floor: int, lo: tuple[int, int, int], hi: tuple[int, int, int]) -> DataFrame:
    """(patient, visit, root, n): components of ``floor`` cells or more among the cells more than ``slack`` from the visit before that have
    a cell with all its face neighbours, which mere growth along a surface lacks."""
    own = cells.select(*CELL).distinct()
    pairs = visit_pairs(own)
    near = dilate(own, slack, lo, hi).withColumnRenamed("visit", "previous").join(pairs, ["patient", "previous"]).select(*CELL)
    gained = own.join(pairs.select(*SCAN), SCAN, "left_semi").join(near, CELL, "left_anti")
    found = label_components(gained)
    solid = found.join(erode(gained), CELL, "left_semi").select(*SCAN, "root").distinct()
    return found.groupBy(*SCAN, "root").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= floor).join(solid, [*SCAN, "root"], "left_semi")


def centroids(cells: DataFrame) -> DataFrame:
    return cells.groupBy(*SCAN).agg(F.count(F.lit(1)).alias("n"), *(F.avg(c).alias(f"c{c}") for c in "xyz"))


def best_shift(cells: DataFrame, reach: int = 2) -> DataFrame:
    """(patient, visit, previous, dx, dy, dz, jaccard_pct): of all shifts up to ``reach`` cells along each axis the one under
    which the visit overlaps the one before best; ties by the smaller shift, then in order."""
    pairs = visit_pairs(cells)
    own = cells.select(*CELL).distinct()
    sizes = own.groupBy(*SCAN).agg(F.count(F.lit(1)).alias("n"))
    offsets = list(product(range(-reach, reach + 1), repeat=3))
    moved = shifted(own.join(pairs, SCAN), offsets).select("patient", "visit", "previous", (F.col("x") + F.col("dx")).alias("x"), (F.col("y") + F.col("dy")).alias("y"), (F.col("z") + F.col("dz")).alias("z"), "dx", "dy", "dz")
    hits = moved.join(own.withColumnRenamed("visit", "previous"), ["patient", "previous", "x", "y", "z"]).groupBy("patient", "visit", "previous", "dx", "dy", "dz").agg(F.count(F.lit(1)).alias("both"))
    rows = hits.join(sizes, SCAN).join(sizes.select("patient", F.col("visit").alias("previous"), F.col("n").alias("m")), ["patient", "previous"])
    rows = rows.withColumn("jaccard_pct", 100.0 * F.col("both") / (F.col("n") + F.col("m") - F.col("both")))
    turn = Window.partitionBy("patient", "visit").orderBy(F.desc("jaccard_pct"), F.abs("dx") + F.abs("dy") + F.abs("dz"), "dx", "dy", "dz")
    return rows.withColumn("r", F.row_number().over(turn)).where("r = 1").select("patient", "visit", "previous", "dx", "dy", "dz", "jaccard_pct")


#: The numbers of a transform: three angles, a translation, a centre.
FIT = ("rx", "ry", "rz", "tx", "ty", "tz", "cx", "cy", "cz")
#: Cells of fixed grids that are mapped together.
SLAB = 1 << 18


def mapped(fit: list[np.ndarray], at: np.ndarray) -> list[np.ndarray]:
    """Where each transform (numbers as in FIT, one entry each) takes each of the cells (3, n), to the nearest cell, halves away from 0."""
    rx, ry, rz, *rest = (n[:, None] for n in fit)
    u, v, w = (at[k] - rest[3 + k] for k in range(3))
    u, w = np.cos(ry) * u + np.sin(ry) * w, -np.sin(ry) * u + np.cos(ry) * w
    v, w = np.cos(rx) * v - np.sin(rx) * w, np.sin(rx) * v + np.cos(rx) * w
    u, v = np.cos(rz) * u - np.sin(rz) * v, np.sin(rz) * u + np.cos(rz) * v
    there = (p + rest[3 + k] + rest[k] for k, p in enumerate((u, v, w)))
    return [np.sign(p) * np.floor(np.abs(p) + 0.5) for p in there]


def resampled(cells: DataFrame, transforms: DataFrame, lo: tuple[int, int, int], hi: tuple[int, int, int]) -> DataFrame:
    """Labels on the fixed grid after a rigid transform, nearest neighbour: each fixed cell looks up the moving cell that it maps to. One shuffle by scan; the
    grid is laid out inside the scan's task only, SLAB cells at a time.

    transforms: (patient, visit, rx, ry, rz, tx, ty, tz, cx, cy, cz); the rotation is Z X Y, so that y turns first, then x, then z, around
    the centre, from fixed to moving coordinates. Cells that map outside the moving table stay empty."""
    kind = cells.schema["label"].dataType
    keys = [F.col(c).cast("bigint").alias(c) for c in CELL]
    moving = cells.select(*keys, "label", F.lit(False).alias("turn"), *(F.lit(None).cast("double").alias(c) for c in FIT))
    turns = transforms.select(*keys[:2], *(F.lit(0).cast("bigint").alias(c) for c in "xyz"), F.lit(None).cast(kind).alias("label"), F.lit(True).alias("turn"), *(F.col(c).cast("double").alias(c) for c in FIT))
    shape = tuple(b - a + 1 for a, b in zip(lo, hi))
    size = int(np.prod(shape))

    def work(table: pa.Table) -> pa.Table:
        number, cell = scan.numbered(table)
        is_turn = table.column("turn").to_numpy()
        turn, held = np.flatnonzero(is_turn), np.flatnonzero(~is_turn)
        key = number[held] * scan.SIDE**3 + cell[held]
        order = np.argsort(key, kind="stable")
        held, key = held[order], key[order]
        fits = [table.column(c).to_numpy()[turn] for c in FIT]
        places, rows, together = [np.zeros((3, 0), np.int64)], [np.zeros(0, np.int64)], max(1, SLAB // size)
        for first in range(0, len(turn), together):
            some = np.s_[first : first + together]
            for start in range(0, size, SLAB):
                at = np.stack(np.unravel_index(np.arange(start, min(start + SLAB, size)), shape)) + np.array(lo)[:, None]
                there = mapped([n[some] for n in fits], at)
                fit, place = np.nonzero(np.logical_and.reduce([(p >= 0) & (p < scan.SIDE - 1) for p in there]))
                x, y, z = (p[fit, place].astype(np.int64) for p in there)
                wanted = number[turn[some]][fit] * scan.SIDE**3 + (x * scan.SIDE + y) * scan.SIDE + z
                low, high = np.searchsorted(key, wanted), np.searchsorted(key, wanted, "right")
                hits = high - low
                places.append(np.repeat(at[:, place], hits, axis=1))
                rows.append(held[np.repeat(low, hits) + np.arange(hits.sum()) - np.repeat(np.cumsum(hits) - hits, hits)])
        place, row = np.concatenate(places, axis=1), np.concatenate(rows)
        own = table.select([*SCAN, "label"]).take(pa.array(row))
        return pa.Table.from_arrays([own.column(0), own.column(1), *(pa.array(p, pa.int32()) for p in place), own.column(2)], [*CELL, "label"])

    return scan.by_scan(moving.unionByName(turns), work, f"patient bigint, visit bigint, x int, y int, z int, label {kind.simpleString()}")

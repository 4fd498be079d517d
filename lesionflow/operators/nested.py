"""Components inside components: the pieces that a lesion falls into on its slices, from one forest.

The cells of a slice (fixed z) that touch are joined first; the trees are the pieces. The trees are then joined across slices; the trees of trees are the
26-connected lesions. So every piece hangs under its lesion, and no second search is needed. One shuffle by scan."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import scan
from .voxel import HALF_6, HALF_26

FLAT = scan.steps_of([o for o in HALF_26 if o[2] == 0])
UPRIGHT = scan.steps_of([o for o in HALF_26 if o[2] != 0])


def forest(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(piece, lesion) of each of the sorted distinct cell numbers: the index of the first cell of either."""
    piece = scan.connected(keys, FLAT)
    a, b = [], []
    for step in UPRIGHT:
        at = np.minimum(np.searchsorted(keys, keys + step), len(keys) - 1)
        hit = np.flatnonzero(keys[at] == keys + step)
        a.append(piece[hit])
        b.append(piece[at[hit]])
    return piece, scan.united(len(keys), np.concatenate(a), np.concatenate(b))[piece]


def sorted_cells(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row of the table, scan number, cell number, key) in the order of the keys."""
    number, cell = scan.numbered(table)
    key = number * scan.SIDE**3 + cell
    order = np.argsort(key)
    return order, number[order], cell[order], key[order]


def slices_of(lesion: np.ndarray, piece: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lesion, z, pieces) of each slice of each lesion."""
    heads = np.unique(piece)
    marks, counts = np.unique(np.stack([lesion[heads], z[heads]], axis=1), axis=0, return_counts=True)
    return marks[:, 0], marks[:, 1], counts


def pieces(cells: DataFrame) -> DataFrame:
    """(patient, visit, root, z, pieces): how many pieces each lesion falls into on each slice that it reaches."""

    def work(table: pa.Table) -> pa.Table:
        order, _, cell, key = sorted_cells(table)
        piece, lesion = forest(key)
        of, z, count = slices_of(lesion, piece, cell % scan.SIDE)
        patient, visit = (table.column(c).to_numpy()[order][of] for c in scan.SCAN)
        return pa.Table.from_arrays([pa.array(patient, pa.int64()), pa.array(visit, pa.int64()), pa.array(cell[of], pa.int64()), pa.array(z, pa.int32()), pa.array(count, pa.int64())], ["patient", "visit", "root", "z", "pieces"])

    return scan.by_scan(cells.select(*scan.SCAN, "x", "y", "z").distinct(), work, "patient bigint, visit bigint, root bigint, z int, pieces bigint")


RECORD = "patient bigint, visit bigint, total bigint, sizes array<bigint>, sizes_6 array<bigint>, slices bigint, fragmented bigint"


def records(cells: DataFrame) -> DataFrame:
    """One row a scan: cells, the sizes of its lesions under 26 and under 6 neighbours (largest first), the slices of the largest lesion (of equals the one with
    the smaller first cell) and on how many it falls into several pieces."""

    def work(table: pa.Table) -> pa.Table:
        order, number, cell, key = sorted_cells(table)
        piece, lesion = forest(key)
        heads, sizes = np.unique(lesion, return_counts=True)
        heads_6, sizes_6 = np.unique(scan.connected(key, scan.steps_of(HALF_6)), return_counts=True)
        of, _, count = slices_of(lesion, piece, cell % scan.SIDE)
        starts = np.flatnonzero(np.r_[True, number[1:] != number[:-1]])
        patient, visit = (table.column(c).to_numpy()[order][starts] for c in scan.SCAN)
        by, by_6 = np.split(np.arange(len(heads)), np.searchsorted(heads, starts[1:])), np.split(sizes_6, np.searchsorted(heads_6, starts[1:]))
        largest = [int(heads[k[np.argmax(sizes[k])]]) for k in by]
        low, high = np.searchsorted(of, largest), np.searchsorted(of, largest, "right")
        fragmented = [int((count[a:b] > 1).sum()) for a, b in zip(low, high)]
        descending = lambda x: np.sort(x)[::-1].tolist()
        columns = [patient, visit, [int(sizes[k].sum()) for k in by], [descending(sizes[k]) for k in by], [descending(s) for s in by_6], high - low, fragmented]
        kinds = [pa.int64()] * 3 + [pa.list_(pa.int64())] * 2 + [pa.int64()] * 2
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [c.split(" ")[0] for c in RECORD.split(", ")])

    return scan.by_scan(cells.select(*scan.SCAN, "x", "y", "z").distinct(), work, RECORD)

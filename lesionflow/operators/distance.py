"""Distances to a set of cells on a box, for all margins at once, and the nearest cell of a point."""

from __future__ import annotations

import numpy as np


def spread(seeds: np.ndarray, low: np.ndarray, shape: tuple[int, ...], most: int, steps: str) -> np.ndarray:
    """For each cell of the box at ``low`` the distance to the nearest seed (n, 3), ``most`` + 1 where it is farther.

    steps: ``cube`` counts moves to any of the 26 neighbours, so that ``distance <= r`` is a dilation by the cube of radius r;
    ``face`` counts moves over faces (r dilations by the six neighbours). Both are separable: one pass for each axis. Seeds outside the box
    count for nothing."""
    far = np.iinfo(np.int32).max // 2
    at = seeds - low
    at = at[((at >= 0) & (at < shape)).all(axis=1)]
    out = np.full(shape, most + 1 if steps == "cube" else far, np.int32)
    out[tuple(at.T)] = 0
    for axis in range(len(shape)):
        line = np.moveaxis(out, axis, 0)
        if steps == "cube":
            before = line.copy()
            for s in range(1, min(most, len(line) - 1) + 1):
                np.minimum(line[s:], np.maximum(before[:-s], s), out=line[s:])
                np.minimum(line[:-s], np.maximum(before[s:], s), out=line[:-s])
        else:
            for k in range(1, len(line)):
                np.minimum(line[k], line[k - 1] + 1, out=line[k])
            for k in range(len(line) - 2, -1, -1):
                np.minimum(line[k], line[k + 1] + 1, out=line[k])
    return np.minimum(out, most + 1)


def distances(points: np.ndarray, seeds: np.ndarray, most: int, steps: str = "cube") -> np.ndarray:
    """The distance of each point (n, 3) to the nearest seed, ``most`` + 1 where it is farther."""
    if not len(points) or not len(seeds):
        return np.full(len(points), most + 1, np.int32)
    low = np.maximum(points.min(axis=0) - most, np.minimum(points.min(axis=0), seeds.min(axis=0)))
    high = np.minimum(points.max(axis=0) + most, np.maximum(points.max(axis=0), seeds.max(axis=0)))
    field = spread(seeds, low, tuple((high - low + 1).tolist()), most, steps)
    return field[tuple((points - low).T)]


class Near:
    """A grid index of cells: buckets of SIDE cells along each axis, searched in rings around a point until no nearer cell can follow."""

    SIDE = 4

    def __init__(self, cells: np.ndarray):
        self.bucket = np.floor_divide(cells, self.SIDE)
        order = np.lexsort(self.bucket.T[::-1])
        self.cells, self.bucket = cells[order].astype(float), self.bucket[order]
        new = np.flatnonzero(np.r_[True, (self.bucket[1:] != self.bucket[:-1]).any(axis=1)]) if len(cells) else np.zeros(0, int)
        self.of = {tuple(self.bucket[a].tolist()): (a, b) for a, b in zip(new.tolist(), [*new[1:].tolist(), len(cells)])}
        self.low, self.high = (self.bucket.min(axis=0), self.bucket.max(axis=0)) if len(cells) else (None, None)

    def ring(self, home: np.ndarray, r: int):
        """Buckets r rings from home that lie within the index's bounds."""
        low, high = np.maximum(home - r, self.low), np.minimum(home + r, self.high)
        for x in range(low[0], high[0] + 1):
            for y in range(low[1], high[1] + 1):
                if max(abs(x - home[0]), abs(y - home[1])) == r:
                    yield from ((x, y, z) for z in range(low[2], high[2] + 1))
                else:
                    yield from ((x, y, z) for z in {home[2] - r, home[2] + r} if low[2] <= z <= high[2])

    def distance(self, point: np.ndarray) -> float | None:
        """From the point to the nearest cell; None without cells."""
        if not self.of:
            return None
        home = np.floor_divide(point, self.SIDE).astype(int)
        r = int(max(0, (self.low - home).max(), (home - self.high).max()))  # nearer rings are empty
        best = np.inf
        while r <= max(np.abs(home - self.low).max(), np.abs(home - self.high).max()):
            # a cell r rings away is at least (r - 1) buckets off, and as far as the point lies from the bucket's side
            if best < np.inf and self.SIDE * (r - 1) > best:
                break
            for key in self.ring(home, r):
                if key in self.of:
                    a, b = self.of[key]
                    best = min(best, float(np.sqrt(((self.cells[a:b] - point) ** 2).sum(axis=1).min())))
            r += 1
        return best

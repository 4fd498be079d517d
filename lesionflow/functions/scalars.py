"""Scalar functions on columns: labels, volumes, affines, free text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def week_label(label: Column) -> tuple[Column, Column]:
    """(week, sub) of ``week-NNN[-S]``; sub is 0 where absent; both NULL for other text."""
    good = F.regexp_like(label, F.lit(r"^week-\d+(-\d+)?$"))
    week = F.when(good, F.regexp_extract(label, r"^week-(\d+)", 1).cast("double"))
    sub = F.when(good, F.coalesce(F.expr("NULL").cast("int"), F.when(F.regexp_extract(label, r"^week-\d+-(\d+)$", 1) != "", F.regexp_extract(label, r"^week-\d+-(\d+)$", 1).cast("int")).otherwise(0)))
    return week, sub


#: Spread of volume by size. Volumes from the first column up to the next row's have the second column's band, in percentage points.
BANDS = [(0.0, 36.6), (1000.0, 14.8), (5000.0, 5.3), (20000.0, 2.8), (60000.0, 1.5)]


def uncertainty_pp(volume: Column) -> Column:
    out = F.lit(None).cast("double")
    for low, pp in BANDS:
        out = F.when(volume >= low, pp).otherwise(out)
    return out


def determinant(a: list[list[Column]]) -> Column:
    return a[0][0] * (a[1][1] * a[2][2] - a[1][2] * a[2][1]) - a[0][1] * (a[1][0] * a[2][2] - a[1][2] * a[2][0]) + a[0][2] * (a[1][0] * a[2][1] - a[1][1] * a[2][0])


def affine(prefix: str = "a") -> list[list[Column]]:
    """The 3x3 part of an affine from columns a00 to a22, as doubles."""
    return [[F.col(f"{prefix}{i}{j}").cast("double") for j in range(3)] for i in range(3)]


def voxel_volume(a: list[list[Column]]) -> Column:
    """Volume of a voxel: the determinant, which also holds for sheared grids."""
    return F.abs(determinant(a))


def spacing(a: list[list[Column]]) -> list[Column]:
    """Lengths of the columns."""
    return [F.sqrt(a[0][j] * a[0][j] + a[1][j] * a[1][j] + a[2][j] * a[2][j]) for j in range(3)]


def anisotropy(s: list[Column]) -> Column:
    """Largest over smallest spacing; infinite at a zero spacing."""
    return F.when(F.least(*s) > 0, F.greatest(*s) / F.least(*s)).otherwise(F.lit(float("inf")))


def cosines(a: list[list[Column]]) -> list[list[Column]]:
    """Columns divided by their lengths; zero columns stay zero."""
    s = spacing(a)
    return [[F.when(s[j] > 0, a[i][j] / s[j]).otherwise(0.0) for j in range(3)] for i in range(3)]

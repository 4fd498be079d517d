"""Exact order statistics without gathering a group: places of distinct values, percentiles, average ranks.

Distinct values with their counts are dealt out by ranges of (group, value). Each range's rows per group are added up, the few sums get a running
total over the ranges, and only values of one range are ordered together. So a group as large as the table and a value that most rows share
are both spread: the first over the ranges, the second by counting it first."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.shared import stash


def places(rows: DataFrame, value: str, *by: str, also: dict[str, Column] | None = None) -> DataFrame:
    """(by, value, m, before): each distinct value of a group, how many rows have it, and how many have a smaller one; ``also``: further aggregates
    of the rows of a value. Nulls are left out."""
    more = [c.alias(k) for k, c in (also or {}).items()]
    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("m"), *more)
    ranged = stash(counts.repartitionByRange(*(F.col(c) for c in (*by, value))).withColumn("part", F.spark_partition_id()))
    earlier = Window.partitionBy(*by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range that a group reaches into
    sums = ranged.groupBy(*by, "part").agg(F.sum("m").alias("rows")).withColumn("offset", F.coalesce(F.sum("rows").over(earlier), F.lit(0))).drop("rows")
    within = Window.partitionBy(*by, "part").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    return ranged.join(sums, [*by, "part"]).select(*by, value, "m", *(also or {}), (F.col("offset") + F.coalesce(F.sum("m").over(within), F.lit(0))).alias("before"))


def percentiles(rows: DataFrame, value: str, shares: dict[str, float], *by: str, nearest: bool = False) -> DataFrame:
    """(by, n, a column for each name of ``shares``): exact percentiles, which interpolate between the two nearest values, or with ``nearest`` the value
    at place floor(share * n), at most the last. Groups without a value are not in the result (without ``by``, a row of nulls)."""
    held = stash(places(rows, value, *by))
    n = held.groupBy(*by).agg(F.sum("m").alias("n"))
    ranked = held.join(n, list(by)) if by else held.crossJoin(n)

    def at(place):
        return F.max(F.when((F.col("before") <= place) & (place < F.col("before") + F.col("m")), F.col(value)))

    columns, out = [], []
    for name, share in shares.items():
        if nearest:
            columns.append(at(F.least(F.floor(F.lit(share) * F.col("n")), F.col("n") - 1)).alias(name))
            out.append(F.col(name))
            continue
        place = F.lit(share) * (F.col("n") - 1)
        columns += [at(F.floor(place)).alias(f"{name}_low"), at(F.ceil(place)).alias(f"{name}_high"), F.max(place - F.floor(place)).alias(f"{name}_share")]
        out.append((F.col(f"{name}_low") + (F.col(f"{name}_high") - F.col(f"{name}_low")) * F.col(f"{name}_share")).alias(name))
    return ranked.groupBy(*by).agg(F.max("n").alias("n"), *columns).select(*by, "n", *out)


def with_rank(rows: DataFrame, value: str, *by: str, name: str = "rank") -> DataFrame:
    """Adds the average rank of ``value`` within by, from 1; equal values share the mean of their places; nulls have none."""
    ranks = places(rows, value, *by).select(*by, value, (F.col("before") + (F.col("m") + 1) / 2).alias(name))
    return rows.join(ranks, [*by, value], "left")


def medians(rows: DataFrame, columns: dict[str, str], *by: str) -> DataFrame:
    """(by, the median of each column under its new name): null where a group has no value; a row for each group, one of nulls without ``by`` and rows."""
    out = rows.select(*by).distinct() if by else rows.sparkSession.range(1).select()
    for name, column in columns.items():
        part = percentiles(rows, column, {name: 0.5}, *by).drop("n")
        out = out.join(part, list(by), "left") if by else out.crossJoin(part)
    return out

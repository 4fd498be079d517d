"""Shards by proportional stratified interleaving.

Rows of each source are ordered by a seeded hash; row r of n gets the fractional rank (r - 1/2) / n. The
order of all rows by fractional rank carries every source at its own rate, and equal cuts of that order
give shards whose row counts differ by one at most and whose mixtures match the whole.

No source is gathered: ranks come from counts of (source, hash bucket) and of bins of the fractional
rank, each with a running total, plus a row number inside a bucket. Only ids, hashes and sizes move.

Equal texts are no unit here: each of their rows is dealt by itself. Keeping a group of equal texts in one shard and counts at most
one row apart exclude each other as soon as a group is larger than that gap allows.

A null source is a source of its own; null text has size 1; repeated rows each get a slot (rows equal in
every used column are interchangeable); an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.shared import stash

ROWS_PER_BUCKET = 20_000


def shard_rows(docs: DataFrame, shards: int = 16, seed: int = 20_240_229) -> DataFrame:
    """doc_id, source, size, text_crc32, shard and slot (gapless from 0 in each shard)."""
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = stash(docs.select(
        "doc_id", "source", (F.octet_length(raw).cast("long") + 1).alias("size"), F.crc32(raw).alias("text_crc32"),
        F.coalesce(F.concat(F.lit("="), "source"), F.lit("-")).alias("stratum"), F.xxhash64(F.lit(seed), F.col("doc_id")).alias("key"),
    ))
    total = rows.count()
    buckets = max(1, total // ROWS_PER_BUCKET)
    rows = rows.withColumn("bucket", F.pmod(F.shiftrightunsigned("key", 24), F.lit(buckets)))
    before = Window.partitionBy("stratum").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("stratum", "bucket").agg(F.count(F.lit(1)).alias("n")).select(
        "stratum", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"), F.sum("n").over(Window.partitionBy("stratum")).alias("of")
    )
    inside = Window.partitionBy("stratum", "bucket").orderBy("key", "doc_id", "text_crc32", "size")
    ranked = rows.join(counts, ["stratum", "bucket"]).withColumn("fraction", (F.col("offset") + F.row_number().over(inside) - 0.5) / F.col("of"))
    ranked = stash(ranked.select("doc_id", "source", "size", "text_crc32", "stratum", "key", "fraction", F.floor(F.col("fraction") * buckets).alias("bin")))
    bins = ranked.groupBy("bin").agg(F.count(F.lit(1)).alias("n")).select("bin", F.coalesce(F.sum("n").over(Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    within = Window.partitionBy("bin").orderBy("fraction", "stratum", "key", "doc_id", "text_crc32", "size")
    place = ranked.join(bins, "bin").withColumn("at", F.col("start") + F.row_number().over(within) - 1)
    n = F.lit(max(1, total))
    placed = place.withColumn("shard", F.expr(f"CAST(at * {shards} DIV {max(1, total)} AS INT)"))
    first = F.expr(f"(shard * {total}L + {shards - 1}) DIV {shards}")
    return placed.select("doc_id", "source", "size", "text_crc32", "shard", (F.col("at") - first).cast("long").alias("slot"))


def write_shards(docs: DataFrame, path: str, shards: int = 16, seed: int = 20_240_229) -> DataFrame:
    """Writes the rows of ``docs``, which needs distinct doc_ids, as one folder per shard in slot order, and returns the assignment."""
    placed = shard_rows(docs, shards, seed)
    docs.join(placed.select("doc_id", "shard", "slot"), "doc_id").repartition("shard", F.floor(F.col("slot") / ROWS_PER_BUCKET)).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    return placed

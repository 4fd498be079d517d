"""Exact deduplication with a heavy-hitter split.

Misra-Gries summaries of every partition, merged by addition, hold each digest that more than
N / (k + 1) rows share. Their exact counts and smallest ids (the verified winners, k rows at most)
are broadcast, so the copies of hot texts leave before any shuffle. All other digests are shuffled, each task's
copies of a text as one row: sums of groups meet the rows again in a join that can be split, and of whole rows
a task sends on the first of each text only.

Texts are equal when identical after each run of ``[\\x20\\x09-\\x0D]`` became one space; null counts as
empty. Of equal texts the row with the smallest doc_id stays. Rows that repeat a doc_id and its text are
one document (all have kept = true in ``exact_groups``; ``drop_exact_copies`` returns one of them).
Null ids sort last; a group with null ids only keeps null. Empty tables give empty results; further
columns are ignored by ``exact_groups`` and kept by ``drop_exact_copies``.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.shared import stash
from .text import unused

HEAVY_COUNTERS = 255


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " "), 256))


def merged(counts: Counter, k: int) -> Counter:
    """The Misra-Gries step: at most k counters stay, less the (k + 1)-th largest count."""
    if len(counts) <= k:
        return counts
    over = sorted(counts.values(), reverse=True)[k]
    return Counter({x: n - over for x, n in counts.items() if n > over})


def summaries(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            counts.update(batch.column(0).to_pylist())
            counts = merged(counts, k)
        if counts:
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["digest", "held"])

    return run


def winners(rows: DataFrame, k: int = HEAVY_COUNTERS) -> DataFrame:
    """(digest, keep_id, group_size) of each digest that more than N / (k + 1) of the rows
    (doc_id, digest) have: k rows at most, with exact figures from a second pass.

    Summaries of 4 k counters undercount a digest by N / (4 k + 1) at most over all partitions together
    and never overcount it, so every such digest passes the floor below, and 4 / 3 (k + 1) digests at most do."""
    total = rows.count()
    held = rows.select("digest").mapInArrow(summaries(4 * k), "digest binary, held bigint").groupBy("digest").agg(F.sum("held").alias("held"))
    candidates = stash(held.where(F.col("held") > total / (k + 1) - total / (4 * k + 1)).select("digest"))
    exact = rows.join(F.broadcast(candidates), "digest", "left_semi").groupBy("digest").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    return stash(exact.where(F.col("group_size") > max(1, total // (k + 1))))


def exact_groups(docs: DataFrame, k: int = HEAVY_COUNTERS) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = stash(docs.select("doc_id", digest(F.col("text")).alias("digest")))
    heavy = winners(rows, k)
    hot = rows.join(F.broadcast(heavy), "digest")
    others = rows.join(F.broadcast(heavy), "digest", "left_anti")
    sums = others.groupBy("digest").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    rest = others.join(sums, "digest").select("digest", "doc_id", "keep_id", "group_size")
    return hot.select("digest", "doc_id", "keep_id", "group_size").union(rest).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )


def drop_exact_copies(docs: DataFrame, k: int = HEAVY_COUNTERS) -> DataFrame:
    """The rows that stay, with all their columns; of rows that repeat a doc_id and its text any one, the same in every run."""
    mark, keep, hot = unused(docs.columns, "digest_of_text", "id_that_stays", "is_hot")
    marked = docs.withColumn(mark, digest(F.col("text")))
    heavy = winners(marked.select("doc_id", F.col(mark).alias("digest")), k).select(F.col("digest").alias(mark), F.col("keep_id").alias(keep), F.lit(True).alias(hot))
    left = marked.join(F.broadcast(heavy), mark, "left").where(F.col(hot).isNull() | F.col("doc_id").eqNullSafe(F.col(keep)))
    order = F.struct(F.col("doc_id").isNull(), "doc_id", F.xxhash64(*docs.columns))
    return left.groupBy(mark).agg(F.min_by(F.struct(*docs.columns), order).alias(keep)).select(f"{keep}.*")

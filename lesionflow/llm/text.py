"""What several text operators share: ASCII case, words, stable hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: bytes.translate table that lower-cases A-Z only; bytes.split() then cuts at [\x20\x09-\x0D]+ exactly.
ASCII_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(ASCII_LOWER).split() if text else []


def with_likely(rows: DataFrame, keys: DataFrame, name: str) -> DataFrame:
    """Adds the boolean column ``name``: whether a row's doc_id hashes to a bit that some key has set, which is so for all rows with a key
    and few others, so that a join of the likely rows shuffles little else. The bits are 8 MB at any size of the keys; more keys only let
    more rows by."""
    columns = unused(rows.columns, "bit_bucket", "bit_place", "bits_set")
    bucket, place, held = columns
    bit = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 26))
    bits = keys.select(bit.alias("bit")).select(F.floor(F.col("bit") / 32768).alias(bucket), (F.col("bit") % 32768).alias("place")).groupBy(bucket).agg(F.bitmap_construct_agg("place").alias(held))
    marked = rows.withColumns({bucket: F.floor(bit / 32768), place: bit % 32768}).join(F.broadcast(bits), bucket, "left")
    byte = F.conv(F.hex(F.expr(f"substring({held}, CAST({place} DIV 8 AS INT) + 1, 1)")), 16, 10).cast("long")
    return marked.withColumn(name, F.coalesce(byte.bitwiseAND(F.expr(f"shiftleft(1L, CAST({place} % 8 AS INT))")) != 0, F.lit(False))).select(*rows.columns, name)


def likely_in(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """The likely rows alone."""
    (name,) = unused(rows.columns, "is_likely")
    return with_likely(rows, keys, name).where(F.col(name)).drop(name)


def without(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows whose doc_id is none of the keys; only likely ones are moved to find out."""
    (name,) = unused(rows.columns, "is_likely")
    marked = with_likely(rows, keys, name)
    return marked.where(~F.col(name)).drop(name).union(marked.where(F.col(name)).drop(name).join(keys, "doc_id", "left_anti").select(*rows.columns))


def unused(columns: list[str], *names: str) -> list[str]:
    """The names, lengthened until no column has them (in any case)."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out

"""Content addresses for rows and whole datasets.

Row ids hash canonical JSON (NULL fields kept, field order fixed by the caller).
A dataset digest must not depend on row order and must not gather rows in one
place, so it adds up the eight 32-bit words of every row hash: the sums combine
map-side and only one row per task is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_WORDS = 8


def canonical_json(columns: list[Column | str]) -> Column:
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def canonical_number(value: Column) -> Column:
    """Shortest plain decimal text of a double (no exponent, no trailing zeros); beyond 10^20 as the engine writes it."""
    plain = value.try_cast("decimal(38,18)").cast("string")
    return F.coalesce(F.rtrim(F.rtrim(plain, F.lit("0")), F.lit(".")), value.cast("string"))


def content_id(columns: list[Column | str]) -> Column:
    return F.sha2(canonical_json(columns), 256)


def kind_id(kind: str, columns: list[Column | str]) -> Column:
    """Id of a record of one kind: equal records of different kinds differ."""
    return F.sha2(F.concat(F.lit(kind + ":"), canonical_json(columns)), 256)


def word_sums(row_hash: Column) -> list[Column]:
    """Mergeable sums of the hash words; DECIMAL(38,0) cannot overflow here."""
    words = [
        F.conv(F.substring(row_hash, 1 + 8 * i, 8), 16, 10).cast("decimal(10,0)") for i in range(_WORDS)
    ]
    return [F.sum(word).cast("decimal(28,0)").alias(f"w{i}") for i, word in enumerate(words)]


def combine_words(count: str = "rows", words: str | None = None) -> Column:
    """Digest of word sums and the row count; ``words`` names a struct that holds the sums."""
    parts = [F.coalesce(F.col(f"{words}.w{i}" if words else f"w{i}"), F.lit(0)).cast("string") for i in range(_WORDS)]
    return F.sha2(F.concat_ws(":", F.col(count).cast("string"), *parts), 256)


def dataset_digest(df: DataFrame, row_hash: Column, by: list[str] | None = None) -> DataFrame:
    """Columns ``rows`` and ``digest`` per group (or one row)."""
    grouped = df.withColumn("_h", row_hash).groupBy(*(by or []))
    summed = grouped.agg(F.count(F.lit(1)).alias("rows"), *word_sums(F.col("_h")))
    return summed.select(*(by or []), "rows", combine_words().alias("digest"))

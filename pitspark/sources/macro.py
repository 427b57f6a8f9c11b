"""Macro observation documents and series metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.reasons import finite, reason_array, require_zero
from ..functions.times import after_local_date

# Zone, labels and the open end of a vintage.
ZONE = "America/Chicago"
SOURCE = "fred-alfred"
BASIS = "vintage_date_end_america_chicago"
OPEN_END = "9999-12-31"
TEXT_FIELDS = [
    "title", "frequency", "frequency_short", "units", "units_short", "seasonal_adjustment", "seasonal_adjustment_short",
]

_PAGE = "observations array<struct<date: string, realtime_start: string, realtime_end: string, value: string>>"
KEY = ["series_id", "observation_date", "vintage_date"]


def parse_observations(pages: DataFrame, payload: str = "payload") -> DataFrame:
    """Vintage rows; a dot or null is a missing value, not zero."""
    kept = [c for c in pages.columns if c != payload]
    parsed = pages.select(*kept, F.from_json(payload, _PAGE).alias("_p"))
    rows = parsed.select(*kept, F.explode("_p.observations").alias("o"))
    text = F.nullif(F.col("o.value"), F.lit("."))
    vintage = F.col("o.realtime_start").try_cast("date")
    return rows.select(
        F.upper("series_id").alias("series_id"), F.col("o.date").try_cast("date").alias("observation_date"),
        text.try_cast("double").alias("value"), vintage.alias("vintage_date"),
        after_local_date(vintage, ZONE).alias("available_at"), F.lit(SOURCE).alias("source"),
        F.coalesce(F.col("o.realtime_end"), F.lit(OPEN_END)).try_cast("date").alias("realtime_end"),
        F.lit(BASIS).alias("availability_basis"),
        (text.isNotNull() & text.try_cast("double").isNull()).alias("_bad_value"),
    )


def observation_checks() -> list:
    return [
        ("date_invalid", F.col("observation_date").isNull() | F.col("vintage_date").isNull() | F.col("realtime_end").isNull()),
        ("value_invalid", F.col("_bad_value") | (F.col("value").isNotNull() & ~finite(F.col("value")))),
        ("realtime_end_before_vintage", F.coalesce(F.col("realtime_end") < F.col("vintage_date"), F.lit(False))),
    ]


def unique_observations(rows: DataFrame) -> DataFrame:
    """One row per vintage with ``conflict`` when its copies disagree."""
    from .filings import conflict_columns

    payload = [c for c in rows.columns if c not in KEY]
    merged = rows.groupBy(*KEY).agg(
        F.max(F.struct(*payload)).alias("_o"), *conflict_columns("value"),
        (F.min("realtime_end") != F.max("realtime_end")).alias("_end_conflict"),
    )
    return merged.select(*KEY, "_o.*", (F.col("conflict") | F.col("_end_conflict")).alias("conflict"))


def require_observations(rows: DataFrame) -> DataFrame:
    require_zero(rows, dict(observation_checks()))
    merged = unique_observations(rows)
    require_zero(merged, {"conflicting values for one vintage": F.col("conflict")})
    return merged.drop("conflict", "_bad_value")


def observation_window(rows: DataFrame, start: Column, end: Column) -> tuple[DataFrame, DataFrame]:
    """(rows inside the window, audit row with explicit excluded and out-of-range counts)."""
    before = F.col("observation_date") < start
    after = F.greatest("observation_date", "vintage_date") > end
    audit = rows.groupBy("series_id").agg(
        F.count(F.lit(1)).alias("parsed"), F.count_if(before).alias("excluded_before_start"),
        F.count_if(after).alias("after_requested_end"),
    )
    return rows.filter(~before), audit


def normalise_metadata(raw: DataFrame, observed_at: Column) -> DataFrame:
    """Metadata is available when it was observed, not when the provider updated it."""
    return raw.withColumns(
        {
            "series_id": F.upper("series_id"), "observed_at": observed_at, "available_at": observed_at,
            "source": F.lit("fred-series-metadata"), "availability_basis": F.lit("local_observation"),
        }
    )


def metadata_checks() -> list:
    """Reason codes of an unusable metadata record."""
    text_ok = F.lit(True)
    for name in TEXT_FIELDS:
        text_ok = text_ok & (F.length(F.trim(F.col(name))) > 0) & ~F.col(name).rlike(r"[\x00-\x1f\x7f]")
    return [
        ("text_invalid", ~text_ok),
        ("observation_range_reversed", F.col("observation_start") > F.col("observation_end")),
        ("realtime_not_a_single_day", F.col("realtime_start") != F.col("realtime_end")),
        ("availability_is_not_observation", F.col("available_at") != F.col("observed_at")),
        ("updated_after_observation", F.col("last_updated") > F.col("observed_at")),
        ("realtime_after_observation", F.col("realtime_end") > F.to_date("observed_at")),
    ]


def metadata_reasons(records: DataFrame) -> DataFrame:
    return records.withColumn("reasons", reason_array(metadata_checks()))

"""Observed-context features at one cutoff: six market and five macro slots.

A slot always yields a row: either a value or the first gate that blocked it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.digest import canonical_number, combine_words, content_id, word_sums
from ..functions.reasons import finite
from ..functions.times import utc_text

# Feature names, macro definitions, age limits and reasons of the frozen contract.
MARKET_FEATURES = {
    "market.return_1_observed_bar": (2, "fraction"),
    "market.return_5_observed_bars": (6, "fraction"),
    "market.return_20_observed_bars": (21, "fraction"),
    "market.volatility_20_observed_intervals": (21, "fraction"),
    "market.range_fraction": (1, "fraction"),
    "market.volume_to_mean_20_observed_bars": (20, "ratio"),
}
SPREAD = "macro.DGS10_minus_DFF.spread_pp"
# series: units, frequency, seasonal adjustment, max availability age (days), max observation age (days)
MACRO_POLICY = {
    "DFF": ("Percent", "Daily, 7-Day", "Not Seasonally Adjusted", 7, 7),
    "DGS10": ("Percent", "Daily", "Not Seasonally Adjusted", 7, 7),
    "CPIAUCSL": ("Index 1982-1984=100", "Monthly", "Seasonally Adjusted", 62, 100),
    "UNRATE": ("Percent", "Monthly", "Seasonally Adjusted", 62, 100),
}
MAX_METADATA_DAYS = 30
MAX_MARKET_DAYS = 7
MAX_GAP_DAYS = 7
REASONS = {
    "AVAILABLE": None,
    "INSUFFICIENT_HISTORY": "The required number of observed market bars is unavailable.",
    "STALE_MARKET": "The latest market event exceeds the seven-calendar-day age limit.",
    "EXCESSIVE_MARKET_GAP": "An observed market date gap exceeds seven calendar days.",
    "ZERO_DENOMINATOR": "The required denominator is zero; no substitute is used.",
    "MISSING_METADATA": "No strictly eligible macro metadata record was supplied.",
    "STALE_METADATA": "Macro metadata observation age exceeds thirty days.",
    "DEFINITION_MISMATCH": "Macro units, frequency, or seasonal adjustment differs from the frozen definition.",
    "MISSING_OBSERVATION": "No eligible macro observation was supplied.",
    "MISSING_VALUE": "The latest macro observation is null; older values are not substituted.",
    "STALE_OBSERVATION": "The latest macro observation availability age exceeds the series limit.",
    "STALE_OBSERVATION_DATE": "The latest macro observation date exceeds the series calendar-age limit.",
    "IDENTITY_BLOCKED": "No eligible matching single-source equity description binds these inputs.",
    "INPUT_BLOCKED": "At least one required macro level is unavailable.",
    "OBSERVATION_DATE_MISMATCH": "The latest rate observations have different dates; no alignment is inferred.",
    "NUMERIC_ERROR": "The calculation cannot produce a finite numeric result.",
}
_DEEPEST = max(count for count, _ in MARKET_FEATURES.values())


def contract(spark: SparkSession) -> DataFrame:
    """The frozen definitions as a table (feature, unit, bars, age limits)."""
    rows = [(n, u, c, MAX_MARKET_DAYS, None) for n, (c, u) in MARKET_FEATURES.items()]
    rows += [(f"macro.{s}.level", p[0], 1, p[3], p[4]) for s, p in MACRO_POLICY.items()]
    rows.append((SPREAD, "percentage_points", 1, None, None))
    return spark.createDataFrame(
        rows, "feature string, unit string, records int, max_age_days int, max_observation_days int"
    )


def macro_policy(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [(s, *p) for s, p in MACRO_POLICY.items()],
        "series_id string, units string, frequency string, seasonal_adjustment string, max_age_days int, max_observation_days int",
    )


def reason_text(status: Column) -> Column:
    mapping = F.create_map(*[F.lit(x) for k, v in REASONS.items() if v for x in (k, v)])
    return F.element_at(mapping, status)


def market_features(market: DataFrame, instruments: DataFrame, cutoff: Column) -> DataFrame:
    """Six rows per requested instrument from its evidence market section.

    Only the last 21 bars matter: the numbering limits every instrument before the
    shuffle, and the rest is one aggregation. Where the section carries ``evidence_id``,
    every slot names the records it was computed from.
    """
    traced = "evidence_id" in market.columns
    recent = W.partitionBy("instrument_id").orderBy(F.desc("event_time"))
    last = market.withColumn("rn", F.row_number().over(recent)).filter(F.col("rn") <= _DEEPEST)
    # the neighbour in this numbering is the next older bar
    staged = last.withColumns(
        {
            "_older_close": F.lead("close").over(recent),
            "_gap": F.datediff(F.to_date("event_time"), F.to_date(F.lead("event_time").over(recent))),
        }
    ).withColumn("_ret", F.try_divide(F.col("close"), F.col("_older_close")) - 1)
    at = lambda c, n: F.max(F.when(F.col("rn") == n, F.col(c)))
    counts = sorted({c for c, _ in MARKET_FEATURES.values()})
    wide = staged.groupBy("instrument_id").agg(
        F.count(F.lit(1)).alias("bars"),
        at("event_time", 1).alias("latest"),
        *[at("close", n).alias(f"c{n}") for n in (1, 2, 6, 21)],
        *[at(c, 1).alias(c) for c in ("open", "high", "low", "volume")],
        F.stddev_samp(F.when(F.col("rn") <= 20, F.col("_ret"))).alias("vol"),
        F.avg(F.when(F.col("rn") <= 20, F.col("volume"))).alias("mean_volume"),
        *[F.max(F.when(F.col("rn") < n, F.col("_gap"))).alias(f"gap{n}") for n in counts],
        *[F.max(F.when(F.col("rn") <= n, F.col("available_at"))).alias(f"avail{n}") for n in counts],
        *[F.array_sort(F.collect_set(F.when(F.col("rn") <= n, F.col("evidence_id")))).alias(f"ids{n}") for n in counts if traced],
    )
    asked = instruments.select("instrument_id").distinct().join(wide, "instrument_id", "left")
    c1 = F.col("c1")
    values = {
        "market.return_1_observed_bar": F.try_divide(c1, F.col("c2")) - 1,
        "market.return_5_observed_bars": F.try_divide(c1, F.col("c6")) - 1,
        "market.return_20_observed_bars": F.try_divide(c1, F.col("c21")) - 1,
        "market.volatility_20_observed_intervals": F.col("vol"),
        "market.range_fraction": F.try_divide(F.col("high") - F.col("low"), F.col("open")),
        "market.volume_to_mean_20_observed_bars": F.try_divide(F.col("volume"), F.col("mean_volume")),
    }
    slots = []
    for name, (count, unit) in MARKET_FEATURES.items():
        value = values[name]
        zero = F.col("mean_volume") == 0 if "volume" in name else F.lit(False)
        status = (
            F.when(F.coalesce(F.col("bars"), F.lit(0)) < count, "INSUFFICIENT_HISTORY")
            .when(F.datediff(F.to_date(cutoff), F.to_date("latest")) > MAX_MARKET_DAYS, "STALE_MARKET")
            .when(F.coalesce(F.col(f"gap{count}"), F.lit(0)) > MAX_GAP_DAYS, "EXCESSIVE_MARKET_GAP")
            .when(zero, "ZERO_DENOMINATOR")
            .when(~finite(value), "NUMERIC_ERROR")
            .otherwise("AVAILABLE")
        )
        slots.append(
            F.struct(
                F.lit(name).alias("feature"), F.lit(unit).alias("unit"), status.alias("status"),
                F.when(status == "AVAILABLE", value).alias("value"),
                F.least(F.coalesce(F.col("bars"), F.lit(0)), F.lit(count)).cast("bigint").alias("records_used"),
                # with fewer bars than asked for, the selection is what there is
                F.col(f"avail{count}").alias("latest_input_available_at"),
                *([F.coalesce(f"ids{count}", _none()).alias("source_evidence_ids"), _none().alias("metadata_record_hashes")] if traced else []),
            )
        )
    return asked.select("instrument_id", F.inline(F.array(*slots)))


def _none() -> Column:
    return F.array().cast("array<string>")


def metadata_hash() -> Column:
    """Content hash of a series definition as it was observed."""
    return content_id(["series_id", "units", "frequency", "seasonal_adjustment", utc_text(F.col("observed_at")).alias("observed_at")])


def metadata_as_of(catalog: DataFrame, cutoff: Column) -> DataFrame:
    """Per series: the record, or why it may not be used at the cutoff.

    ``catalog(series_id, status, generated_at, available_at, observed_at, units,
    frequency, seasonal_adjustment)`` has one row per series.
    """
    status = (
        F.when(F.col("status") != "AVAILABLE", F.col("status"))
        .when(F.col("generated_at") >= cutoff, F.lit("UNAVAILABLE_AT_CUTOFF"))
        .when(F.col("available_at") >= cutoff, F.lit("UNAVAILABLE_AT_CUTOFF"))
        .otherwise(F.lit("AVAILABLE"))
    )
    return catalog.withColumn("eligibility", status)


def catalog_summary(catalog: DataFrame) -> DataFrame:
    """COMPLETE only when every series is available."""
    return catalog.agg(
        F.count(F.lit(1)).alias("series"),
        F.count_if(F.col("status") == "AVAILABLE").alias("available"),
        F.when(F.bool_and(F.col("status") == "AVAILABLE"), "COMPLETE").otherwise("PARTIAL").alias("status"),
    )


def macro_features(macro: DataFrame, metadata: DataFrame, cutoff: Column) -> DataFrame:
    """Four level rows and the spread row from the evidence macro section.

    ``metadata`` holds eligible records (one per series). The latest observation is
    taken as it is: a NULL value blocks the slot.
    """
    spark = macro.sparkSession
    policy = macro_policy(spark)
    traced = "evidence_id" in macro.columns
    row = F.struct("observation_date", "available_at", "value", *(["evidence_id"] if traced else []))
    latest = macro.groupBy("series_id").agg(F.max_by(row, "observation_date").alias("o"))
    definition = metadata.select(
        "series_id", F.struct("observed_at", "units", "frequency", "seasonal_adjustment", metadata_hash().alias("hash")).alias("m")
    )
    lineage = {}
    if traced:
        lineage = {
            "source_evidence_ids": F.array_compact(F.array("o.evidence_id")), "metadata_record_hashes": F.array_compact(F.array("m.hash")),
        }
    joined = policy.join(latest, "series_id", "left").join(definition, "series_id", "left")
    day_us = 86_400_000_000
    age = lambda c: F.unix_micros(cutoff) - F.unix_micros(c)
    same = (
        F.col("m.units").eqNullSafe(F.col("units"))
        & F.col("m.frequency").eqNullSafe(F.col("frequency"))
        & F.col("m.seasonal_adjustment").eqNullSafe(F.col("seasonal_adjustment"))
    )
    status = (
        F.when(F.col("m").isNull(), "MISSING_METADATA")
        .when(~same, "DEFINITION_MISMATCH")
        .when(age(F.col("m.observed_at")) > MAX_METADATA_DAYS * day_us, "STALE_METADATA")
        .when(F.col("o").isNull(), "MISSING_OBSERVATION")
        .when(F.col("o.value").isNull(), "MISSING_VALUE")
        .when(age(F.col("o.available_at")) > F.col("max_age_days") * F.lit(day_us), "STALE_OBSERVATION")
        .when(F.datediff(F.to_date(cutoff), F.col("o.observation_date")) > F.col("max_observation_days"), "STALE_OBSERVATION_DATE")
        .otherwise("AVAILABLE")
    )
    levels = joined.select(
        F.concat(F.lit("macro."), "series_id", F.lit(".level")).alias("feature"),
        F.col("units").alias("unit"),
        status.alias("status"),
        F.when(status == "AVAILABLE", F.col("o.value")).alias("value"),
        F.when(F.col("o").isNotNull(), 1).otherwise(0).cast("bigint").alias("records_used"),
        F.greatest("o.available_at", "m.observed_at").alias("latest_input_available_at"),
        F.col("o.observation_date").alias("observation_date"),
        *[ids.alias(name) for name, ids in lineage.items()],
    )
    pair = lambda s, c: F.max(F.when(F.col("feature") == f"macro.{s}.level", F.col(c)))
    both = levels.filter(F.col("feature").isin("macro.DGS10.level", "macro.DFF.level")).agg(
        *[pair(s, c).alias(f"{s}_{c}") for s in ("DGS10", "DFF") for c in ("status", "value", "observation_date", "records_used")],
        F.max("latest_input_available_at").alias("latest_input_available_at"),
        *[F.array_sort(F.array_distinct(F.flatten(F.collect_list(name)))).alias(name) for name in lineage],  # two series
    )
    difference = F.col("DGS10_value") - F.col("DFF_value")
    spread_status = (
        F.when((F.col("DGS10_status") != "AVAILABLE") | (F.col("DFF_status") != "AVAILABLE"), "INPUT_BLOCKED")
        .when(F.col("DGS10_observation_date") != F.col("DFF_observation_date"), "OBSERVATION_DATE_MISMATCH")
        .when(~finite(difference), "NUMERIC_ERROR")
        .otherwise("AVAILABLE")
    )
    spread = both.select(
        F.lit(SPREAD).alias("feature"), F.lit("percentage_points").alias("unit"), spread_status.alias("status"),
        F.when(spread_status == "AVAILABLE", difference).alias("value"),
        (F.col("DGS10_records_used") + F.col("DFF_records_used")).alias("records_used"), "latest_input_available_at", *lineage,
    )
    return levels.drop("observation_date").unionByName(spread)


def feature_packet(market: DataFrame, macro: DataFrame) -> DataFrame:
    """Eleven rows per instrument: its market slots and the shared macro slots."""
    instruments = market.select("instrument_id").distinct()
    slots = macro.agg(F.collect_list(F.struct(*macro.columns))).scalar()  # five rows
    shared = instruments.select("instrument_id", F.inline(slots))
    return market.unionByName(shared, allowMissingColumns=True).withColumn("reason", reason_text(F.col("status")))


def packet_status(features: DataFrame) -> DataFrame:
    """COMPLETE iff every slot is available, plus an order-free digest of all result fields of the slots.

    Slots that carry their lineage also get ``lineage_hash``: statuses, units and inputs without the values.
    """
    origin = [c for c in ("source_evidence_ids", "metadata_record_hashes") if c in features.columns]
    stamp = utc_text(F.col("latest_input_available_at")).alias("latest_input_available_at")
    fields = ["feature", "status", "unit", "reason", *origin, stamp] if "reason" in features.columns else ["feature", "status", "unit", *origin, stamp]
    hashes = {"feature_hash": content_id([*fields, canonical_number(F.col("value")).alias("value")])}
    if origin:
        hashes["lineage_hash"] = content_id(fields)
    grouped = features.groupBy("instrument_id").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("status") == "AVAILABLE").alias("available_count"),
        *[F.struct(*word_sums(h)).alias(name) for name, h in hashes.items()],
    )
    return grouped.select(
        "instrument_id", F.col("rows").alias("feature_count"), "available_count",
        F.when(F.col("rows") == F.col("available_count"), "COMPLETE").otherwise("PARTIAL").alias("status"),
        *[combine_words(words=name).alias(name) for name in hashes],
    )


def provenance(market: DataFrame, count: int) -> DataFrame:
    """Sorted evidence ids of the last ``count`` bars per instrument (at most ``count`` each)."""
    recent = W.partitionBy("instrument_id").orderBy(F.desc("event_time"))
    last = market.withColumn("rn", F.row_number().over(recent)).filter(F.col("rn") <= count)
    return last.groupBy("instrument_id").agg(
        F.array_sort(F.collect_set("evidence_id")).alias("source_evidence_ids"),
        F.max("available_at").alias("latest_input_available_at"),
    )

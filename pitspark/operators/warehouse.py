"""Point-in-time warehouse: reads as of an instant, versioned ingest, quality reports.

Ingest functions are pure: they take the existing table and the incoming batch and
return the rows to append (or the merged table). Publishing is the sink's job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.digest import canonical_json
from ..functions.reasons import ohlc_checks, require_unique, require_zero
from ..functions.times import utc_text
from ..schemas import PRIMARY_KEYS, contract_checks
from .cutoffs import known_inclusive, latest_version, versions_at_cutoffs

SNAPSHOT_PREFIX = "snapshot-v2:"
LEGACY_VERSION = "adjusted-v1"
OHLCV = ["open", "high", "low", "close", "volume"]
FACT_KEYS = ["instrument_id", "metric", "period_start", "period_end", "unit", "source"]
MACRO_KEYS = ["series_id", "observation_date", "source"]


def observed_daily(bars: DataFrame) -> DataFrame:
    """Observed daily snapshots only; legacy adjusted rows are never read as of a time."""
    return bars.filter(
        (F.col("source") == "yahoo") & (F.col("interval") == "1d") & F.col("data_version").startswith(SNAPSHOT_PREFIX)
    )


def _one(df: DataFrame, column: str, value: str | None) -> DataFrame:
    return df if value is None else df.filter(F.col(column) == value)


def bars_as_of(bars: DataFrame, as_of: Column, instrument_id: str | None = None) -> DataFrame:
    """One observed bar per (instrument, day): the latest available at ``as_of`` inclusive."""
    known = _one(observed_daily(bars), "instrument_id", instrument_id).filter(known_inclusive(as_of))
    return latest_version(
        known, ["instrument_id", "event_time"], [F.desc("available_at"), F.desc("ingested_at"), F.desc("data_version")]
    )


def fundamentals_as_of(facts: DataFrame, as_of: Column, instrument_id: str | None = None) -> DataFrame:
    """Latest filing per metric, period, unit and source; quarter and year-to-date stay apart."""
    known = _one(facts, "instrument_id", instrument_id).filter(known_inclusive(as_of))
    return latest_version(known, FACT_KEYS, [F.desc_nulls_last("filed_at"), F.desc_nulls_last("accession_number")])


def macro_as_of(macro: DataFrame, as_of: Column, series_id: str | None = None) -> DataFrame:
    """Latest vintage per observation date; the fetched realtime end is not a filter."""
    known = _one(macro, "series_id", series_id.upper() if series_id else None).filter(known_inclusive(as_of))
    return latest_version(known, MACRO_KEYS, [F.desc("vintage_date")])


def bars_at_cutoffs(bars: DataFrame, cutoffs: DataFrame) -> DataFrame:
    return versions_at_cutoffs(
        observed_daily(bars), cutoffs, ["instrument_id", "event_time"],
        [F.col("available_at"), F.col("ingested_at"), F.col("data_version")],
    )


def fundamentals_at_cutoffs(facts: DataFrame, cutoffs: DataFrame) -> DataFrame:
    # NULL period_start is one partition value, and joins on it must match it too
    return versions_at_cutoffs(facts, cutoffs, FACT_KEYS, [F.col("filed_at"), F.col("accession_number")])


def macro_at_cutoffs(macro: DataFrame, cutoffs: DataFrame) -> DataFrame:
    return versions_at_cutoffs(macro, cutoffs, MACRO_KEYS, [F.col("vintage_date")])


# ---- ingest -----------------------------------------------------------------


def stamp_snapshot(frame: DataFrame, observed_at: Column) -> DataFrame:
    """Completed rows of a fetched history as observed snapshots.

    Input (symbol, event_time, OHLCV). The version names the observation instant
    and the content hash, so equal content observed twice differs only in time.
    """
    done = frame.filter(F.timestamp_add("DAY", F.lit(1), F.col("event_time")) <= observed_at)
    payload = F.sha2(canonical_json(OHLCV), 256)
    return done.select(
        F.concat(F.lit("YF:"), F.upper("symbol")).alias("instrument_id"),
        "event_time",
        F.lit("1d").alias("interval"),
        *OHLCV,
        observed_at.alias("available_at"),
        observed_at.alias("ingested_at"),
        F.lit("yahoo").alias("source"),
        F.concat_ws(":", F.lit(SNAPSHOT_PREFIX.rstrip(":")), utc_text(observed_at), payload).alias("data_version"),
    )


def require_valid_snapshot(frame: DataFrame) -> DataFrame:
    """Whole batch rejected on a duplicate or missing time or an invalid bar (exact bounds)."""
    require_unique(frame, ["symbol", "event_time"], "snapshot bar")
    return require_zero(frame, {"missing_time": F.col("event_time").isNull(), **dict(ohlc_checks(0.0))})


def append_if_changed(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming snapshots that are new or differ from the latest stored version.

    An old value that comes back after a correction differs from the latest one,
    so it appends again. Only the history of the incoming bars is ranked.
    """
    keys = ["instrument_id", "event_time", "interval", "source"]
    snapshots = existing.filter((F.col("source") == "yahoo") & F.col("data_version").startswith(SNAPSHOT_PREFIX))
    stored = snapshots.join(incoming.select(*keys).distinct(), keys, "left_semi")
    latest = latest_version(
        stored, keys, [F.desc("available_at"), F.desc("ingested_at"), F.desc("data_version")]
    ).select(*keys, F.struct(*OHLCV).alias("_prior"))
    same = F.col("_prior").isNotNull()
    for name in OHLCV:
        same = same & F.col(name).eqNullSafe(F.col(f"_prior.{name}"))
    joined = incoming.join(latest, keys, "left")
    return insert_or_ignore(existing, joined.filter(~same).select(*incoming.columns), "market_bars")


def insert_or_ignore(existing: DataFrame, incoming: DataFrame, table: str) -> DataFrame:
    """Rows whose primary key is not stored; of rows that share a key the one of least content hash, on every run."""
    keys = PRIMARY_KEYS[table]
    return latest_version(incoming, keys, [F.xxhash64(*incoming.columns)]).join(existing.select(*keys), keys, "left_anti")


def changed_values(existing: DataFrame, incoming: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Keys whose stored or repeated value differs from an incoming one."""
    both = existing.select(*keys, value).unionByName(incoming.select(*keys, value))
    spread = both.groupBy(*keys).agg(
        F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.count(value).alias("_n"),
        F.count(F.lit(1)).alias("_rows"),
    )
    differs = (F.col("_lo") != F.col("_hi")) | ((F.col("_n") > 0) & (F.col("_n") < F.col("_rows")))
    return spread.filter(F.coalesce(differs, F.lit(False))).select(*keys)


def ingest_fundamentals(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Rows to append; the whole batch fails on a contract violation or a changed value."""
    require_zero(incoming, {**contract_checks("fundamentals"), **_finite_or_null("value")})
    conflict = changed_values(
        existing.join(incoming.select("record_id"), "record_id", "left_semi"), incoming, ["record_id"], "value"
    )
    require_zero(conflict, {"stored value changed under one record id": F.lit(True)})
    return insert_or_ignore(existing, incoming, "fundamentals")


def merge_macro(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Merged table: values are immutable per vintage, ``realtime_end`` takes the incoming one."""
    keys = PRIMARY_KEYS["macro_observations"]
    require_zero(incoming, {**contract_checks("macro_observations"), **_finite_or_null("value")})
    touched = existing.join(incoming.select(*keys).distinct(), keys, "left_semi")
    require_zero(
        changed_values(touched, incoming, keys, "value"), {"stored vintage value changed": F.lit(True)}
    )
    fresh = incoming.groupBy(*keys).agg(F.max(F.struct("realtime_end", *_rest(incoming, keys))).alias("_new"))
    old = existing.select(*keys, F.struct(*_rest(existing, keys), "realtime_end").alias("_old"))
    merged = old.join(fresh, keys, "full")
    columns = [
        F.coalesce(F.col("_new.realtime_end"), F.col("_old.realtime_end")).alias("realtime_end")
        if c == "realtime_end"
        else F.when(F.col("_old").isNotNull(), F.col(f"_old.{c}")).otherwise(F.col(f"_new.{c}")).alias(c)
        for c in existing.columns
        if c not in keys
    ]
    return merged.select(*keys, *columns).select(*existing.columns)


MACRO_PARTS = ("series_id", "period")


def write_macro(rows: DataFrame, root: str) -> None:
    """A macro table on disk, partitioned by series and year of observation."""
    rows.withColumn("period", F.year("observation_date")).write.partitionBy(*MACRO_PARTS).parquet(root)


def read_macro(spark: SparkSession, root: str, columns: list) -> DataFrame:
    """The table written by ``write_macro``; ``columns`` are the fields of its rows."""
    return spark.read.schema(T.StructType([*columns, T.StructField("period", T.IntegerType())])).parquet(root)


def merge_macro_into(root: str, incoming: DataFrame) -> None:
    """``merge_macro`` into the stored table: partitions the batch touches are read, merged and replaced, no other file is.

    The replaced partitions are written aside and moved when the job commits; a rejected batch changes nothing.
    """
    spark, period = incoming.sparkSession, F.year("observation_date").alias("period")
    touched = incoming.select("series_id", period).distinct()
    years = [r.period for r in touched.select("period").distinct().collect()]  # bounded by the calendar
    stored = read_macro(spark, root, incoming.schema.fields).where(F.col("period").isin(years))
    existing = stored.join(touched, list(MACRO_PARTS), "left_semi").select(*incoming.columns)
    merged = merge_macro(existing, incoming).withColumn("period", period)
    merged.write.partitionBy(*MACRO_PARTS).option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(root)


def _rest(df: DataFrame, keys: list[str]) -> list[str]:
    return [c for c in df.columns if c not in keys and c != "realtime_end"]


def _finite_or_null(column: str) -> dict[str, Column]:
    value = F.col(column)
    broken = F.isnan(value) | (F.abs(value) == F.lit(float("inf")))
    return {f"{column}_nonfinite": value.isNotNull() & broken}


def ingest_news(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    require_zero(
        incoming,
        {
            **contract_checks("news_events"),
            "available_before_seen": F.col("available_at") < F.greatest("published_at", "first_seen_at"),
        },
    )
    return insert_or_ignore(existing, incoming, "news_events")


def upsert_aliases(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Last write wins per (source, source_symbol); a batch replaces what is stored."""
    ranked = existing.withColumn("_batch", F.lit(0)).unionByName(incoming.withColumn("_batch", F.lit(1)))
    return latest_version(
        ranked, PRIMARY_KEYS["instrument_aliases"],
        [F.desc("_batch"), F.desc("available_at"), F.desc("ingested_at"), F.desc("instrument_id")],
    ).drop("_batch")


def ingestion_run(batch: DataFrame, run_id: str, source: str, request_json: str, row_hash: Column) -> DataFrame:
    """One audit row: count and content digest of the batch."""
    from ..functions.digest import dataset_digest

    return dataset_digest(batch, row_hash).select(
        F.lit(run_id).alias("run_id"), F.lit(source).alias("source"), F.lit(request_json).alias("request_json"),
        F.col("rows").alias("record_count"), F.col("digest").alias("content_hash"), F.lit("complete").alias("status"),
        F.current_timestamp().alias("completed_at"),
    )


def split_legacy(table: DataFrame, required: list[str]) -> tuple[DataFrame, DataFrame]:
    """(usable rows, quarantined rows lacking provenance). Nothing is dropped."""
    ok = F.lit(True)
    for name in required:
        ok = ok & F.col(name).isNotNull()
    return table.filter(ok), table.filter(~ok)


# ---- reports ----------------------------------------------------------------


def coverage(tables: dict[str, DataFrame]) -> DataFrame:
    """Per table and source: rows, first and last availability."""
    parts = [
        df.groupBy("source").agg(
            F.count(F.lit(1)).alias("rows"), F.min("available_at").alias("first_available"),
            F.max("available_at").alias("last_available"),
        ).select(F.lit(name).alias("table_name"), "*")
        for name, df in tables.items()
    ]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def violation_report(fundamentals: DataFrame, macro: DataFrame, news: DataFrame) -> DataFrame:
    """The four availability violations, one row each."""
    parts = [
        (fundamentals, {"fundamental_available_before_filed": F.col("available_at") < F.col("filed_at")}),
        (macro, {"macro_available_before_vintage": F.to_date("available_at") < F.col("vintage_date")}),
        (
            news,
            {
                "news_available_before_published": F.col("available_at") < F.col("published_at"),
                "news_available_before_first_seen": F.col("available_at") < F.col("first_seen_at"),
            },
        ),
    ]
    result = None
    for df, checks in parts:
        counted = df.agg(*[F.count_if(c).alias(n) for n, c in checks.items()])
        rows = counted.select(F.inline(F.array(*[F.struct(F.lit(n).alias("check_name"), F.col(n).alias("violations")) for n in checks])))
        result = rows if result is None else result.unionByName(rows)
    return result


def excluded_report(bars: DataFrame, legacy: dict[str, DataFrame] | None = None) -> DataFrame:
    """Rows kept but never read as of a time."""
    result = bars.agg(F.count_if(F.col("data_version") == LEGACY_VERSION).alias("rows")).select(
        F.lit("market_bars_adjusted_v1").alias("kind"), "rows"
    )
    for name, df in (legacy or {}).items():
        result = result.unionByName(df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("kind"), "rows"))
    return result


def table_stats(tables: dict[str, DataFrame]) -> DataFrame:
    parts = [
        df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table_name"), "rows")
        for name, df in tables.items()
    ]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def refresh_outcomes(batches: dict[str, tuple[DataFrame, DataFrame]]) -> DataFrame:
    """(source, fetched, inserted, status) for (fetched, new) frames per source."""
    result = None
    for name, (fetched, new) in batches.items():
        both = fetched.agg(F.count(F.lit(1)).alias("fetched")).crossJoin(new.agg(F.count(F.lit(1)).alias("inserted")))
        row = both.select(
            F.lit(name).alias("source"), "fetched", "inserted",
            F.when(F.col("fetched") == 0, "EMPTY").when(F.col("inserted") > 0, "UPDATED").otherwise("NO_NEW_ROWS").alias("status"),
        )
        result = row if result is None else result.unionByName(row)
    return result


def refresh_status(outcomes: DataFrame) -> DataFrame:
    """COMPLETE iff every source was updated or had nothing new."""
    done = F.bool_and(F.col("status").isin("UPDATED", "NO_NEW_ROWS"))
    return outcomes.agg(F.when(done, "COMPLETE").otherwise("PARTIAL").alias("status"))

"""Daily-bar files: scan, normalise, de-duplicate, describe and validate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.reasons import ValidationError, ohlc_checks, reason_array, require_unique, require_zero
from ..operators.cutoffs import latest_version

REQUIRED = ["open", "high", "low", "close", "volume"]
CSV_SCHEMA = "timestamp timestamp, open double, high double, low double, close double, volume double"
MIN_ROWS = 100


def read_daily_csv(spark: SparkSession, path: str) -> DataFrame:
    """All symbol files of a folder in one scan; the symbol comes from the file name.

    ``INDEX_`` in a file name stands for the caret; a ``-USD`` suffix means crypto.
    ``_seq`` keeps the position within the scan for keep-last de-duplication.
    """
    raw = spark.read.schema(CSV_SCHEMA).option("header", True).option("mode", "FAILFAST").csv(path)
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    folder = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
    # one file per symbol, or one folder ``symbol=<name>`` per symbol
    stem = F.when(folder.startswith("symbol="), F.url_decode(F.regexp_replace(folder, "^symbol=", ""))).otherwise(
        F.regexp_replace(name, r"\.csv(\.gz)?$", "")
    )
    return raw.select(
        F.regexp_replace(stem, "INDEX_", "^").alias("symbol"), *raw.columns, F.monotonically_increasing_id().alias("_seq")
    ).withColumn("asset_class", asset_class(F.col("symbol")))


def asset_class(symbol: Column) -> Column:
    return F.when(symbol.endswith("-USD"), "crypto").otherwise("equity")


def normalise_columns(df: DataFrame, required: list[str] | None = None) -> DataFrame:
    """Lower-case snake names; duplicate or missing columns fail."""
    names = [c.strip().lower().replace(" ", "_") for c in df.columns]
    missing = [c for c in (required or REQUIRED) if c not in names]
    if len(set(names)) != len(names) or missing:
        raise ValidationError(f"missing or duplicate columns: {missing or names}")
    return df.toDF(*names)


def keep_last(df: DataFrame, sequence: str = "_seq") -> DataFrame:
    """Last row per (symbol, timestamp) in ingest order, without rows lacking a value."""
    latest = latest_version(df, ["symbol", "timestamp"], [F.desc(sequence)])
    return latest.dropna(subset=REQUIRED).drop(sequence)


def completed_rows(df: DataFrame, now: Column) -> DataFrame:
    """Rows dated before today's UTC date."""
    return df.filter(F.to_date("timestamp") < F.to_date(now))


def describe(df: DataFrame) -> DataFrame:
    """Rows, first and last date per symbol."""
    return df.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("rows"), F.to_date(F.min("timestamp")).alias("first_date"),
        F.to_date(F.max("timestamp")).alias("last_date"),
    )


def require_enough(description: DataFrame, minimum: int = MIN_ROWS) -> DataFrame:
    return require_zero(description, {"too few valid rows": F.col("rows") < minimum})


def snapshot_checks() -> list:
    """Strict snapshot rules: exact OHLC bounds, no tolerance."""
    return [("missing_timestamp", F.col("timestamp").isNull()), *ohlc_checks(0.0)]


def snapshot_reasons(df: DataFrame) -> DataFrame:
    return df.withColumn("reasons", reason_array(snapshot_checks()))


def require_snapshot(df: DataFrame, max_rows: int | None = None) -> DataFrame:
    """Whole snapshot rejected on any bad row, a repeated UTC day or (when given) too many rows."""
    require_unique(df.withColumn("_day", F.to_date("timestamp")), ["symbol", "_day"], "daily bar")
    if max_rows is not None:
        require_zero(df.groupBy("symbol").count(), {"snapshot exceeds the row limit": F.col("count") > max_rows})
    return require_zero(df, dict(snapshot_checks()))


def completeness(df: DataFrame, observed_at: Column) -> DataFrame:
    """Adds ``complete``: a bar is complete one day after its timestamp."""
    return df.withColumn("complete", F.col("timestamp") <= F.timestamp_add("DAY", F.lit(-1), observed_at))


def historical_cut(bars: DataFrame, cutoff: Column, day: str = "d") -> tuple[DataFrame, DataFrame]:
    """(rows up to the cutoff date, coverage per symbol): features must not see later rows."""
    kept = bars.filter(F.col(day) <= cutoff)
    coverage = kept.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("rows"), F.min(day).alias("first_date"), F.max(day).alias("last_date")
    )
    return kept, coverage

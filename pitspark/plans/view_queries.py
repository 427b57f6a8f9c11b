"""Checks that the derived views hold the same rows in both engines."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import oracle_views as V
from . import views
from .registry import query

_DAY = "CAST(d AS VARCHAR) AS d"


@query("E16 B1", V.with_views(V.BARS) + f"SELECT symbol, {_DAY}, open, high, low, close, volume FROM bars")
def daily_bars(spark, sf):
    return views.bars(spark, sf).withColumn("d", F.col("d").cast("string"))


@query(
    "G1",
    V.with_views(V.SESSIONS)
    + "SELECT calendar, CAST(session_date AS VARCHAR) AS session_date, epoch_us(open_at) AS open_us, "
    "epoch_us(close_at) AS close_us FROM sessions",
)
def session_calendar(spark, sf):
    return views.sessions(spark, sf).select(
        "calendar",
        F.col("session_date").cast("string").alias("session_date"),
        F.unix_micros("open_at").alias("open_us"),
        F.unix_micros("close_at").alias("close_us"),
    )


for _name, _text, _cols in (
    ("market_bars", V.MARKET_BARS, ["instrument_id", "data_version", "open", "close", "volume"]),
    ("fundamentals", V.FUNDAMENTALS, ["record_id", "metric", "value", "unit", "form", "fiscal_period"]),
    ("macro", V.MACRO, ["series_id", "value"]),
    ("news", V.NEWS, ["event_id", "title_hash", "source"]),
    ("identities", V.IDENTITIES, ["instrument_id", "symbol", "asset_class", "primary_exchange", "source"]),
    ("quotes", V.QUOTES, ["symbol", "event_id", "event_ns", "bid", "ask", "bid_size", "ask_size", "tape"]),
    ("fills", V.FILLS, ["symbol", "side", "l_orderkey"]),
    ("predictions", V.PREDICTIONS, ["symbol", "probability", "target_return"]),
):
    _stamped = _name in ("market_bars", "fundamentals", "macro", "news", "identities")
    _sql_cols = ", ".join(_cols + (["epoch_us(available_at) AS available_us", "epoch_us(ingested_at) AS ingested_us"] if _stamped else []))

    def _run(spark, sf, _name=_name, _cols=_cols, _stamped=_stamped):
        extra = (
            [F.unix_micros("available_at").alias("available_us"), F.unix_micros("ingested_at").alias("ingested_us")]
            if _stamped
            else []
        )
        return getattr(views, _name)(spark, sf).select(*_cols, *extra)

    query("B1", V.with_views(_text) + f"SELECT {_sql_cols} FROM {_name}", name=f"{_name}_table")(_run)

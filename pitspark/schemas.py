"""Table contracts: column types, primary keys and CHECK rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SCHEMA_VERSION = 4

# Table layouts of schema version 4.
TABLES: dict[str, str] = {
    "schema_versions": "version int, applied_at timestamp",
    "instruments": (
        "instrument_id string, symbol string, asset_class string, primary_exchange string, "
        "valid_from timestamp, valid_to timestamp, available_at timestamp, ingested_at timestamp, source string"
    ),
    "instrument_aliases": (
        "source string, source_symbol string, instrument_id string, available_at timestamp, ingested_at timestamp"
    ),
    "market_bars": (
        "instrument_id string, event_time timestamp, interval string, open double, high double, low double, "
        "close double, volume double, available_at timestamp, ingested_at timestamp, source string, "
        "data_version string"
    ),
    "fundamentals": (
        "record_id string, instrument_id string, metric string, period_start date, period_end date, value double, "
        "unit string, form string, accession_number string, filed_at timestamp, available_at timestamp, "
        "ingested_at timestamp, source string, fiscal_year int, fiscal_period string, frame string, "
        "availability_basis string"
    ),
    "macro_observations": (
        "series_id string, observation_date date, value double, vintage_date date, available_at timestamp, "
        "ingested_at timestamp, source string, realtime_end date, availability_basis string"
    ),
    "news_events": (
        "event_id string, published_at timestamp, first_seen_at timestamp, available_at timestamp, "
        "ingested_at timestamp, source string, title_hash string, raw_uri string, entity_ids string, "
        "quality_flags string"
    ),
    "index_membership": (
        "index_id string, instrument_id string, effective_from timestamp, effective_to timestamp, "
        "announced_at timestamp, available_at timestamp, ingested_at timestamp, source string"
    ),
    "corporate_actions": (
        "instrument_id string, action_type string, ex_date date, value double, currency string, "
        "announced_at timestamp, available_at timestamp, ingested_at timestamp, source string"
    ),
    "ingestion_runs": (
        "run_id string, source string, request_json string, record_count bigint, content_hash string, "
        "status string, completed_at timestamp"
    ),
    "shadow_signals": (
        "signal_id string, generated_at timestamp, generation_date date, symbol string, asset_class string, "
        "feature_as_of date, probability_up double, direction smallint, model_hash string, "
        "model_trained_through date, model_approved boolean, feature_hash string, cost_bps double, status string, "
        "target_session date, realized_return double, strategy_return double, evaluated_at timestamp, "
        "target_open timestamp, target_close timestamp, feature_payload_json string, "
        "feature_contract_version string, legacy_status string, settlement_bar_json string, "
        "settlement_bar_hash string"
    ),
    "sessions": "calendar string, session_date date, open_at timestamp, close_at timestamp",
}

PRIMARY_KEYS: dict[str, list[str]] = {
    "schema_versions": ["version"],
    "instruments": ["instrument_id", "valid_from", "source"],
    "instrument_aliases": ["source", "source_symbol"],
    "market_bars": ["instrument_id", "event_time", "interval", "source", "data_version"],
    "fundamentals": ["record_id"],
    "macro_observations": ["series_id", "observation_date", "vintage_date", "source"],
    "news_events": ["event_id"],
    "index_membership": ["index_id", "instrument_id", "effective_from", "source"],
    "corporate_actions": ["instrument_id", "action_type", "ex_date", "source"],
    "ingestion_runs": ["run_id"],
    "shadow_signals": ["model_hash", "symbol", "target_session"],
    "sessions": ["calendar", "session_date"],
}

NULLABLE: dict[str, set[str]] = {
    "instruments": {"primary_exchange", "valid_to"},
    "fundamentals": {
        "period_start", "value", "unit", "form", "accession_number", "fiscal_year", "fiscal_period", "frame",
    },
    "macro_observations": {"value"},
    "news_events": {"raw_uri", "entity_ids", "quality_flags"},
    "index_membership": {"effective_to", "announced_at"},
    "corporate_actions": {"value", "currency", "announced_at"},
    "shadow_signals": {
        "target_session", "realized_return", "strategy_return", "evaluated_at", "target_open", "target_close",
        "feature_payload_json", "feature_contract_version", "legacy_status", "settlement_bar_json",
        "settlement_bar_hash",
    },
}


def column_names(table: str) -> list[str]:
    return [part.split()[0] for part in TABLES[table].split(", ")]


def contract_checks(table: str) -> dict[str, Column]:
    """NOT NULL and CHECK rules as violation conditions (FALSE when satisfied)."""
    nullable = NULLABLE.get(table, set())
    checks = {
        f"{name}_null": F.col(name).isNull() for name in column_names(table) if name not in nullable
    }
    if table == "fundamentals":
        checks["period_start_after_end"] = F.coalesce(F.col("period_start") > F.col("period_end"), F.lit(False))
        checks["available_before_filed"] = F.col("available_at") < F.col("filed_at")
    if table == "macro_observations":
        checks["realtime_end_before_vintage"] = F.col("realtime_end") < F.col("vintage_date")
    return checks

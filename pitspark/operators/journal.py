"""Forward-signal journal: generate, append once, settle on the exact target bar, report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.reasons import finite, reason_array, require_zero
from .features import CONTRACT_VERSION
from .metrics import signal
from .sessions import is_crypto, minutes, next_session, session_bounds, valid_bar

PENDING, EVALUATED, INVALIDATED = "PENDING", "EVALUATED", "INVALIDATED_LEGACY"
TARGET_KEY = ["model_hash", "symbol", "target_session"]
SETTLE_MINUTES = 30
RECENT = 30


def feature_payload(features: list[str]) -> Column:
    """Features as JSON with sorted names."""
    return F.to_json(F.struct(*sorted(features)), {"ignoreNullFields": "false"})


def generate(
    scored: DataFrame, sessions: DataFrame, features: list[str], generated_at: Column, model: dict, cost_bps: float
) -> DataFrame:
    """Signals for scored latest snapshots, each with ``skip_reasons`` (empty when it may be appended).

    ``scored(symbol, feature_as_of, probability, <features>)`` holds one row per symbol;
    ``model`` names model_hash, trained_through (ISO date) and approved.
    """
    dated = next_session(scored, sessions, "feature_as_of").withColumnRenamed("next_session", "target_session")
    bounded = session_bounds(dated, sessions, "target_session")
    p = F.col("probability")
    out = bounded.select(
        F.sha2(F.concat_ws("|", F.lit(model["model_hash"]), "symbol", F.col("target_session").cast("string")), 256).alias("signal_id"),
        generated_at.alias("generated_at"), F.to_date(generated_at).alias("generation_date"), "symbol",
        F.lit("equity").alias("asset_class"), "feature_as_of", p.alias("probability_up"),
        signal(p).cast("smallint").alias("direction"), F.lit(model["model_hash"]).alias("model_hash"),
        F.lit(model["trained_through"]).cast("date").alias("model_trained_through"),
        F.lit(bool(model["approved"])).alias("model_approved"), F.lit(float(cost_bps)).alias("cost_bps"),
        F.lit(PENDING).alias("status"), "target_session", F.col("open_at").alias("target_open"),
        F.col("close_at").alias("target_close"), feature_payload(features).alias("feature_payload_json"),
        F.lit(CONTRACT_VERSION).alias("feature_contract_version"),
    ).withColumn("feature_hash", F.sha2("feature_payload_json", 256))
    return out.withColumn(
        "skip_reasons",
        reason_array(
            [
                ("crypto_requires_delayed_entry_target", is_crypto(F.col("symbol"))),
                ("no_next_session", F.col("target_session").isNull()),
                ("stale_or_target_opened", F.coalesce(F.col("generated_at") >= minutes(F.col("target_open"), -1), F.lit(False))),
                ("model_trained_beyond_features", F.col("model_trained_through") > F.col("feature_as_of")),
                ("invalid_probability", ~finite(F.col("probability_up")) | (F.col("probability_up") < 0) | (F.col("probability_up") > 1)),
            ]
        ),
    )


def split_signals(generated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(eligible signals, skipped symbols with reasons)."""
    eligible = generated.filter(F.size("skip_reasons") == 0).drop("skip_reasons")
    skipped = generated.filter(F.size("skip_reasons") > 0).select("symbol", "skip_reasons")
    return eligible, skipped


def integrity_checks() -> list:
    """The checks of one signal; needs the calendar's ``expected_session``, ``session_open``, ``session_close``."""
    p = F.col("probability_up")
    return [
        ("generated_after_target_open", F.col("generated_at") >= F.col("session_open")),
        ("target_is_not_next_session", ~F.col("expected_session").eqNullSafe(F.col("target_session"))),
        (
            "target_bounds_disagree_with_calendar",
            ~(F.col("target_open").eqNullSafe(F.col("session_open")) & F.col("target_close").eqNullSafe(F.col("session_close"))),
        ),
        ("invalid_cost", ~finite(F.col("cost_bps")) | (F.col("cost_bps") < 0)),
        ("obsolete_contract", ~F.col("feature_contract_version").eqNullSafe(F.lit(CONTRACT_VERSION))),
        ("invalid_probability", ~finite(p) | (p < 0) | (p > 1)),
        ("direction_disagrees_with_thresholds", F.col("direction") != signal(p)),
        ("payload_hash_mismatch", F.sha2("feature_payload_json", 256) != F.col("feature_hash")),
        ("training_exceeds_feature_cutoff", F.col("model_trained_through") > F.col("feature_as_of")),
    ]


def with_calendar(signals: DataFrame, sessions: DataFrame) -> DataFrame:
    """Adds what the calendar says about each signal's feature day and target."""
    expected = next_session(signals, sessions, "feature_as_of").withColumnRenamed("next_session", "expected_session")
    bounded = session_bounds(expected, sessions, "target_session")
    return bounded.withColumnsRenamed({"open_at": "session_open", "close_at": "session_close"}).drop("is_session")


def integrity_reasons(signals: DataFrame, sessions: DataFrame) -> DataFrame:
    return with_calendar(signals, sessions).withColumn("integrity_reasons", reason_array(integrity_checks()))


def append(journal: DataFrame, signals: DataFrame, sessions: DataFrame, check: bool = True) -> DataFrame:
    """Signals to add: the whole batch fails on a bad signal; one per (model, symbol, target) ever."""
    if check:
        require_zero(with_calendar(signals, sessions), dict(integrity_checks()))
    # many identical submissions collapse before the shuffle; ties go to the first id
    first = signals.groupBy(*TARGET_KEY).agg(F.min(F.struct("signal_id", *_others(signals))).alias("_s"))
    fresh = first.join(journal.select(*TARGET_KEY), TARGET_KEY, "left_anti")
    return fresh.select(*TARGET_KEY, "_s.*").select(*signals.columns)


def _others(signals: DataFrame) -> list[str]:
    return [c for c in signals.columns if c not in TARGET_KEY and c != "signal_id"]


def settle(journal: DataFrame, bars: DataFrame, now: Column, day: str = "d") -> DataFrame:
    """The journal with due signals evaluated; a missing or invalid target bar leaves them pending.

    Only the exact target session settles a signal, at the earliest 30 minutes after
    its close.
    """
    payload = F.to_json(F.struct(F.col("close"), F.col("high"), F.col("low"), F.col("open"), F.col(day).alias("session")))
    bar = bars.filter(valid_bar()).select(
        "symbol", F.col(day).alias("target_session"),
        (F.col("close") / F.col("open") - 1).alias("_return"), payload.alias("_payload"),
    )
    joined = journal.join(bar, ["symbol", "target_session"], "left")
    due = (F.col("status") == PENDING) & (minutes(F.col("target_close"), SETTLE_MINUTES) <= now) & F.col("_return").isNotNull()
    hit = F.coalesce(due, F.lit(False))
    strategy = F.col("direction") * F.col("_return") - F.when(F.col("direction") != 0, F.col("cost_bps") / 10000).otherwise(0.0)
    values = {
        "status": F.when(hit, EVALUATED).otherwise(F.col("status")),
        "realized_return": F.when(hit, F.col("_return")).otherwise(_old(journal, "realized_return", "double")),
        "strategy_return": F.when(hit, strategy).otherwise(_old(journal, "strategy_return", "double")),
        "evaluated_at": F.when(hit, now).otherwise(_old(journal, "evaluated_at", "timestamp")),
        "settlement_bar_json": F.when(hit, F.col("_payload")).otherwise(_old(journal, "settlement_bar_json", "string")),
        "settlement_bar_hash": F.when(hit, F.sha2("_payload", 256)).otherwise(_old(journal, "settlement_bar_hash", "string")),
    }
    return joined.withColumns(values).drop("_return", "_payload")


def _old(df: DataFrame, name: str, kind: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


def require_settleable(journal: DataFrame) -> DataFrame:
    """Pending signals must declare their session and precede its open."""
    pending = F.col("status") == PENDING
    return require_zero(
        journal,
        {
            "pending signal lacks session bounds": pending
            & (F.col("target_session").isNull() | F.col("target_open").isNull() | F.col("target_close").isNull()),
            "pending signal generated after target open": F.coalesce(
                pending & (F.col("generated_at") >= F.col("target_open")), F.lit(False)
            ),
        },
    )


def invalidate_legacy(journal: DataFrame) -> DataFrame:
    """Signals without a feature contract keep their old status beside the new one."""
    legacy = F.col("feature_contract_version").isNull() & (F.col("status") != INVALIDATED)
    return journal.withColumns(
        {
            "legacy_status": F.when(legacy, F.col("status")).otherwise(_old(journal, "legacy_status", "string")),
            "status": F.when(legacy, INVALIDATED).otherwise(F.col("status")),
        }
    )


def pending_symbols(journal: DataFrame) -> DataFrame:
    return journal.filter(F.col("status") == PENDING).select("symbol").distinct()


def status_counts(journal: DataFrame) -> DataFrame:
    return journal.groupBy("status").agg(F.count(F.lit(1)).alias("signals"))


def cohorts(journal: DataFrame) -> DataFrame:
    """Evaluated signals per model version and cost; different versions are never combined."""
    done = journal.filter(F.col("status") == EVALUATED)
    outcome = (F.col("realized_return") > 0).cast("int")
    error = F.col("probability_up") - outcome
    return done.groupBy("model_hash", "cost_bps").agg(
        F.count(F.lit(1)).alias("observations"), F.count_distinct("target_session").alias("target_sessions"),
        F.avg(error * error).alias("brier_score"), F.avg("strategy_return").alias("mean_hypothetical_signal_return"),
    )


def recent(journal: DataFrame, limit: int = RECENT) -> DataFrame:
    """The latest signals of the report: a top-k, so no global sort."""
    label = F.when(F.col("direction") == 1, "LONG").when(F.col("direction") == -1, "SHORT").otherwise("FLAT")
    return journal.withColumn("direction_label", label).orderBy(F.desc("generated_at"), "symbol").limit(limit)

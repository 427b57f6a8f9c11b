"""Registered queries: gates on inputs with planted violations, archives with altered rows, audit rows, group summaries.

A gate query counts each violation before the gate and in what it lets through; the clean rows pass the raising gate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.reasons import failed, violation_counts
from ..operators import admission as adm
from ..operators import evidence as ev
from ..operators import features as feat
from ..operators import identity as idn
from ..operators import ledger as lg
from ..operators import metrics as met
from ..operators import regime as reg
from ..operators import timing
from ..operators import walkforward as wf
from ..operators import warehouse as wh
from . import oracle_features as O
from . import oracle_market as M
from . import oracle_views as V
from . import views
from .feature_queries import _NOT_NULL, _SCHEDULE, _TIMING
from .ledger_queries import _FEES, _MARKS, _marks, _positions
from .metric_queries import _AUC, _LONGFLAT, _SIGNAL, _STRATEGY, portfolio_ctes, r6, text
from .pit_queries import _ID_T, _IDENTITY, _RESOLVE, _digest_sql, at
from .registry import query


def _gate(rows: DataFrame, checks: dict, passes) -> DataFrame:
    """(stage, violation, rows): counts before the gate and of the rows it lets through."""
    rows = views.stored(rows)
    clean = rows
    for bad in checks.values():
        clean = clean.filter(~failed(bad))
    passes(clean)
    counts = [violation_counts(df, checks).select(F.lit(stage).alias("stage"), "*") for stage, df in (("before", rows), ("after", clean))]
    both = counts[0].unionByName(counts[1])
    return both.unpivot("stage", list(checks), "violation", "rows")


def _gate_sql(source: str, checks: dict[str, str]) -> str:
    """The same counts; after the gate every one is zero."""
    before = " UNION ALL ".join(f"SELECT 'before' AS stage, '{name}' AS violation, count(*) FILTER ({bad}) AS rows FROM {source}" for name, bad in checks.items())
    after = " UNION ALL ".join(f"SELECT 'after', '{name}', 0" for name in checks)
    return f"{before} UNION ALL {after}"


_ATTACHED = V.with_views(V.BARS, V.SESSIONS, _SCHEDULE, _TIMING.replace("dated", "scheduled"), O.regime_table(), O.regime_attach("paired", "decision_at"),
                         f"known AS (SELECT *, dayofyear(target_session) AS k, target_return>0 AS up FROM attached WHERE {_NOT_NULL})")


@query(
    "H28",
    _ATTACHED
    + _gate_sql("known", {"nonfinite value": "k%70=0", "label": "k%100=0 AND k%70<>0 OR (k%70=0 AND (CASE WHEN k%100=0 THEN NOT up ELSE up END)<>up)", "contract": "k%90=0", "chronology": "k%80=0"}),
)
def dataset_gate(spark, sf):
    """A research dataset with infinite features, flipped labels, another contract and exits before entries."""
    bars = views.stored(views.bars(spark, sf))
    data = timing.timing_dataset(bars, views.stored(views.sessions(spark, sf)), reg.regime_table(bars))
    k = F.dayofyear("target_session")
    rows = data.withColumns(
        {
            "rsi_14": F.when(k % 70 == 0, float("inf")).otherwise(F.col("rsi_14")),
            "target": F.when(k % 100 == 0, 1 - F.col("target")).otherwise(F.col("target")),
            "target_contract_version": F.when(k % 90 == 0, "other").otherwise(F.col("target_contract_version")),
            "exit_at": F.when(k % 80 == 0, F.col("entry_at")).otherwise(F.col("exit_at")),
        }
    )
    features = feat.FEATURE_COLUMNS + reg.REGIME_COLUMNS
    symbols = [r.symbol for r in data.select("symbol").distinct().collect()]  # the declared universe
    return _gate(rows, wf.dataset_checks(features), lambda clean: wf.validate_dataset(clean, symbols, features))


_K = "(SELECT *, dayofyear(d) AS k FROM bars)"


@query("F12", V.with_views(V.BARS) + _gate_sql(f"{_K} WHERE symbol IN ('SPY','QQQ','IWM','^VIX','^TNX')".replace(" WHERE", " AS b WHERE"), {"missing_day": "k%91=0", "invalid_close": "k%60=0"}).replace(" FILTER (k", " FILTER (b.k"))
def context_gate(spark, sf):
    """Market context with missing days and closes that are no prices."""
    k = F.dayofyear("d")
    rows = views.bars(spark, sf).filter(F.col("symbol").isin(*reg.CONTEXT_SYMBOLS)).withColumns(
        {"close": F.when(k % 60 == 0, F.when(k % 120 == 0, float("nan")).otherwise(-1.0)).otherwise(F.col("close")), "d": F.when(k % 91 != 0, F.col("d"))}
    )
    return _gate(rows, reg.context_checks(), reg.validate_context)


@query(
    "E11 B4",
    V.with_views(V.BARS)
    + _gate_sql(_K, {"missing_day": "k%91=0", "nonfinite": "k%50=0", "nonpositive_price": "k%60=0 AND k%50<>0", "negative_volume": "k%70=0", "ohlc_bounds": "k%60=0 AND k%50<>0"}),
)
def daily_bar_gate(spark, sf):
    """Daily bars with missing days, infinite highs, negative lows and volumes."""
    k = F.dayofyear("d")
    bars = views.bars(spark, sf).withColumns(
        {
            "close": F.when((k % 60 == 0) & (k % 50 != 0), -1.0).otherwise(F.col("close")),
            "high": F.when(k % 50 == 0, float("inf")).otherwise(F.col("high")),
            "volume": F.when(k % 70 == 0, -1.0).otherwise(F.col("volume")), "d": F.when(k % 91 != 0, F.col("d")),
        }
    )
    return _gate(bars, feat.daily_bar_checks(), feat.validate_daily_bars)


_RESOLVED = V.with_views(V.IDENTITIES, _IDENTITY, _RESOLVE.format(src="effective"), "own AS (SELECT *, substr(instrument_id, 5)::INTEGER AS k FROM resolved)")


@query("C17", _RESOLVED + "SELECT instrument_id FROM own WHERE k%11=0 OR k%13=0 OR (k%17=0 AND status IN ('SINGLE_ASSERTION','EQUIVALENT_ASSERTIONS'))")
def identity_recheck(spark, sf):
    """An archived resolution with altered counts, lost rows and another symbol against one rebuilt from the assertions."""
    ids = views.identities(spark, sf)
    rebuilt = views.stored(idn.resolve(ev.identity_section(ids, at(_ID_T)), ids))
    k = F.expr("CAST(substr(instrument_id, 5) AS INT)")
    other = F.when(F.col("resolved").isNotNull() & (k % 17 == 0), F.col("resolved").withField("symbol", F.lit("?"))).otherwise(F.col("resolved"))
    archived = rebuilt.filter(k % 13 != 0).withColumns(
        {"assertion_count": F.when(k % 11 == 0, F.col("assertion_count") + 1).otherwise(F.col("assertion_count")), "resolved": other}
    )
    return idn.resolution_mismatches(archived, rebuilt)


@query(
    "C24 C15",
    V.with_views(
        V.IDENTITIES, _IDENTITY,
        "held AS (SELECT * FROM effective QUALIFY row_number() OVER (PARTITION BY instrument_id ORDER BY valid_from DESC, source, available_at DESC, ingested_at DESC)<=1)",
        _RESOLVE.format(src="held"), "cut AS (SELECT instrument_id FROM effective GROUP BY 1 HAVING count(*)>1)",
    )
    + "SELECT instrument_id, CASE WHEN instrument_id IN (FROM cut) THEN 'TRUNCATED' ELSE status END AS status, CAST(assertion_count AS BIGINT) AS assertion_count FROM resolved",
)
def identity_truncation(spark, sf):
    """Resolution under a limit of one assertion: where the sentinel row shows that more exist, nothing is resolved."""
    ids = views.identities(spark, sf)
    section = ev.limited(ev.identity_section(ids, at(_ID_T)), "identity", 1)
    return idn.resolve(section.filter("row <= 1"), ids, section.filter("row > 1")).select("instrument_id", "status", "assertion_count")


@query(
    "B11",
    V.with_views(V.NEWS)
    + "SELECT 'run-1' AS run_id, 'news' AS source, '{\"kind\":\"news\"}' AS request_json, rows AS record_count, digest AS content_hash, 'complete' AS status FROM ("
    + _digest_sql("SELECT 1 AS g, sha256(event_id||title_hash) AS h FROM news", "g") + ")",
)
def ingestion_runs(spark, sf):
    """The audit row of a news batch: request, count and a content hash that ignores the order of rows."""
    row_hash = F.sha2(F.concat("event_id", "title_hash"), 256)
    return wh.ingestion_run(views.news(spark, sf), "run-1", "news", '{"kind":"news"}', row_hash).drop("completed_at")


_MODELS = """models AS (SELECT *, 'shown' AS model FROM predictions UNION ALL SELECT * REPLACE (1-probability AS probability), 'turned' FROM predictions),
grouped AS (SELECT *, CASE WHEN symbol LIKE '%-USD' THEN 'crypto' ELSE 'equity' END AS grp, (CASE WHEN symbol LIKE '%-USD' THEN 'crypto' ELSE 'equity' END)||'@'||model AS gm FROM models)"""


@query(
    "H30",
    V.with_views(
        V.PREDICTIONS, _MODELS, _AUC.format(by="gm", src="grouped", out="auc"), _LONGFLAT.format(src="grouped"),
        "five AS (SELECT * FROM lf WHERE cost_bps=5)", portfolio_ctes("five", "gm"), "span AS (SELECT gm, min(d) AS lo, max(d) AS hi FROM grouped GROUP BY gm)",
    )
    + """SELECT split_part(gm,'@',1) AS grp, split_part(gm,'@',2) AS model, CAST(lo AS VARCHAR) AS oos_start, CAST(hi AS VARCHAR) AS oos_end, 5.0::DOUBLE AS selected_round_trip_cost_bps,
  round(roc_auc,6) AS roc_auc, days, round(net_return_pct,6) AS net_return_pct, round(annualized_sharpe,6) AS annualized_sharpe, round(max_drawdown_pct,6) AS max_drawdown_pct
  FROM m JOIN auc USING (gm) JOIN span USING (gm)""",
)
def group_report_summary(spark, sf):
    """The selected-cost metrics of two models per asset group."""
    shown = views.predictions(spark, sf).withColumn("model", F.lit("shown"))
    both = shown.unionByName(shown.withColumns({"probability": 1 - F.col("probability"), "model": F.lit("turned")}))
    rows = views.stored(both.withColumn("grp", F.when(F.col("symbol").endswith("-USD"), "crypto").otherwise("equity")))
    out = met.group_summary(rows, ["grp"], 5.0)
    return out.select(
        "grp", "model", text("oos_start"), text("oos_end"), "selected_round_trip_cost_bps", *r6("roc_auc"), "days",
        *r6("net_return_pct", "annualized_sharpe", "max_drawdown_pct"),
    )


@query(
    "H25 H1",
    V.with_views(
        V.PREDICTIONS, "dates AS (SELECT d, row_number() OVER (ORDER BY d)-1 AS idx, count(*) OVER () AS n FROM (SELECT DISTINCT d FROM predictions))",
        "tested AS (SELECT p.*, 0 AS g FROM predictions p JOIN dates USING (d) WHERE idx>=floor(n*(1.0::DOUBLE-0.2::DOUBLE)))", _AUC.format(by="g", src="tested", out="auc"),
        _STRATEGY.format(src="tested", sig=_SIGNAL), "five AS (SELECT * FROM strat WHERE cost_bps=5)", portfolio_ctes("five", "g"),
        "one AS (SELECT m.*, roc_auc, (SELECT count(*) FILTER (sig<>0) FROM five) AS active FROM m, auc)",
    )
    + """SELECT (SELECT count(*) FROM tested) AS rows, active AS active_predictions, round(roc_auc,6) AS roc_auc, round(net_return_pct,6) AS net_return_pct, round(annualized_sharpe,6) AS annualized_sharpe,
  round(max_drawdown_pct,6) AS max_drawdown_pct, array_to_string(list_filter([CASE WHEN coalesce(roc_auc<0.53,true) THEN 'ROC AUC is below 0.53' END, CASE WHEN annualized_sharpe<0.75 THEN 'annualized Sharpe is below 0.75' END,
   CASE WHEN max_drawdown_pct<-20 THEN 'maximum drawdown exceeds 20%' END, CASE WHEN net_return_pct<=0 THEN 'net out-of-sample return is not positive' END], lambda x: x IS NOT NULL),'|') AS reasons FROM one""",
)
def one_split_gate(spark, sf):
    """The gate over the last fifth of the sessions."""
    split = wf.chronological_split(views.stored(views.predictions(spark, sf)))
    out = met.evaluate_split(views.stored(split.filter("role = 'test'").drop("role").withColumn("base_probability", F.lit(0.5))), 5.0)
    return out.select("rows", "active_predictions", *r6("roc_auc", "net_return_pct", "annualized_sharpe", "max_drawdown_pct"), F.array_join("rejection_reasons", "|").alias("reasons"))


@query(
    "N8",
    V.with_views(V.BARS, V.FILLS, _FEES, _MARKS)
    + """, pos AS (SELECT symbol, sum(s) AS q, max(multiplier) AS m FROM feed GROUP BY 1),
ord AS (SELECT symbol, sum(quantity) FILTER (side='BUY') AS b, sum(quantity) FILTER (side='SELL') AS s FROM fills WHERE day>=DATE '2001-01-01' GROUP BY 1)
SELECT round(sum(CAST(greatest(abs(q+coalesce(b,0)),abs(q-coalesce(s,0))) AS DOUBLE)*mark*m),0) AS gross_worst_notional, count(*) FILTER (mark IS NULL) AS missing_marks
FROM pos LEFT JOIN ord USING (symbol) LEFT JOIN marks USING (symbol)""",
)
def gross_worst_case(spark, sf):
    """The worst case of all symbols together."""
    pending = views.fills(spark, sf).filter(F.col("day") >= F.lit("2001-01-01").cast("date"))
    exposure = lg.worst_case_exposure(_positions(spark, sf), pending, _marks(spark, sf))
    return lg.gross_exposure(exposure).select(F.round("gross_worst_notional", 0).alias("gross_worst_notional"), "missing_marks")


@query(
    "L3 L2",
    V.with_views(M.EVENTS, M.WINDOWS, "offers AS (SELECT w.* FROM windows w, range(6))")
    + _gate_sql(
        "offers",
        {
            "INTENT_SYMBOL_UNSUPPORTED": "w%31=0", "INTENT_SIDE_INVALID": "w%37=0", "INTENT_NOTIONAL_INVALID": "w%41=0", "INTENT_DECISION_TIME_INVALID": "w%61=0",
            "INTENT_LATENCY_INVALID": "w%47=0", "INTENT_SOURCE_HASH_INVALID": "w%53=0", "INTENT_NOTIONAL_LIMIT_EXCEEDED": "w%43=0 AND w%41<>0", "INTENT_ID_MISMATCH": "w%59=0",
        },
    ),
)
def intent_gate(spark, sf):
    """Intents with a foreign symbol, side, amount, latency, source or id, and without a decision time."""
    w = F.col("w")
    plant = lambda modulus, value, name: F.when(w % modulus == 0, F.lit(value)).otherwise(F.col(name))
    intents = adm.generate_intents(views.quote_windows(spark, sf), ["w"]).withColumns(
        {
            "symbol": plant(31, "ZZZ", "symbol"), "side": plant(37, "HOLD", "side"), "latency_ms": plant(47, 7, "latency_ms"), "source_sha256": plant(53, "short", "source_sha256"),
            "notional_decimal": F.when(w % 41 == 0, "5.123456789").when(w % 43 == 0, "25.01").otherwise(F.col("notional_decimal")),
            "decision_ns": F.when(w % 61 != 0, F.col("decision_ns")),
        }
    )
    forged = intents.withColumn("intent_id", F.when(w % 59 == 0, F.lit("forged")).otherwise(adm.intent_id()))
    return _gate(forged, dict(adm.intent_checks(F.lit(25).cast("decimal(38,8)"))), adm.require_unique_intents)


@query(
    "L4",
    _gate_sql(
        "customer",
        {
            "POLICY_PAPER_ONLY_REQUIRED": "c_custkey%7=0", "POLICY_EXECUTION_MUST_BE_DISABLED": "c_custkey%11=0", "POLICY_NOTIONAL_LIMIT_INVALID": "c_custkey%13=0 OR 1+c_custkey%40>25",
            "POLICY_QUOTE_AGE_LIMIT_INVALID": "c_custkey%1500>1000", "POLICY_EXPECTED_FEED_INVALID": "c_custkey%17=0", "POLICY_SOURCE_HASH_INVALID": "c_custkey%19=0",
        },
    ),
)
def policy_gate(spark, sf):
    """One policy per customer: amounts and ages beyond the hard caps, execution allowed, foreign feeds, broken hashes."""
    k = F.col("c_custkey")
    policy = F.struct(
        F.when(k % 13 == 0, "x").otherwise((1 + k % 40).cast("string")).alias("max_notional_usd"), (k % 7 != 0).alias("paper_only"), (k % 11 == 0).alias("execution_enabled"),
        (k % 1500).cast("int").alias("max_quote_age_ms"), F.when(k % 17 == 0, "otc").otherwise("sip").alias("expected_stock_feed"), F.lit("crypto_us").alias("expected_crypto_feed"),
        F.when(k % 19 == 0, "zz").alias("expected_source_sha256"),
    )
    return _gate(views.table(spark, sf, "customer").select(policy.alias("policy")), dict(adm.policy_checks()), lambda clean: None)

"""Registered queries: forward-signal journal, ledger, exposure, audit chains."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.times import SECOND_NS
from ..operators import journal as jr
from ..operators import ledger as lg
from ..operators.features import CONTRACT_VERSION
from ..operators.metrics import signal
from . import oracle_views as V
from . import views
from .feature_queries import _SCHEDULE
from .registry import query

_NOW = "2000-06-15 21:10:00"
_ORDER = ["day", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
_ORDER_SQL = "day, l_orderkey, l_partkey, l_suppkey, l_linenumber"
# Key ranges cut a day of fills into bins; narrow enough that small data has several.
_KEY_RANGE = 1 << 13
# Wide enough that most bins of large data hold several fills; with narrow ones their totals are as many rows as the fills.
_WIDE_RANGE = 1 << 16


def r(name, digits):
    return F.round(name, digits).alias(name)


def text(name):
    return F.col(name).cast("string").alias(name)


# ---- journal ----------------------------------------------------------------

_SIGNALS = f"""signals AS (SELECT p.symbol, p.d AS feature_as_of, c.next_session AS target_session, c.next_open_at AS target_open, c2.close_at AS target_close,
  p.d::TIMESTAMP + INTERVAL 22 HOUR AS generated_at, probability AS probability_up,
  CASE WHEN probability>=0.55::DOUBLE THEN 1 WHEN probability<=0.45::DOUBLE THEN -1 ELSE 0 END AS direction, CASE WHEN year(p.d)%2=0 THEN 'model-a' ELSE 'model-b' END AS model_hash, 5.0::DOUBLE AS cost_bps
  FROM predictions p JOIN cal c ON p.d=c.session_date JOIN sessions c2 ON c2.session_date=c.next_session WHERE p.symbol NOT LIKE '%-USD')"""
_JOURNAL = V.with_views(V.BARS, V.SESSIONS, _SCHEDULE, V.PREDICTIONS, _SIGNALS)


def _signals(spark, sf):
    """One signal per equity prediction whose day and next day are sessions."""
    from ..operators.sessions import schedule

    cal = views.stored(schedule(views.sessions(spark, sf)))
    at_feature = cal.select(F.col("session_date").alias("feature_as_of"), "next_session", "next_open_at", "next_close_at")
    rows = views.predictions(spark, sf).filter(~F.col("symbol").endswith("-USD")).withColumnRenamed("d", "feature_as_of")
    p = F.col("probability")
    payload = F.to_json(F.struct(p.alias("score")))
    model = F.when(F.year("feature_as_of") % 2 == 0, "model-a").otherwise("model-b")
    return rows.join(at_feature, "feature_as_of").filter(F.col("next_session").isNotNull()).select(
        F.sha2(F.concat_ws("|", model, "symbol", F.col("next_session").cast("string")), 256).alias("signal_id"),
        F.timestamp_add("HOUR", F.lit(22), F.col("feature_as_of").cast("timestamp")).alias("generated_at"), "symbol", "feature_as_of",
        p.alias("probability_up"), signal(p).cast("smallint").alias("direction"), model.alias("model_hash"),
        F.date_sub("feature_as_of", 30).alias("model_trained_through"), F.lit(5.0).alias("cost_bps"), F.lit(jr.PENDING).alias("status"),
        F.col("next_session").alias("target_session"), F.col("next_open_at").alias("target_open"), F.col("next_close_at").alias("target_close"),
        payload.alias("feature_payload_json"), F.sha2(payload, 256).alias("feature_hash"), F.lit(CONTRACT_VERSION).alias("feature_contract_version"),
    )


@query(
    "M2",
    _JOURNAL
    + """SELECT symbol, count(*) AS signals, count(*) FILTER (generated_at>=target_open) AS generated_after_target_open, CAST(0 AS BIGINT) AS other_reasons FROM signals GROUP BY 1""",
)
def signal_integrity(spark, sf):
    tagged = jr.integrity_reasons(_signals(spark, sf), views.sessions(spark, sf))
    late = F.array_contains("integrity_reasons", "generated_after_target_open")
    return tagged.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("signals"), F.count_if(late).alias("generated_after_target_open"),
        F.sum(F.size("integrity_reasons") - late.cast("int")).alias("other_reasons"),
    )


@query(
    "M3",
    _JOURNAL
    + """SELECT model_hash, symbol, count(*) AS appended, CAST(min(target_session) AS VARCHAR) AS first_target FROM signals WHERE target_session > DATE '1998-01-05' GROUP BY 1,2""",
)
def signal_append(spark, sf):
    """The whole history submitted twice against a journal that already holds the early targets."""
    rows = _signals(spark, sf)
    stored = rows.filter(F.col("target_session") <= F.lit("1998-01-05").cast("date"))
    fresh = jr.append(stored, rows.unionByName(rows), views.sessions(spark, sf))
    return fresh.groupBy("model_hash", "symbol").agg(
        F.count(F.lit(1)).alias("appended"), F.min("target_session").cast("string").alias("first_target")
    )


_SETTLED = f""", settled AS (SELECT s.*, b.close/b.open-1 AS r, (target_close + INTERVAL 30 MINUTE <= TIMESTAMP '{_NOW}' AND b.symbol IS NOT NULL) AS hit
  FROM signals s LEFT JOIN bars b ON b.symbol=s.symbol AND b.d=s.target_session),
final AS (SELECT *, CASE WHEN hit THEN 'EVALUATED' ELSE 'PENDING' END AS status, CASE WHEN hit THEN direction*r - CASE WHEN direction<>0 THEN cost_bps/10000 ELSE 0 END END AS strategy FROM settled) """


def _settled(spark, sf):
    return jr.settle(_signals(spark, sf), views.bars(spark, sf), F.lit(_NOW).cast("timestamp"))


@query(
    "M4 M5",
    _JOURNAL + _SETTLED
    + """SELECT model_hash, symbol, CAST(target_session AS VARCHAR) AS target_session, status, round(CASE WHEN hit THEN r END,6) AS realized_return, round(strategy,6) AS strategy_return FROM final""",
)
def signal_settlement(spark, sf):
    return _settled(spark, sf).select(
        "model_hash", "symbol", text("target_session"), "status", r("realized_return", 6), r("strategy_return", 6)
    )


@query("M7", _JOURNAL + _SETTLED + "SELECT status, count(*) AS signals, count(DISTINCT symbol) AS symbols FROM final GROUP BY 1")
def signal_status(spark, sf):
    done = views.stored(_settled(spark, sf).select("status", "symbol"))
    symbols = done.groupBy("status").agg(F.count_distinct("symbol").alias("symbols"))
    return jr.status_counts(done).join(symbols, "status")


@query(
    "M8",
    _JOURNAL + _SETTLED
    + """SELECT model_hash, cost_bps, count(*) AS observations, count(DISTINCT target_session) AS target_sessions,
  round(avg((probability_up-CASE WHEN r>0 THEN 1 ELSE 0 END)*(probability_up-CASE WHEN r>0 THEN 1 ELSE 0 END)),6) AS brier_score, round(avg(strategy),6) AS mean_hypothetical_signal_return
  FROM final WHERE hit GROUP BY 1,2""",
)
def signal_cohorts(spark, sf):
    return jr.cohorts(_settled(spark, sf)).select(
        "model_hash", "cost_bps", "observations", "target_sessions", r("brier_score", 6), r("mean_hypothetical_signal_return", 6)
    )


@query(
    "M9",
    _JOURNAL
    + """SELECT symbol, CAST(target_session AS VARCHAR) AS target_session, probability_up, CASE direction WHEN 1 THEN 'LONG' WHEN -1 THEN 'SHORT' ELSE 'FLAT' END AS direction_label
  FROM signals ORDER BY generated_at DESC, symbol LIMIT 30""",
)
def recent_signals(spark, sf):
    return jr.recent(_signals(spark, sf)).select("symbol", text("target_session"), "probability_up", "direction_label")


@query(
    "M6",
    _JOURNAL
    + """SELECT CASE WHEN year(feature_as_of)<1997 THEN 'INVALIDATED_LEGACY' ELSE 'PENDING' END AS status, CASE WHEN year(feature_as_of)<1997 THEN 'PENDING' END AS legacy_status, count(*) AS signals FROM signals GROUP BY 1,2""",
)
def legacy_signals(spark, sf):
    old = F.year("feature_as_of") < 1997
    rows = _signals(spark, sf).withColumn("feature_contract_version", F.when(~old, F.col("feature_contract_version")))
    return jr.invalidate_legacy(rows).groupBy("status", "legacy_status").agg(F.count(F.lit(1)).alias("signals"))


@query(
    "M1 M10",
    V.with_views(V.BARS, V.SESSIONS, _SCHEDULE)
    + """, last AS (SELECT symbol, max(d) AS d FROM bars GROUP BY 1)
SELECT l.symbol, CAST(l.d AS VARCHAR) AS feature_as_of, CAST(CASE WHEN symbol LIKE '%-USD' THEN l.d+1 ELSE c.next_session END AS VARCHAR) AS target_session,
  CASE WHEN symbol LIKE '%-USD' THEN 'crypto_requires_delayed_entry_target' WHEN c.next_session IS NULL THEN 'no_next_session' ELSE '' END AS first_reason FROM last l LEFT JOIN cal c ON c.session_date=l.d""",
)
def generated_signals(spark, sf):
    """Forward signals for the latest features of every symbol, with the reason when one is skipped."""
    from ..operators.features import FEATURE_COLUMNS, latest_snapshot

    bars, cal = views.stored(views.bars(spark, sf)), views.sessions(spark, sf)
    scored = latest_snapshot(bars).withColumn("probability", F.col("rsi_14") / 100)
    model = {"model_hash": "model-a", "trained_through": "1999-12-31", "approved": False}
    out = jr.generate(scored, cal, FEATURE_COLUMNS, F.lit("1990-01-01").cast("timestamp"), model, 5.0)
    reason = F.coalesce(F.get("skip_reasons", F.lit(0)), F.lit(""))
    return out.select("symbol", text("feature_as_of"), text("target_session"), reason.alias("first_reason"))


@query("M1 H7", None)
def model_scored_signals(spark, sf):
    """Latest features scored by a logistic model fitted on the whole dataset."""
    from ..operators import models
    from ..operators.features import FEATURE_COLUMNS, daily_dataset, latest_snapshot

    bars, cal = views.stored(views.bars(spark, sf)), views.sessions(spark, sf)
    model = models.final_model(views.stored(daily_dataset(bars)), FEATURE_COLUMNS, "logistic")
    scored = models.score(model, latest_snapshot(bars).filter("complete"))
    info = {"model_hash": "logistic-final", "trained_through": "1999-12-31", "approved": False}
    out = jr.generate(scored, cal, FEATURE_COLUMNS, F.lit("1990-01-01").cast("timestamp"), info, 5.0)
    return out.select("symbol", text("feature_as_of"), F.round("probability_up", 4).alias("probability_up"), "direction")


# ---- quotes -----------------------------------------------------------------


@query(
    "N1 N2",
    V.with_views(V.QUOTES)
    + """SELECT symbol, event_id, round(imb,6) AS imbalance, round(mom,6) AS momentum, round(imb+0.01::DOUBLE*mom*10000,6) AS score, abs(imb+0.01::DOUBLE*mom*10000)>=0.5 AS active FROM (
  SELECT symbol, event_id, (bid_size-ask_size)/(bid_size+ask_size) AS imb, CASE WHEN prev IS NULL OR prev=0 THEN 0.0 ELSE (mid-prev)/prev END AS mom FROM (
  SELECT *, lag(mid) OVER (PARTITION BY symbol ORDER BY event_ns, event_id) AS prev FROM (SELECT *, bid+(ask-bid)/2 AS mid FROM quotes)))""",
)
def quote_scores(spark, sf):
    out = lg.quote_scores(views.quotes(spark, sf), 0.01, 0.5, tie=["event_id"])
    return out.select("symbol", "event_id", r("imbalance", 6), r("momentum", 6), r("score", 6), "active")


@query(
    "N7",
    """WITH o AS (SELECT event_id, event_type, epoch_us(ts)*1000 AS ts_ns FROM events)
SELECT event_id, count(*) OVER w AS orders_in_window, count(*) OVER w > 3 AS breach FROM o WINDOW w AS (PARTITION BY event_type ORDER BY ts_ns RANGE BETWEEN 3599999999999 PRECEDING AND CURRENT ROW)""",
)
def order_rate(spark, sf):
    events = views.table(spark, sf, "events")
    orders = events.select("event_id", "event_type", (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("ts_ns"))
    out = lg.order_rate(orders, 3, ["event_type"], window_ns=3600 * SECOND_NS)
    return out.select("event_id", "orders_in_window", "breach")


# ---- fills ------------------------------------------------------------------


def _fills(spark, sf, width=_KEY_RANGE):
    fills = views.fills(spark, sf)
    fee = lg.commission(F.when(F.col("symbol") == "BTC-USD", "crypto").otherwise("equity"), F.col("quantity"), F.col("price"))
    return fills.withColumns(
        {"commission": F.round(fee, 6).cast("decimal(18,8)"), "bin": F.expr(f"l_orderkey div {width}")}
    )


_FEES = """feed AS (SELECT *, round(CASE WHEN symbol='BTC-USD' THEN quantity::DOUBLE*price::DOUBLE*0.0015::DOUBLE ELSE greatest(quantity::DOUBLE*0.0035::DOUBLE,0.35::DOUBLE) END,6)::DECIMAL(18,8) AS commission,
  CASE WHEN side='BUY' THEN quantity ELSE -quantity END AS s FROM fills)"""


@query(
    "N9",
    V.with_views(V.FILLS, _FEES)
    + "SELECT symbol, count(*) AS fills, round(CAST(sum(commission) AS DOUBLE),4) AS fees, CAST(min(commission) AS DOUBLE) AS smallest, CAST(max(commission) AS DOUBLE) AS largest FROM feed GROUP BY 1",
)
def commissions(spark, sf):
    return _fills(spark, sf).groupBy("symbol").agg(
        F.count(F.lit(1)).alias("fills"), F.round(F.sum("commission").cast("double"), 4).alias("fees"),
        F.min("commission").cast("double").alias("smallest"), F.max("commission").cast("double").alias("largest"),
    )


@query(
    "N3",
    V.with_views(V.FILLS, _FEES)
    + f"""SELECT symbol, CAST(day AS VARCHAR) AS day, l_orderkey, l_partkey, l_suppkey, l_linenumber, CAST(sum(s) OVER w AS DOUBLE) AS position,
  CAST(sum(-round(s::DOUBLE*price::DOUBLE*multiplier,2)::DECIMAL(28,8) - commission) OVER w AS VARCHAR) AS cash, CAST(sum(commission) OVER w AS VARCHAR) AS fees_paid
  FROM feed WINDOW w AS (PARTITION BY symbol ORDER BY {_ORDER_SQL} ROWS UNBOUNDED PRECEDING)""",
)
def position_ledger(spark, sf):
    out = lg.running_positions(_fills(spark, sf), ["day", "bin"], _ORDER)
    return out.select(
        "symbol", text("day"), *_ORDER[1:], F.col("position").cast("double").alias("position"),
        text("cash"), text("fees_paid"),
    )


def _money(value: str, digits: int = 24) -> str:
    """SQL text of a whole number of 10^-digits as decimal text with eight places, halves away from zero."""
    unit = 10 ** (digits - 8)
    return f"CAST(CAST((sign({value})*((abs({value})+{unit // 2})//{unit}))::DECIMAL(28,0)*0.00000001::DECIMAL(9,8) AS DECIMAL(28,8)) AS VARCHAR)"


# Fill by fill in whole numbers: prices and profits in units of 10^-24, quantities as they are (whole in these tables).
# The fold keeps the state before each new day.
_UNITS = 10**24
_ADDS = "acc.q=0 OR (acc.q>0)=(x.q>0)"
_FILL_STEP = f"""lambda acc, x: {{'q': acc.q+x.q,
  'p': CASE WHEN {_ADDS} THEN (abs(acc.q)*acc.p+abs(x.q)*x.p)//(abs(acc.q)+abs(x.q)) WHEN acc.q+x.q=0 THEN 0::HUGEINT WHEN (acc.q>0)<>(acc.q+x.q>0) THEN x.p ELSE acc.p END,
  'r': acc.r + CASE WHEN {_ADDS} THEN 0::HUGEINT ELSE (x.p-acc.p)*least(abs(acc.q),abs(x.q))*sign(acc.q)::HUGEINT*x.m END, 'm': x.m, 'n': acc.n+1, 'd': x.d,
  'o': CASE WHEN x.d IS DISTINCT FROM acc.d THEN list_append(acc.o, {{'q': acc.q, 'p': acc.p, 'r': acc.r, 'n': acc.n, 'd': acc.d}}) ELSE acc.o END}}"""
_STATES = f"""lists AS (SELECT symbol, list({{'q': s::HUGEINT, 'p': (price*100)::HUGEINT*{_UNITS // 100}::HUGEINT, 'r': 0::HUGEINT, 'm': multiplier::HUGEINT, 'n': 0::BIGINT, 'd': day,
    'o': [{{'q': 0::HUGEINT, 'p': 0::HUGEINT, 'r': 0::HUGEINT, 'n': 0::BIGINT, 'd': day}}]}} ORDER BY {_ORDER_SQL}) AS l FROM feed GROUP BY symbol),
folded AS (SELECT symbol, list_reduce(l, {_FILL_STEP}, {{'q': 0::HUGEINT, 'p': 0::HUGEINT, 'r': 0::HUGEINT, 'm': 0::HUGEINT, 'n': 0::BIGINT, 'd': NULL::DATE, 'o': l[1].o[:0]}}) AS f FROM lists),
opened AS (SELECT symbol, unnest(list_append(f.o, {{'q': f.q, 'p': f.p, 'r': f.r, 'n': f.n, 'd': f.d}}), recursive := true) FROM folded),
states AS (SELECT *, r-lag(r) OVER w AS gained, n-lag(n) OVER w AS fills FROM opened WINDOW w AS (PARTITION BY symbol ORDER BY d NULLS FIRST))"""


@query(
    "N4",
    V.with_views(V.FILLS, _FEES, _STATES)
    + f"""SELECT symbol, CAST(d AS VARCHAR) AS day, fills, CAST(q AS VARCHAR) AS quantity, {_money('p')} AS average_price,
  {_money('gained')} AS realized_day, {_money('r')} AS realized_pnl FROM states WHERE d IS NOT NULL""",
)
def average_cost_pnl(spark, sf):
    """Daily average-cost states against a fill-by-fill fold in whole numbers; quantities are whole in these tables."""
    out = lg.average_cost(_fills(spark, sf), "day", "bin", _ORDER)
    money = [F.col(c).cast("decimal(28,8)").cast("string").alias(c) for c in ("average_price", "realized_day", "realized_pnl")]
    return out.select("symbol", text("day"), "fills", F.col("quantity").cast("decimal(28,0)").cast("string").alias("quantity"), *money)


_FOLD = f"""seqd AS (SELECT symbol, list({{'s': s::DOUBLE, 'p': price::DOUBLE, 'm': multiplier::DOUBLE}} ORDER BY {_ORDER_SQL}) AS l FROM feed GROUP BY 1),
fold AS (SELECT symbol, len(l) AS fills, list_reduce(l, lambda acc, x: {{'s': acc.s + x.s,
  'p': CASE WHEN acc.s=0 OR acc.s*x.s>0 THEN (abs(acc.s)*acc.p+abs(x.s)*x.p)/(abs(acc.s)+abs(x.s)) WHEN acc.s+x.s=0 THEN 0 WHEN acc.s*(acc.s+x.s)<0 THEN x.p ELSE acc.p END,
  'm': acc.m + CASE WHEN acc.s=0 OR acc.s*x.s>0 THEN 0 ELSE (x.p-acc.p)*least(abs(acc.s),abs(x.s))*sign(acc.s)*x.m END}},
  {{'s': 0.0::DOUBLE, 'p': 0.0::DOUBLE, 'm': 0.0::DOUBLE}}) AS f FROM seqd)"""


@query(
    "N4",
    V.with_views(V.FILLS, _FEES, _FOLD)
    + "SELECT symbol, fills, f.s AS quantity, round(f.p,3) AS average_price, round(f.m,0) AS realized_pnl FROM fold",
)
def closing_average_cost(spark, sf):
    """Final average-cost position and realised profit, checked against a fill-by-fill fold."""
    daily = lg.average_cost(_fills(spark, sf, _WIDE_RANGE), "day", "bin", _ORDER)
    fills = daily.groupBy("symbol").agg(F.sum("fills").alias("fills"))
    closing = lg.closing_positions(views.stored(daily), "day").join(fills, "symbol")
    return closing.select(
        "symbol", "fills", *[F.col(c).cast("double").alias(c) for c in ("quantity", "average_price", "realized_pnl")]
    ).select("symbol", "fills", "quantity", r("average_price", 3), r("realized_pnl", 0)
    )


_MARKS = "marks AS (SELECT symbol, arg_max(close, d) AS mark FROM bars GROUP BY 1)"


def _positions(spark, sf):
    fills = _fills(spark, sf)
    s = lg.signed()
    return fills.groupBy("symbol").agg(
        F.sum(s).alias("quantity"), F.max("multiplier").alias("multiplier"),
        F.sum(-(s * F.col("price")).cast("decimal(30,8)") * F.col("multiplier").cast("decimal(6,0)") - F.col("commission")).alias("cash"),
        F.sum("commission").alias("fees_paid"),
    )


def _marks(spark, sf):
    return views.bars(spark, sf).groupBy("symbol").agg(F.max_by("close", "d").alias("mark"))


_WORTH = "(q::DECIMAL(19,8)*round(mark,8)::DECIMAL(18,8))::DECIMAL(30,16)*m::DECIMAL(6,0)"


@query(
    "N5",
    V.with_views(V.BARS, V.FILLS, _FEES, _MARKS)
    + f""", pos AS (SELECT symbol, sum(s) AS q, max(multiplier) AS m, sum(-(s::DECIMAL(19,8)*price)::DECIMAL(30,8)*multiplier::DECIMAL(6,0)-commission) AS cash, sum(commission) AS fees FROM feed GROUP BY 1)
SELECT CAST((1000000+sum(cash::DECIMAL(27,8))+coalesce(sum(({_WORTH})::DECIMAL(34,16)) FILTER (q<>0),0))::DECIMAL(28,8) AS VARCHAR) AS equity,
  CAST(coalesce(sum(abs(({_WORTH})::DECIMAL(34,16))) FILTER (q<>0),0)::DECIMAL(28,8) AS VARCHAR) AS gross_notional,
  CAST(sum(fees)::DECIMAL(28,8) AS VARCHAR) AS fees_paid, count(*) FILTER (q<>0 AND mark IS NULL) AS missing_marks FROM pos LEFT JOIN marks USING (symbol)""",
)
def mark_to_market(spark, sf):
    out = lg.mark_to_market(_positions(spark, sf), _marks(spark, sf), 1_000_000)
    money = [F.col(c).cast("decimal(28,8)").cast("string").alias(c) for c in ("equity", "gross_notional", "fees_paid")]
    return out.select(*money, "missing_marks")


@query(
    "N8",
    V.with_views(V.BARS, V.FILLS, _FEES, _MARKS)
    + """, pos AS (SELECT symbol, sum(s) AS q, max(multiplier) AS m FROM feed GROUP BY 1),
ord AS (SELECT symbol, sum(quantity) FILTER (side='BUY') AS b, sum(quantity) FILTER (side='SELL') AS s FROM fills WHERE day>=DATE '2001-01-01' GROUP BY 1)
SELECT symbol, CAST(greatest(abs(q+coalesce(b,0)),abs(q-coalesce(s,0))) AS DOUBLE) AS worst_quantity,
  round(CAST(greatest(abs(q+coalesce(b,0)),abs(q-coalesce(s,0))) AS DOUBLE)*mark*m,0) AS worst_notional, mark IS NULL AS missing_mark FROM pos LEFT JOIN ord USING (symbol) LEFT JOIN marks USING (symbol)""",
)
def worst_case_exposure(spark, sf):
    pending = views.fills(spark, sf).filter(F.col("day") >= F.lit("2001-01-01").cast("date"))
    out = lg.worst_case_exposure(_positions(spark, sf), pending, _marks(spark, sf))
    return out.select("symbol", "worst_quantity", r("worst_notional", 0), "missing_mark")


@query(
    "N6",
    V.with_views(V.PREDICTIONS)
    + """, c AS (SELECT d, 100000.0::DOUBLE + sum(sum(round(target_return*1000,4)::DECIMAL(18,4))) OVER (ORDER BY d)::DOUBLE AS equity FROM predictions GROUP BY d),
p AS (SELECT *, greatest(max(equity) OVER (ORDER BY d), 100000.0::DOUBLE) AS peak FROM c)
SELECT round(arg_max(equity,d),4) AS ending_equity, round(arg_max(equity,d)-100000,4) AS net_pnl, round((arg_max(equity,d)-100000)/100000*100,6) AS return_pct,
  round(greatest(max((peak-equity)/peak),0)*100,6) AS max_drawdown_pct FROM p""",
)
def equity_report(spark, sf):
    from pyspark.sql import Window as W

    daily = views.predictions(spark, sf).groupBy("d").agg(
        F.sum(F.round(F.col("target_return") * 1000, 4).cast("decimal(18,4)")).alias("gain")
    )
    run = W.partitionBy(F.lit(0)).orderBy("d").rowsBetween(W.unboundedPreceding, W.currentRow)  # one row a day
    curve = daily.select("d", (F.lit(100000.0) + F.sum("gain").over(run).cast("double")).alias("equity"))
    out = lg.equity_report(curve, 100000.0)
    return out.select(r("ending_equity", 4), r("net_pnl", 4), r("return_pct", 6), r("max_drawdown_pct", 6))


# ---- audit ------------------------------------------------------------------


def _audit_lines(spark, sf):
    """A log per event with three linked lines; the second line of some logs was altered later."""
    events = views.table(spark, sf, "events")
    ts = F.unix_micros(F.col("ts").cast("timestamp")) * 1000
    zero = F.lit("0" * 64)

    def line(number, name, previous):
        payload = F.struct(
            F.col("props").alias("data"), F.lit(name).alias("event"), previous.alias("previous_hash"), (ts + number).alias("ts_ns")
        )
        return payload, F.sha2(F.to_json(payload, {"ignoreNullFields": "false"}), 256)

    p1, h1 = line(1, "created", zero)
    step = events.withColumns({"p1": p1, "h1": h1})
    p2, h2 = line(2, "checked", F.col("h1"))
    step = step.withColumns({"p2": p2, "h2": h2})
    p3, h3 = line(3, "closed", F.col("h2"))
    step = step.withColumns({"p3": p3, "h3": h3})
    rows = F.array(*[F.struct(F.lit(n).alias("line_number"), F.col(f"p{n}").alias("p"), F.col(f"h{n}").alias("hash")) for n in (1, 2, 3)])
    flat = step.select("event_id", "event_type", F.inline(rows))
    altered = (F.col("event_id") % 37 == 0) & (F.col("line_number") == 2)
    return flat.select(
        "event_id", "event_type", "line_number", F.when(altered, '{"k": -1}').otherwise(F.col("p.data")).alias("data"),
        F.col("p.event").alias("event"), F.col("p.previous_hash").alias("previous_hash"), F.col("p.ts_ns").alias("ts_ns"), "hash",
    )


@query(
    "N10 L12",
    """SELECT event_id, CAST(3 AS BIGINT) AS lines, CASE WHEN event_id%37=0 THEN CAST(2 AS BIGINT) END AS first_bad_line FROM events""",
)
def audit_chain_check(spark, sf):
    out = lg.verify_chain(_audit_lines(spark, sf), ["event_id"])
    return out.withColumn("first_bad_line", F.col("first_bad_line").cast("bigint"))

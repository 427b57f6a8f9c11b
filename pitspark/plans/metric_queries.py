"""Registered queries: folds, portfolio metrics, classification, models, flagship."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import boosting
from ..operators import features as feat
from ..operators import metrics as met
from ..operators import models
from ..operators import regime as reg
from ..operators import timing
from ..operators import walkforward as wf
from . import oracle_features as O
from . import oracle_trees as T
from . import oracle_views as V
from . import views
from .feature_queries import _DATASET, _NOT_NULL, _SCHEDULE, _TIMING
from .registry import query

_P = wf.Protocol()
_METRICS = ["net_return_pct", "annualized_sharpe", "max_drawdown_pct"]


def r6(*names):
    return [F.round(n, 6).alias(n) for n in names]


def text(name):
    return F.col(name).cast("string").alias(name)


def fold_ctes(source: str, min_train=1260, test=252, purge=5, max_folds=12) -> str:
    return f"""dates AS (SELECT d, row_number() OVER (ORDER BY d)-1 AS idx, count(*) OVER () AS n FROM (SELECT DISTINCT d FROM {source})),
dated AS (SELECT d, idx, CASE WHEN idx>=greatest({min_train + purge}, n-{max_folds * test}) THEN (idx-greatest({min_train + purge}, n-{max_folds * test}))//{test}+1 END AS fold FROM dates),
foldt AS (SELECT fold, min(idx) AS test_from, min(idx)-{purge} AS train_to FROM dated WHERE fold IS NOT NULL GROUP BY fold),
rates AS (SELECT foldt.fold AS fold, min(s.d) AS train_start, max(s.d) AS train_end, count(*) AS train_rows, avg(target) AS base_probability
  FROM {source} s JOIN dated USING (d) JOIN foldt ON dated.idx<train_to GROUP BY foldt.fold),
oos AS (SELECT s.*, dated.fold, base_probability FROM {source} s JOIN dated USING (d) JOIN rates ON rates.fold=dated.fold)"""


def portfolio_ctes(rows: str, by: str, out: str = "m") -> str:
    """CTEs from row returns to metrics per ``by`` (one column)."""
    return f"""{out}_w AS (SELECT {by}, count(DISTINCT symbol) AS k, min(d) AS lo, max(d) AS hi FROM {rows} GROUP BY {by}),
{out}_c AS (SELECT {by}, k, unnest(generate_series(lo::TIMESTAMP, hi::TIMESTAMP, INTERVAL 1 DAY))::DATE AS d FROM {out}_w),
{out}_s AS (SELECT {by}, d, sum(row_return) AS s FROM {rows} GROUP BY {by}, d),
{out}_daily AS (SELECT c.{by}, c.d, coalesce(s/k,0.0)::DOUBLE AS daily_return FROM {out}_c c LEFT JOIN {out}_s s ON s.{by}=c.{by} AND s.d=c.d),
{out}_eq AS (SELECT *, product(1+daily_return) OVER (PARTITION BY {by} ORDER BY d) AS equity FROM {out}_daily),
{out}_dd AS (SELECT *, equity/greatest(max(equity) OVER (PARTITION BY {by} ORDER BY d),1.0::DOUBLE)-1 AS drawdown FROM {out}_eq),
{out} AS (SELECT {by}, count(*) AS days, (arg_max(equity,d)-1)*100 AS net_return_pct,
  CASE WHEN stddev_samp(daily_return)>0 THEN avg(daily_return)/stddev_samp(daily_return)*sqrt(365.25::DOUBLE) ELSE 0.0 END AS annualized_sharpe,
  min(drawdown)*100 AS max_drawdown_pct FROM {out}_dd GROUP BY {by})"""


_SIGNAL = "CASE WHEN probability>=0.55::DOUBLE THEN 1 WHEN probability<=0.45::DOUBLE THEN -1 ELSE 0 END"
_STRATEGY = (
    "strat AS (SELECT *, sig*target_return - CASE WHEN sig<>0 THEN cost_bps/10000.0::DOUBLE ELSE 0 END AS row_return FROM "
    "(SELECT *, {sig} AS sig FROM {src}), (SELECT unnest([0.0,5.0,10.0,20.0])::DOUBLE AS cost_bps))"
)
_MET_SQL = ", ".join(f"round({m},6) AS {m}" for m in _METRICS)


# ---- flagship ---------------------------------------------------------------


def _flagship_rows(spark, sf):
    """Test-fold rows scored by their lagged oscillator."""
    data = feat.daily_dataset(views.stored(views.bars(spark, sf)))
    oos = wf.base_rate_predictions(views.stored(data), _P)
    return oos.select(
        "symbol", "d", "fold", "base_probability", (F.col("rsi_14") / 100.0).alias("probability"),
        "target_return", "target",
    )


@query(
    "B13 E12 H2 H4 H13 H14 H16 H17 H18 H19 H20 H22",
    V.with_views(
        V.BARS, O.raw_features(), _DATASET, fold_ctes("dataset"),
        "scored AS (SELECT symbol, d, fold, rsi_14/100.0::DOUBLE AS probability, target_return FROM oos)",
        _STRATEGY.format(src="scored", sig=_SIGNAL), portfolio_ctes("strat", "cost_bps"),
    )
    + f"SELECT cost_bps, days, {_MET_SQL} FROM m",
)
def flagship_cost_stress(spark, sf):
    rows = met.strategy_rows(_flagship_rows(spark, sf), met.stress_costs(5.0))
    out = met.return_metrics(met.portfolio_daily(rows, ["cost_bps"]), ["cost_bps"])
    return out.select("cost_bps", "days", *r6(*_METRICS))


# ---- folds ------------------------------------------------------------------


@query(
    "H1",
    V.with_views(
        V.PREDICTIONS,
        "dates AS (SELECT d, row_number() OVER (ORDER BY d)-1 AS idx, count(*) OVER () AS n FROM (SELECT DISTINCT d FROM predictions))",
    )
    + """SELECT role, count(*) AS rows, count(DISTINCT d) AS sessions, CAST(min(d) AS VARCHAR) AS first_day, CAST(max(d) AS VARCHAR) AS last_day FROM (
  SELECT p.*, CASE WHEN idx>=floor(n*(1.0::DOUBLE-0.2::DOUBLE)) THEN 'test' WHEN idx<floor(n*(1.0::DOUBLE-0.2::DOUBLE))-5 THEN 'train' ELSE 'purged' END AS role
  FROM predictions p JOIN dates USING (d)) GROUP BY role""",
)
def chronological_split(spark, sf):
    out = wf.chronological_split(views.stored(views.predictions(spark, sf)))
    return out.groupBy("role").agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("d").alias("sessions"),
        F.min("d").cast("string").alias("first_day"), F.max("d").cast("string").alias("last_day"),
    )


@query(
    "H2 H4 H8",
    V.with_views(V.PREDICTIONS, fold_ctes("predictions"))
    + """SELECT CAST(fold AS BIGINT) AS fold, CAST(train_start AS VARCHAR) AS train_start, CAST(train_end AS VARCHAR) AS train_end, train_rows,
  round(base_probability,6) AS base_probability FROM rates""",
)
def walk_forward_folds(spark, sf):
    rows = views.stored(views.predictions(spark, sf))
    dated = wf.fold_dates(rows, _P)
    return wf.base_rates(rows, dated, _P).select(
        F.col("fold").cast("bigint").alias("fold"), text("train_start"), text("train_end"), "train_rows",
        *r6("base_probability"),
    )


_TIMED = """timed AS (SELECT *, d::TIMESTAMP + INTERVAL 30 MINUTE AS decision_at,
  d::TIMESTAMP + to_hours(CASE WHEN symbol='BTC-USD' THEN 240 ELSE 21 END) AS label_available_at FROM predictions)"""


@query(
    "H3",
    V.with_views(
        V.PREDICTIONS, _TIMED, fold_ctes("timed"),
        "firstd AS (SELECT fold, min(decision_at) AS fd FROM oos GROUP BY fold)",
    )
    + """SELECT CAST(f.fold AS BIGINT) AS fold, count(*) AS train_rows, count(DISTINCT t.d) AS train_sessions, CAST(max(t.d) AS VARCHAR) AS train_end,
  epoch_us(max(label_available_at)) AS last_label_us, round(avg(target),6) AS base_probability
  FROM timed t JOIN dated USING (d) JOIN foldt ON dated.idx<train_to JOIN firstd f ON f.fold=foldt.fold WHERE label_available_at<fd GROUP BY f.fold""",
)
def availability_purged_folds(spark, sf):
    rows = views.stored(views.predictions(spark, sf)).withColumns(
        {
            "decision_at": F.timestamp_add("MINUTE", F.lit(30), F.col("d").cast("timestamp")),
            "label_available_at": F.timestamp_add(
                "HOUR", F.when(F.col("symbol") == "BTC-USD", 240).otherwise(21), F.col("d").cast("timestamp")
            ),
        }
    )
    out = wf.purged_base_rates(rows, wf.fold_dates(rows, _P), _P)
    return out.select(
        F.col("fold").cast("bigint").alias("fold"), "train_rows", "train_sessions", text("train_end"),
        F.unix_micros("last_label_available_at").alias("last_label_us"), *r6("base_probability"),
    )


# ---- metrics ----------------------------------------------------------------

_AUC = """{out} AS (SELECT {by}, sum(pos*(nb+neg/2.0))::DOUBLE/nullif(sum(pos)*sum(neg),0) AS roc_auc FROM (
  SELECT *, coalesce(sum(neg) OVER (PARTITION BY {by} ORDER BY probability ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0)::DOUBLE AS nb FROM (
  SELECT {by}, probability, sum(target)::DOUBLE AS pos, sum(1-target)::DOUBLE AS neg FROM {src} GROUP BY {by}, probability)) GROUP BY {by})"""
_LOSS = "-avg(CASE WHEN target=1 THEN ln(least(greatest({p},2.220446049250313e-16::DOUBLE),1-2.220446049250313e-16::DOUBLE)) ELSE ln(1-least(greatest({p},2.220446049250313e-16::DOUBLE),1-2.220446049250313e-16::DOUBLE)) END)"


@query(
    "H8 H9 H10",
    V.with_views(V.PREDICTIONS, fold_ctes("predictions"), _AUC.format(by="fold", src="oos", out="auc"))
    + """SELECT CAST(fold AS BIGINT) AS fold, CAST(min(d) AS VARCHAR) AS test_start, CAST(max(d) AS VARCHAR) AS test_end, count(*) AS test_rows,
  round(avg(CASE WHEN (probability>=0.5)=(target=1) THEN 1.0 ELSE 0.0 END),6) AS accuracy, round(any_value(roc_auc),6) AS roc_auc
  FROM oos JOIN auc USING (fold) GROUP BY fold""",
)
def fold_metrics(spark, sf):
    oos = views.stored(wf.base_rate_predictions(views.stored(views.predictions(spark, sf)), _P))
    return met.fold_metrics(oos).select(
        F.col("fold").cast("bigint").alias("fold"), text("test_start"), text("test_end"), "test_rows",
        *r6("accuracy", "roc_auc"),
    )


@query(
    "H9 H10 H11 H12 H27",
    V.with_views(V.PREDICTIONS, fold_ctes("predictions"), _AUC.format(by="symbol", src="oos", out="auc"))
    + f"""SELECT symbol, count(*) AS rows, round(avg(CASE WHEN (probability>=0.5)=(target=1) THEN 1.0 ELSE 0.0 END),6) AS accuracy,
  round({_LOSS.format(p='probability')},6) AS log_loss, round({_LOSS.format(p='base_probability')},6) AS base_rate_log_loss,
  round(avg((probability-target)*(probability-target)),6) AS brier_score, round(any_value(roc_auc),6) AS roc_auc
  FROM oos JOIN auc USING (symbol) GROUP BY symbol""",
)
def classification_by_symbol(spark, sf):
    oos = views.stored(wf.base_rate_predictions(views.stored(views.predictions(spark, sf)), _P))
    return met.classification(oos, ["symbol"]).select(
        "symbol", "rows", *r6("accuracy", "log_loss", "base_rate_log_loss", "brier_score", "roc_auc")
    )


@query(
    "H13 H14 H16 H17 H18 H19 H20 H22",
    V.with_views(V.PREDICTIONS, _STRATEGY.format(src="predictions", sig=_SIGNAL), portfolio_ctes("strat", "cost_bps"))
    + f"SELECT cost_bps, days, {_MET_SQL} FROM m",
)
def cost_stress(spark, sf):
    rows = met.strategy_rows(views.stored(views.predictions(spark, sf)), [0, 5, 10, 20])
    out = met.return_metrics(met.portfolio_daily(rows, ["cost_bps"]), ["cost_bps"])
    return out.select("cost_bps", "days", *r6(*_METRICS))


@query(
    "H16 H17",
    V.with_views(
        V.PREDICTIONS, "rows0 AS (SELECT *, 0 AS g, target_return AS row_return FROM predictions)", portfolio_ctes("rows0", "g")
    )
    + "SELECT CAST(d AS VARCHAR) AS d, round(daily_return,6) AS daily_return, round(equity,6) AS equity, round(drawdown,6) AS drawdown FROM m_dd",
)
def portfolio_curve(spark, sf):
    daily = met.portfolio_daily(met.benchmark_rows(views.stored(views.predictions(spark, sf))))
    return met.equity_curve(daily).select(text("d"), *r6("daily_return", "equity", "drawdown"))


_LONGFLAT = (
    "lf AS (SELECT *, CASE WHEN probability>=0.55::DOUBLE THEN target_return-cost_bps/10000.0::DOUBLE ELSE 0.0 END AS row_return FROM "
    "{src}, (SELECT unnest([5.0,10.0])::DOUBLE AS cost_bps))"
)


@query(
    "H15 H27",
    V.with_views(
        V.PREDICTIONS, _LONGFLAT.format(src="predictions"), "tagged AS (SELECT *, symbol||'@'||cost_bps AS grp FROM lf)",
        portfolio_ctes("tagged", "grp"),
    )
    + f"SELECT split_part(grp,'@',1) AS symbol, CAST(split_part(grp,'@',2) AS DOUBLE) AS cost_bps, days, {_MET_SQL} FROM m",
)
def long_flat_by_symbol(spark, sf):
    rows = met.long_flat_rows(views.stored(views.predictions(spark, sf)), [5, 10])
    # the sleeve count is per group, so a symbol on its own owns the whole capital
    out = met.return_metrics(met.portfolio_daily(rows.withColumn("s", F.col("symbol")), ["s", "cost_bps"]), ["s", "cost_bps"])
    return out.select(F.col("s").alias("symbol"), "cost_bps", "days", *r6(*_METRICS))


@query(
    "H23 H15",
    V.with_views(
        V.PREDICTIONS,
        "bm AS (SELECT *, target_return-cost_bps/10000.0::DOUBLE AS row_return FROM predictions, (SELECT unnest([0.0,5.0,10.0])::DOUBLE AS cost_bps))",
        portfolio_ctes("bm", "cost_bps"),
    )
    + f"SELECT cost_bps, days, {_MET_SQL} FROM m",
)
def always_long_benchmark(spark, sf):
    rows = met.benchmark_rows(views.stored(views.predictions(spark, sf)), [0, 5, 10])
    out = met.return_metrics(met.portfolio_daily(rows, ["cost_bps"]), ["cost_bps"])
    return out.select("cost_bps", "days", *r6(*_METRICS))


@query(
    "H21",
    V.with_views(V.PREDICTIONS)
    + """SELECT count(*) AS rows, count(*) FILTER (probability<0 OR probability>1) AS probability, count(*) FILTER (target_return<=-1) AS total_loss,
  count(*) FILTER (target<>CASE WHEN target_return>0 THEN 1 ELSE 0 END) AS label, count(*)-count(DISTINCT symbol||d) AS duplicate_keys FROM predictions""",
)
def prediction_guards(spark, sf):
    checks = met.prediction_checks(5.0)
    label = F.col("target") != (F.col("target_return") > 0).cast("int")
    per_key = views.stored(views.predictions(spark, sf)).groupBy("symbol", "d").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(checks["probability"]).alias("probability"),
        F.count_if(F.col("target_return") <= -1).alias("total_loss"), F.count_if(label).alias("label"),
    )
    return per_key.agg(
        F.sum("n").alias("rows"), *[F.sum(c).alias(c) for c in ("probability", "total_loss", "label")],
        F.sum(F.col("n") - 1).alias("duplicate_keys"),
    )


@query(
    "H24 H25",
    V.with_views(
        V.PREDICTIONS, fold_ctes("predictions"), "oo AS (SELECT *, 0 AS g FROM oos)", _AUC.format(by="fold", src="oo", out="fauc"),
        _AUC.format(by="g", src="oo", out="auc"), _STRATEGY.format(src="oo", sig=_SIGNAL), portfolio_ctes("strat", "cost_bps"),
        "rows0 AS (SELECT *, target_return AS row_return FROM oo)", portfolio_ctes("rows0", "g", "b"),
        f"""one AS (SELECT count(*) AS rows, count(*) FILTER ({_SIGNAL}<>0) AS active_predictions, {_LOSS.format(p='probability')} AS ll,
   {_LOSS.format(p='base_probability')} AS bl, (SELECT roc_auc FROM auc) AS auc, (SELECT avg(CASE WHEN roc_auc>0.5 THEN 1.0 ELSE 0.0 END) FROM fauc) AS pf,
   (SELECT net_return_pct FROM b) AS bench FROM oo)""",
    )
    + """SELECT rows, active_predictions, round(auc,6) AS roc_auc, round(ll,6) AS log_loss, round(bl,6) AS base_rate_log_loss, round(pf,6) AS positive_auc_fold_fraction,
  round(m5.net_return_pct,6) AS net_return_pct, round(bench,6) AS benchmark_return_pct,
  array_to_string(list_filter([CASE WHEN coalesce(auc<0.53,true) THEN 'walk-forward ROC AUC is below 0.53' END,
   CASE WHEN ll>=bl THEN 'probability log loss does not beat the training-only base rate' END,
   CASE WHEN m5.annualized_sharpe<0.75 THEN 'walk-forward Sharpe is below 0.75' END,
   CASE WHEN m5.max_drawdown_pct<-20 THEN 'walk-forward maximum drawdown exceeds 20%' END,
   CASE WHEN pf<0.6 THEN 'fewer than 60% of folds have ROC AUC above 0.50' END,
   CASE WHEN m10.net_return_pct<=0 THEN 'return is not positive at twice the assumed trading cost' END], lambda x: x IS NOT NULL),'|') AS reasons
  FROM one, (SELECT * FROM m WHERE cost_bps=5) m5, (SELECT * FROM m WHERE cost_bps=10) m10""",
)
def walk_forward_gate(spark, sf):
    oos = views.stored(wf.base_rate_predictions(views.stored(views.predictions(spark, sf)), _P))
    out = met.evaluate(oos, 5.0)
    return out.select(
        "rows", "active_predictions",
        *r6("roc_auc", "log_loss", "base_rate_log_loss", "positive_auc_fold_fraction", "net_return_pct", "benchmark_return_pct"),
        F.array_join("rejection_reasons", "|").alias("reasons"),
    )


_BOOTSTRAP = V.with_views(
    V.PREDICTIONS, _LONGFLAT.format(src="predictions"), "five AS (SELECT * FROM lf WHERE cost_bps=5)", portfolio_ctes("five", "cost_bps"),
    """day0 AS (SELECT row_number() OVER (ORDER BY d)-1 AS i, daily_return FROM m_daily),
size AS (SELECT count(*) AS n, least(20, count(*)) AS width FROM day0),
drawn AS (SELECT r AS resample, b, n, width, ('0x'||substr(md5('17:'||r||':'||b),1,15))::BIGINT % n AS start FROM size, range(500) t(r), range(10000) u(b) WHERE b*width<n),
taken AS (SELECT resample, n, unnest(range(start, start+least(width, n-b*width))) % n AS i FROM drawn),
means AS (SELECT resample, sum(daily_return)/any_value(n)*10000 AS mean_bps FROM taken JOIN day0 USING (i) GROUP BY resample)""",
)


@query("H26", _BOOTSTRAP + """SELECT (SELECT round(avg(daily_return)*10000,6) FROM day0) AS mean_daily_bps, round(quantile_cont(mean_bps,0.025),6) AS lower_95_bps,
  round(quantile_cont(mean_bps,0.975),6) AS upper_95_bps, (SELECT width::INTEGER FROM size) AS block_calendar_days, 500::INTEGER AS resamples FROM means""")
def bootstrap_mean_return(spark, sf):
    """The interval, against resamples built day by day from the same draws."""
    daily = met.portfolio_daily(met.long_flat_rows(views.stored(views.predictions(spark, sf)), [5]))
    return met.bootstrap_interval(views.stored(daily)).select(*r6("mean_daily_bps", "lower_95_bps", "upper_95_bps"), "block_calendar_days", "resamples")


@query("H26", _BOOTSTRAP + "SELECT resample, round(mean_bps,6) AS mean_bps FROM means")
def bootstrap_resamples(spark, sf):
    daily = met.portfolio_daily(met.long_flat_rows(views.stored(views.predictions(spark, sf)), [5]))
    return met.bootstrap_means(views.stored(daily)).select("resample", *r6("mean_bps"))


# ---- models -----------------------------------------------------------------


_PANEL = V.with_views(
    V.BARS, V.SESSIONS, _SCHEDULE, _TIMING.replace("dated", "scheduled"), O.regime_table(), O.regime_attach("paired", "decision_at"),
    f"""known AS (SELECT symbol, target_session AS d, CASE WHEN target_return>0 THEN 1 ELSE 0 END AS target, decision_at, exit_at + INTERVAL 30 MINUTE AS label_available_at
  FROM attached WHERE {_NOT_NULL})""",
    fold_ctes("known"),
    "firstd AS (SELECT fold, min(decision_at) AS fd, count(*) AS test_rows FROM oos GROUP BY fold)",
    """trained AS (SELECT f.fold, count(*) AS train_rows, max(label_available_at) AS last_label, avg(target) AS base_rate FROM known t JOIN dated USING (d)
  JOIN foldt ON dated.idx<train_to JOIN firstd f ON f.fold=foldt.fold WHERE label_available_at<fd GROUP BY f.fold)""",
)


def _panel_sql(names: str) -> str:
    return _PANEL + f"""SELECT model, CAST(t.fold AS BIGINT) AS fold, train_rows, epoch_us(last_label) AS last_label_us, round(base_rate,6) AS base_probability,
  test_rows, test_rows AS scored_keys, test_rows AS probabilities FROM trained t JOIN firstd USING (fold), (SELECT unnest([{names}]) AS model)"""


def _panel(spark, sf, names):
    """All folds of the protocol on the 19 features; everything but the probabilities has a check in SQL."""
    bars = views.stored(views.bars(spark, sf))
    rows = timing.timing_dataset(bars, views.stored(views.sessions(spark, sf)), reg.regime_table(bars))
    scored = models.walk_forward(rows, feat.FEATURE_COLUMNS + reg.REGIME_COLUMNS, _P, names)
    p = F.col("probability")
    return scored.groupBy("model", F.col("fold").cast("bigint").alias("fold")).agg(
        F.max("train_rows").alias("train_rows"), F.unix_micros(F.max("last_label_available_at")).alias("last_label_us"),
        F.round(F.max("base_probability"), 6).alias("base_probability"), F.count(F.lit(1)).alias("test_rows"),
        F.count_distinct("symbol", "target_session").alias("scored_keys"), F.count_if((p >= 0) & (p <= 1)).alias("probabilities"),
    )


@query("H3 H5 H7 H29", _panel_sql("'base_rate','logistic'"))
def logistic_walk_forward(spark, sf):
    return _panel(spark, sf, ["base_rate", "logistic"])


@query("H3 H6 H7", _panel_sql("'gradient_boosting'"))
def boosted_walk_forward(spark, sf):
    return _panel(spark, sf, ["gradient_boosting"])


_TREES = 2


@query(
    "H6",
    V.with_views(
        V.BARS, O.raw_features(), _DATASET, fold_ctes("dataset"),
        f"""train AS MATERIALIZED (SELECT foldt.fold, row_number() OVER () AS rid, target, {', '.join(f'round({c},9) AS {c}' for c in O.FEATURES)}
  FROM dataset JOIN dated USING (d) JOIN foldt ON dated.idx<train_to)""",
        T.binned("train", O.FEATURES), T.trees("train", _TREES),
    )
    + """SELECT fold::INTEGER AS fold, tree::INTEGER AS tree, step::INTEGER AS step, node, feature::INTEGER AS feature, round(threshold,6) AS threshold, round(gain,6) AS gain,
  left_rows::BIGINT AS left_rows, right_rows::BIGINT AS right_rows, round(left_value,8) AS left_value, round(right_value,8) AS right_value FROM splits""",
)
def boosted_first_trees(spark, sf):
    """All splits of the first trees of every fold on the ten daily features, with the frozen settings."""
    data = views.stored(feat.daily_dataset(views.stored(views.bars(spark, sf))))
    dated = wf.fold_dates(data, _P)
    plan = wf.folds(dated, _P).collect()  # at most max_folds rows
    rounded = [F.round(c, 9).alias(c) for c in O.FEATURES]
    indexed = data.join(dated.select("d", "idx"), "d").select(*rounded, "target", "idx")
    is_known = {int(f["fold"]): F.col("idx") < int(f["train_to"]) for f in plan}
    fitted = models.boosted_folds(indexed, O.FEATURES, is_known, trees=_TREES)
    found = boosting.split_table(spark, fitted).withColumn("fold", F.col("grp").cast("int"))
    return found.select("fold", "tree", "step", "node", "feature", *r6("threshold", "gain"), "left_rows", "right_rows",
                        *[F.round(c, 8).alias(c) for c in ("left_value", "right_value")])

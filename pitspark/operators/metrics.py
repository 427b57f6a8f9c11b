"""Portfolio and classification metrics for daily out-of-sample predictions.

Capital convention: one fixed equal sleeve per symbol of the whole prediction set;
a missing row or a flat signal leaves its sleeve in cash; calendar days without
rows return zero. Prediction rows are only ever grouped with partial aggregation;
ordered work happens on the daily series, which the calendar bounds.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.quantiles import value_ranks
from ..functions.reasons import finite, require_unique, require_zero

# Signal thresholds, annualisation, clip of the log loss, default cost grid rule.
LONG_THRESHOLD = 0.55
SHORT_THRESHOLD = 0.45
DAYS_PER_YEAR = 365.25
EPSILON = 2.220446049250313e-16
STRESS_BPS = 20.0

# The admission limits.
ADMISSION = {
    "min_auc": 0.53,
    "min_sharpe": 0.75,
    "max_drawdown_pct": -20.0,
    "min_positive_folds": 0.60,
}


def prediction_checks(cost_bps: float = 0.0) -> dict[str, Column]:
    p = F.col("probability")
    return {
        "missing_key": F.col("d").isNull() | F.col("symbol").isNull(),
        "probability": ~finite(p) | (p < 0) | (p > 1),
        "target_return": ~finite(F.col("target_return")),
        "cost": F.lit(not (math.isfinite(cost_bps) and cost_bps >= 0)),
    }


def require_predictions(predictions: DataFrame, cost_bps: float = 0.0) -> DataFrame:
    require_zero(predictions, prediction_checks(cost_bps))
    return require_unique(predictions, ["d", "symbol"], "prediction")


def signal(probability: Column, long: float = LONG_THRESHOLD, short: float = SHORT_THRESHOLD) -> Column:
    return F.when(probability >= long, 1).when(probability <= short, -1).otherwise(0)


def cost_grid(costs: list[float]) -> Column:
    """A handful of round-trip costs to unfold every row into; an argument, not data."""
    return F.explode(F.array(*[F.lit(float(c)) for c in sorted(set(costs))]))


def stress_costs(cost_bps: float) -> list[float]:
    return sorted({0.0, float(cost_bps), 2.0 * cost_bps, STRESS_BPS})


def strategy_rows(predictions: DataFrame, costs: list[float]) -> DataFrame:
    """Long/short/flat row returns for each cost; only active rows pay."""
    signed = predictions.withColumns({"signal": signal(F.col("probability")), "cost_bps": cost_grid(costs)})
    net = F.col("signal") * F.col("target_return") - F.when(F.col("signal") != 0, F.col("cost_bps") / 10000.0).otherwise(0.0)
    return signed.withColumn("row_return", net)


def long_flat_rows(predictions: DataFrame, costs: list[float], threshold: float = LONG_THRESHOLD) -> DataFrame:
    """Long when the probability reaches the threshold, else cash."""
    crossed = predictions.withColumn("cost_bps", cost_grid(costs))
    net = F.when(F.col("probability") >= threshold, F.col("target_return") - F.col("cost_bps") / 10000.0).otherwise(0.0)
    return crossed.withColumn("row_return", net)


def benchmark_rows(predictions: DataFrame, costs: list[float] | None = None) -> DataFrame:
    """Always long open to close; free of cost unless a grid is given."""
    if costs is None:
        return predictions.withColumn("row_return", F.col("target_return"))
    return long_flat_rows(predictions.withColumn("probability", F.lit(1.0)), costs)


def portfolio_daily(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, d, daily_return) on every calendar day between the first and last row of a group."""
    by = by or []
    per_day = rows.groupBy(*by, "d").agg(F.sum("row_return").alias("_sum"))
    whole = rows.groupBy(*by, "symbol").agg(F.min("d").alias("_lo"), F.max("d").alias("_hi")).groupBy(*by).agg(
        F.count(F.lit(1)).alias("_sleeves"), F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi")
    )
    calendar = whole.select(*by, "_sleeves", F.explode(F.sequence("_lo", "_hi")).alias("d"))
    joined = calendar.join(per_day, [*by, "d"], "left")
    return joined.select(*by, "d", F.coalesce(F.col("_sum") / F.col("_sleeves"), F.lit(0.0)).alias("daily_return"))


def equity_curve(daily: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Cumulative equity and drawdown; the high-water mark starts at the original 1.0."""
    by = by or []
    run = W.partitionBy(*(by or [F.lit(0)])).orderBy("d").rowsBetween(W.unboundedPreceding, W.currentRow)
    curve = daily.withColumn("equity", F.product(1 + F.col("daily_return")).over(run))
    peak = F.greatest(F.max("equity").over(run), F.lit(1.0))
    return curve.withColumn("drawdown", F.col("equity") / peak - 1)


def return_metrics(daily: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Net return %, annualised Sharpe (0 without variation) and maximum drawdown % per group."""
    by = by or []
    curve = equity_curve(daily, by)
    stats = curve.groupBy(*by).agg(
        F.count(F.lit(1)).alias("days"),
        F.max_by("equity", "d").alias("_last"),
        F.avg("daily_return").alias("_mean"),
        F.stddev_samp("daily_return").alias("_std"),
        F.min("drawdown").alias("_dd"),
    )
    sharpe = F.when(F.col("_std") > 0, F.col("_mean") / F.col("_std") * math.sqrt(DAYS_PER_YEAR)).otherwise(0.0)
    return stats.select(
        *by, "days", ((F.col("_last") - 1) * 100).alias("net_return_pct"), sharpe.alias("annualized_sharpe"),
        (F.col("_dd") * 100).alias("max_drawdown_pct"),
    )


def require_daily(daily: DataFrame) -> DataFrame:
    """Daily returns must be finite and above -100 %."""
    r = F.col("daily_return")
    return require_zero(daily, {"daily return": ~finite(r) | (r <= -1)})


def clipped_log_loss(probability: Column, target: Column) -> Column:
    p = F.least(F.greatest(probability, F.lit(EPSILON)), F.lit(1 - EPSILON))
    return -F.avg(F.when(target == 1, F.log(p)).otherwise(F.log(1 - p)))


def roc_auc(rows: DataFrame, by: list[str], probability: str = "probability", target: str = "target") -> DataFrame:
    """Exact rank-sum AUC with ties counted half; NULL when a group has one class.

    Rows are counted per distinct probability first and ranked in bins, so neither a
    constant score nor one dominating group meets a single task.
    """
    ranked = value_ranks(rows, by, probability, {"pos": F.col(target).cast("bigint")})
    negative = (F.col("n") - F.col("pos")).cast("double")
    below = (F.col("below") - F.col("pos_below")).cast("double")
    sums = ranked.groupBy(*by).agg(
        F.sum(F.col("pos") * (below + negative / 2)).alias("_u"),
        F.sum("pos").cast("double").alias("_p"),
        F.sum(negative).alias("_n"),
    )
    return sums.select(*by, F.try_divide(F.col("_u"), F.nullif(F.col("_p") * F.col("_n"), F.lit(0.0))).alias("roc_auc"))


def classification(rows: DataFrame, by: list[str]) -> DataFrame:
    """Accuracy at 0.5, log loss, Brier score, base-rate log loss where present, and AUC."""
    p, t = F.col("probability"), F.col("target")
    aggregates = [
        F.count(F.lit(1)).alias("rows"),
        F.avg(((p >= 0.5).cast("int") == t).cast("double")).alias("accuracy"),
        clipped_log_loss(p, t).alias("log_loss"),
        F.avg((p - t) * (p - t)).alias("brier_score"),
    ]
    if "base_probability" in rows.columns:
        aggregates.append(clipped_log_loss(F.col("base_probability"), t).alias("base_rate_log_loss"))
    basic = rows.groupBy(*by).agg(*aggregates)
    auc = roc_auc(rows, by)
    if by:
        return basic.join(auc, by)
    return basic.crossJoin(auc)  # one row each


def fold_metrics(predictions: DataFrame) -> DataFrame:
    """One row per fold: test range, rows, AUC (NULL with one class) and accuracy."""
    p, t = F.col("probability"), F.col("target")
    basic = predictions.groupBy("fold").agg(
        F.min("d").alias("test_start"), F.max("d").alias("test_end"), F.count(F.lit(1)).alias("test_rows"),
        F.avg(((p >= 0.5).cast("int") == t).cast("double")).alias("accuracy"),
    )
    return basic.join(roc_auc(predictions, ["fold"]), "fold")


def stability(folds: DataFrame, predictions: DataFrame) -> DataFrame:
    """Share of folds with AUC above one half, and the number of active predictions."""
    active = predictions.agg(F.count_if(signal(F.col("probability")) != 0).alias("active_predictions"))
    share = folds.agg(F.avg(F.coalesce(F.col("roc_auc") > 0.5, F.lit(False)).cast("double")).alias("positive_auc_fold_fraction"))
    return share.crossJoin(active)  # one row each


def rejection_reasons(auc, log_loss, base_loss, sharpe, drawdown, positive_folds, doubled_return) -> Column:
    """Ordered reasons; empty means approved for paper signals."""
    checks = [
        (F.coalesce(auc < ADMISSION["min_auc"], F.lit(True)), "walk-forward ROC AUC is below 0.53"),
        (log_loss >= base_loss, "probability log loss does not beat the training-only base rate"),
        (sharpe < ADMISSION["min_sharpe"], "walk-forward Sharpe is below 0.75"),
        (drawdown < ADMISSION["max_drawdown_pct"], "walk-forward maximum drawdown exceeds 20%"),
        (positive_folds < ADMISSION["min_positive_folds"], "fewer than 60% of folds have ROC AUC above 0.50"),
        (doubled_return <= 0, "return is not positive at twice the assumed trading cost"),
    ]
    return F.array_compact(F.array(*[F.when(cond, F.lit(text)) for cond, text in checks]))


def evaluate(predictions: DataFrame, cost_bps: float) -> DataFrame:
    """One row: classification, selected and doubled cost metrics, stability and the gate.

    Raises on a duplicate or invalid prediction, and on a day that loses all capital.
    """
    require_predictions(predictions, cost_bps)
    daily = require_daily(portfolio_daily(strategy_rows(predictions, stress_costs(cost_bps)), ["cost_bps"]))
    per_cost = return_metrics(daily, ["cost_bps"])
    at = lambda c, name: F.max(F.when(F.col("cost_bps") == float(c), F.col(name)))
    money = per_cost.agg(
        at(cost_bps, "net_return_pct").alias("net_return_pct"),
        at(cost_bps, "annualized_sharpe").alias("annualized_sharpe"),
        at(cost_bps, "max_drawdown_pct").alias("max_drawdown_pct"),
        at(2 * cost_bps, "net_return_pct").alias("doubled_return_pct"),
    )
    bench = return_metrics(portfolio_daily(benchmark_rows(predictions))).select(
        F.col("net_return_pct").alias("benchmark_return_pct")
    )
    joined = (
        classification(predictions, []).crossJoin(money).crossJoin(bench)
        .crossJoin(stability(fold_metrics(predictions), predictions))
    )  # one row each
    reasons = rejection_reasons(
        F.col("roc_auc"), F.col("log_loss"), F.col("base_rate_log_loss"), F.col("annualized_sharpe"),
        F.col("max_drawdown_pct"), F.col("positive_auc_fold_fraction"), F.col("doubled_return_pct"),
    )
    return joined.withColumn("rejection_reasons", reasons).withColumn(
        "approved_for_paper_signals", F.size("rejection_reasons") == 0
    )


def split_rejection_reasons(auc, sharpe, drawdown, net_return) -> Column:
    """Ordered reasons of the gate after one chronological split; empty means approved for paper signals."""
    checks = [
        (F.coalesce(auc < ADMISSION["min_auc"], F.lit(True)), "ROC AUC is below 0.53"),
        (sharpe < ADMISSION["min_sharpe"], "annualized Sharpe is below 0.75"),
        (drawdown < ADMISSION["max_drawdown_pct"], "maximum drawdown exceeds 20%"),
        (net_return <= 0, "net out-of-sample return is not positive"),
    ]
    return F.array_compact(F.array(*[F.when(cond, F.lit(text)) for cond, text in checks]))


def evaluate_split(predictions: DataFrame, cost_bps: float) -> DataFrame:
    """One row for the test part of a chronological split: classification, money at one cost, and the gate."""
    require_predictions(predictions, cost_bps)
    rows = strategy_rows(predictions, [cost_bps])
    money = return_metrics(require_daily(portfolio_daily(rows))).drop("days")
    active = rows.agg(F.count_if(F.col("signal") != 0).alias("active_predictions"))
    joined = classification(predictions, []).crossJoin(money).crossJoin(active)  # one row each
    reasons = split_rejection_reasons(*[F.col(c) for c in ("roc_auc", "annualized_sharpe", "max_drawdown_pct", "net_return_pct")])
    return joined.withColumn("rejection_reasons", reasons).withColumn("approved_for_paper", F.size("rejection_reasons") == 0)


def group_summary(predictions: DataFrame, groups: list[str], cost_bps: float) -> DataFrame:
    """One row per group and model: span, AUC, and the long/flat portfolio at the group's selected cost.

    ``predictions`` has ``model`` beside the group columns; every model of a group must cover the same span.
    """
    by = [*groups, "model"]
    span = predictions.groupBy(*by).agg(F.min("d").alias("oos_start"), F.max("d").alias("oos_end"))
    daily = require_daily(portfolio_daily(long_flat_rows(predictions, [cost_bps]), by))
    scores = roc_auc(predictions, by)
    return span.join(return_metrics(daily, by), by).join(scores, by, "left").select(
        *by, "oos_start", "oos_end", F.lit(float(cost_bps)).alias("selected_round_trip_cost_bps"), "roc_auc",
        "days", "net_return_pct", "annualized_sharpe", "max_drawdown_pct",
    )


def block_start(seed: int, resample: Column, block: Column, days: Column) -> Column:
    """Day 0 .. days - 1 on which a block begins: a counter-based draw, the same on every run and executor."""
    counter = F.concat_ws(":", F.lit(str(seed)), resample.cast("string"), block.cast("string"))
    return F.conv(F.substring(F.md5(counter), 1, 15), 16, 10).cast("bigint") % days


def bootstrap_means(daily: DataFrame, resamples: int = 500, block: int = 20, seed: int = 17) -> DataFrame:
    """(resample, mean_bps): circular block resamples of the daily returns, as many days as there are.

    Blocks are drawn on the executors. A block sum is a difference of prefix sums; a block that wraps adds the head.
    """
    order = W.partitionBy(F.lit(0)).orderBy("d")  # one row a calendar day
    run = order.rowsBetween(W.unboundedPreceding, W.currentRow)
    prefix = daily.select(F.row_number().over(order).alias("pos"), F.sum("daily_return").over(run).alias("total"))
    shape = daily.agg(F.count(F.lit(1)).alias("n"), F.sum("daily_return").alias("whole")).withColumn("width", F.least(F.lit(block).cast("bigint"), "n"))
    shape = shape.where("n > 0").withColumn("blocks", F.expr("(n + width - 1) div width"))
    drawn = daily.sparkSession.range(resamples).withColumnRenamed("id", "resample").crossJoin(F.broadcast(shape)).select(  # one row
        "*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("b")
    )
    start = block_start(seed, F.col("resample"), F.col("b"), F.col("n"))
    stop = F.col("start") + F.least("width", F.col("n") - F.col("b") * F.col("width"))
    ends = drawn.withColumn("start", start).withColumn("stop", stop).withColumn("end", F.when(stop > F.col("n"), stop - F.col("n")).otherwise(stop))
    before, after = (prefix.select(F.col("pos").alias(name), F.col("total").alias(total)) for name, total in (("start", "_s"), ("end", "_e")))
    head = F.when(F.col("stop") > F.col("n"), F.col("whole")).otherwise(0.0)
    summed = ends.join(before, "start", "left").join(after, "end")
    return summed.groupBy("resample").agg((F.sum(F.col("_e") - F.coalesce("_s", F.lit(0.0)) + head) / F.max("n") * 10000).alias("mean_bps"))


def bootstrap_interval(
    daily: DataFrame, resamples: int = 500, block: int = 20, seed: int = 17
) -> DataFrame:
    """Circular block bootstrap of the mean daily return in bps, 95 % interval; no row without daily returns."""
    if min(resamples, block) < 1:
        raise ValueError("resamples and block must be positive")
    interval = bootstrap_means(daily, resamples, block, seed).agg(F.percentile("mean_bps", [0.025, 0.975]).alias("q"))
    mean = daily.agg((F.avg("daily_return") * 10000).alias("mean_daily_bps"), F.count(F.lit(1)).alias("n")).where("n > 0")
    return mean.crossJoin(interval).select(  # one row each
        "mean_daily_bps", F.col("q")[0].alias("lower_95_bps"), F.col("q")[1].alias("upper_95_bps"),
        F.least(F.lit(block).cast("bigint"), "n").cast("int").alias("block_calendar_days"), F.lit(resamples).alias("resamples"),
    )

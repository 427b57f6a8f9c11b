"""DuckDB text for daily features, regime and timing."""

from __future__ import annotations

FEATURES = [
    "return_1", "return_5", "return_20", "volatility_5", "volatility_20", "ma_gap_5", "ma_gap_20", "range_pct",
    "volume_z20", "rsi_14",
]
REGIME = [
    "market_return_1", "market_return_20", "market_volatility_20", "growth_relative_20", "small_relative_20",
    "vix_level", "vix_change_5", "rate_level", "rate_change_20",
]


def raw_features(source: str = "bars", out: str = "raw") -> str:
    """CTE text: ten unshifted features per (symbol, d)."""
    w = "(PARTITION BY symbol ORDER BY d)"

    def frame(n):
        return f"(PARTITION BY symbol ORDER BY d ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"

    def full(fn, col, n):
        return f"CASE WHEN count({col}) OVER {frame(n)}={n} THEN {fn}({col}) OVER {frame(n)} END"

    return f"""{out}_s1 AS (SELECT *, close/lag(close) OVER {w}-1 AS r, close-lag(close) OVER {w} AS df FROM {source}),
{out}_s2 AS (SELECT *, CASE WHEN df IS NOT NULL THEN greatest(df,0) END AS g,
   CASE WHEN df IS NOT NULL THEN greatest(-df,0) END AS ls FROM {out}_s1),
{out}_s3 AS (SELECT *, {full('avg', 'g', 14)} AS ag, {full('avg', 'ls', 14)} AS al FROM {out}_s2),
{out} AS (SELECT symbol, d, open, high, low, close, volume, r AS return_1, close/lag(close,5) OVER {w}-1 AS return_5,
   close/lag(close,20) OVER {w}-1 AS return_20, {full('stddev_samp', 'r', 5)} AS volatility_5,
   {full('stddev_samp', 'r', 20)} AS volatility_20, close/({full('avg', 'close', 5)})-1 AS ma_gap_5,
   close/({full('avg', 'close', 20)})-1 AS ma_gap_20, (high-low)/close AS range_pct,
   (volume-({full('avg', 'volume', 20)}))/nullif({full('stddev_samp', 'volume', 20)},0) AS volume_z20,
   CASE WHEN ag IS NULL OR al IS NULL THEN NULL WHEN al=0 AND ag>0 THEN 100.0 WHEN al=0 THEN 50.0
     ELSE 100-100/(1+ag/al) END AS rsi_14 FROM {out}_s3)"""


def regime_table() -> str:
    w = "(ORDER BY d)"
    return f"""panel AS (SELECT d, max(close) FILTER (symbol='SPY') AS spy, max(close) FILTER (symbol='QQQ') AS qqq,
   max(close) FILTER (symbol='IWM') AS iwm, max(close) FILTER (symbol='^VIX') AS vix,
   max(close) FILTER (symbol='^TNX') AS rate FROM bars GROUP BY d),
eq0 AS (SELECT *, spy/lag(spy) OVER {w}-1 AS r FROM panel WHERE spy IS NOT NULL AND qqq IS NOT NULL AND iwm IS NOT NULL),
eq AS (SELECT d, r AS market_return_1, spy/lag(spy,20) OVER {w}-1 AS market_return_20,
   CASE WHEN count(r) OVER (ORDER BY d ROWS 19 PRECEDING)=20 THEN stddev_samp(r) OVER (ORDER BY d ROWS 19 PRECEDING) END
     AS market_volatility_20,
   (qqq/lag(qqq,20) OVER {w}-1)-(spy/lag(spy,20) OVER {w}-1) AS growth_relative_20,
   (iwm/lag(iwm,20) OVER {w}-1)-(spy/lag(spy,20) OVER {w}-1) AS small_relative_20 FROM eq0),
vx AS (SELECT d, vix AS vix_level, vix/lag(vix,5) OVER {w}-1 AS vix_change_5 FROM panel WHERE vix IS NOT NULL),
rt AS (SELECT d, rate AS rate_level, rate-lag(rate,20) OVER {w} AS rate_change_20 FROM panel WHERE rate IS NOT NULL),
regime AS (SELECT * FROM eq FULL JOIN vx USING (d) FULL JOIN rt USING (d))"""


def regime_attach(source: str, cutoff: str, out: str = "attached") -> str:
    """CTEs adding the nine columns to ``source`` at TIMESTAMP expression ``cutoff``, one ASOF join each."""
    cutoffs = f"{out}_c AS (SELECT DISTINCT {cutoff} AS cutoff FROM {source})"
    joins, cols = [], []
    for i, name in enumerate(REGIME):
        joins.append(
            f"ASOF LEFT JOIN (SELECT d::TIMESTAMP + INTERVAL 1 DAY AS av, {name} FROM regime WHERE {name} IS NOT NULL) j{i} "
            f"ON c.cutoff >= j{i}.av"
        )
        cols.append(f"CASE WHEN c.cutoff - j{i}.av <= INTERVAL 7 DAY THEN j{i}.{name} END AS {name}")
    return (
        f"{cutoffs}, {out}_m AS (SELECT c.cutoff, {', '.join(cols)} FROM {out}_c c {' '.join(joins)}),\n"
        f"{out} AS (SELECT s.*, {', '.join('m.' + c for c in REGIME)} FROM {source} s "
        f"JOIN {out}_m m ON m.cutoff = s.{cutoff})"
    )


def rounded(columns, digits: int = 6) -> str:
    levels = ("vix_level", "rate_level")
    places = {"rate_change_20": 9}
    return ", ".join(c if c in levels else f"round({c},{places.get(c, digits)}) AS {c}" for c in columns)

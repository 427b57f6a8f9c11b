"""DuckDB text for leaf-wise boosted trees: one step after the other, every leaf searched anew."""

from __future__ import annotations

UNIT = 2**30


def binned(source: str, features: list[str], bins: int = 255) -> str:
    """CTEs ``binned(fold, rid, feature, v, bin)`` and ``edge(fold, feature, bin, threshold)`` of ``source(fold, rid, ...)``."""
    return f"""long AS (SELECT fold, rid, unnest(range({len(features)})) AS feature, unnest([{', '.join(features)}]) AS v FROM {source}),
ranked AS (SELECT *, rank() OVER w - 1 AS below, dense_rank() OVER w AS dr, count(*) OVER (PARTITION BY fold, feature) AS total
  FROM long WINDOW w AS (PARTITION BY fold, feature ORDER BY v)),
binned AS MATERIALIZED (SELECT fold, rid, feature, v, CASE WHEN max(dr) OVER (PARTITION BY fold, feature)<={bins} THEN dr ELSE below*{bins}//total END AS bin FROM ranked),
edge AS MATERIALIZED (SELECT fold, feature, bin, (max(v) + lead(min(v)) OVER (PARTITION BY fold, feature ORDER BY bin))/2 AS threshold
  FROM binned GROUP BY fold, feature, bin)"""


def _step(tree: int, step: int, min_rows: int, l2: float) -> str:
    at, best = f"at_{tree}_{step - 1}", f"best_{tree}_{step}"
    term = lambda g, h: f"(({g})/{UNIT}::DOUBLE)*(({g})/{UNIT}::DOUBLE)/(({h})/{UNIT}::DOUBLE+{l2}::DOUBLE)"
    return f"""{best} AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY gain DESC, node, feature, bin) AS place FROM (
  SELECT *, round({term('gl', 'hl')}+{term('gt-gl', 'ht-hl')}-{term('gt', 'ht')}, 9) AS gain FROM (
  SELECT fold, node, feature, bin, sum(n) OVER a AS nl, sum(g) OVER a AS gl, sum(h) OVER a AS hl, sum(n) OVER b AS nt, sum(g) OVER b AS gt, sum(h) OVER b AS ht
  FROM (SELECT fold, node, feature, bin, count(*) AS n, sum(g) AS g, sum(h) AS h FROM binned JOIN {at} USING (fold, rid) JOIN gh_{tree} USING (fold, rid) GROUP BY ALL)
  WINDOW a AS (PARTITION BY fold, node, feature ORDER BY bin), b AS (PARTITION BY fold, node, feature))
  WHERE nl>={min_rows} AND nt-nl>={min_rows} AND hl>=0.001*{UNIT} AND ht-hl>=0.001*{UNIT}) WHERE gain>0) WHERE place=1),
at_{tree}_{step} AS MATERIALIZED (SELECT a.fold, a.rid, CASE WHEN a.node IS DISTINCT FROM s.node THEN a.node WHEN x.bin<=s.bin THEN 2*a.node ELSE 2*a.node+1 END AS node
  FROM {at} a LEFT JOIN {best} s USING (fold) LEFT JOIN binned x ON x.fold=a.fold AND x.rid=a.rid AND x.feature=s.feature)"""


def trees(source: str, count: int, leaves: int = 15, min_rows: int = 30, l2: float = 1.0, rate: float = 0.05) -> str:
    """CTEs up to ``splits(fold, tree, step, node, feature, threshold, gain, left_rows, right_rows, left_value, right_value)``."""
    parts = [
        f"raw_1 AS (SELECT fold, rid, target, ln(r/(1-r)) AS raw FROM {source} JOIN (SELECT fold, avg(target) AS r FROM {source} GROUP BY fold) USING (fold))"
    ]
    found = []
    for tree in range(1, count + 1):
        parts.append(
            f"""gh_{tree} AS MATERIALIZED (SELECT fold, rid, round((p-target)*{UNIT})::BIGINT AS g, round(p*(1-p)*{UNIT})::BIGINT AS h
  FROM (SELECT *, 1/(1+exp(-raw)) AS p FROM raw_{tree})),
at_{tree}_0 AS (SELECT fold, rid, 1::BIGINT AS node FROM raw_{tree})"""
        )
        for step in range(1, leaves):
            parts.append(_step(tree, step, min_rows, l2))
            value = lambda g, h: f"-{rate}::DOUBLE*({g}/{UNIT}::DOUBLE)/({h}/{UNIT}::DOUBLE+{l2}::DOUBLE)"
            found.append(
                f"""SELECT fold, {tree} AS tree, {step} AS step, node, feature, threshold, gain, nl AS left_rows, nt-nl AS right_rows,
  {value('gl', 'hl')} AS left_value, {value('(gt-gl)', '(ht-hl)')} AS right_value FROM best_{tree}_{step} JOIN edge USING (fold, feature, bin)"""
            )
        if tree < count:
            parts.append(
                f"""worth_{tree} AS (SELECT fold, node, {value('sum(g)', 'sum(h)')} AS value FROM at_{tree}_{leaves - 1} JOIN gh_{tree} USING (fold, rid) GROUP BY ALL),
raw_{tree + 1} AS MATERIALIZED (SELECT r.fold, r.rid, target, raw+value AS raw FROM raw_{tree} r JOIN at_{tree}_{leaves - 1} USING (fold, rid) JOIN worth_{tree} USING (fold, node))"""
            )
    return ",\n".join([*parts, f"splits AS ({' UNION ALL '.join(found)})"])

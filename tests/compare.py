"""Run registered queries against their SQL check on DuckDB.

    python -m tests.compare [--sf DIR] [name ...]
"""

from __future__ import annotations

import argparse
import os
import sys
import time
from decimal import Decimal

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def normal(value):
    if isinstance(value, Decimal):
        return float(value)
    if isinstance(value, bool):
        return value
    if isinstance(value, float):
        return value + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(normal(v) for v in value)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(normal(r[i]) for i in order) for r in rows]
    return sorted(out, key=repr)


def compare(df, con, sql):
    """None when equal, else a description of the first difference."""
    cursor = con.execute(sql)
    theirs_cols = [c[0] for c in cursor.description]
    theirs = rows_of(theirs_cols, cursor.fetchall())
    ours = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sorted(df.columns) != sorted(theirs_cols):
        return f"columns {sorted(df.columns)} vs {sorted(theirs_cols)}"
    if len(ours) != len(theirs):
        extra = [r for r in ours if r not in set(theirs)][:2] if len(ours) < 50000 else []
        return f"rows {len(ours)} vs {len(theirs)}; e.g. ours only {extra}"
    bad = [(a, b) for a, b in zip(ours, theirs) if repr(a) != repr(b)]
    if bad:
        return f"{len(bad)} of {len(ours)} rows differ ({sorted(df.columns)}): {bad[0][0]} vs {bad[0][1]}"
    return None


def main() -> int:
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from pitspark.session import local_session

    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    parser.add_argument("--match", default="")
    parser.add_argument("--module", default="", help="only queries registered by this module of pitspark.plans")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    spark = local_session(8, "compare")
    con = duck(args.sf)
    queries, oracles = entry.queries(), entry.oracle_sql()
    if args.module:
        from pitspark.plans.catalog import all_queries

        queries = {n: q for n, q in queries.items() if n in all_queries() and all_queries()[n].module == args.module}
    failures = 0
    for name in args.names or [n for n in queries if args.match in n]:
        start = time.time()
        try:
            df = queries[name](spark, args.sf)
            if name in oracles:
                problem = compare(df, con, oracles[name])
                rows = con.execute(f"SELECT count(*) FROM ({oracles[name]})").fetchone()[0]
            else:
                rows, problem = df.count(), None
        except Exception as error:  # noqa: BLE001
            problem, rows = f"{type(error).__name__}: {str(error)[:1500]}", -1
        failures += problem is not None
        label = "FAIL" if problem else ("ok" if name in oracles else "rows-only")
        print(f"{label:9s} {name} rows={rows} {time.time() - start:.1f}s {problem or ''}", flush=True)
    print(f"{failures} failures")
    return 1 if failures else 0


if __name__ == "__main__":
    raise SystemExit(main())

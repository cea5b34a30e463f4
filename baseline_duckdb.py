"""Single-node reference timings: the oracle SQL on DuckDB.

process, all cores) running the same statements on the same folder.  Two
modes: ``raw`` computes the stand-in tables inside every statement (as the
oracle does); ``staged`` first stores them as tables, like the Spark side.
Prints one JSON line per mode.  Usage: python baseline_duckdb.py [sf_dir]
"""

from __future__ import annotations

import json
import statistics
import sys
import time

import duckdb

import oracle_queries

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()
VIEWS = ("customers_v orders_v items_v payments_v reviews_v products_v translation_v sellers_v "
         "items_s orders_s reviews_s sale review rated").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def staged(sql: str) -> str:
    """Replace the leading binding CTEs by the stored tables of the same names."""
    body = sql.replace(oracle_queries.BINDINGS.strip(), "", 1).strip()
    body = body[len("WITH"):].lstrip() if body.startswith("WITH") else body
    return ("WITH " + body.lstrip(", \n")) if body.lstrip().startswith(",") else body


def run(con, queries: dict[str, str], runs: int = 3) -> dict[str, float]:
    out = {}
    for name, sql in queries.items():
        con.execute(sql).fetchall()
        times = []
        for _ in range(runs):
            t0 = time.perf_counter()
            con.execute(sql).fetchall()
            times.append(time.perf_counter() - t0)
        out[name] = round(statistics.median(times), 4)
    return out


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    sql = oracle_queries.oracle_sql()
    con = connect(sf_dir)
    raw = run(con, sql)
    print(json.dumps({"mode": "raw", "value": round(sum(raw.values()), 3), "queries": raw}))
    for v in VIEWS:
        con.execute(f"CREATE TABLE {v} AS WITH {oracle_queries.BINDINGS.strip()} SELECT * FROM {v}")
    st = run(con, {k: staged(s) for k, s in sql.items()})
    print(json.dumps({"mode": "staged", "value": round(sum(st.values()), 3), "queries": st}))


if __name__ == "__main__":
    main()

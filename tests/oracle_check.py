"""Run registered queries next to their SQL and compare the results as multisets of rows.

``python tests/oracle_check.py [--sf 0.01] [name ...]``
"""

from __future__ import annotations

import argparse
import collections
import math
import pathlib
import sys
import time

import duckdb

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()
TYPES = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "boolean": "BOOLEAN",
    "timestamp": "TIMESTAMP",
}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"create view {table} as select * from '{sf_dir}/{table}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    return value


def compare(spark, con, name, fn, sql, sf_dir):
    """An empty string if both agree, else what differs."""
    df = fn(spark, sf_dir)
    cols = sorted(df.columns)
    rows = [tuple(_plain(r[c]) for c in cols) for r in df.collect()]
    if sql is None:
        return "" if rows else "no rows"
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    if sorted(names) != cols:
        return f"columns {cols} against {sorted(names)}"
    want = [tuple(_plain(dict(zip(names, r))[c]) for c in cols) for r in got.fetchall()]
    kinds = {r[0]: r[1] for r in con.execute(f"describe {sql}").fetchall()}
    for col, kind in df.dtypes:
        if TYPES.get(kind, kind) != kinds[col]:
            return f"type of {col}: {kind} against {kinds[col]}"
    a, b = collections.Counter(rows), collections.Counter(want)
    if a != b:
        return (
            f"rows {len(rows)} against {len(want)}; only here {list((a - b).items())[:3]}; "
            f"only in SQL {list((b - a).items())[:3]} of {cols}"
        )
    return "" if rows else "no rows"


def main() -> None:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="0.01")
    parser.add_argument("--skip-good", action="store_true")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    import __spark_entry__ as entry
    from quillsieve.session import build_session

    sf_dir = f"/root/testdata/sf{args.sf}"
    spark = build_session(**{"spark.driver.memory": "12g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    chosen = [n for n in queries if not args.names or any(n.startswith(p) for p in args.names)]
    bad = 0
    for name in chosen:
        begin = time.time()
        try:
            problem = compare(spark, con, name, queries[name], oracles.get(name), sf_dir)
        except Exception as error:  # noqa: BLE001 - the report lists every failure
            problem = f"{type(error).__name__}: {str(error)[:900]}"
        kind = "sql" if name in oracles else "rows"
        if problem:
            bad += 1
        print(f"{'BAD ' if problem else 'ok  '} {kind:4s} {time.time() - begin:6.1f}s {name} {problem}", flush=True)
    print(f"{len(chosen) - bad} of {len(chosen)} good")


if __name__ == "__main__":
    main()

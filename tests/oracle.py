"""Compare registered queries with their DuckDB text. `python -m tests.oracle [sf] [name...]`"""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("set threads to 8")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[:-8]
        con.execute(f"create view {name} as select * from read_parquet('{path}')")
    return con


def _value(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "~null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return repr(v)
    return str(v)


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(_value(r[i]) for i in order) for r in rows)


KINDS = {"tinyint": "int", "smallint": "int", "int": "int", "integer": "int", "bigint": "int",
         "float": "float", "double": "float", "varchar": "string", "string": "string",
         "boolean": "bool", "date": "date", "timestamp": "ts", "timestamp_ntz": "ts"}


def compare(spark, con, fn, sql, sf_dir):
    """Empty string when both sides agree, else what differs."""
    df = fn(spark, sf_dir)
    cur = con.execute(sql)
    oracle = {d[0]: KINDS.get(str(d[1]).lower(), str(d[1])) for d in cur.description}
    ours = {n: KINDS.get(t, t) for n, t in df.dtypes}
    if ours != oracle:
        return f"schema {ours} != {oracle}"
    a = _rows(df.columns, [tuple(x) for x in df.collect()])
    b = _rows([d[0] for d in cur.description], cur.fetchall())
    if len(a[1]) != len(b[1]):
        return f"rows {len(a[1])} != {len(b[1])}"
    if not a[1]:
        return "no rows"
    bad = [(x, y) for x, y in zip(a[1], b[1]) if x != y]
    return f"{len(bad)} of {len(a[1])} rows differ, e.g. {a[0]}: {bad[0]}" if bad else ""


if __name__ == "__main__":
    from trackframe.plans.catalog import ORACLES, QUERIES
    from trackframe.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.001"
    only = sys.argv[2:]
    path = f"/root/testdata/sf{sf}"
    spark, con = local_session(), connect(path)
    spark.sparkContext.setLogLevel("ERROR")
    for name, fn in QUERIES.items():
        if only and not any(o in name for o in only):
            continue
        t = time.time()
        try:
            if name in ORACLES:
                msg = compare(spark, con, fn, ORACLES[name], path) or "ok"
            else:
                msg = f"rows only: {len(fn(spark, path).collect())}"
        except Exception as e:  # noqa: BLE001
            msg = "ERROR " + str(e)[:600]
        print(f"{name}: {msg} [{time.time() - t:.1f}s]", flush=True)

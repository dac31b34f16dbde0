"""Run a query in Spark and its SQL in DuckDB on the same files and compare schema and rows."""

from __future__ import annotations

import datetime
import decimal
import glob
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb

from streetloom import catalog

SF = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.01")
GROUPS = {"tinyint": "int", "smallint": "int", "int": "int", "integer": "int", "bigint": "int", "hugeint": "int",
          "double": "float", "float": "float", "varchar": "string", "string": "string", "boolean": "boolean",
          "timestamp": "timestamp", "timestamp_ntz": "timestamp"}


def connect(sf: str = SF) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET threads=8")
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(repr(v))
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((plain(k), plain(x)) for k, x in v.items()))
    return v


def rows(names: list[str], data: list) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


def check(spark, con, name: str, sf: str = SF) -> tuple[bool, str]:
    entry = catalog.load_all()[name]
    t0 = time.time()
    df = catalog.queries()[name](spark, sf)
    got = df.collect()
    t1 = time.time()
    mine = rows(df.columns, got)
    if len(df.columns) != len(set(df.columns)):
        return False, "duplicate columns"
    if entry.oracle is None:
        return bool(mine), f"rows-only {len(mine)} rows, {t1 - t0:.2f}s"
    cur = con.execute(catalog.oracle_sql()[name])
    desc = [(d[0], str(d[1]).lower()) for d in cur.description]
    theirs = rows([d[0] for d in desc], cur.fetchall())
    t2 = time.time()
    if sorted(df.columns) != sorted(d[0] for d in desc):
        return False, f"columns {sorted(df.columns)} != {sorted(d[0] for d in desc)}"
    kinds = dict(desc)
    for f, t in df.dtypes:
        a, b = GROUPS.get(t, t), GROUPS.get(kinds[f], kinds[f])
        if a in ("int", "float", "string", "boolean") and a != b:
            return False, f"column {f}: {t} against {kinds[f]}"
    if mine != theirs:
        extra = [r for r in mine if r not in set(theirs)][:3] if len(mine) < 200000 else []
        lost = [r for r in theirs if r not in set(mine)][:3] if len(mine) < 200000 else []
        return False, f"{len(mine)} rows against {len(theirs)}; {sorted(df.columns)}\n   only Spark {extra}\n   only SQL {lost}"
    return len(mine) > 0, f"{len(mine)} rows, spark {t1 - t0:.2f}s duckdb {t2 - t1:.2f}s"


if __name__ == "__main__":
    from streetloom.session import local_session
    spark = local_session(cores=8)
    con = connect()
    wanted = sys.argv[1:]
    bad = []
    for n, e in catalog.load_all().items():
        if wanted and not any(n == w or (w.endswith("*") and n.startswith(w[:-1])) or w == e.build.__module__.split(".")[-1]
                              for w in wanted):
            continue
        try:
            ok, note = check(spark, con, n)
        except Exception as ex:  # report and go on
            ok, note = False, f"{type(ex).__name__}: {str(ex)[:700]}"
        if not ok:
            bad.append(n)
        print(("ok   " if ok else "FAIL ") + n + ": " + note, flush=True)
    print("failed:", bad)

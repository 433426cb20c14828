"""Runs a query and its SQL on the same tables and compares names, kinds and values."""
from __future__ import annotations

import math
import os
import pathlib
import sys
import time

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def duck(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _kind(v):
    if isinstance(v, bool):
        return "bool"
    if isinstance(v, int):
        return "int"
    return "float" if isinstance(v, float) else type(v).__name__


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}" if v else "0"
    return repr(v)


def compare(spark, con, name, build, sql, sf_dir):
    """-> (problem or None, rows, spark seconds)."""
    t0 = time.time()
    df = build(spark, sf_dir)
    columns = sorted(df.columns)
    mine = [tuple(r[c] for c in columns) for r in df.collect()]
    took = time.time() - t0
    if sql is None:
        return None, len(mine), took
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    if sorted(names) != columns:
        return f"columns {columns} != {sorted(names)}", len(mine), took
    at = [names.index(c) for c in columns]
    theirs = [tuple(r[i] for i in at) for r in cur.fetchall()]
    if len(mine) != len(theirs):
        return f"rows {len(mine)} != {len(theirs)}", len(mine), took
    for n, c in enumerate(columns):
        a = {_kind(r[n]) for r in mine if r[n] is not None}
        b = {_kind(r[n]) for r in theirs if r[n] is not None}
        if a != b and a and b:
            return f"kinds of {c}: {a} != {b}", len(mine), took
    left, right = sorted(tuple(map(_norm, r)) for r in mine), sorted(tuple(map(_norm, r)) for r in theirs)
    if left != right:
        bad = [(x, y) for x, y in zip(left, right) if x != y]
        return f"{len(bad)} rows differ ({columns}), e.g. {bad[0]}", len(mine), took
    return None, len(mine), took


if __name__ == "__main__":
    from wayspark.session import build_session
    import __spark_entry__ as entry
    sf = sys.argv[1]
    only = [a for a in sys.argv[2:] if not a.startswith("--")]
    extra = {"wayspark.hotGroupRows": "4"} if "--hot" in sys.argv else {}       # every group takes the chunked way
    sf_dir = f"/root/testdata/{sf}"
    spark = build_session(master=os.environ.get("TEST_MASTER", "local[8]"), **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", **extra})
    spark.sparkContext.setLogLevel("ERROR")
    con, oracles, bad = duck(sf_dir), entry.oracle_sql(), 0
    for name, build in entry.queries().items():
        if only and not any(name.startswith(o) for o in only):
            continue
        try:
            problem, rows, took = compare(spark, con, name, build, oracles.get(name), sf_dir)
        except Exception as e:                                     # report and go on with the next query
            problem, rows, took = f"{type(e).__name__}: {str(e)[:600]}", -1, 0.0
        bad += problem is not None
        print(f"{'BAD ' if problem else 'ok  '} {name:40s} rows={rows:7d} {took:6.2f}s {'' if name in oracles else '(no sql)'} {problem or ''}", flush=True)
    print("bad:", bad)

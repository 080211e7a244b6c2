"""Side-by-side check of a catalogue query against its DuckDB oracle."""

from __future__ import annotations

import math
import sys

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if hasattr(v, "asDict"):
        return tuple(_norm(x) for x in v)
    return v


def rows_key(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda t: tuple((x is None, str(type(x)), x if x is not None else 0) for x in t))


def compare(spark, key: str, sf_dir: str, fn, sql: str) -> tuple[bool, str]:
    sdf = fn(spark, sf_dir)
    scols = sdf.columns
    srows = [tuple(r) for r in sdf.collect()]
    con = duck(sf_dir)
    res = con.execute(sql)
    dcols = [d[0] for d in res.description]
    drows = res.fetchall()
    if sorted(scols) != sorted(dcols):
        return False, f"columns differ: spark={sorted(scols)} duck={sorted(dcols)}"
    if len(srows) != len(drows):
        return False, f"row count differs: spark={len(srows)} duck={len(drows)}"
    a, b = rows_key(srows, scols), rows_key(drows, dcols)
    for x, y in zip(a, b):
        if x != y:
            return False, f"first differing row: spark={x} duck={y}"
    return True, f"{len(srows)} rows match"


if __name__ == "__main__":
    sys.path.insert(0, "/root/repo")
    import __spark_entry__ as E
    from rowaudit.session import get_spark
    sf = "/root/testdata/sf0.01"
    keys = sys.argv[1:] or sorted(E.oracle_sql())
    spark = get_spark()
    bad = 0
    for k in keys:
        sql = E.oracle_sql().get(k)
        if sql is None:
            try:
                n = E.queries()[k](spark, sf).count()
                print(f"[rows] {k}: {n} rows", flush=True)
            except Exception as e:
                bad += 1
                print(f"[FAIL] {k}: error: {type(e).__name__}: {str(e)[:300]}", flush=True)
            continue
        try:
            ok, msg = compare(spark, k, sf, E.queries()[k], sql)
        except Exception as e:  # report and continue
            ok, msg = False, f"error: {type(e).__name__}: {str(e)[:300]}"
        bad += not ok
        print(f"[{'ok' if ok else 'FAIL'}] {k}: {msg}", flush=True)
    print(f"failures: {bad}")

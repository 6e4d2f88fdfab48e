"""Side-by-side run of a query and its SQL. ``python -m tests.oracle sf0.01 [key ...]``"""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time

import duckdb

from dyadspark.plans.registry import TABLES

ROOT = "/root/testdata"


def cell(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return ("b", v)
    if isinstance(v, (int, decimal.Decimal)):
        return float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else (0.0 if v == 0 else v)
    if isinstance(v, (datetime.date, datetime.datetime)):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(cell(x) for x in v)
    return v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(cell(r[i]) for i in order) for r in rows), key=lambda r: tuple((x is not None, str(x)) for x in r))


def duck(folder):
    con = duckdb.connect()
    con.execute("SET timezone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


KIND = {"bigint": "int", "int": "int", "integer": "int", "double": "float", "string": "str", "varchar": "str", "date": "date"}


def compare(spark, con, key, fn, sql, folder):
    df = fn(spark, folder)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    types = {d[0]: str(d[1]).lower() for d in cur.description}
    want = rows_of(names, cur.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} vs {sorted(names)}"
    off = {c: (t, types[c]) for c, t in df.dtypes if KIND.get(t, t) != KIND.get(types[c], types[c])}
    if off:
        return f"types {off}"
    if len(got) != len(want):
        return f"rows {len(got)} vs {len(want)}: {got[:2]} {want[:2]}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        return f"{len(bad)} of {len(got)} rows differ ({sorted(names)}): {bad[:2]}"
    return f"ok {len(got)}"


def main(argv):
    import __spark_entry__ as entry
    from dyadspark import get_spark

    sf, keys = argv[0], [a for a in argv[1:] if a != "-v"]
    folder = f"{ROOT}/{sf}"
    spark = get_spark("oracle")
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(folder)
    queries, sqls = entry.queries(), entry.oracle_sql()
    picked = [k for k in queries if not keys or any(k == p or (p.endswith("*") and k.startswith(p[:-1])) for p in keys)]
    failed = []
    for key in picked:
        start = time.time()
        try:
            if key in sqls:
                res = compare(spark, con, key, queries[key], sqls[key], folder)
            else:
                res = f"ok {len(queries[key](spark, folder).collect())} (no SQL)"
        except Exception as exc:  # noqa: BLE001 - report and go on
            res = f"ERROR {type(exc).__name__} {str(exc)[:900]}"
        took = time.time() - start
        if not res.startswith("ok") or res.startswith("ok 0"):
            failed.append(key)
            print(f"{key:24s} {took:6.2f}s  {res}", flush=True)
        elif took > 4 or "-v" in argv:
            print(f"{key:24s} {took:6.2f}s  {res}", flush=True)
    print(f"{len(picked) - len(failed)} of {len(picked)} agree; not: {failed}")


if __name__ == "__main__":
    main(sys.argv[1:])

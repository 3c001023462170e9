"""Run registered Spark queries next to their SQL twins in DuckDB and compare.

Usable from pytest (``compare``) and as a script:
    python tests/oracle_check.py [sf_dir] [name ...]
"""

from __future__ import annotations

import datetime as dt
import sys
import time
from collections import Counter
from decimal import Decimal

import duckdb

DRIVER_TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
                 "benchmark labels conversations").split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in DRIVER_TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _norm(v):
    if isinstance(v, Decimal):
        return ("dec", str(v))
    if isinstance(v, float):
        return ("float", round(v, 6))
    if isinstance(v, bool):
        return ("bool", v)
    if isinstance(v, int):
        return ("int", v)
    if isinstance(v, dt.datetime):
        return ("ts", v.replace(tzinfo=None).isoformat())
    if isinstance(v, dt.date):
        return ("date", v.isoformat())
    if isinstance(v, (list, tuple)):
        return ("list", tuple(_norm(x) for x in v))
    if isinstance(v, dict):
        return ("map", tuple(sorted((str(k), _norm(x)) for k, x in v.items())))
    return (type(v).__name__, v)


def _rows(cols: list[str], rows) -> Counter:
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return Counter(tuple(_norm(r[i]) for i in order) for r in rows)


def compare(spark, con, name: str, build, sql: str | None, sf_dir: str) -> dict:
    t0 = time.time()
    sdf = build(spark, sf_dir)
    s_cols = sdf.columns
    s_rows = [tuple(r) for r in sdf.collect()]
    t1 = time.time()
    out = {"name": name, "rows": len(s_rows), "spark_s": round(t1 - t0, 2)}
    if sql is None:
        out["status"] = "no-oracle"
        return out
    rel = con.sql(sql)
    d_cols = rel.columns
    d_rows = rel.fetchall()
    out["oracle_rows"] = len(d_rows)
    if sorted(s_cols) != sorted(d_cols):
        out["status"] = f"COLUMNS spark={sorted(s_cols)} oracle={sorted(d_cols)}"
        return out
    a, b = _rows(s_cols, s_rows), _rows(d_cols, d_rows)
    if a == b:
        out["status"] = "ok"
    else:
        only_s = list((a - b).elements())[:3]
        only_d = list((b - a).elements())[:3]
        out["status"] = f"VALUES cols={sorted(s_cols)} spark_only={only_s} oracle_only={only_d}"
    return out


def main(argv: list[str]) -> int:
    sys.path.insert(0, ".")
    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    names = argv[1:]
    from __spark_entry__ import oracle_sql, queries
    from storefront.session import build_session
    spark = build_session()
    con = duck(sf_dir)
    qs, sqls = queries(), oracle_sql()
    bad = 0
    for name in names or sorted(qs):
        try:
            r = compare(spark, con, name, qs[name], sqls.get(name), sf_dir)
        except Exception as e:  # report and go on
            r = {"name": name, "status": f"ERROR {type(e).__name__}: {str(e)[:400]}"}
        if r["status"] not in ("ok", "no-oracle"):
            bad += 1
        print(r, flush=True)
    print(f"mismatches: {bad}")
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main(sys.argv[1:]))

"""Compare registered queries with their SQL: python tests/check_catalog.py [sf] [name ...]"""

from __future__ import annotations

import datetime
import math
import os
import sys
import time
from collections import Counter

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from metroframe.fixtures import TABLES  # noqa: E402


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(norm(e) for e in v)
    if isinstance(v, dict):
        return tuple((k, norm(e)) for k, e in v.items())
    return repr(v)


def compare(spark, sf: str, fn, sql: str):
    df = fn(spark, sf)
    cols = sorted(df.columns)
    got = Counter(tuple(norm(v) for v in row) for row in df.select(*cols).collect())
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    rel = con.sql(sql)
    if sorted(rel.columns) != cols:
        return f"columns {cols} != {sorted(rel.columns)}"
    order = [rel.columns.index(c) for c in cols]
    want = Counter(tuple(norm(row[i]) for i in order) for row in rel.fetchall())
    if got == want:
        return None
    extra, lost = got - want, want - got
    return (
        f"{sum(got.values())} rows vs {sum(want.values())}; only here {sum(extra.values())}, only SQL {sum(lost.values())}\n"
        f"   cols {cols}\n   here {list(extra)[:3]}\n   sql  {list(lost)[:3]}"
    )


def session():
    from metroframe.session import get_spark

    return get_spark(
        "check", "local[8]", **{
            "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "16g", "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false", "spark.log.level": "ERROR",
        }
    )


def main():
    args = sys.argv[1:]
    sf = f"/root/testdata/{args[0]}" if args and args[0].startswith("sf") else "/root/testdata/sf0.01"
    names = [a for a in args if not a.startswith("sf")]
    from metroframe.catalog import ORACLES, QUERIES

    spark = session()
    bad = 0
    for name, fn in QUERIES.items():
        if names and name not in names:
            continue
        t0 = time.time()
        try:
            if name in ORACLES:
                err = compare(spark, sf, fn, ORACLES[name])
            else:
                n = len(fn(spark, sf).collect())
                err = None if n else "no rows"
        except Exception as e:  # noqa: BLE001
            err = f"{type(e).__name__}: {str(e)[:1500]}"
        bad += err is not None
        print(f"{'ok  ' if err is None else 'FAIL'} {name} {time.time() - t0:.1f}s {'' if name in ORACLES else '(rows only)'} {err or ''}", flush=True)
    print(f"{bad} failed")


if __name__ == "__main__":
    main()

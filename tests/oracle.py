"""Runs a registered query and its SQL on the same files and compares the rows."""

from __future__ import annotations

import datetime as dt
import math
import sys
import time
from collections import Counter

import duckdb

import __spark_entry__ as contract

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, float):
        return v + 0.0
    return tuple(map(_cell, v)) if isinstance(v, list) else v


def _rows(names, rows) -> Counter:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple((type(c).__name__, c) for c in (_cell(r[i]) for i in order)) for r in rows)


def compare(spark, con, name: str, sf_dir: str) -> tuple[bool, str]:
    df = contract.queries()[name](spark, sf_dir)
    got = _rows(df.columns, [tuple(r) for r in df.collect()])
    sql = contract.oracle_sql().get(name)
    if sql is None:
        return sum(got.values()) > 0, f"{sum(got.values())} rows, no SQL"
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    want = _rows(names, cur.fetchall())
    if sorted(names) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} != {sorted(names)}"
    if got == want:
        return True, f"{sum(got.values())} rows"
    extra, lacking = got - want, want - got
    return False, (
        f"rows {sum(got.values())} != {sum(want.values())}" if sum(got.values()) != sum(want.values()) else "values"
    ) + f"\n  only spark {sum(extra.values())}: {list(extra)[:2]}\n  only sql   {sum(lacking.values())}: {list(lacking)[:2]}"


if __name__ == "__main__":
    from tests.conftest import make_session

    sf, wanted = sys.argv[1], sys.argv[2:]
    spark, con = make_session(), connect(sf)
    failed = []
    for name in contract.queries():
        if wanted and name not in wanted:
            continue
        start = time.time()
        try:
            ok, note = compare(spark, con, name, sf)
        except Exception as e:  # noqa: BLE001
            ok, note = False, f"{type(e).__name__}: {str(e)[:1500]}"
        print(f"{'ok  ' if ok else 'FAIL'} {name:28s} {time.time() - start:6.2f}s {note}", flush=True)
        if not ok:
            failed.append(name)
    print("failed:", failed)

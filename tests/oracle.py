"""Compare registered queries with their SQL: ``python tests/oracle.py sf_dir [name ...]``."""

from __future__ import annotations

import math
import os
import sys
import time
from datetime import date, datetime

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def _plain(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, date):
        return v.isoformat()
    if isinstance(v, (int, float)) or type(v).__name__ in ("Decimal",):
        f = float(v)
        return "nan" if math.isnan(f) else f + 0.0
    return str(v)


def compare(spark, con, name: str, sf: str) -> tuple[bool, str]:
    import __spark_entry__ as contract

    df = contract.queries()[name](spark, sf)
    got = [tuple(_plain(r[c]) for c in sorted(df.columns)) for r in df.collect()]
    text = contract.oracle_sql().get(name)
    if text is None:
        return len(got) > 0, f"{len(got)} rows, no SQL"
    cursor = con.execute(text)
    names = [d[0] for d in cursor.description]
    if sorted(names) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} vs {sorted(names)}"
    order = [names.index(c) for c in sorted(names)]
    want = [tuple(_plain(r[i]) for i in order) for r in cursor.fetchall()]
    def key(row):
        return tuple((v is None, str(type(v)), v if v is not None else 0) for v in row)

    got.sort(key=key)
    want.sort(key=key)
    if got == want:
        return len(got) > 0, f"{len(got)} rows"
    extra = [r for r in got if r not in set(want)][:3]
    lacking = [r for r in want if r not in set(got)][:3]
    differing = len(set(got) ^ set(want)) // 2
    return False, f"{len(got)} vs {len(want)} rows, {differing} differ\n   columns {sorted(names)}\n   got {extra}\n   want {lacking}"


if __name__ == "__main__":
    import __spark_entry__ as contract
    from structpeak.session import local_session

    sf = sys.argv[1]
    spark, con = local_session(8), connect(sf)
    failed = []
    for n in sys.argv[2:] or contract.queries():
        t = time.time()
        try:
            ok, text = compare(spark, con, n, sf)
        except Exception as e:  # report and go on
            ok, text = False, f"{type(e).__name__}: {str(e)[:1500]}"
        print(f"{'ok  ' if ok else 'FAIL'} {n} {time.time() - t:.1f}s {text}", flush=True)
        if not ok:
            failed.append(n)
    print("failed:", failed)

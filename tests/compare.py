"""Run registered queries beside their SQL counterparts: python tests/compare.py [sf_dir] [name part ...]"""

from __future__ import annotations

import datetime
import decimal
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v + 0.0
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return v


def rows_of(columns: list[str], rows) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(plain(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=repr)


def compare(spark, con, name: str, query, sql: str | None, sf_dir: str) -> tuple[bool, str]:
    t0 = time.time()
    df = query(spark, sf_dir)
    got_cols, got = rows_of(df.columns, df.collect())
    t1 = time.time()
    if sql is None:
        return len(got) > 0, f"{len(got)} rows, no sql, {t1 - t0:.1f}s"
    rel = con.execute(sql)
    want_cols, want = rows_of([c[0] for c in rel.description], rel.fetchall())
    note = f"{len(got)} rows, spark {t1 - t0:.1f}s sql {time.time() - t1:.1f}s"
    if got_cols != want_cols:
        return False, f"columns {got_cols} != {want_cols}"
    if got == want:
        return len(got) > 0, note
    wrong = [(g, w) for g, w in zip(got, want) if g != w][:3]
    return False, f"{note}; {len(want)} expected; first differences: " + "; ".join(f"\n   got  {g}\n   want {w}" for g, w in wrong)


if __name__ == "__main__":
    from evidentia.catalogue import load
    from evidentia.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark = local_session("8")
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf)
    queries, oracle = load()
    bad = 0
    for name, query in queries.items():
        if wanted and not any(w in name for w in wanted):
            continue
        try:
            ok, note = compare(spark, con, name, query, oracle.get(name), sf)
        except Exception as e:
            ok, note = False, f"{type(e).__name__}: {str(e)[:700]}"
        bad += not ok
        print("ok  " if ok else "FAIL", name, note, flush=True)
    print("failures:", bad)

"""Run registered queries next to their SQL twins and compare rows: check.py [folder] [name-part ...]."""

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from genoweave import local_session  # noqa: E402
from genoweave.registry import load  # noqa: E402
from genoweave.registry.views import TABLES  # noqa: E402


def plain(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    if isinstance(v, int):
        return v
    return str(v)


def key(row):
    return tuple((v is None, str(type(v)) if not isinstance(v, (int, float)) else "n", v if v is not None else 0) for v in row)


def main():
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    parts = sys.argv[2:]
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    queries, oracles = load()
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    bad = []
    for name, fn in queries.items():
        if parts and not any(p in name for p in parts):
            continue
        t0 = time.time()
        try:
            df = fn(spark, folder)
            cols = sorted(df.columns)
            rows = [[plain(r[c]) for c in cols] for r in df.select(*[f"`{c}`" for c in cols]).collect()]
        except Exception as e:  # noqa: BLE001
            bad.append(name)
            print(f"ERR  {name}: {str(e)[:1500]}", flush=True)
            continue
        t1 = time.time()
        if name not in oracles:
            print(f"rows {name}: {len(rows)} {t1 - t0:.1f}s", flush=True)
            if not rows:
                print("   (empty)")
            continue
        try:
            cur = con.execute(oracles[name])
            names = [d[0] for d in cur.description]
            order = sorted(range(len(names)), key=lambda i: names[i])
            want = [[plain(r[i]) for i in order] for r in cur.fetchall()]
        except Exception as e:  # noqa: BLE001
            bad.append(name)
            print(f"SQL  {name}: {str(e)[:700]}", flush=True)
            continue
        t2 = time.time()
        names = sorted(names)
        a, b = sorted(rows, key=key), sorted(want, key=key)
        ok = names == cols and a == b
        print(f"{'ok  ' if ok else 'DIFF'} {name}: {len(rows)} rows spark {t1 - t0:.1f}s sql {t2 - t1:.1f}s", flush=True)
        if not rows:
            print("   (empty)")
        if not ok:
            bad.append(name)
            print("   columns", cols, names, len(a), len(b))
            sa, sb = {repr(r) for r in a}, {repr(r) for r in b}
            print("   spark only", sorted(sa - sb)[:3])
            print("   sql only  ", sorted(sb - sa)[:3])
    print("FAILED", len(bad), bad)


if __name__ == "__main__":
    main()

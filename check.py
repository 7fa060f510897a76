"""Run registered plans against their oracle SQL: ``python check.py [sf] [key-prefix ...]``."""

from __future__ import annotations

import math
import sys
import time

import duckdb

from oddsmith.plans import all_oracles, all_queries
from oddsmith.plans.bindings import TABLES
from oddsmith.session import local_session


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v
    if isinstance(v, (list, tuple)):
        return str(v)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return v


def main() -> int:
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    prefixes = sys.argv[2:]
    folder = f"/root/testdata/sf{sf}"
    spark = local_session("8")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    oracles, bad = all_oracles(), 0
    for key, fn in all_queries().items():
        if prefixes and not any(key.startswith(p) for p in prefixes):
            continue
        t0 = time.time()
        try:
            df = fn(spark, folder)
            rows = df.collect()
            took = time.time() - t0
            names = df.columns
            got = [tuple(norm(r[c]) for c in sorted(names)) for r in rows]
            if key not in oracles:
                print(f"ROWS {key} rows={len(got)} {took:.2f}s", flush=True)
                continue
            t1 = time.time()
            cur = con.execute(oracles[key])
            cols = [d[0] for d in cur.description]
            order = sorted(range(len(cols)), key=lambda i: cols[i])
            want = [tuple(norm(r[i]) for i in order) for r in cur.fetchall()]
            t2 = time.time() - t1
        except Exception as e:  # noqa: BLE001 - a report tool shows every failure
            bad += 1
            print(f"FAIL {key} {type(e).__name__}: {str(e)[:900]}", flush=True)
            continue
        if sorted(names) != sorted(cols):
            bad += 1
            print(f"COLS {key} {sorted(names)} != {sorted(cols)}", flush=True)
            continue
        got.sort(key=repr)
        want.sort(key=repr)
        types = lambda rs: [sorted({type(r[i]).__name__ for r in rs} - {"NoneType"}) for i in range(len(cols))]
        tdiff = [(sorted(cols)[i], a, b) for i, (a, b) in enumerate(zip(types(got), types(want))) if a != b]
        if got != want or tdiff:
            bad += 1
            gs, ws = set(map(repr, got)), set(map(repr, want))
            print(f"DIFF {key} spark={len(got)} duck={len(want)} types={tdiff} cols={sorted(cols)}")
            print("   only spark:", sorted(gs - ws)[:3])
            print("   only duck :", sorted(ws - gs)[:3], flush=True)
        else:
            print(f"ok   {key} rows={len(got)} spark={took:.2f}s duck={t2:.2f}s", flush=True)
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)

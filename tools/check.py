"""Compare registered queries with their SQL: python tools/check.py SF_DIR [name-prefix ...]"""

import math
import sys
import time
import traceback

sys.path.insert(0, ".")
import duckdb  # noqa: E402

from tidepanel import catalog  # noqa: E402
from tidepanel.plans.session import local_session  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else (v + 0.0 if v != 0 else 0.0)
    if hasattr(v, "item"):
        return norm(v.item())
    if type(v).__name__ in ("Timestamp", "datetime", "date", "NaTType"):
        return None if str(v) == "NaT" else str(v)[:19].replace(" 00:00:00", "")
    return v


def key(row):
    return tuple((v is not None, str(type(v)), str(v)) for v in row)


def rows_of(cols, data):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in data), key=key)


def main(sf, prefixes):
    catalog.load_all()
    spark = local_session()
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    bad, n = [], 0
    for name, fn in catalog.QUERIES.items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        n += 1
        t0 = time.time()
        try:
            df = fn(spark, sf)
            got = df.collect()
            dt = time.time() - t0
            a = rows_of(df.columns, got)
            sql = catalog.ORACLES.get(name)
            if sql is None:
                print(f"rows  {name:36s} {len(a):7d} {dt:6.2f}s", flush=True)
                continue
            rel = con.sql(sql)
            b = rows_of(rel.columns, rel.fetchall())
            if sorted(df.columns) != sorted(rel.columns):
                raise AssertionError(f"columns {sorted(df.columns)} != {sorted(rel.columns)}")
            if a != b:
                diff = [(x, y) for x, y in zip(a, b) if x != y][:3]
                raise AssertionError(f"{len(a)} vs {len(b)} rows; first differences "
                                     f"{sorted(df.columns)} {diff}")
            if not a:
                print(f"EMPTY {name}")
            tt = {x: type(y).__name__ for x, y in zip(sorted(df.columns), b[0])} if b else {}
            ts = {x: type(y).__name__ for x, y in zip(sorted(df.columns), a[0])} if a else {}
            warn = "" if tt == ts else f" TYPES {[(k, ts[k], tt[k]) for k in tt if tt[k] != ts.get(k)]}"
            print(f"ok    {name:36s} {len(a):7d} {dt:6.2f}s{warn}", flush=True)
        except Exception as e:
            bad.append(name)
            msg = str(e) if isinstance(e, AssertionError) else "".join(traceback.format_exception_only(e))
            print(f"FAIL  {name}: {msg[:1500]}", flush=True)
    print(f"{n} queries, {len(bad)} bad: {bad}")


main(sys.argv[1], sys.argv[2:])

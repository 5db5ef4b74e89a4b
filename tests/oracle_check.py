"""Run registered queries in Spark and their oracles in DuckDB, compare
row count, column names, column kinds and an order-insensitive value hash.

    python tests/oracle_check.py [sf_dir] [name ...]
"""

from __future__ import annotations

import hashlib
import json
import math
import os
import sys
import time

import duckdb
import pandas as pd

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

EXACT_FLOATS = bool(os.environ.get("CHECK_EXACT_FLOATS"))

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        p = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if isinstance(v, float):
        return repr(v + 0.0) if EXACT_FLOATS else repr(round(v, 9) + 0.0)
    if isinstance(v, pd.Timestamp):
        return v.tz_localize(None).isoformat() if v.tzinfo else v.isoformat()
    if hasattr(v, "isoformat"):
        return v.isoformat()
    if hasattr(v, "item"):
        return _norm(v.item())
    return repr(v)


def frame_hash(df: pd.DataFrame) -> str:
    cols = sorted(df.columns)
    rows = sorted("|".join(_norm(r[c]) for c in cols) for r in df[cols].to_dict("records"))
    return hashlib.sha256("\n".join(rows).encode()).hexdigest()


def kind(dtype) -> str:
    s = str(dtype).lower()
    for k in ("int", "float", "bool", "datetime", "object", "string"):
        if k in s:
            return {"object": "str", "string": "str"}.get(k, k)
    return s


def main(argv: list[str]) -> int:
    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    names = argv[1:]
    from vintner.session import get_session
    import __spark_entry__ as E
    spark = get_session("local[8]", shuffle_partitions=8)
    spark.sparkContext.setLogLevel("ERROR")
    if os.environ.get("CHECK_ANSI"):
        spark.conf.set("spark.sql.ansi.enabled", os.environ["CHECK_ANSI"])
    if os.environ.get("CHECK_SESSION_TZ"):
        spark.conf.set("spark.sql.session.timeZone", os.environ["CHECK_SESSION_TZ"])
    qs, ors = E.queries(), E.oracle_sql()
    con = duck(sf_dir)
    report, bad = {}, 0
    for name in names or list(qs):
        t = time.time()
        try:
            s = qs[name](spark, sf_dir).toPandas()
        except Exception as e:  # noqa: BLE001
            report[name] = {"error": f"spark: {type(e).__name__}: {str(e)[:300]}"}
            bad += 1
            print(name, report[name], flush=True)
            continue
        ts = time.time() - t
        if name not in ors:
            report[name] = {"rows": len(s), "oracle": None, "sec": round(ts, 2)}
            print(name, report[name], flush=True)
            continue
        try:
            o = con.execute(ors[name]).df()
        except Exception as e:  # noqa: BLE001
            report[name] = {"error": f"duckdb: {type(e).__name__}: {str(e)[:300]}"}
            bad += 1
            print(name, report[name], flush=True)
            continue
        r = {"rows": (len(s), len(o)), "cols": sorted(s.columns) == sorted(o.columns),
             "kinds": {c: (kind(s[c].dtype), kind(o[c].dtype)) for c in s.columns
                       if c in o.columns and kind(s[c].dtype) != kind(o[c].dtype)},
             "hash": frame_hash(s) == frame_hash(o) if sorted(s.columns) == sorted(o.columns) else False,
             "sec": round(ts, 2)}
        ok = r["rows"][0] == r["rows"][1] and r["cols"] and r["hash"]
        if not ok:
            bad += 1
            if r["cols"] and r["rows"][0] == r["rows"][1]:
                cols = sorted(s.columns)
                ss = s[cols].sort_values(cols).reset_index(drop=True)
                oo = o[cols].sort_values(cols).reset_index(drop=True)
                diff = [(i, c, ss.at[i, c], oo.at[i, c]) for i in range(len(ss)) for c in cols
                        if _norm(ss.at[i, c]) != _norm(oo.at[i, c])][:5]
                r["diff"] = [tuple(map(str, d)) for d in diff]
            else:
                r["spark_cols"], r["oracle_cols"] = list(s.columns), list(o.columns)
        report[name] = r
        print(name, "OK" if ok else "FAIL", r, flush=True)
    print(json.dumps({"failed": bad, "total": len(report)}))
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))

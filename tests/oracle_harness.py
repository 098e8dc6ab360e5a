"""Run a named query in Spark and its SQL twin in DuckDB, compare results.

Usage: python tests/oracle_harness.py [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from causeway.sources.tables import TABLES, table_path  # noqa: E402


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{table_path(sf_dir, t)}')")
    return con


def _norm(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if df[c].dtype == object:
            df[c] = df[c].map(lambda v: v.tolist() if hasattr(v, "tolist") else v)
    df = df.astype({c: "object" for c in df.columns if df[c].dtype == object})
    key = [c for c in df.columns if not isinstance(df[c].iloc[0] if len(df) else 0, (list, dict))]
    return df.sort_values(key, na_position="last", kind="mergesort").reset_index(drop=True)


def _eq(a, b) -> bool:
    if a is None or (isinstance(a, float) and math.isnan(a)):
        return b is None or (isinstance(b, float) and math.isnan(b)) or pd.isna(b)
    if isinstance(a, float) or isinstance(b, float):
        try:
            return float(a) == float(b)
        except (TypeError, ValueError):
            return False
    return a == b


def compare(spark, con, name: str, fn, sql: str, sf_dir: str) -> dict:
    t0 = time.time()
    s = fn(spark, sf_dir).toPandas()
    t1 = time.time()
    d = con.execute(sql).df()
    out = {"name": name, "spark_s": round(t1 - t0, 2), "rows": (len(s), len(d))}
    if sorted(s.columns) != sorted(d.columns):
        out.update(ok=False, why=f"columns {sorted(s.columns)} vs {sorted(d.columns)}")
        return out
    kinds = {c: (s[c].dtype.kind, d[c].dtype.kind) for c in s.columns}
    # pandas has no missing integers: a column with NULLs may come as float from one engine only
    bad_kind = {c: k for c, k in kinds.items()
                if k[0] != k[1] and not (s[c].isna().any() and set(k) <= set("fiO"))}
    if len(s) != len(d):
        out.update(ok=False, why="row count", kinds=bad_kind)
        return out
    s, d = _norm(s), _norm(d)
    mism = []
    for c in s.columns:
        for i, (a, b) in enumerate(zip(s[c].tolist(), d[c].tolist())):
            if not _eq(a, b):
                mism.append((c, i, a, b))
                break
    out.update(ok=not mism and not bad_kind, kinds=bad_kind, mism=mism[:5])
    return out


def main(argv: list[str]) -> int:
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    names = argv[2:]
    import __spark_entry__ as E
    from causeway.session import local_session

    spark = local_session(8, 8)
    con = duck(sf_dir)
    qs, oracle = E.queries(), E.oracle_sql()
    bad = 0
    for name in names or list(qs):
        if name not in oracle:
            t0 = time.time()
            n = qs[name](spark, sf_dir).count()
            print(f"RONLY {name}: rows={n} {time.time() - t0:.1f}s", flush=True)
            continue
        try:
            res = compare(spark, con, name, qs[name], oracle[name], sf_dir)
        except Exception as exc:  # report and continue
            res = {"name": name, "ok": False, "why": repr(exc)[:800]}
        bad += not res.get("ok")
        print(("OK   " if res.get("ok") else "FAIL ") + str(res), flush=True)
    print(f"{len(names or qs) - bad} ok, {bad} failing")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv))

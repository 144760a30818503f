"""Compare registered queries with their SQL in DuckDB: python tests/check.py [sf] [name ...]"""

from __future__ import annotations

import sys
import time

import duckdb
import pandas as pd


def oracle_rows(sql: str, sf_dir: str) -> pd.DataFrame:
    from tidemark.plans.registry import TABLES

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con.execute(sql).fetch_df()


def _cell(v):
    if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and v != v):
        return None
    if isinstance(v, (bool,)) or type(v).__name__ == "bool_":
        return bool(v)
    if hasattr(v, "isoformat"):
        return pd.Timestamp(v).isoformat()
    if hasattr(v, "item"):
        v = v.item()
    if type(v).__name__ == "Decimal":
        v = float(v)
    return v


def canonical(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    rows = [tuple(_cell(v) for v in r) for r in df.astype(object).itertuples(index=False)]
    return sorted(rows, key=lambda r: tuple((v is None, str(type(v).__name__ in ("int", "float")), str(v)) for v in r))


def same(a: list[tuple], b: list[tuple]) -> tuple[bool, str]:
    if len(a) != len(b):
        return False, f"rows {len(a)} vs {len(b)}"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    return not bad, "" if not bad else f"{len(bad)} differ, e.g.\n   spark  {bad[0][0]}\n   oracle {bad[0][1]}"


def compare(spark, name: str, sf_dir: str) -> tuple[bool, str]:
    from __spark_entry__ import oracle_sql, queries

    got = queries()[name](spark, sf_dir)
    types = dict(got.dtypes)
    got = got.toPandas()
    sql = oracle_sql().get(name)
    if sql is None:
        return len(got) > 0, f"rows-only {len(got)}"
    want = oracle_rows(sql, sf_dir)
    if sorted(got.columns) != sorted(want.columns):
        return False, f"columns {sorted(got.columns)} vs {sorted(want.columns)}"
    notes = [c for c in got.columns if types[c] == "int" and str(want[c].dtype).lower() == "int64"]
    ok, msg = same(canonical(got), canonical(want))
    return ok, (msg or f"{len(got)} rows") + (f" [int vs bigint: {notes}]" if notes else "")


if __name__ == "__main__":
    sys.path.insert(0, __file__.rsplit("/", 2)[0])
    from __spark_entry__ import queries
    from tidemark.session import get_session

    args = sys.argv[1:]
    sf = args.pop(0) if args and args[0].startswith("0.") else "0.01"
    spark = get_session("check", "local[8]", 8, "8g")
    spark.sparkContext.setLogLevel("ERROR")
    for q in args or list(queries()):
        t0 = time.time()
        try:
            ok, msg = compare(spark, q, f"/root/testdata/sf{sf}")
        except Exception as e:  # noqa: BLE001
            ok, msg = False, f"{type(e).__name__}: {str(e)[:1500]}"
        print(f"{'ok  ' if ok else 'FAIL'} {q:24s} {time.time() - t0:6.2f}s {msg}", flush=True)

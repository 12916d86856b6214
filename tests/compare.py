"""Runs registered queries against their SQL. `python tests/compare.py [sf] [name-prefix ...]`."""

from __future__ import annotations

import pathlib
import sys
import time

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))

import duckdb
import pandas as pd

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def canonical(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf[sorted(pdf.columns)].copy()
    for c in pdf.columns:
        if str(pdf[c].dtype).startswith("datetime"):
            pdf[c] = pdf[c].astype("datetime64[us]")
    return pdf.sort_values(list(pdf.columns), kind="stable", na_position="last").reset_index(drop=True)


def difference(spark_pdf: pd.DataFrame, sql_pdf: pd.DataFrame) -> str | None:
    """None when equal, else what differs."""
    if sorted(spark_pdf.columns) != sorted(sql_pdf.columns):
        return f"columns {sorted(spark_pdf.columns)} != {sorted(sql_pdf.columns)}"
    if len(spark_pdf) != len(sql_pdf):
        return f"rows {len(spark_pdf)} != {len(sql_pdf)}"
    a, b = canonical(spark_pdf), canonical(sql_pdf)
    for c in a.columns:
        if str(a[c].dtype) != str(b[c].dtype):
            kinds = {str(a[c].dtype), str(b[c].dtype)}
            if kinds != {"object", "str"} and not (a[c].isna().any() or b[c].isna().any()):
                return f"type of {c}: {a[c].dtype} != {b[c].dtype}"
        same = (a[c] == b[c]) | (a[c].isna() & b[c].isna())
        if not same.all():
            i = same.idxmin()
            return f"{(~same).sum()} values of {c}, first {a[c][i]!r} != {b[c][i]!r}"
    return None


def main() -> int:
    from backuplake.plans import load
    from backuplake.session import build_session

    sf, prefixes = (sys.argv[1] if len(sys.argv) > 1 else "0.01"), tuple(sys.argv[2:])
    sf_dir = f"/root/testdata/sf{sf}"
    spark = build_session(master="local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false", spark__driver__memory="12g")
    spark.sparkContext.setLogLevel("ERROR")
    queries, oracles = load()
    con, bad = connect(sf_dir), 0
    for name, fn in queries.items():
        if prefixes and not name.startswith(prefixes):
            continue
        t = time.time()
        try:
            got = fn(spark, sf_dir).toPandas()
            took = time.time() - t
            if name in oracles:
                t = time.time()
                problem = difference(got, con.execute(oracles[name]).df())
                note = f"sql {time.time() - t:.1f}s"
            else:
                problem, note = None, "rows only"
        except Exception as e:
            problem, note, took, got = f"{type(e).__name__}: {str(e)[:600]}", "", time.time() - t, []
        bad += problem is not None
        print(f"{'FAIL' if problem else 'ok  '} {name:34s} {len(got):7d} rows {took:6.2f}s {note} {problem or ''}", flush=True)
    print(f"{bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(min(main(), 1))

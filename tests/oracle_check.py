"""Compare registered queries with their SQL on DuckDB: columns, row count, values."""

from __future__ import annotations

import math
import pathlib
import sys
import time

import duckdb
import pandas as pd

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(root: str):
    con = duckdb.connect()
    for name in TABLES:
        if pathlib.Path(f"{root}/{name}.parquet").exists():
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{root}/{name}.parquet')")
    return con


def _cell(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
        return "NULL"
    if isinstance(v, bool) or type(v).__name__ == "bool_":
        return str(bool(v))
    if isinstance(v, float):
        return repr(int(v)) if v.is_integer() else repr(round(v, 9))
    if isinstance(v, pd.Timestamp):
        return v.isoformat()
    return str(v)


def rows_of(pdf: pd.DataFrame):
    pdf = pdf[sorted(pdf.columns)].astype(object)
    return sorted(tuple(_cell(v) for v in row) for row in pdf.itertuples(index=False))


def differences(ours: pd.DataFrame, theirs: pd.DataFrame) -> list[str]:
    if sorted(ours.columns) != sorted(theirs.columns):
        return [f"columns {sorted(ours.columns)} != {sorted(theirs.columns)}"]
    a, b = rows_of(ours), rows_of(theirs)
    out = [] if len(a) == len(b) else [f"rows {len(a)} != {len(b)}"]
    if a != b:
        left, right = set(a), set(b)
        out += [f"only ours: {r}" for r in sorted(left - right)[:3]]
        out += [f"only sql:  {r}" for r in sorted(right - left)[:3]]
        out = out or ["row multiplicity differs"]
    kinds = [f"{c}: {ours[c].dtype} vs {theirs[c].dtype}" for c in sorted(ours.columns) if ours[c].dtype != theirs[c].dtype]
    if kinds and "-v" in sys.argv:
        print("   types", kinds)
    return out


if __name__ == "__main__":
    sys.path.insert(0, str(pathlib.Path(__file__).resolve().parent.parent))
    from __spark_entry__ import oracle_sql, queries
    from vocale.session import build_session

    args = [a for a in sys.argv[1:] if not a.startswith("-")]
    root = f"/root/testdata/{args[0]}"
    spark = build_session("check", 8)
    con = connect(root)
    oracles = oracle_sql()
    bad = 0
    for name, fn in queries().items():
        if args[1:] and name not in args[1:]:
            continue
        t0 = time.time()
        try:
            ours = fn(spark, root).toPandas()
            seconds = time.time() - t0
            if name not in oracles:
                print(f"rows {name:26s} {len(ours):7d} {seconds:6.2f}s", flush=True)
                continue
            diff = differences(ours, con.execute(oracles[name]).df())
        except Exception as exc:
            diff, seconds, ours = [f"{type(exc).__name__}: {str(exc)[:1500]}"], time.time() - t0, []
        print(f"{'BAD ' if diff else 'ok  '} {name:26s} {len(ours):7d} {seconds:6.2f}s", *diff, sep="\n     " if diff else " ", flush=True)
        bad += bool(diff)
    print("bad:", bad)

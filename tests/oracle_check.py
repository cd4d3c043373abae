"""Run registered queries beside their SQL and compare rows (also usable from the shell)."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _cell(v):
    if v is None:
        return "~"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return "~" if math.isnan(v) else f"{v:.9g}"
    return str(v)


def rows_of(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_cell(r[i]) for i in order) for r in records)


def compare(spark, con, name, sf_dir, queries, oracle):
    t0 = time.time()
    df = queries[name](spark, sf_dir)
    got_cols, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    t1 = time.time()
    if name not in oracle:
        return True, f"rows-only {len(got)} rows ({t1 - t0:.1f}s)"
    cur = con.execute(oracle[name])
    want_cols, want = rows_of([d[0] for d in cur.description], cur.fetchall())
    t2 = time.time()
    if got_cols != want_cols:
        return False, f"columns differ {got_cols} / {want_cols}"
    if got != want:
        a, b = set(got), set(want)
        return False, f"rows differ {len(got)} / {len(want)}\n   spark {sorted(a - b)[:3]}\n   sql   {sorted(b - a)[:3]}"
    return True, f"{len(got)} rows match (spark {t1 - t0:.1f}s, sql {t2 - t1:.1f}s)"


if __name__ == "__main__":
    import __spark_entry__ as entry
    from pactlane.session import local_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:] or list(entry.queries())
    session, con = local_session(), connect(folder)
    for q in wanted:
        try:
            ok, note = compare(session, con, q, folder, entry.queries(), entry.oracle_sql())
        except Exception as exc:  # noqa: BLE001
            ok, note = False, f"{type(exc).__name__}: {str(exc)[:600]}"
        print("OK  " if ok else "FAIL", q, note, flush=True)

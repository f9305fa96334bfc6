"""Runs a registered query on Spark and its check SQL on DuckDB, and compares whole results."""

from __future__ import annotations

import glob
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.01")


def connect(sf_dir: str = SF) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def canonical(rows: list[tuple], columns: list[str]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(repr(r[i]) for i in order) for r in rows))


def compare(query, spark, con, sf_dir: str = SF) -> str | None:
    """None when equal, else a short description of the difference."""
    df = query.run(spark, sf_dir)
    ours = canonical([tuple(r) for r in df.collect()], df.columns)
    if query.sql is None:
        return None if ours else "no rows"
    result = con.execute(query.sql)
    names = [d[0] for d in result.description]
    theirs = canonical(result.fetchall(), names)
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} vs {sorted(names)}"
    if len(ours) != len(theirs):
        return f"{len(ours)} rows vs {len(theirs)}; first ours {ours[:1]} theirs {theirs[:1]}"
    bad = [(a, b) for a, b in zip(ours, theirs) if a != b]
    return f"{len(bad)} of {len(ours)} rows differ; first {bad[0]}" if bad else None


if __name__ == "__main__":
    from conftest import make_session
    from fillcast.catalog import REGISTRY

    spark, con = make_session(), connect()
    wanted = sys.argv[1:]
    failed = 0
    for name, q in REGISTRY.items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        t = time.time()
        try:
            problem = compare(q, spark, con)
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        failed += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {time.time() - t:6.1f}s {name}{'' if q.sql else ' (no SQL)'} {problem or ''}", flush=True)
    print("failed:", failed)

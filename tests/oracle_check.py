"""Compare registered queries with their SQL: ``python tests/oracle_check.py <dir> [names]``."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from __spark_entry__ import oracle_sql, queries  # noqa: E402
from ticketmill.session import local_session  # noqa: E402


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def rows(columns: list[str], data) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(r[i] for i in order) for r in data), key=repr)


def compare(spark, con, name: str, sf_dir: str) -> str | None:
    """None when equal, else a short description of the difference."""
    df = queries()[name](spark, sf_dir)
    got = rows(df.columns, df.collect())
    cur = con.execute(oracle_sql()[name])
    names = [d[0] for d in cur.description]
    want = rows(names, cur.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    if len(got) != len(want):
        extra = [r for r in got if r not in set(want)][:2] if len(got) < 20000 else ""
        return f"rows {len(got)} != {len(want)} {str(extra)[:500]}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    return f"{len(bad)} of {len(got)} rows differ: {str(bad[0])[:900]}" if bad else None


if __name__ == "__main__":
    folder, chosen = sys.argv[1], sys.argv[2:] or list(oracle_sql())
    session, con_ = local_session(), connect(folder)
    session.sparkContext.setLogLevel("ERROR")
    failed = 0
    for query_name in chosen:
        start = time.time()
        try:
            diff = compare(session, con_, query_name, folder)
        except Exception as error:  # report and go on with the next query
            diff = f"{type(error).__name__}: {str(error)[:700]}"
        failed += diff is not None
        print(f"{query_name:22s} {time.time() - start:6.1f}s {'ok' if diff is None else diff}", flush=True)
    print(f"{len(chosen) - failed} of {len(chosen)} equal")

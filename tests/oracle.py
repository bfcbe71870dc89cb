"""Run queries next to their SQL in DuckDB and compare rows.

    python tests/oracle.py [sf_dir] [name ...]
"""

from __future__ import annotations

import sys
import time
import traceback
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

SMALL = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _cell(value):
    if value is None or (isinstance(value, float) and value != value):
        return None
    if isinstance(value, bool):
        return int(value)
    if hasattr(value, "item"):
        value = value.item()
    return value


def _rows(columns: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_cell(r[i]) for i in order) for r in rows), key=repr)


def compare(spark_df, sql: str, con: duckdb.DuckDBPyConnection) -> str | None:
    """None if both give the same rows, else what differs."""
    got = _rows(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    want = _rows(names, result.fetchall())
    if sorted(spark_df.columns) != sorted(names):
        return f"columns {sorted(spark_df.columns)} != {sorted(names)}"
    if len(got) != len(want):
        return f"{len(got)} rows, expected {len(want)}"
    if got == want and repr(got) != repr(want):
        kinds = [(a, b) for x, y in zip(got, want) for a, b in zip(x, y) if type(a) is not type(b)]
        return f"types differ: {kinds[:3]}" if kinds else None
    if got != want:
        wrong = [(a, b) for a, b in zip(got, want) if a != b]
        return f"{len(wrong)} rows differ, first: spark {wrong[0][0]} sql {wrong[0][1]} (columns {sorted(names)})"
    return None if got else "both empty"


def main() -> None:
    import __spark_entry__ as entry
    from casewise.session import local_session

    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    spark, con = local_session(), connect(sf_dir)
    queries, sql = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in args or queries:
        start = time.time()
        try:
            df = queries[name](spark, sf_dir)
            if name in sql:
                note = compare(df, sql[name], con) or "ok"
            else:
                note = f"ok, {len(df.collect())} rows, no SQL"
        except Exception as error:  # report and go on with the next query
            note = f"ERROR {type(error).__name__}: {str(error)[:700]}"
            if "-v" in sys.argv:
                traceback.print_exc()
        bad += not note.startswith("ok")
        print(f"{time.time() - start:6.2f}s {name}: {note}", flush=True)
    print(f"{bad} failed", flush=True)


if __name__ == "__main__":
    main()

"""Compare registered queries with their SQL twins: python -m tests.oracle [sf] [name pattern ...]."""

from __future__ import annotations

import math
import re
import sys
import time
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
DATA = Path("/root/testdata")
KINDS = {"long": "BIGINT", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def duck(sf_dir: Path) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _key(row):
    return [(v is None, str(type(v)), v if v is not None else 0) for v in row]


def _norm(v):
    if isinstance(v, float) and math.isnan(v):
        return "nan"
    if isinstance(v, float):
        return repr(v)
    return v


def differences(df, con, sql: str) -> list[str]:
    """Empty list when row count, column names, types and values agree."""
    problems = []
    rel = con.sql(sql)
    columns = sorted(rel.columns)
    if columns != sorted(df.columns):
        return [f"columns {sorted(df.columns)} != {columns}"]
    kinds = dict(zip(rel.columns, [str(t) for t in rel.types]))
    for f in df.schema.fields:
        want = KINDS.get(f.dataType.simpleString(), f.dataType.simpleString())
        if kinds[f.name] != want:
            problems.append(f"type of {f.name}: {f.dataType.simpleString()} vs {kinds[f.name]}")
    ours = sorted(
        ([r[c] for c in columns] for r in (row.asDict() for row in df.collect())), key=_key
    )
    index = [rel.columns.index(c) for c in columns]
    theirs = sorted(([row[i] for i in index] for row in rel.fetchall()), key=_key)
    if len(ours) != len(theirs):
        problems.append(f"rows {len(ours)} != {len(theirs)}")
    bad = [(a, b) for a, b in zip(ours, theirs) if [_norm(x) for x in a] != [_norm(x) for x in b]]
    if bad:
        problems.append(f"{len(bad)} rows differ, e.g. {columns}: {bad[0][0]} vs {bad[0][1]}")
    return problems


def main(argv: list[str]) -> int:
    import __spark_entry__ as entry
    from tests.conftest import build_session

    sf = argv[0] if argv else "sf0.01"
    patterns = argv[1:] or ["."]
    spark = build_session()
    con = duck(DATA / sf)
    oracles = entry.oracle_sql()
    failed = 0
    for name, run in entry.queries().items():
        if not any(re.search(p, name) for p in patterns):
            continue
        start = time.time()
        try:
            df = run(spark, str(DATA / sf))
            problems = differences(df, con, oracles[name]) if name in oracles else [] if df.count() else ["no rows"]
            note = "" if name in oracles else f" (rows only: {df.count()})"
        except Exception as error:
            problems, note = [f"{type(error).__name__}: {str(error)[:1200]}"], ""
        failed += bool(problems)
        print(f"{'FAIL' if problems else 'ok  '} {name} {time.time() - start:.1f}s{note}", *problems, sep="\n   " if problems else "", flush=True)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)

"""Compare every checked query with its SQL twin: ``python -m evisift_checks.compare [dir] [name ...]``."""

from __future__ import annotations

import datetime
import math
import sys
import time
from pathlib import Path

import duckdb

from evisift.session import local_session
from evisift_checks.queries import ORACLE, QUERIES


def normal(value):
    if isinstance(value, bool) or value is None:
        return str(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if hasattr(value, "as_integer_ratio") and not isinstance(value, int):
        return repr(float(value))
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(normal(row[i]) for i in order) for row in rows)


def compare(spark, con, name: str, sf_dir: str) -> str:
    started = time.time()
    frame = QUERIES[name](spark, sf_dir)
    ours = rows_of(frame.columns, frame.collect())
    took = time.time() - started
    if name not in ORACLE:
        return f"{name}: {len(ours)} rows, no twin, {took:.1f}s"
    started = time.time()
    cursor = con.execute(ORACLE[name])
    columns = [d[0] for d in cursor.description]
    theirs = rows_of(columns, cursor.fetchall())
    twin = time.time() - started
    if sorted(columns) != sorted(frame.columns):
        return f"{name}: MISMATCH columns {sorted(columns)} {sorted(frame.columns)}"
    if ours == theirs:
        return f"{name}: ok {len(ours)} rows, {took:.1f}s, twin {twin:.1f}s"
    only_ours, only_theirs = set(ours) - set(theirs), set(theirs) - set(ours)
    sample = f"\n   ours   {sorted(only_ours)[:2]}\n   theirs {sorted(only_theirs)[:2]}"
    return f"{name}: MISMATCH {len(ours)} vs {len(theirs)} rows, {len(only_ours)}/{len(only_theirs)} differ{sample}"


def connect(sf_dir: str):
    con = duckdb.connect()
    for path in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(QUERIES)
    spark = local_session("8", **{"spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad = 0
    for name in names:
        try:
            told = compare(spark, con, name, sf_dir)
        except Exception as failure:  # report and go on with the next query
            told = f"{name}: ERROR {str(failure)[:1500]}"
        bad += ": ok" not in told
        print(told, flush=True)
    print(f"{len(names) - bad} of {len(names)} match")


if __name__ == "__main__":
    main()

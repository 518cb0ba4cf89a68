"""Run named queries against their SQL in DuckDB. Usage: oracle_check.py [sf_dir] [query ...]"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
import __spark_entry__ as entry  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _value(v):
    if isinstance(v, float) and math.isnan(v):
        return "NaN"
    return repr(v)


def compare(spark, con, name: str, sf_dir: str) -> str:
    """Empty text when columns, types and the multiset of rows agree."""
    frame = entry.queries()[name](spark, sf_dir)
    columns = sorted(frame.columns)
    got = sorted(tuple(_value(v) for v in row) for row in frame.select(columns).collect())
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return "" if got else "no rows"
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    if sorted(names) != columns:
        return f"columns {columns} != {sorted(names)}"
    order = [names.index(c) for c in columns]
    rows = result.fetchall()
    want = sorted(tuple(_value(row[i]) for i in order) for row in rows)
    kinds = {d[0]: str(d[1]).upper() for d in result.description}
    expected = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    for c, kind in frame.dtypes:
        if kind in expected and kinds[c] not in (expected[kind], "STRING", "NUMBER", "BOOL"):
            return f"type of {c}: {kind} != {kinds[c]}"
    if got == want:
        return ""
    diff = [(a, b) for a, b in zip(got, want) if a != b][:2]
    return f"{len(got)} rows != {len(want)} rows; columns {columns}; first differences {str(diff)[:900]}"


def main() -> int:
    from pairsight.session import local_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    names = sys.argv[2:] or list(entry.queries())
    spark, con = local_session("oracle-check"), connect(sf_dir)
    bad = 0
    for name in names:
        start = time.time()
        try:
            problem = compare(spark, con, name, sf_dir)
        except Exception as error:  # report and go on with the next query
            problem = f"{type(error).__name__}: {str(error)[:1200]}"
        kind = "sql" if name in entry.oracle_sql() else "rows"
        print(f"{'ok  ' if not problem else 'FAIL'} {kind} {name} {time.time() - start:.1f}s {problem}", flush=True)
        bad += bool(problem)
    print(f"{bad} of {len(names)} differ")
    return bad


if __name__ == "__main__":
    sys.exit(main())

"""Compare registered queries with their SQL on one of the supplied folders.

python tests/oracle.py FOLDER [NAME ...]
"""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from caseweave.operators.scale import run_scope  # noqa: E402


def connection(folder: str):
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def canonical(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6) + 0.0
    return str(value) if value is not None and not isinstance(value, (int, bool, str)) else value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(canonical(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, folder: str, query, sql: str) -> str:
    """Empty when equal, else a short description of the difference."""
    with run_scope(spark):
        df = query(spark, folder)
        left = rows_of(df.columns, [tuple(r) for r in df.collect()])
    result = con.execute(sql)
    columns = [c[0] for c in result.description]
    right = rows_of(columns, result.fetchall())
    if sorted(df.columns) != sorted(columns):
        return f"columns {sorted(df.columns)} against {sorted(columns)}"
    kinds = {"INTEGER": "int", "BIGINT": "bigint", "HUGEINT": "hugeint", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean", "DATE": "date", "TIMESTAMP": "timestamp_ntz"}
    types = {c[0]: kinds.get(str(c[1]), str(c[1])) for c in result.description}
    odd = {c: (t, types[c]) for c, t in df.dtypes if t != types[c] and not (t == "timestamp" and types[c] == "timestamp_ntz")}
    if odd:
        return f"types {odd}"
    if len(left) != len(right):
        return f"{len(left)} rows against {len(right)}"
    different = [(a, b) for a, b in zip(left, right) if a != b]
    return f"{len(different)} of {len(left)} rows differ, first {different[0]}" if different else ""


if __name__ == "__main__":
    from conftest import make_session

    from caseweave.plans.catalog import registered

    folder, names = sys.argv[1], sys.argv[2:]
    spark = make_session()
    con = connection(folder)
    for name, (query, sql) in registered().items():
        if names and name not in names:
            continue
        started = time.time()
        try:
            outcome = compare(spark, con, folder, query, sql) if sql else f"rows only: {query(spark, folder).count()}"
        except Exception as problem:
            outcome = f"ERROR {type(problem).__name__}: {str(problem)[:1500]}"
        print(f"{name:28s} {time.time() - started:7.2f}s {outcome or 'ok'}", flush=True)

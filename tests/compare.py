"""Compare every query with its SQL on one scale. Usage: python tests/compare.py [folder] [names]"""

from __future__ import annotations

import datetime
import glob
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.9g}")
    if isinstance(value, bool):
        return value
    if isinstance(value, int):
        return float(value)
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    if hasattr(value, "as_tuple"):
        return float(value)
    return value


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    names = [columns[i] for i in order]
    return names, sorted((tuple(_cell(r[i]) for i in order) for r in rows), key=repr)


def duck(folder):
    connection = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return connection


def expected(connection, sql):
    cursor = connection.execute(sql)
    return normal([d[0] for d in cursor.description], cursor.fetchall())


def actual(df):
    return normal(df.columns, [tuple(r) for r in df.collect()])


def difference(left, right):
    if left[0] != right[0]:
        return f"columns {left[0]} / {right[0]}"
    if left[1] == right[1]:
        return None
    extra = [r for r in left[1] if r not in set(right[1])][:2]
    lacking = [r for r in right[1] if r not in set(left[1])][:2]
    return f"rows {len(left[1])} / {len(right[1])}; only here {extra}; only in SQL {lacking}"


if __name__ == "__main__":
    from __spark_entry__ import oracle_sql, queries
    from lodgecast.session import local_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    names = sys.argv[2:] or list(queries())
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    connection = duck(folder)
    for name in names:
        start = time.time()
        try:
            result = actual(queries()[name](spark, folder))
            took = time.time() - start
            if name in oracle_sql():
                verdict = difference(result, expected(connection, oracle_sql()[name])) or "same"
            else:
                verdict = "rows only"
        except Exception as error:  # noqa: BLE001
            took, result, verdict = time.time() - start, ([], []), f"ERROR {str(error)[:600]}"
        print(f"{name}: {verdict} ({len(result[1])} rows, {took:.1f} s)", flush=True)

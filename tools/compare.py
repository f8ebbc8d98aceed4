"""Run named queries on Spark and their SQL twins on DuckDB and compare the rows.

    python tools/compare.py [--sf 0.01] [name or prefix ...]
"""

from __future__ import annotations

import argparse
import math
import pathlib
import sys
import time

import duckdb
from pyspark.sql import SparkSession

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parent.parent))
from loanloom.catalog import REGISTRY  # noqa: E402
from loanloom.session import build_session  # noqa: E402

TESTDATA = pathlib.Path("/root/testdata")


def _plain(value):
    if value is None or isinstance(value, (str, bool)):
        return value
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value + 0.0
    return float(value) if hasattr(value, "as_tuple") else value


def normalise(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr), sorted(columns)


def duck(folder: pathlib.Path) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for path in sorted(folder.glob("*.parquet")):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


def compare(spark: SparkSession, connection, name: str, folder: str) -> tuple[bool, str]:
    query = REGISTRY[name]
    start = time.time()
    df = query(spark, folder)
    got_rows = [tuple(r) for r in df.collect()]
    spent = time.time() - start
    if query.sql is None:
        return True, f"{len(got_rows)} rows, no twin, {spent:.1f}s"
    relation = connection.execute(query.sql)
    want_columns = [c[0] for c in relation.description]
    want, want_columns = normalise(relation.fetchall(), want_columns)
    got, got_columns = normalise(got_rows, df.columns)
    if got_columns != want_columns:
        extra, lacking = set(got_columns) - set(want_columns), set(want_columns) - set(got_columns)
        return False, f"columns differ: only here {sorted(extra)[:8]}, only in SQL {sorted(lacking)[:8]}"
    if len(got) != len(want):
        return False, f"{len(got)} rows here, {len(want)} in SQL"
    for a, b in zip(got, want):
        if repr(a) != repr(b):
            where = [(c, x, y) for c, x, y in zip(got_columns, a, b) if repr(x) != repr(y)]
            return False, f"rows differ: {where[:6]}"
    return True, f"{len(got)} rows x {len(got_columns)}, {spent:.1f}s"


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("names", nargs="*")
    parser.add_argument("--sf", default="0.01")
    args = parser.parse_args()
    folder = TESTDATA / f"sf{args.sf}"
    names = [n for n in REGISTRY if not args.names or any(n == a or n.startswith(a) for a in args.names)]
    spark = build_session("compare", "local[8]", spark__sql__shuffle__partitions=8, spark__ui__enabled="false",
                          spark__driver__memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    connection, failed = duck(folder), []
    for name in names:
        try:
            ok, note = compare(spark, connection, name, str(folder))
        except Exception as error:  # report and go on to the next query
            ok, note = False, f"{type(error).__name__}: {str(error)[:600]}"
        print("ok  " if ok else "FAIL", name, note, flush=True)
        if not ok:
            failed.append(name)
    print(f"{len(names) - len(failed)}/{len(names)} agree", "" if not failed else f"failed: {failed}")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())

"""Run registered queries and their oracles side by side: ``python -m verification.compare``."""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time
from collections import Counter

import duckdb

from verification import fields, jobs, scans, statistics  # noqa: F401
from verification.base import ORACLES, QUERIES

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 12) + 0.0
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, (datetime.date, datetime.datetime)):
        return value.isoformat()
    return value


def multiset(names: list[str], rows) -> Counter:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(plain(row[i]) for i in order) for row in rows)


TYPES = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string",
         "BOOLEAN": "boolean"}


def compare(spark, connection, name: str, sf_dir: str) -> str | None:
    """None when the results are equal, else a description of the difference."""
    found = QUERIES[name](spark, sf_dir)
    got = multiset(found.columns, [tuple(row) for row in found.collect()])
    if name not in ORACLES:
        return None if got else "no rows"
    result = connection.execute(ORACLES[name])
    columns = [d[0] for d in result.description]
    expected = multiset(columns, result.fetchall())
    if sorted(columns) != sorted(found.columns):
        return f"columns {sorted(found.columns)} vs {sorted(columns)}"
    kinds = {d[0]: TYPES.get(str(d[1]), str(d[1])) for d in result.description}
    different = [f"{c}: {t} vs {kinds[c]}" for c, t in found.dtypes if t != kinds[c]]
    if different:
        return f"types {different}"
    if not expected:
        return "the oracle has no rows"
    if got == expected:
        return None
    extra, missing = got - expected, expected - got
    return (
        f"{sum(got.values())} vs {sum(expected.values())} rows; only Spark "
        f"{list(extra)[:2]} ({sum(extra.values())}); only oracle {list(missing)[:2]} "
        f"({sum(missing.values())})"
    )


def main() -> int:
    from pyspark.sql import SparkSession

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    chosen = sys.argv[2:] or list(QUERIES)
    spark = (
        SparkSession.builder.master("local[8]").appName("compare")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    connection, failed = connect(sf_dir), 0
    for name in chosen:
        start = time.time()
        try:
            problem = compare(spark, connection, name, sf_dir)
        except Exception as error:  # a failing query must not hide the others
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        failed += problem is not None
        print(f"{'FAIL' if problem else 'ok  '} {name} {time.time() - start:.1f}s {problem or ''}",
              flush=True)
    print(f"{len(chosen) - failed} of {len(chosen)} equal")
    return min(failed, 1)


if __name__ == "__main__":
    sys.exit(main())

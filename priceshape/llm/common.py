"""What the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query, with a DuckDB equivalent where SQL can express it."""

    def register(made: Query) -> Query:
        QUERIES[name] = made
        if sql is not None:
            ORACLES[name] = sql
        return made

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def col(name: str) -> Column:
    """Column of exactly this name, dots and blanks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def slices(batches, rows: int = 256):
    """Arrow batches cut into small ones, so that what a task makes of them stays small."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def map_rows(rows: DataFrame, task) -> DataFrame:
    """``mapInArrow`` to the same columns, which may have any names (``task`` goes by position)."""
    plain = rows.toDF(*[f"_c{i}" for i in range(len(rows.columns))])
    return plain.mapInArrow(task, plain.schema).toDF(*rows.columns)

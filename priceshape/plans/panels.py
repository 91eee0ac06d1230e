"""Stored monthly reports that follow the store: only months that an upsert touched are made anew.

A growth rate pairs a month with the same month a year before, so a changed observation reaches its own
month and the one a year later. Reports of a month need no other month, so those two, of every changed
observation, are computed from four months of observations at most, whatever the length of the history.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from priceshape.functions.periods import normalize_period
from priceshape.schemas import Tables
from priceshape.scratch import pin

Report = Callable[..., DataFrame]


def touched_months(changed: set[tuple[int, str]]) -> set[tuple[int, str]]:
    """Months whose growth rates depend on changed observations (year, period)."""
    months = {f"M{m:02d}" for m in range(1, 13)}
    own = {(year, period.strip().upper()) for year, period in changed}
    return {(y, p) for year, p in own if p in months for y in (year, year + 1)}


def _of(observations: DataFrame, months: set[tuple[int, str]]) -> DataFrame:
    """Observations of some months, by conditions on the columns that the files are laid out by."""
    years: dict[int, list[str]] = {}
    for year, period in sorted(months):
        years.setdefault(year, []).append(period)
    wanted = F.lit(False)
    for year, periods in years.items():
        wanted = wanted | ((F.col("year") == year) & normalize_period(F.col("period")).isin(periods))
    return observations.filter(wanted)


class MonthlyReport:
    """The rows of ``reports.panel`` or ``reports.metrics_timeseries`` kept as Parquet, a folder per month.

    ``options`` go to the report. Months outside ``start`` to ``end`` are never made.
    """

    def __init__(self, spark: SparkSession, root: str, report: Report, start: str, end: str, **options):
        self.spark, self.root, self.report = spark, root.rstrip("/"), report
        self.start, self.end, self.options = start, end, options

    def rebuild(self, tables: Tables) -> None:
        """All months anew."""
        rows = pin(self.report(tables, self.start, self.end, **self.options), "report")
        self._write(rows, {r["date"] for r in rows.select("date").distinct().collect()} | self._months())

    def refresh(self, tables: Tables, changed: set[tuple[int, str]]) -> set[str]:
        """Follow changed observations (year, period), as ``Store.upsert_observations`` gives them; returns
        the months made anew. A month that has no rows any more is emptied."""
        months = {(y, p) for y, p in touched_months(changed) if self.start <= f"{y}-{p[1:]}" <= self.end}
        if not months:
            return set()
        needed = months | {(y - 1, p) for y, p in months}
        labels = {f"{y}-{p[1:]}" for y, p in months}
        near = replace(tables, observation=_of(tables.observation, needed))
        rows = self.report(near, min(labels), max(labels), **self.options).filter(F.col("date").isin(sorted(labels)))
        self._write(pin(rows, "report"), labels)
        return labels

    def read(self) -> DataFrame:
        return self.spark.read.parquet(self.root).drop("month")

    def _months(self) -> set[str]:
        try:
            stored = self.spark.read.schema("month string").parquet(self.root)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return set()
        return {r["month"] for r in stored.select("month").distinct().collect()}

    def _write(self, rows: DataFrame, months: set[str]) -> None:
        """``rows`` in place of all that is stored of ``months``."""
        rows.withColumn("month", F.col("date")).hint("rebalance", "month").write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic").partitionBy("month").parquet(self.root)
        kept = {r["date"] for r in rows.select("date").distinct().collect()}
        none = self.spark.createDataFrame([], T.StructType(rows.schema.fields))
        for month in sorted(months - kept):
            none.write.mode("overwrite").parquet(f"{self.root}/month={month}")

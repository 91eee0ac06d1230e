"""Column functions over (year, period code) pairs."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from priceshape.functions.fields import strip


def normalize_period(period: Column) -> Column:
    return F.upper(strip(period))


def period_rank(period: Column) -> Column:
    """Digits after the first character as a number, 0 when there are none."""
    code = normalize_period(period)
    digits = code.substr(F.lit(2), F.length(code)).try_cast("int")
    return F.when(code.rlike("^.[0-9]+$"), digits).otherwise(F.lit(0))


def period_sort_key(year: Column, period: Column) -> Column:
    """Struct ordered by year, then rank, then code."""
    return F.struct(
        year.alias("year"),
        period_rank(period).alias("rank"),
        normalize_period(period).alias("code"),
    )


def period_date(year: Column, period: Column) -> Column:
    """Date of an observation; annual averages fall on 31 December, unknown codes on 1 January."""
    number = F.substring(period, 2, 2).try_cast("int")
    month = (
        F.when(period.rlike("^M(0[1-9]|1[0-2])$"), number)
        .when(period.isin("M13", "S03"), F.lit(12))
        .when(period.rlike("^Q0[1-4]$"), (number - 1) * 3 + 1)
        .when(period == "S02", F.lit(7))
        .otherwise(F.lit(1))
    )
    day = F.when(period.isin("M13", "S03"), F.lit(31)).otherwise(F.lit(1))
    return F.make_date(year, month, day)


def month_date(year: Column, period: Column) -> Column:
    """First day of the month for M01-M12, else NULL."""
    is_month = period.rlike("^M(0[1-9]|1[0-2])$")
    month = F.when(is_month, F.substring(period, 2, 2).try_cast("int")).otherwise(F.lit(1))
    return F.when(is_month, F.make_date(year, month, F.lit(1)))


def period_label(year: Column, period: Column) -> Column:
    """``YYYY-MM`` for codes of M and digits (M13 gives ``YYYY-13``), else ``YYYY-code``."""
    code = normalize_period(period)
    digits = code.substr(F.lit(2), F.length(code)).try_cast("int")
    return F.when(code.rlike("^M[0-9]+$"), F.format_string("%d-%02d", year, digits)).otherwise(
        F.concat_ws("-", year.cast("string"), code)
    )


def is_annual(period: Column) -> Column:
    return F.upper(period).rlike("^[MR]13")


def parse_month(text: str) -> tuple[int, str, dt.date]:
    """``YYYY-MM`` argument -> (year, month code, first day); ValueError otherwise."""
    match = re.fullmatch(r"(\d{4})-(\d{1,2})", text)
    if not match:
        raise ValueError(f"{text!r} is not a month; write it like 2024-06")
    first = dt.date(int(match[1]), int(match[2]), 1)
    return first.year, f"M{first.month:02d}", first


def month_sequence(spark: SparkSession, start: str, end: str) -> DataFrame:
    """One row (year, period, date label) per month from ``start`` to ``end``, both included."""
    _, _, first = parse_month(start)
    _, _, last = parse_month(end)
    if first > last:
        raise ValueError(f"start {start} is after end {end}")
    months = spark.range(1).select(
        F.explode(
            F.sequence(F.lit(first), F.lit(last), F.expr("interval 1 month"))
        ).alias("month")
    )
    return months.select(
        F.year("month").alias("year"),
        F.date_format("month", "'M'MM").alias("period"),
        F.date_format("month", "yyyy-MM").alias("date"),
    )


def in_month_range(year: Column, period: Column, start: str, end: str) -> Column:
    """Predicate for months of a closed range, in a form a partitioned scan can prune on year."""
    start_year, start_code, first = parse_month(start)
    end_year, end_code, last = parse_month(end)
    if first > last:
        raise ValueError(f"start {start} is after end {end}")
    return (
        year.between(start_year, end_year)
        & period.rlike("^M(0[1-9]|1[0-2])$")
        & ((year > start_year) | (period >= start_code))
        & ((year < end_year) | (period <= end_code))
    )


def latest_month_text(observations: DataFrame) -> DataFrame:
    """Latest (year, month code) by the text ``year-dd`` of all observations."""
    text = F.concat_ws("-", F.col("year").cast("string"), F.expr("right(period, 2)"))
    return observations.agg(F.max(text).alias("ym")).select(
        F.substring("ym", 1, 4).cast("int").alias("year"),
        F.concat(F.lit("M"), F.substring("ym", 6, 2)).alias("period"),
    )

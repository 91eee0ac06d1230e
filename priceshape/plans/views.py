"""Detail views and the documented sample queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from priceshape.functions.periods import month_date, parse_month, period_date
from priceshape.operators.filters import detail_filter, selectable_items
from priceshape.operators.growth import lagged_growth
from priceshape.schemas import Tables


def series_details(tables: Tables) -> DataFrame:
    """observation x series x item with the observation's date.

    The small tables are joined first, so observations meet them once, by series.
    """
    dims = tables.series.join(tables.item, "item_code")
    return tables.observation.join(dims, "series_id").withColumn(
        "date", period_date(F.col("year"), F.col("period"))
    )


def series_view(
    tables: Tables,
    *,
    display_level: int | None = None,
    code_length: int | None = None,
    selectable_only: bool = True,
) -> DataFrame:
    """id, name, date, value of one display level or one item-code length."""
    items = selectable_items(tables.item, selectable_only)
    items = detail_filter(items, display_level=display_level, code_length=code_length)
    dims = tables.series.join(items, "item_code").select("series_id", "item_name")
    return tables.observation.join(dims, "series_id").select(
        F.col("series_id").alias("id"),
        F.col("item_name").alias("name"),
        period_date(F.col("year"), F.col("period")).alias("date"),
        "value",
    )


def create_series_view(tables: Tables, name: str | None = None, **options) -> str:
    """Register ``series_view`` as a temporary view; returns its name."""
    if name is None:
        level, length = options.get("display_level"), options.get("code_length")
        name = f"display_level_{level}" if level is not None else f"item_length_{length}"
    series_view(tables, **options).createOrReplaceTempView(name)
    return name


def national_slice(tables: Tables, area_code: str = "0000") -> DataFrame:
    """Monthly, unadjusted observations of one area."""
    series = tables.series.filter(
        (F.col("area_code") == area_code)
        & (F.col("seasonal") == "U")
        & (F.col("periodicity_code") == "R")
    )
    return series.join(tables.observation, "series_id").select(
        "series_id", "item_code", "area_code", "year", "period", "value"
    )


def right_tail(tables: Tables, month: str, k: int = 15) -> DataFrame:
    """The k largest growth rates of a month in the national slice, against the 12th row before."""
    year, _, first = parse_month(month)
    # Later years cannot be among the twelve rows before; whole parts of the store stay unread.
    growth = lagged_growth(national_slice(tables).filter(F.col("year") <= year))
    dims = tables.series.select("series_id", "item_code").join(tables.item, "item_code")
    in_month = growth.filter(month_date(F.col("year"), F.col("period")) == F.lit(first))
    return (
        in_month.join(dims, "series_id")
        .select("series_id", "item_name", "display_level", "yoy")
        .orderBy(F.col("yoy").desc_nulls_first(), "series_id")
        .limit(k)
    )

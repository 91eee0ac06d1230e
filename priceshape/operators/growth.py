"""Year-over-year growth of each series.

An observation is compared with the same period code of the year before, found with one window over
(series, period) in year order: a single shuffle of the observations, with no self-join. The key
(series, year, period) is unique, so a window partition holds one row per year.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from priceshape.functions.periods import (
    in_month_range,
    normalize_period,
    parse_month,
    period_rank,
    period_sort_key,
)
from priceshape.operators.filters import apply_locks, selectable_items
from priceshape.schemas import Tables
from priceshape.scratch import pin


def growth_ratio(current: Column, previous: Column) -> Column:
    """(current - previous) / previous as a double; NULL without both values or a zero base.

    The subtraction is exact decimal arithmetic, only the division is binary.
    """
    usable = current.isNotNull() & previous.isNotNull() & (previous != 0)
    return F.when(
        usable, (current - previous).cast("double") / previous.cast("double")
    )


def yoy_pairs(observations: DataFrame) -> DataFrame:
    """series_id, year, period (normalised), value, previous for every observation.

    ``previous`` is NULL when the year before has no such period. Period codes that differ only in
    case are one period; the last of them in code order counts.
    """
    keyed = observations.select(
        "series_id", "year", F.col("period").alias("_raw"),
        normalize_period(F.col("period")).alias("period"), "value",
    )
    by_code = Window.partitionBy("series_id", "period").orderBy("year", "_raw")
    unique = keyed.withColumn("_next", F.lead("year").over(by_code)).filter(
        "_next IS NULL OR _next <> year"
    )
    by_year = Window.partitionBy("series_id", "period").orderBy("year")
    return unique.select(
        "series_id",
        "year",
        "period",
        "value",
        F.lag("year").over(by_year).alias("_prev_year"),
        F.lag("value").over(by_year).alias("_prev_value"),
    ).selectExpr(
        "series_id",
        "year",
        "period",
        "value",
        "if(_prev_year = year - 1, _prev_value, NULL) AS previous",
    )


def latest_period(observations: DataFrame) -> DataFrame:
    """series_id, year, period of each series' own last observation (M13 ranks after M12)."""
    key = period_sort_key(F.col("year"), F.col("period"))
    return observations.groupBy("series_id").agg(F.max(key).alias("k")).select(
        "series_id", F.col("k.year").alias("year"), F.col("k.code").alias("period")
    )


def ordered_periods(observations: DataFrame) -> DataFrame:
    """Distinct (year, period, rank); sort by year, rank, period for calendar order."""
    return observations.select(
        "year",
        normalize_period(F.col("period")).alias("period"),
        period_rank(F.col("period")).alias("rank"),
    ).distinct()


def global_latest(observations: DataFrame) -> DataFrame:
    """One row: the last (year, period) of all observations."""
    key = period_sort_key(F.col("year"), F.col("period"))
    return observations.agg(F.max(key).alias("k")).select(
        F.col("k.year").alias("year"), F.col("k.code").alias("period")
    )


def component_series(
    tables: Tables, locks: dict[str, str] | None = None, selectable_only: bool = True
) -> DataFrame:
    """Series that may contribute, with the item fields a component carries."""
    series = apply_locks(tables.series, locks)
    items = selectable_items(tables.item, selectable_only)
    return series.join(items, "item_code").select(
        "series_id", "item_code", "item_name", "display_level", "series_title"
    )


def growth_components(
    tables: Tables,
    *,
    months: tuple[str, str] | None = None,
    selectable_only: bool = True,
    locks: dict[str, str] | None = None,
) -> DataFrame:
    """One row per series and target period with a growth rate.

    ``months`` is a closed range of ``YYYY-MM``; None means every series' own latest period.
    Series without a known item, and observations without a known series, do not contribute.
    """
    # Written, so that its size is known: a small one filters the observations before the shuffle.
    dims = pin(component_series(tables, locks, selectable_only), "component-series")
    observed = tables.observation.select("series_id", "year", "period", "value")
    if locks or selectable_only:
        observed = observed.join(dims.select("series_id"), "series_id", "left_semi")

    year, period = F.col("year"), F.col("period")
    if months:
        start, end = months
        first, last = parse_month(start), parse_month(end)
        # The year filter reaches the partitioned scan; the months are cut after normalising.
        observed = observed.filter(year.between(first[0] - 1, last[0]))
        observed = observed.filter(normalize_period(period).rlike("^M(0[1-9]|1[0-2])$"))
        pairs = yoy_pairs(observed).filter(in_month_range(year, period, start, end))
    else:
        # Spreading by series serves both the pairing and the search for the latest period.
        pairs = yoy_pairs(observed.repartition("series_id"))
        own = Window.partitionBy("series_id")
        key = period_sort_key(year, period)
        pairs = pairs.withColumn("_latest", F.max(key).over(own)).filter(key == F.col("_latest"))
    return (
        pairs.withColumn("yoy", growth_ratio(F.col("value"), F.col("previous")))
        .filter("yoy IS NOT NULL")
        .join(dims, "series_id")
        .select(
            "series_id",
            "item_code",
            "item_name",
            "display_level",
            "series_title",
            F.col("yoy").alias("value"),
            "year",
            "period",
        )
    )


def lagged_growth(observations: DataFrame, lag: int = 12) -> DataFrame:
    """series_id, year, period, yoy against the row ``lag`` places earlier (not the year before)."""
    ordered = Window.partitionBy("series_id").orderBy("year", "period")
    earlier = F.lag("value", lag).over(ordered)
    ratio = F.try_divide(F.col("value").cast("double"), earlier.cast("double")) - 1
    return observations.select("series_id", "year", "period", "value", ratio.alias("yoy"))

"""Row filters: series locks, month ranges, small-sample guards."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from priceshape.functions.fields import item_code_length, strip
from priceshape.scratch import pin

# The names a lock may use, and the series column of each.
LOCK_NAMES = {
    "area": "area_code",
    "area_code": "area_code",
    "base": "base_code",
    "base_code": "base_code",
    "base_period": "base_period",
    "item": "item_code",
    "item_code": "item_code",
    "periodicity": "periodicity_code",
    "periodicity_code": "periodicity_code",
    "seasonal": "seasonal",
    "seasonality": "seasonal",
}


def parse_locks(expressions: Iterable[str]) -> dict[str, str]:
    """``KEY=VALUE`` texts -> {series column: required value}; ValueError on a malformed lock."""
    locks: dict[str, str] = {}
    for text in filter(None, map(str.strip, expressions)):
        name, equals, value = (part.strip() for part in text.partition("="))
        if not equals:
            raise ValueError(f"series lock {text!r} is not of the form KEY=VALUE")
        if not name or not value:
            raise ValueError(f"series lock {text!r} needs both a key and a value")
        column = LOCK_NAMES.get(name.lower())
        if column is None:
            raise ValueError(f"unknown series lock key {name!r}; use one of {sorted(LOCK_NAMES)}")
        if column in locks:
            raise ValueError(f"{column} is locked twice")
        locks[column] = value
    return locks


def apply_locks(series: DataFrame, locks: dict[str, str] | None) -> DataFrame:
    """Series whose locked columns equal the required values, ignoring case and outer blanks."""
    for column, value in (locks or {}).items():
        series = series.filter(F.upper(strip(F.col(column))) == value.strip().upper())
    return series


def selectable_items(items: DataFrame, selectable_only: bool = True) -> DataFrame:
    return items.filter("selectable") if selectable_only else items


def detail_filter(df: DataFrame, *, display_level: int | None = None,
                  code_length: int | None = None) -> DataFrame:
    """Rows of one item display level or one item-code length."""
    if (display_level is None) == (code_length is None):
        raise ValueError("give either display_level or code_length")
    if display_level is not None:
        return df.filter(F.col("display_level") == display_level)
    return df.filter(item_code_length(F.col("item_code")) == code_length)


def sample_guard(
    components: DataFrame, scope_cols: list[str], min_sample_size: int, skip: bool
) -> DataFrame:
    """Drop the rows of scopes with fewer than ``min_sample_size`` rows if ``skip`` is set.

    The sizes come from an aggregation and are joined back, so a large scope is never gathered. The
    rows that stay are written: what follows reads them several times, and a join that feeds a
    write can be split where a scope is hot.
    """
    if min_sample_size <= 0 or not skip:
        return components
    sizes = components.groupBy(*scope_cols).count()
    small = pin(sizes.filter(F.col("count") < min_sample_size), "small")
    renamed = small.select([F.col(c).alias(f"_s_{c}") for c in scope_cols])
    condition = " AND ".join(f"`{c}` <=> `_s_{c}`" for c in scope_cols)
    return pin(components.join(renamed, F.expr(condition), "left_anti"), "guarded")


def sample_warnings(
    sizes: DataFrame, scope: str, label_cols: list[str], size_col: str, min_sample_size: int
) -> DataFrame:
    """scope, label, sample_size, min_sample_size for every undersized scope of a size table."""
    return sizes.filter(
        (F.lit(min_sample_size) > 0) & (F.col(size_col) < min_sample_size)
    ).select(
        F.lit(scope).alias("scope"),
        F.concat_ws(":", *label_cols).alias("label"),
        F.col(size_col).alias("sample_size"),
        F.lit(min_sample_size).alias("min_sample_size"),
    )


def top_k(df: DataFrame, group_cols: list[str], order: list, k: int) -> DataFrame:
    """First ``k`` rows per group in the given order.

    Spark keeps only the k best rows per group of every partition before it shuffles.
    """
    ranked = df.withColumn("rank", F.row_number().over(
        Window.partitionBy(*group_cols).orderBy(*order)))
    return ranked.filter(F.col("rank") <= k)

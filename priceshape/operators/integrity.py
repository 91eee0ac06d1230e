"""Referential checks between the tables."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from priceshape.schemas import Tables

# child table, child column, parent table
REFERENCES = [
    ("series", "area_code", "area"),
    ("series", "item_code", "item"),
    ("observation", "series_id", "series"),
]


def orphans(tables: Tables, children: tuple[str, ...] = ("series", "observation")) -> DataFrame:
    """reference, key, rows: values of each reference of ``children`` that have no parent, with their
    row counts."""
    found = None
    for child, column, parent in REFERENCES:
        if child not in children:
            continue
        counts = tables.get(child).groupBy(column).agg(F.count(F.lit(1)).alias("rows"))
        missing = counts.join(tables.get(parent).select(column), column, "left_anti").select(
            F.lit(f"{child}.{column}").alias("reference"), F.col(column).alias("key"), "rows"
        )
        found = missing if found is None else found.unionByName(missing)
    return found


def require_integrity(tables: Tables, children: tuple[str, ...] = ("series", "observation")) -> None:
    examples = orphans(tables, children).limit(5).collect()
    if examples:
        shown = ", ".join(f"{r['reference']}={r['key']}" for r in examples)
        raise ValueError(f"rows refer to missing parents, e.g. {shown}")


def cascade(tables: Tables) -> Tables:
    """Tables without the rows whose parents are missing."""
    series = tables.series.join(tables.area.select("area_code"), "area_code", "left_semi")
    series = series.join(tables.item.select("item_code"), "item_code", "left_semi")
    observation = tables.observation.join(series.select("series_id"), "series_id", "left_semi")
    return replace(
        tables,
        series=series.select(tables.series.columns),
        observation=observation.select(tables.observation.columns),
    )

"""Duplicate policies on a key: first wins, last wins, upsert.

Each is an aggregation, so copies of a key are folded on the map side before any shuffle and a key
with very many copies costs no more than one row per task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _pick(df: DataFrame, keys: list[str], order: list[str], pick) -> DataFrame:
    payload = [c for c in df.columns if c not in keys and c not in order]
    kept = pick(F.struct(*payload), F.struct(*order)).alias("_kept")
    picked = df.groupBy(*keys).agg(kept)
    return picked.select(*keys, *[F.col("_kept")[c].alias(c) for c in payload])


def first_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key, the first in ``order``; the order columns are dropped."""
    return _pick(df, keys, order, F.min_by)


def last_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key, the last in ``order``; the order columns are dropped."""
    return _pick(df, keys, order, F.max_by)


def union_first_wins(parts: list[DataFrame], keys: list[str], order: list[str]) -> DataFrame:
    """Union in which an earlier part wins over a later one, and inside a part the first row."""
    ranked = [part.withColumn("_part", F.lit(i)) for i, part in enumerate(parts)]
    union = ranked[0]
    for part in ranked[1:]:
        union = union.unionByName(part)
    return first_wins(union, keys, ["_part", *order])


def upsert(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``existing`` whose key is not incoming, plus ``incoming`` (unique on the key)."""
    untouched = existing.join(incoming.select(*keys), keys, "left_anti")
    return untouched.select(incoming.columns).unionByName(incoming)

"""Weighted moments from one read: centred sums that merge.

Each task folds the rows it has at hand into one row per group: count, weight, mean and the second to
fourth sums of powers about that mean. Sums about different means merge exactly by their binomial
shifts, so nothing cancels however far the values lie from zero, and rows of fine groups (month and
label) add up to coarse ones (month).
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import types as T

# The functions go to the workers themselves, which need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Rows that a task folds at once.
IN_HAND = 1 << 18

SUMS = ["n", "w", "w2", "mean", "s2", "s3", "s4", "lo", "hi", "positive_lo", "positive_hi", "min_w"]


def foldable(rows: DataFrame, keys: list[str]) -> bool:
    """Whether the keys are plain values, which Arrow can number."""
    return not any(isinstance(rows.schema[k].dataType, (T.ArrayType, T.MapType, T.StructType, T.VariantType)) for k in keys)


def _numbers(table: pa.Table, keys: int) -> tuple[np.ndarray, np.ndarray]:
    """First row of each group, and the group of each row."""
    code = np.zeros(table.num_rows, np.int64)
    for i in range(keys):
        encoded = pc.dictionary_encode(table.column(i).combine_chunks(), null_encoding="encode")
        _, code = np.unique(code * len(encoded.dictionary) + encoded.indices.to_numpy(zero_copy_only=False), return_inverse=True)
    _, first, group = np.unique(code, return_index=True, return_inverse=True)
    return first, group


def _fold(keys: int):
    def folded(table: pa.Table) -> pa.RecordBatch:
        first, group = _numbers(table, keys)
        x, w = (table.column(keys + i).to_numpy() for i in (0, 1))
        total = lambda v: np.bincount(group, v, len(first))
        weight = total(w)
        over = np.where(weight > 0, weight, 1.0)
        mean = total(w * (x - x[first][group])) / over + x[first]
        # Once more about the mean, whose own rounding is taken out.
        d = x - mean[group]
        rest = total(w * d) / over
        mean, d = mean + rest, d - rest[group]
        ends = {}
        for name, values, start, take in (("lo", x, np.inf, np.minimum), ("hi", x, -np.inf, np.maximum),
                                          ("positive_lo", np.where(w > 0, x, np.inf), np.inf, np.minimum),
                                          ("positive_hi", np.where(w > 0, x, -np.inf), -np.inf, np.maximum),
                                          ("min_w", w, np.inf, np.minimum)):
            ends[name] = np.full(len(first), start)
            take.at(ends[name], group, values)
        made = [np.bincount(group, minlength=len(first)).astype(np.int64), weight, total(w * w), mean,
                total(w * d * d), total(w * d**3), total(w * d**4)]
        arrays = [pa.array(v) for v in made] + [pa.array(v, mask=~np.isfinite(v)) for v in ends.values()]
        own = [table.column(i).take(pa.array(first)).combine_chunks() for i in range(keys)]
        return pa.RecordBatch.from_arrays([*own, *arrays], [*table.column_names[:keys], *SUMS])

    def task(batches):
        held, rows = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                rows += batch.num_rows
            if rows >= IN_HAND:
                yield folded(pa.Table.from_batches(held))
                held, rows = [], 0
        if held:
            yield folded(pa.Table.from_batches(held))

    return task


def partial_moments(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys and ``SUMS`` of the rows (keys, _x, _w) that one task had at hand; one read, no shuffle."""
    kinds = [f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys]
    schema = ", ".join([*kinds, "n long", *[f"{name} double" for name in SUMS[1:]]])
    return rows.select(*keys, "_x", "_w").mapInArrow(_fold(len(keys)), schema)


def merged_moments(partials: DataFrame, keys: list[str]) -> DataFrame:
    """Facts of the groups of ``keys`` (some of the partials' keys, or all) from a written table of
    partials: n, sw, sw2, swx, var, skew, kurt and the ends of values and weights."""
    from priceshape.operators.samples import expressions, join_facts

    sums = partials.groupBy(*keys).agg(*expressions({
        "n": "sum(n)", "sw": "sum(w)", "sw2": "sum(w2)", "swx": "sum(w * mean)", "lo": "min(lo)", "hi": "max(hi)",
        "positive_lo": "min(positive_lo)", "positive_hi": "max(positive_hi)", "min_w": "min(min_w)"}))
    centre = sums.selectExpr(*keys, "swx / nullif(sw, 0D) AS _centre")
    shifted = (
        join_facts(partials.filter("w > 0"), centre, keys)
        .selectExpr(*keys, "w", "s2", "s3", "s4", "mean - _centre AS _d")
        .groupBy(*keys)
        .agg(*expressions({
            "_w": "sum(w)",
            "_1": "sum(w * _d)",
            "_2": "sum(s2 + w * _d * _d)",
            "_3": "sum(s3 + 3 * _d * s2 + w * _d * _d * _d)",
            "_4": "sum(s4 + 4 * _d * s3 + 6 * _d * _d * s2 + w * _d * _d * _d * _d)"}))
        # The centre is the mean but for rounding, which is taken out here.
        .selectExpr(*keys, "_1 / _w AS _a", "_2 / _w AS _b", "_3 / _w AS _c", "_4 / _w AS _e")
        .selectExpr(*keys, "_b - _a * _a AS var", "_c - 3 * _a * _b + 2 * _a * _a * _a AS _third",
                    "_e - 4 * _a * _c + 6 * _a * _a * _b - 3 * _a * _a * _a * _a AS _fourth")
        .selectExpr(*keys, "var", "try_divide(_third, pow(var, 1.5)) AS skew", "try_divide(_fourth, var * var) - 3 AS kurt"))
    return join_facts(sums, shifted, keys, how="left")

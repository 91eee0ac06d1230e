"""Weighted quantile summaries: which values can hold a cut of the running weight.

A summary is a list of intervals of values with their weights. Every task sorts the rows it has at
hand, cuts those of a group into at most ``2 * PARTS`` runs of neighbours, and passes on the ends and
the weight of each run; lists are merged by putting them together, and shortened by cutting them into
runs again. However the intervals overlap, two bounds hold for the weight below any value ``v``: at
least that of the intervals that end below ``v``, at most that of those that begin at or below it. So
the first value whose running weight passes a position ``p`` is not below the least ``lo`` whose
running weight by ``lo`` passes ``p``, and not above the least ``hi`` whose running weight by ``hi``
does. The intervals around a value hold at most about ``1 / PARTS`` of the weight for each time the
list was shortened, single heavy values aside, and those are intervals of length 0.

The range of the values plays no part, nor does their order in the input.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from priceshape.operators.samples import Sample, expressions, join_facts
from priceshape.scratch import pin

# The functions go to the workers themselves, which need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Runs of a group in a task's hand, and rows in hand.
PARTS, IN_HAND = 512, 1 << 18

_SCHEMA = "_g long, _lo double, _hi double, _w double"


def runs(group: np.ndarray, lo: np.ndarray, hi: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, ...]:
    """Shortened list of intervals, group by group."""
    order = np.lexsort((lo, group))
    group, lo, hi, w = (a[order] for a in (group, lo, hi, w))
    first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    size = np.diff(np.append(first, len(group)))
    at = np.arange(len(group)) - np.repeat(first, size)
    total = np.repeat(np.add.reduceat(w, first), size)
    before = np.cumsum(w) - w
    before -= np.repeat(before[first], size)
    with np.errstate(invalid="ignore", divide="ignore"):
        share = np.where(total > 0, before / total, 0.0)
    heavy = w * PARTS > total
    changes = [group, at * PARTS // np.repeat(size, size), np.floor(share * PARTS), heavy.cumsum() + np.append(0, heavy[:-1].cumsum())]
    new = np.concatenate([[True], np.any([c[1:] != c[:-1] for c in changes], axis=0)])
    start = np.flatnonzero(new)
    return group[start], lo[start], np.maximum.reduceat(hi, start), np.add.reduceat(w, start)


def _shortened(batches):
    held, rows = [], 0

    def cut():
        columns = [np.concatenate([b.column(i).to_numpy(zero_copy_only=False) for b in held]) for i in range(4)]
        made = runs(*columns)
        return pa.RecordBatch.from_arrays([pa.array(c) for c in made], ["_g", "_lo", "_hi", "_w"])

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            rows += batch.num_rows
        if rows >= IN_HAND:
            yield cut()
            held, rows = [], 0
    if held:
        yield cut()


def brackets(sample: Sample, positions: list[str], task_rows: int, slack: float) -> DataFrame:
    """keys with ``_a0``, ``_b0``, ``_a1``, ...: for every position the least and the greatest value
    that can hold it; one row per group, from one read of the rows.

    ``positions`` are expressions over ``group_n`` and ``group_w``; a bracket is made for all positions
    within ``slack`` of the weight, for the rounding of sums. Groups of at most ``task_rows`` rows
    are not summarised: their first bracket is all their values, the others are NULL.
    """
    keys = sample.keys
    large = pin(sample.facts.filter(F.col("n") > task_rows).select(
        *keys, F.monotonically_increasing_id().alias("_g"), F.col("n").alias("group_n"), F.col("sw").alias("group_w")), "large")
    rows = sample.attach(sample.rows, large.select(*keys, "_g"))
    lists = pin(rows.selectExpr("_g", "_x AS _lo", "_x AS _hi", "_w").mapInArrow(_shortened, _SCHEMA), "runs")
    while True:
        counts = pin(lists.groupBy("_g").count(), "counts")
        longest, in_all = counts.agg(F.max("count"), F.sum("count")).first()
        if longest <= task_rows:
            break
        # A group of many intervals is dealt to as many tasks as have it in hand.
        dealt = lists.join(counts, "_g").withColumn("_s", F.expr(
            f"pmod(xxhash64(_lo, _hi, _w), 1 + count div {IN_HAND})"))
        lists = pin(dealt.repartition(1 + in_all // IN_HAND, "_g", "_s").select("_g", "_lo", "_hi", "_w").mapInArrow(
            _shortened, _SCHEMA), "runs")
        if lists.count() > 0.9 * in_all:
            break
    room = f"{slack!r}D * group_w"
    upto = "sum(_w) OVER (PARTITION BY _g ORDER BY {0} RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    placed = lists.join(large, "_g").selectExpr(
        *keys, "_lo", "_hi", "group_n", "group_w", f"{upto.format('_lo')} AS _by_lo", f"{upto.format('_hi')} AS _by_hi")
    ends = {}
    for i, p in enumerate(positions):
        ends[f"_a{i}"] = f"min(CASE WHEN _by_lo > {p} - {room} THEN _lo END)"
        ends[f"_b{i}"] = f"min(CASE WHEN _by_hi > {p} + {room} THEN _hi END)"
    found = placed.groupBy(*keys).agg(*expressions(ends))
    names = [f"_{end}{i}" for i in range(len(positions)) for end in "ab"]
    # Beyond all weight lies the greatest value.
    whole = join_facts(sample.facts.select(*keys, "n", "lo", "hi"), found, keys, how="left").selectExpr(
        *keys, "n", "lo", "hi", *names)
    small = f"n <= {task_rows}"
    columns = [f"CASE WHEN {small} THEN {'lo' if i == 0 else 'NULL'} ELSE coalesce(_a{i}, hi) END AS _a{i}"
               for i in range(len(positions))]
    columns += [f"CASE WHEN {small} THEN {'hi' if i == 0 else 'NULL'} ELSE coalesce(_b{i}, hi) END AS _b{i}"
                for i in range(len(positions))]
    return pin(whole.selectExpr(*keys, *columns), "brackets")

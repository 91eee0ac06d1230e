"""Weighted histograms and axis limits."""

from __future__ import annotations

from pyspark.sql import DataFrame

from priceshape.operators.quantiles import linear_quantiles
from priceshape.operators.samples import Sample, expressions, join_facts, named


@named
def histogram(sample: Sample, bins: int = 30) -> DataFrame:
    """keys, bin, bin_low, bin_high, weight: equal bins over the range, the last one closed.

    Weights are normalised. A group of equal values is spread half a unit to both sides.
    """
    keys = sample.keys
    frame = sample.facts.selectExpr(
        *keys,
        "sw",
        "if(lo = hi, lo - 0.5D, lo) AS low",
        "if(lo = hi, hi + 0.5D, hi) AS high",
    )

    def edge(i: str) -> str:
        return f"if({i} = {bins}, high, low + {i} * ((high - low) / {bins}))"

    # The quotient may round across an edge; the edges decide.
    bin_no = f"""CASE WHEN _x < {edge('_guess')} THEN _guess - 1
        WHEN _guess < {bins - 1} AND _x >= {edge('(_guess + 1)')} THEN _guess + 1
        ELSE _guess END"""
    guess = f"least(cast(floor((_x - low) / (high - low) * {bins}) AS int), {bins - 1})"
    filled = (
        sample.attach(sample.rows, frame)
        .selectExpr(*keys, "_x", "_w", "low", "high", f"{guess} AS _guess")
        .selectExpr(*keys, "_w AS _bin_w", f"{bin_no} AS bin")
        .groupBy(*keys, "bin")
        .agg(*expressions({"_bin_w": "sum(_bin_w)"}))
    )
    empty = frame.selectExpr(*keys, f"explode(sequence(0, {bins - 1})) AS bin", "0D AS _bin_w")
    totals = filled.unionByName(empty).groupBy(*keys, "bin")
    return join_facts(totals.agg(*expressions({"_bin_w": "sum(_bin_w)"})), frame, keys).selectExpr(
        *keys,
        "bin",
        f"{edge('bin')} AS bin_low",
        f"{edge('(bin + 1)')} AS bin_high",
        "_bin_w / sw AS weight",
    )


@named
def axis_limits(
    sample: Sample, *, clip: float = 0.995, padding: float = 0.05, task_rows: int | None = None
) -> DataFrame:
    """keys, axis_low, axis_high: central share of the values, padded, near the data range.

    An ungrouped sample without rows gives (-1, 1).
    """
    tail = sorted((0.5 * (1.0 - 0.9999), 0.5 * (1.0 - clip), 0.25))[1]  # a share of 0.5 to 0.9999 stays
    keys = sample.keys
    ends = linear_quantiles.keyed(sample, {"_low": tail, "_high": 1.0 - tail}, task_rows=task_rows)
    limits = (
        join_facts(ends, sample.facts.select(*keys, "lo", "hi"), keys)
        .selectExpr(
            "*",
            "if(_high <= _low, greatest(abs(_low), abs(_high), 1D), _high - _low) AS _span",
            f"if(_high <= _low, 0.5D, {padding!r}D) AS _pad",
        )
        .selectExpr(
            *keys,
            "greatest(_low - _span * _pad, lo - _span) AS _low",
            "least(_high + _span * _pad, hi + _span) AS _high",
        )
        .selectExpr(
            *keys,
            "if(_low = _high, _low - 1, _low) AS axis_low",
            "if(_low = _high, _high + 1, _high) AS axis_high",
        )
    )
    if sample.grouped:
        return limits
    return limits.agg(
        *expressions(
            {
                "axis_low": "coalesce(max(axis_low), -1D)",
                "axis_high": "coalesce(max(axis_high), 1D)",
            }
        )
    )

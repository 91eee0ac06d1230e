"""The nine-statistic distribution summary of a grouped weighted sample."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame

from priceshape.operators.kde import (
    BANDWIDTH_RULE,
    GRID_POINTS,
    density,
    grid_frame,
    kde_mode,
    mode_of,
)
from priceshape.operators.moments import moments
from priceshape.operators.quantiles import quantiles
from priceshape.operators.samples import Sample, join_facts, make_sample
from priceshape.scratch import pin

STATISTICS = [
    "weighted_mean",
    "weighted_median",
    "trimmed_mean",
    "weighted_std",
    "weighted_skewness",
    "weighted_kurtosis",
    "weighted_kde_bandwidth",
    "weighted_kde_mode",
    "effective_sample_size",
]


def describe(
    sample: Sample,
    *,
    trim: float = 0.08,
    bandwidth: float | None = None,
    task_rows: int | None = None,
) -> DataFrame:
    """All statistics but the mode, with the facts the density grid needs; a written table with the
    group columns under ``sample.keys`` (``sample.finish`` gives them their own names).

    ``bandwidth`` of None or 0 selects the rule of thumb.
    """
    keys = sample.keys
    ranks = quantiles.keyed(
        sample,
        {"q25": 0.25, "weighted_median": 0.5, "q75": 0.75},
        {"trimmed_mean": trim},
        task_rows=task_rows,
    )
    facts = sample.facts.select(*keys, "n", "sw", "lo", "hi", "positive_lo")
    table = join_facts(join_facts(ranks, moments.keyed(sample), keys), facts, keys)
    h = f"{float(bandwidth)!r}D" if bandwidth else BANDWIDTH_RULE
    return pin(
        table.selectExpr(
            *keys,
            "n",
            "sw",
            "lo",
            "hi",
            "positive_lo",
            "q25",
            "q75",
            "mean AS weighted_mean",
            "weighted_median",
            "trimmed_mean",
            "std AS weighted_std",
            "skewness AS weighted_skewness",
            "kurtosis AS weighted_kurtosis",
            f"{h} AS h",
            "ess AS effective_sample_size",
        ),
        "described",
    )


def summarize(
    sample: Sample,
    table: DataFrame,
    *,
    bandwidth: float | None = None,
    grid_points: int = GRID_POINTS,
) -> DataFrame:
    """keys, count and the nine statistics; one row per group of the ``describe`` table."""
    keys = sample.keys
    if bandwidth and bandwidth < 0:
        with_mode = join_facts(kde_mode.keyed(sample, table, grid_points=grid_points), table, keys)
    else:
        # A rule-of-thumb bandwidth of zero means that all positive-weight values are equal.
        frame = grid_frame(table, keys, grid_points)
        modes = mode_of(density(sample, frame, grid_points), keys)
        flat = table.filter("h <= 0").selectExpr("*", "positive_lo AS mode")
        with_mode = join_facts(modes, table, keys).unionByName(flat)
    return sample.finish(
        with_mode.selectExpr(
            *keys,
            "n AS count",
            *STATISTICS[:6],
            "h AS weighted_kde_bandwidth",
            "mode AS weighted_kde_mode",
            "effective_sample_size",
        )
    )


def stat_summary(
    df: DataFrame,
    group_cols: list[str],
    value_col: str | Column,
    weight_col: str | Column | None = None,
    *,
    order_col: str | Column | None = None,
    trim: float = 0.08,
    bandwidth: float | None = None,
    grid_points: int = GRID_POINTS,
    task_rows: int | None = None,
) -> DataFrame:
    """Summary of any numeric column; reads ``df`` three times, so ``pin`` a costly plan first."""
    sample = make_sample(df, group_cols, value_col, weight_col, order_col)
    table = describe(sample, trim=trim, bandwidth=bandwidth, task_rows=task_rows)
    return summarize(sample, table, bandwidth=bandwidth, grid_points=grid_points)

"""Distribution reports over growth components: groups, panels, time series, densities."""

from __future__ import annotations

import warnings
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from priceshape.functions.fields import item_code_length, percent_number, percent_text
from priceshape.functions.periods import period_label
from priceshape.operators.filters import sample_guard, sample_warnings, top_k
from priceshape.operators.growth import global_latest, growth_components
from priceshape.operators.kde import kde_curve
from priceshape.operators.samples import join_facts, make_sample
from priceshape.operators.shape import axis_limits, histogram
from priceshape.operators.summary import STATISTICS, describe, stat_summary, summarize
from priceshape.schemas import Tables
from priceshape.scratch import pin

EXAMPLES = 5


def group_label(group_by: str) -> Column:
    """Label of a component's group: its item display level, or the length of its item code."""
    if group_by == "series-name-length":
        warnings.warn("series-name-length groups by item-code-length", stacklevel=2)
        group_by = "item-code-length"
    if group_by == "display-level":
        return F.col("display_level").cast("string")
    if group_by == "item-code-length":
        return F.concat(item_code_length(F.col("item_code")).cast("string"), F.lit(" chars"))
    raise ValueError(f"unsupported group_by {group_by!r}")


def _group_by_name(group_by: str) -> Column:
    return F.lit(group_by.replace("series-name-length", "item-code-length")).alias("group_by")


def label_order(label: str = "label") -> list[Column]:
    """Sort keys for labels: the first word that is a number, then the text."""
    number = F.regexp_extract(F.col(label), r"(?<!\S)(\d+)(?!\S)", 1).try_cast("int")
    return [F.coalesce(number, F.lit(0)), F.col(label)]


def dated(components: DataFrame) -> DataFrame:
    return components.withColumn("date", period_label(F.col("year"), F.col("period")))


def extreme_examples(components: DataFrame, group_cols: list[str], k: int = EXAMPLES) -> DataFrame:
    """The k components per group with the largest absolute growth, ranked."""
    return top_k(components, group_cols, [F.abs("value").desc(), F.col("series_id")], k)


def group_summary(components: DataFrame, group_by: str = "display-level") -> DataFrame:
    """label, count, nine statistics and the most extreme components of every group."""
    labelled = components.withColumn("label", group_label(group_by))
    return _label_summary(pin(labelled, "components"))


def _label_summary(labelled: DataFrame) -> DataFrame:
    """Group summary of components that carry a label; they are read several times."""
    return _with_examples(stat_summary(labelled, ["label"], "value"), labelled)


def _with_examples(summary: DataFrame, labelled: DataFrame) -> DataFrame:
    example = """struct(rank, series_id, item_code, item_name, series_title, value AS yoy,
        yoy_percent)"""
    examples = (
        extreme_examples(labelled, ["label"])
        .withColumn("yoy_percent", percent_text("value"))
        .groupBy("label")
        .agg(F.expr(f"sort_array(collect_list({example}))").alias("examples"))
    )
    return join_facts(summary, examples, ["label"])


def _group_counts(sizes: DataFrame, min_sample_size: int, skip: bool) -> DataFrame:
    """One row: all components, and the groups that are reported."""
    reported = f"count >= {min_sample_size}" if skip else "true"
    return sizes.selectExpr(
        "coalesce(sum(count), 0) AS component_count", f"count_if({reported}) AS group_count",
        "0 AS _one",
    )


@dataclass(frozen=True)
class Report:
    """Group summaries of one period with the fields of the run."""

    groups: DataFrame
    header: DataFrame
    warnings: DataFrame


def compute(
    tables: Tables,
    *,
    date: str | None = None,
    group_by: str = "display-level",
    selectable_only: bool = True,
    source: str = "database",
    locks: dict[str, str] | None = None,
    min_sample_size: int = 0,
    skip_small_samples: bool = False,
) -> Report:
    """Summary per group of one month, or of every series' latest period.

    ``component_count`` counts before small groups are dropped, ``group_count`` after.
    """
    components = growth_components(
        tables,
        months=(date, date) if date else None,
        selectable_only=selectable_only,
        locks=locks,
    )
    labelled = pin(components.withColumn("label", group_label(group_by)), "components")
    # One row per display level or code length.
    sizes = labelled.groupBy("label").agg(F.count(F.lit(1)).alias("count"))
    if sizes.isEmpty():
        raise ValueError("no components for the requested configuration")
    groups = _label_summary(
        sample_guard(labelled, ["label"], min_sample_size, skip_small_samples)
    )
    counted = _group_counts(sizes, min_sample_size, skip_small_samples)
    # Both sides of the join are single rows.
    label = F.lit(date) if date else period_label(F.col("year"), F.col("period"))
    latest = global_latest(tables.observation).select(label.alias("date"), F.lit(0).alias("_one"))
    header = counted.join(latest, "_one").select(
        "date",
        _group_by_name(group_by),
        F.lit(source).alias("source"),
        F.lit(selectable_only).alias("selectable_only"),
        "component_count",
        "group_count",
        F.lit(min_sample_size).alias("min_sample_size"),
        F.lit(skip_small_samples).alias("skip_small_samples"),
    )
    warned = sample_warnings(sizes, "group", ["label"], "count", min_sample_size)
    return Report(groups, header, warned)


def panel(
    tables: Tables,
    start: str,
    end: str,
    *,
    group_by: str = "display-level",
    selectable_only: bool = True,
    source: str = "database",
    locks: dict[str, str] | None = None,
    min_sample_size: int = 0,
    skip_small_samples: bool = False,
) -> DataFrame:
    """One row per month and group, all months in one pass; months without components are absent."""
    components = dated(
        growth_components(
            tables, months=(start, end), selectable_only=selectable_only, locks=locks
        )
    ).select("date", group_label(group_by).alias("group_label"), "value")
    components = pin(components, "growth")
    components = sample_guard(components, ["date"], min_sample_size, skip_small_samples)
    components = sample_guard(
        components, ["date", "group_label"], min_sample_size, skip_small_samples
    )
    return stat_summary(components, ["date", "group_label"], "value").select(
        "date",
        "group_label",
        _group_by_name(group_by),
        F.lit(selectable_only).alias("selectable_only"),
        F.lit(source).alias("source"),
        "count",
        F.col("weighted_kde_mode").alias("mode"),
        percent_text("weighted_kde_mode").alias("mode_percent"),
        F.col("weighted_mean").alias("mean"),
        F.col("weighted_median").alias("median"),
        "trimmed_mean",
        F.col("weighted_std").alias("std"),
        F.col("weighted_skewness").alias("skewness"),
        F.col("weighted_kurtosis").alias("kurtosis"),
        "effective_sample_size",
    )


def panel_warnings(
    tables: Tables,
    start: str,
    end: str,
    min_sample_size: int,
    *,
    group_by: str = "display-level",
    selectable_only: bool = True,
    locks: dict[str, str] | None = None,
    skip_small_samples: bool = False,
) -> DataFrame:
    """Undersized months, and undersized groups of the months that are not skipped."""
    components = growth_components(
        tables, months=(start, end), selectable_only=selectable_only, locks=locks
    )
    sizes = pin(
        dated(components)
        .groupBy("date", group_label(group_by).alias("group_label"))
        .agg(F.count(F.lit(1)).alias("count")),
        "sizes",
    )
    months = sizes.groupBy("date").agg(F.sum("count").alias("month_count"))
    of_months = sample_warnings(months, "period", ["date"], "month_count", min_sample_size)
    if skip_small_samples:
        kept = months.filter(F.col("month_count") >= min_sample_size)
        sizes = sizes.join(kept.select("date"), "date", "left_semi")
    return of_months.unionByName(
        sample_warnings(sizes, "group", ["date", "group_label"], "count", min_sample_size)
    )


def panel_order() -> list[Column]:
    return [F.col("date"), *label_order("group_label")]


def metrics_timeseries(
    tables: Tables,
    start: str,
    end: str,
    *,
    selectable_only: bool = True,
    source: str = "flatfiles",
    locks: dict[str, str] | None = None,
    min_sample_size: int = 0,
    skip_small_samples: bool = False,
) -> DataFrame:
    """One row per month over all components of the month."""
    components = dated(
        growth_components(
            tables, months=(start, end), selectable_only=selectable_only, locks=locks
        )
    ).select("date", "year", "period", "value")
    components = sample_guard(
        pin(components, "growth"), ["date"], min_sample_size, skip_small_samples
    )
    return stat_summary(components, ["date", "year", "period"], "value").select(
        "date",
        "year",
        "period",
        F.lit(selectable_only).alias("selectable_only"),
        F.lit(source).alias("source"),
        F.col("count").alias("component_count"),
        *with_percent_text(),
    )


# Statistics that reports also show as percent text.
PERCENT_STATISTICS = ["weighted_mean", "weighted_median", "trimmed_mean", "weighted_kde_mode"]


def with_percent_text() -> list[Column]:
    columns = []
    for name in STATISTICS:
        if name == "weighted_kde_bandwidth":
            continue
        columns.append(F.col(name))
        if name in PERCENT_STATISTICS:
            columns.append(percent_text(name).alias(f"{name}_percent"))
    return columns


@dataclass(frozen=True)
class Analysis:
    """Latest-period distribution per group: summaries with examples, density curves, histograms,
    axis limits, and the fields of the run."""

    summaries: DataFrame
    curves: DataFrame
    histograms: DataFrame
    limits: DataFrame
    header: DataFrame
    warnings: DataFrame


def analyze(
    tables: Tables,
    *,
    group_by: str = "display-level",
    selectable_only: bool = True,
    locks: dict[str, str] | None = None,
    min_sample_size: int = 0,
    skip_small_samples: bool = False,
) -> Analysis:
    """Distribution of the latest growth rates; all frames share one set of statistics."""
    components = growth_components(tables, selectable_only=selectable_only, locks=locks)
    labelled = pin(components.withColumn("label", group_label(group_by)), "components")
    sizes = labelled.groupBy("label").agg(F.count(F.lit(1)).alias("count"))
    header = _group_counts(sizes, min_sample_size, skip_small_samples).select(
        _group_by_name(group_by),
        F.col("component_count").alias("components_total"),
        "group_count",
        F.lit(min_sample_size).alias("min_sample_size"),
        F.lit(skip_small_samples).alias("skip_small_samples"),
    )
    kept = sample_guard(labelled, ["label"], min_sample_size, skip_small_samples)
    sample = make_sample(kept, ["label"], "value", order_col="series_id")
    table = describe(sample)
    return Analysis(
        summaries=_with_examples(summarize(sample, table), kept),
        curves=kde_curve(sample, table),
        histograms=histogram(sample),
        limits=axis_limits(sample),
        header=header,
        warnings=sample_warnings(sizes, "group", ["label"], "count", min_sample_size),
    )


def metric_frame(report: DataFrame) -> DataFrame:
    """Chart-ready columns of a panel: real date, band of one std around the mean, percent."""
    return report.select(
        F.to_date("date", "yyyy-MM").alias("date"),
        "group_label",
        "mode",
        "mean",
        "median",
        "trimmed_mean",
        (F.col("mean") - F.col("std")).alias("band_low"),
        (F.col("mean") + F.col("std")).alias("band_high"),
        percent_number(F.col("mode_percent")).alias("mode_percent"),
    )


def timeseries_frame(series: DataFrame) -> DataFrame:
    """Chart-ready columns of a monthly time series: real date, percent texts as numbers.

    ``chart_range`` over the number columns gives the axis of the chart.
    """
    numbers = [f"{name}_percent" for name in PERCENT_STATISTICS]
    return series.select(
        F.to_date("date", "yyyy-MM").alias("date"),
        *[percent_number(F.col(name)).alias(name) for name in numbers],
    )


def chart_range(df: DataFrame, columns: list[str], margin: float = 0.0) -> DataFrame:
    """One row: the least and the greatest value over several columns, widened by a margin."""
    lows = [F.min(c) for c in columns]
    highs = [F.max(c) for c in columns]
    least = F.least(*lows) if len(columns) > 1 else lows[0]
    greatest = F.greatest(*highs) if len(columns) > 1 else highs[0]
    return df.agg((least - margin).alias("low"), (greatest + margin).alias("high"))


def volume_summary(tables: Tables) -> DataFrame:
    """table, rows for the tables a load reports on."""
    counts = None
    for name in ("series", "observation", "area", "item"):
        count = tables.get(name).agg(F.count(F.lit(1)).alias("rows"))
        count = count.select(F.lit(name).alias("table"), "rows")
        counts = count if counts is None else counts.unionByName(count)
    return counts

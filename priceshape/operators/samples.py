"""Grouped weighted samples: the input of every distribution statistic.

A sample is a row table (group keys, value, weight) plus a written table of per-group facts. The
facts come from one aggregation with map-side combine, so the cost of a group does not depend on
where its rows lie, and the rows themselves are never shuffled by group.

Formulas are SQL expressions: one expression is one call into the JVM, however long it is.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from priceshape.operators.partials import foldable, merged_moments, partial_moments
from priceshape.scratch import pin

X, W, ORDER, ALL = "_x", "_w", "_order", "_all"

# Where a table of per-group facts is too large to broadcast, groups of more than HOT_ROWS rows, of
# which there are at most HOT_GROUPS, are joined apart from the others. A row of facts takes FACT_BYTES
# besides its keys.
FACT_BYTES = 200
HOT_ROWS = 1_000_000
HOT_GROUPS = 10_000


@dataclass(frozen=True)
class Sample:
    """Rows (keys, _x, _w[, _order]) and facts (one row per group), with three sizes taken
    from the written facts: the number of groups, all rows, and the rows of the largest group."""

    rows: DataFrame
    facts: DataFrame
    keys: list[str]  # names of the group columns inside: safe in any formula
    names: list[str]  # their own names
    weighted: bool
    grouped: bool
    group_count: int
    total_rows: int
    largest_group: int
    hot: DataFrame | None = None

    def attach(self, rows: DataFrame, table: DataFrame, extra: str = "true") -> DataFrame:
        """Rows of the sample with the columns of a per-group table.

        A table below the broadcast threshold of the session is broadcast. A larger one meets the rows
        in a shuffle by group, in which a hot group would be a single task; so the hot groups, few by
        definition, are taken out of it and broadcast. Where broadcasting is switched off, adaptive
        execution splits what remains of a hot group.
        """
        if self.hot is None:
            return join_facts(rows, table, self.keys, extra)
        hot_table = pin(join_facts(table, self.hot, self.keys, how="left_semi"), "hot")
        cold_rows = join_facts(rows, self.hot, self.keys, how="left_anti")
        hot_part = join_facts(rows, hot_table, self.keys, extra)
        return hot_part.unionByName(join_facts(cold_rows, table, self.keys, extra))

    def finish(self, df: DataFrame) -> DataFrame:
        """Give the group columns their own names, or drop the stand-in key of an ungrouped sample.

        A result column of the same name (case aside) as a group column gets an underscore at its end.
        """
        if not self.grouped:
            return df.drop(ALL)
        own = dict(zip(self.keys, self.names, strict=True))
        taken = {name.lower() for name in self.names}
        columns = []
        for c in df.columns:
            name = own.get(c, c)
            while c not in own and name.lower() in taken:
                name += "_"
            columns.append(F.col(f"`{c}`").alias(name))
        return df.select(*columns)


def named(statistic):
    """A statistic of a sample with the group columns under their own names; its ``keyed`` form, for
    further work on the sample, has them under ``sample.keys``."""

    @functools.wraps(statistic)
    def made(sample: Sample, *args, **options) -> DataFrame:
        return sample.finish(statistic(sample, *args, **options))

    made.keyed = statistic
    return made


def expressions(named: dict[str, str]) -> list[Column]:
    return [F.expr(text).alias(name) for name, text in named.items()]


def join_facts(
    rows: DataFrame, facts: DataFrame, keys: list[str], extra: str = "true", how: str = "inner"
) -> DataFrame:
    """Attach per-group columns to rows (NULL keys match each other)."""
    renamed = facts.withColumnsRenamed({key: f"_f_{key}" for key in keys})
    condition = " AND ".join([f"`{key}` <=> `_f_{key}`" for key in keys] + [extra])
    return rows.join(renamed, F.expr(condition), how).drop(*[f"_f_{key}" for key in keys])


def broadcast_threshold(spark: SparkSession) -> int:
    """Bytes up to which the session broadcasts a join side; -1 where it broadcasts none."""
    text = spark.conf.get("spark.sql.autoBroadcastJoinThreshold").strip().lower()
    number = text.rstrip("bkmgtpi")
    power = "bkmgtp".index((text[len(number):] or "b")[0])
    return int(number) * 1024**power


def make_sample(
    df: DataFrame,
    group_cols: list[str],
    value_col: str | Column,
    weight_col: str | Column | None = None,
    order_col: str | Column | None = None,
) -> Sample:
    """Collect the per-group facts of ``df``; rows whose value is NULL or not finite, or whose weight
    is NULL, take no part and are not counted.

    Group columns may have any name. A negative weight, or a group whose weights do not sum to a
    positive number, is an error.
    """

    def as_column(c):
        return F.col(c) if isinstance(c, str) else c

    grouped = bool(group_cols)
    keys = [f"_k{i}" for i in range(len(group_cols))] if grouped else [ALL]
    columns = [
        F.col("`" + name.replace("`", "``") + "`").alias(key)
        for key, name in zip(keys, group_cols)
    ] or [F.lit(0).alias(ALL)]
    weight = F.lit(1.0) if weight_col is None else as_column(weight_col).cast("double")
    columns += [as_column(value_col).cast("double").alias(X), weight.alias(W)]
    if order_col is not None:
        columns.append(as_column(order_col).alias(ORDER))
    # NaN compares as greater than infinity.
    rows = df.select(*columns).filter("abs(_x) < double('Infinity') AND _w IS NOT NULL")

    aggregates = {
        "n": "count(1)",
        "sw": "sum(_w)",
        "sw2": "sum(_w * _w)",
        "swx": "sum(_w * _x)",
        "lo": "min(_x)",
        "hi": "max(_x)",
    }
    if weight_col is None:
        # One pass suffices with unit weights: Spark's own central moments are the population ones.
        aggregates |= {"var": "var_pop(_x)", "skew": "skewness(_x)", "kurt": "kurtosis(_x)"}
    else:
        aggregates |= {
            "positive_lo": "min(CASE WHEN _w > 0 THEN _x END)",
            "positive_hi": "max(CASE WHEN _w > 0 THEN _x END)",
            "min_w": "min(_w)",
        }
    if weight_col is not None and foldable(rows, keys):
        facts = merged_moments(pin(partial_moments(rows, keys), "partials"), keys)
    else:
        facts = rows.groupBy(*keys).agg(*expressions(aggregates))
    if weight_col is None:
        facts = facts.selectExpr("*", "lo AS positive_lo", "hi AS positive_hi")
    else:
        checked = """CASE WHEN min_w < 0
            THEN cast(raise_error('weights must be non-negative') AS double)
            WHEN sw <= 0 THEN cast(raise_error('weights must sum to a positive value') AS double)
            ELSE sw END"""
        facts = facts.withColumn("sw", F.expr(checked))
    facts = pin(facts, "facts")
    width = " + ".join(f"coalesce(octet_length(cast({key} AS string)), 0)" for key in keys)
    *sizes, key_bytes = facts.selectExpr(
        "count(1)", "coalesce(sum(n), 0)", "coalesce(max(n), 0)", f"coalesce(sum({width}), 0)"
    ).first()
    groups, rows_in_all, _ = sizes
    bytes_in_all, most = key_bytes + FACT_BYTES * groups, broadcast_threshold(df.sparkSession)
    hot = None
    if bytes_in_all > most:
        fitting = most // 2 * groups // bytes_in_all if most > 0 else HOT_GROUPS
        limit = max(HOT_ROWS, rows_in_all // max(1, min(HOT_GROUPS, fitting)))
        hot = pin(facts.filter(F.col("n") > limit).select(*keys), "hot")
    return Sample(
        rows, facts, keys, list(group_cols), weight_col is not None, grouped, *sizes, hot
    )


@named
def value_order(sample: Sample) -> DataFrame:
    """Every row with its place in the value order of its group, ties by the order column (else by
    weight): ``_x``, ``_w``, the order column, ``rank`` (from 1) and ``cum`` (running weight).

    The rows are cut into ranges of values, so a group of any size is ordered by many tasks; what lies
    before a range comes from a table of one row per group and range.
    """
    keys, own = sample.keys, [c for c in (ORDER,) if c in sample.rows.columns]
    order = [X, *(own or [W])]
    placed = pin(sample.rows.repartitionByRange(*keys, *order).withColumn(
        "_part", F.spark_partition_id()), "ranges")
    listed = ", ".join(keys)
    earlier = f"OVER (PARTITION BY {listed} ORDER BY _part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    before = placed.groupBy(*keys, "_part").agg(*expressions({"n": "count(1)", "w": "sum(_w)"})).selectExpr(
        *keys, "_part AS _p", f"coalesce(sum(n) {earlier}, 0) AS _rows", f"coalesce(sum(w) {earlier}, 0) AS _weight")
    inside = f"""OVER (PARTITION BY {listed}, _part ORDER BY {", ".join(order)}
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""
    return join_facts(placed, before, keys, "_part = _p").selectExpr(
        *keys, X, W, *own, f"_rows + row_number() {inside} AS rank", f"_weight + sum(_w) {inside} AS cum")


def heaviest_value(sample: Sample, groups: DataFrame) -> DataFrame:
    """Value of the first row (by order column, else by value) of greatest weight, per given group.

    Carries the other columns of ``groups`` along.
    """
    order = ORDER if ORDER in sample.rows.columns else X
    first = F.expr(f"min_by(_x, struct(-_w, {order}))")
    rows = sample.attach(sample.rows, groups.select(*sample.keys))
    found = rows.groupBy(*sample.keys).agg(first.alias("heaviest"))
    return join_facts(found, groups, sample.keys)

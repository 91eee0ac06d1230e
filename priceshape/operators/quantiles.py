"""Exact weighted quantiles and trimmed means without sorting whole groups.

The statistics need the running weight only around a few cut positions. Groups of more rows than one
task should sort are read twice. The first read gives each cut position a bracket of values
(``brackets.py``). The second cuts the group at the ends of the brackets into value-ordered cells: a
cell between brackets leaves its sums alone, of a bracket the distinct values are kept, with their
weights. Only those are sorted, by cells of at most ``task_rows``; where a bracket has more values, it
is split further, on what was kept, by aggregations with map-side combine. Nothing is approximated.

Such a split cuts at ``SPLIT`` equal widths and, in the same pass, at ``SPLIT`` equal steps of the
signed logarithm, so any cell over all doubles comes down to single values within seven passes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from priceshape.operators.brackets import brackets
from priceshape.operators.samples import ORDER, Sample, expressions, join_facts, named
from priceshape.scratch import pin

SPLIT = 1024
# Rows of a cell that one task sorts.
TASK_ROWS = 100_000
# Share of the weight by which brackets are wider than their positions, as sums in another order may
# differ by rounding. Where they differ by more, the next share is tried; with the last one every row
# is kept.
SLACKS = (1e-9, 1e-4, 2.0)


def _log_scale(x: str) -> str:
    """Signed logarithm: grows with ``x`` over all doubles, 0 at 0 (the least double is 2**-1074)."""
    return f"coalesce(signum({x}) * (log2(abs({x})) + 1076D), 0D)"


def _step(offset: str) -> str:
    return f"least(floor({offset} * {SPLIT}), {SPLIT - 1})"


def _any_cut(positions: list[str]) -> str:
    tests = [
        f"(before <= {p} AND ({p} < before + cell_w OR is_last))" for p in positions
    ]
    return "(" + " OR ".join(tests) + ")"


def _placed(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Add the weight before each cell and its lower neighbour; a group has few cells."""
    ordered = Window.partitionBy(*keys).orderBy("cell_lo")
    earlier = ordered.rowsBetween(Window.unboundedPreceding, -1)
    return cells.select(
        "*",
        F.coalesce(F.sum("cell_w").over(earlier), F.lit(0.0)).alias("before"),
        F.lag("cell_hi").over(ordered).alias("below"),
        F.lead("cell_lo").over(ordered).isNull().alias("is_last"),
    )


def _kept_rows(sample: Sample, positions: list[str], task_rows: int, slack: float) -> DataFrame:
    """One read of all rows, cut at the ends of the brackets: a written table of the distinct values
    inside brackets (``_near``) and one row per cell between them.

    The class of a row is the number of ends at or below it, so rows of a class lie side by side.
    """
    keys = sample.keys
    ends = brackets(sample, positions, task_rows, slack)
    rows = sample.attach(sample.rows, ends)
    count = range(len(positions))
    class_no = " + ".join([f"if(_x >= _a{i}, 1, 0) + if(_x > _b{i}, 1, 0)" for i in count])
    near = " OR ".join([f"coalesce(_x BETWEEN _a{i} AND _b{i}, false)" for i in count])
    order = f"struct(_x, {ORDER if ORDER in sample.rows.columns else '_w'})"
    return pin(
        rows.selectExpr("*", f"{class_no} AS _class", f"({near}) AS _near")
        .groupBy(*keys, "_class", "_near", F.expr("if(_near, _x, NULL)").alias("_value"))
        .agg(*expressions({
            "_lo": "min(_x)", "_hi": "max(_x)", "_first": f"min_by(_w, {order})",
            "_weight": "sum(_w)", "_wx": "sum(_w * _x)"}))
        .selectExpr(*keys, "_class", "_near", "_lo", "_hi", "_lo AS _x", "_weight AS _w", "_wx", "_first"),
        "kept")


def _start(sample: Sample, positions: list[str], task_rows: int) -> tuple[DataFrame, DataFrame]:
    """Rows to finish with (``_x``, ``_w`` and the weight of the first copy, ``_first``) and the first
    cells of every group."""
    keys = sample.keys
    totals = sample.facts.selectExpr(*keys, "n AS group_n", "sw AS group_w")
    for slack in SLACKS if sample.largest_group > task_rows else ():
        kept = _kept_rows(sample, positions, task_rows, slack)
        sums = kept.groupBy(*keys, "_class", "_near").agg(*expressions({
            "cell_lo": "min(_lo)", "cell_hi": "max(_hi)", "cell_n": "count(1)", "cell_w": "sum(_w)",
            "cell_wx": "sum(_wx)"})).drop("_class")
        cells = pin(join_facts(_placed(sums, keys), totals, keys), "cells")
        if cells.filter(f"NOT _near AND {_any_cut(positions)}").isEmpty():
            return kept.filter("_near").select(*keys, "_x", "_w", "_first"), cells.drop("_near")
    cells = sample.facts.selectExpr(
        *keys,
        "lo AS cell_lo",
        "hi AS cell_hi",
        "n AS cell_n",
        "sw AS cell_w",
        "swx AS cell_wx",
        "0D AS before",
        "cast(NULL AS double) AS below",
        "true AS is_last",
        "n AS group_n",
        "sw AS group_w",
    )
    return sample.rows.withColumn("_first", F.col("_w")), cells


def _cells(
    sample: Sample, rows: DataFrame, cells: DataFrame, positions: list[str], task_rows: int
) -> DataFrame:
    """Value-ordered cells per group, fine enough around every cut position."""
    keys = sample.keys
    totals = sample.facts.selectExpr(*keys, "n AS group_n", "sw AS group_w")
    # Halving first keeps the width finite for any pair of doubles. The ends of a cell always fall
    # into different parts, so every split makes progress.
    too_big = f"(cell_n > {task_rows} AND cell_lo / 2 < cell_hi / 2 AND {_any_cut(positions)})"
    offset = "(_x / 2 - cell_lo / 2) / (cell_hi / 2 - cell_lo / 2)"
    while sample.largest_group > task_rows and not cells.filter(too_big).isEmpty():
        targets = cells.filter(too_big).selectExpr(
            *keys,
            "cell_lo",
            "cell_hi",
            f"{_log_scale('cell_lo')} AS _log_lo",
            f"{_log_scale('cell_hi')} AS _log_hi",
        )
        # The ends of a narrow cell may share a logarithm; its widths alone count then.
        log_offset = f"({_log_scale('_x')} - _log_lo) / nullif(_log_hi - _log_lo, 0D)"
        split = (
            sample.attach(rows, targets, "_x BETWEEN cell_lo AND cell_hi")
            .withColumn("_sub", F.expr(_step(offset)))
            .withColumn("_log_sub", F.expr(f"coalesce({_step(log_offset)}, 0)"))
            .groupBy(*keys, "cell_lo", "_sub", "_log_sub")
            .agg(
                *expressions(
                    {
                        "_lo": "min(_x)",
                        "_hi": "max(_x)",
                        "cell_n": "count(1)",
                        "cell_w": "sum(_w)",
                        "cell_wx": "sum(_w * _x)",
                    }
                )
            )
            .selectExpr(*keys, "_lo AS cell_lo", "_hi AS cell_hi", "cell_n", "cell_w", "cell_wx")
        )
        merged = cells.filter(f"NOT {too_big}").select(split.columns).unionByName(split)
        cells = pin(join_facts(_placed(merged, keys), totals, keys), "cells")
    return cells


@named
def cut_statistics(
    sample: Sample,
    positions: list[str],
    measures: dict[str, str],
    cell_measures: dict[str, str] | None = None,
    *,
    task_rows: int | None = None,
) -> DataFrame:
    """Aggregate ``measures`` over the rows around cut positions of the running weight.

    ``positions`` are expressions over ``group_n`` and ``group_w``. ``measures`` are aggregates over
    ``_x``, ``_w``, ``cum`` (running weight), ``prev_cum``, ``prev_x`` and ``step_end`` (running
    weight after the first copy of the value); ``cell_measures`` are aggregates over the cells
    without a cut (``cell_w``, ``cell_wx``, ``before``). Both see ``group_n`` and ``group_w``.
    """
    keys = sample.keys
    rows, cells = _start(sample, positions, task_rows or TASK_ROWS)
    cells = _cells(sample, rows, cells, positions, task_rows or TASK_ROWS)
    cut = _any_cut(positions)
    near = sample.attach(rows, cells.filter(cut), "_x BETWEEN cell_lo AND cell_hi")

    ordered_by = ["_x"] + ([ORDER] if ORDER in rows.columns else ["_w"])
    first_w = f"min_by(_first, struct({', '.join(ordered_by)}))" if sample.weighted else "min(_first)"
    columns = [*keys, "_x", "_w", "cum", "prev_cum", "prev_x", "step_end", "group_n", "group_w"]
    # Copies of one value: interpolation needs no more than the weight of the first of them.
    copies = (
        near.filter("cell_lo = cell_hi")
        .groupBy(*keys, "cell_lo", "before", "below", "group_n", "group_w")
        .agg(*expressions({"_x": "min(_x)", "_first": first_w, "_w": "sum(_w)"}))
        .selectExpr(
            "*",
            "before + _w AS cum",
            "before AS prev_cum",
            "coalesce(below, _x) AS prev_x",
            "before + _first AS step_end",
        )
    )
    order = ", ".join(ordered_by if sample.weighted else ["_x"])
    by_value = f"PARTITION BY {', '.join(f'`{k}`' for k in keys)}, cell_lo ORDER BY {order}"
    running = f"ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    distinct = (
        near.filter("cell_lo < cell_hi")
        .selectExpr("*", f"before + sum(_w) OVER ({by_value} {running}) AS cum")
        .selectExpr(
            "*",
            f"coalesce(lag(cum) OVER ({by_value}), before) AS prev_cum",
            f"coalesce(lag(_x) OVER ({by_value}), below, _x) AS prev_x",
        )
        .selectExpr(
            "*",
            "if(_first = _w, cum, prev_cum + _first) AS step_end",
        )
    )
    rows = distinct.select(columns).unionByName(copies.select(columns))
    result = rows.groupBy(*keys).agg(*expressions(measures))
    if cell_measures:
        rest = cells.filter(f"NOT {cut}").groupBy(*keys).agg(*expressions(cell_measures))
        result = join_facts(result, rest, keys, how="left")
    return result


def quantile_position(q: float) -> str:
    return f"({min(max(q, 0.0), 1.0)!r}D * group_w)"


def quantile_measure(q: float) -> str:
    """Interpolation of the empirical distribution function, clamped at both ends."""
    p = quantile_position(q)
    between = f"""CASE WHEN {p} < step_end
        THEN prev_x + ({p} - prev_cum) / (step_end - prev_cum) * (_x - prev_x) ELSE _x END"""
    return f"""coalesce(max(CASE WHEN prev_cum <= {p} AND {p} < cum THEN {between} END),
        max(CASE WHEN cum <= {p} THEN _x END), min(_x))"""


def trim_positions(trim: float) -> list[str]:
    if not 0 <= trim < 0.5:
        raise ValueError("trim must lie in the interval [0, 0.5)")
    return [f"({trim!r}D * group_w)", f"({1.0 - trim!r}D * group_w)"]


def _kept(start: str, end: str, trim: float) -> str:
    """Weight of the stretch from start to end that lies between the two trim positions."""
    low, high = trim_positions(trim)

    def clip(position: str) -> str:
        return f"least(greatest({position}, {low}), {high})"

    return f"({clip(end)} - {clip(start)})"


@named
def quantiles(
    sample: Sample,
    probabilities: dict[str, float],
    trims: dict[str, float] | None = None,
    *,
    task_rows: int | None = None,
) -> DataFrame:
    """keys + one column per named quantile and per named trimmed mean.

    The boundary rows of a trimmed mean keep the part of their weight that lies inside.
    """
    trims = trims or {}
    positions = [quantile_position(q) for q in probabilities.values()]
    measures = {name: quantile_measure(q) for name, q in probabilities.items()}
    cell_measures, trimmed = {}, []
    for name, trim in trims.items():
        positions += trim_positions(trim)
        row = _kept("prev_cum", "cum", trim)
        # A cell without a cut lies wholly inside or wholly outside.
        cell = _kept("before", "(before + cell_w)", trim)
        measures |= {f"_{name}_w": f"sum({row})", f"_{name}_wx": f"sum({row} * _x)"}
        cell_measures |= {
            f"_{name}_cell_w": f"sum({cell})",
            f"_{name}_cell_wx": f"sum(CASE WHEN cell_w > 0 THEN cell_wx * ({cell} / cell_w) END)",
        }
        total = [f"(_{name}_{part} + coalesce(_{name}_cell_{part}, 0D))" for part in ("wx", "w")]
        trimmed.append(f"{total[0]} / {total[1]} AS {name}")
    result = cut_statistics.keyed(sample, positions, measures, cell_measures, task_rows=task_rows)
    return result.selectExpr(*sample.keys, *probabilities, *trimmed)


@named
def linear_quantiles(
    sample: Sample, probabilities: dict[str, float], *, task_rows: int | None = None
) -> DataFrame:
    """Unweighted quantiles interpolated between order statistics at (n - 1) p."""
    positions, measures, mixed = [], {}, []
    for name, p in probabilities.items():
        rank = f"({p!r}D * (group_n - 1))"
        for end in ("floor", "ceil"):
            position = f"cast({end}{rank} AS double)"
            positions.append(position)
            measures[f"_{name}_{end}"] = (
                f"max(CASE WHEN prev_cum <= {position} AND {position} < cum THEN _x END)"
            )
        measures[f"_{name}_part"] = f"max({rank} - floor{rank})"
        mixed.append(
            f"_{name}_floor + (_{name}_ceil - _{name}_floor) * _{name}_part AS {name}"
        )
    result = cut_statistics.keyed(sample, positions, measures, task_rows=task_rows)
    return result.selectExpr(*sample.keys, *mixed)

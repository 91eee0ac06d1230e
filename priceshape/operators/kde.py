"""Gaussian kernel density on an evenly spaced grid per group.

Rows are not compared with grid points. They are first folded into cells half a bandwidth wide,
keeping for each cell the sums of ``w * exp(-t*t/2) * t**k`` (t = distance from the cell centre in
bandwidths, k < TERMS). Because ``exp(-(u-t)**2/2) = exp(-u*u/2) * exp(-t*t/2) * sum((u*t)**k/k!)``,
these sums give the density of all rows of the cell at any grid point; with |t| <= 1/4 the terms left
out are below double precision. The fold is one aggregation with map-side combine. A cell goes to the
grid points within NEAR bandwidths, so a group has at most about ``grid_points * 4 * NEAR`` cells
however many rows it holds, and only these cells are brought together by group. What lies farther off
adds less than 1e-13 of the density at a point that has a cell within CLOSE bandwidths; points that
have none, in gaps and tails, are summed from the edges of the gaps (``tails.py``).
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from priceshape.operators.samples import Sample, expressions, heaviest_value, join_facts, named
from priceshape.operators.tails import tail_density
from priceshape.scratch import pin

GRID_POINTS = 2048
EXTEND = 3.0  # bandwidths of the grid beyond the least and the greatest value
CELL = 0.5
NEAR = 8.75  # farther off a kernel is below 2.4e-17 of its peak
CLOSE = 4.0
TERMS = 16
TIE = 1e-12  # relative difference from the peak up to which the first grid point is the mode
TASKS_PER_CORE = 4

# Rule of thumb over std, q25, q75 and ess; the interquartile range counts only when positive.
BANDWIDTH_RULE = """0.9D * greatest(0D, if(q75 - q25 <= 0, std, least(std, (q75 - q25) / 1.34D)))
    * pow(ess, -0.2D)"""


def grid_frame(
    table: DataFrame, keys: list[str], grid_points: int, extend: float = EXTEND
) -> DataFrame:
    """keys, h, sw, base, low, step from a table with ``h``, ``lo``, ``hi`` and ``sw``."""
    if grid_points < 2:
        raise ValueError("a density grid needs at least 2 points")
    return (
        table.filter("h > 0")
        .selectExpr(
            *keys,
            "h",
            "sw",
            "lo AS base",
            f"lo - {float(extend)!r}D * h AS low",
            f"hi + {float(extend)!r}D * h AS high",
        )
        .selectExpr(*keys, "h", "sw", "base", "low", f"(high - low) / {grid_points - 1} AS step")
    )


def _exact_sum(name: str, term: str, bits: int, low: int) -> dict[str, str]:
    """Aggregates that add terms of at most 1 in all as whole numbers, so in any order alike: units of
    ``2**-bits``, and of the rest units of ``2**-(bits + low)``."""
    scaled = f"({term}) * {2.0**bits!r}D"
    return {f"{name}_a": f"sum(cast(floor({scaled}) AS bigint))",
            f"{name}_b": f"sum(cast(floor(({scaled} - floor({scaled})) * {2.0**low!r}D) AS bigint))"}


def _exact_value(name: str, bits: int, low: int) -> str:
    return f"(({name}_a + {name}_b / {2.0**low!r}D) / {2.0**bits!r}D)"


def density(sample: Sample, frame: DataFrame, grid_points: int, reproducible: bool = False) -> DataFrame:
    """keys, i, grid_x, density for every grid point with a cell within NEAR bandwidths; ``close`` where
    one is within CLOSE.

    With ``reproducible`` the sums do not depend on how the rows are dealt, to the last bit.
    """
    keys = sample.keys
    centre = f"(base + _cell * (h * {CELL}D))"
    reach = f"h * {NEAR}D"
    first = f"cast(greatest(ceil(({centre} - low - {reach}) / step), 0) AS int)"
    last = f"cast(least(floor(({centre} - low + {reach}) / step), {grid_points - 1}) AS int)"

    powers = ["_kernel" + " * _t" * k for k in range(TERMS)]
    sums = {f"_m{k}": f"sum({power})" for k, power in enumerate(powers)}
    if reproducible:
        low = 61 - sample.largest_group.bit_length()  # the second sum has a term per row
        sums = {n: e for k, power in enumerate(powers) for n, e in _exact_sum(f"_m{k}", power, 61, low).items()}
    cells = (
        sample.attach(sample.rows.filter("_w > 0"), frame)
        .withColumn("_cell", F.expr(f"floor((_x - base) / (h * {CELL}D) + 0.5D)"))
        .filter(f"{first} <= {last}")
        .selectExpr(*keys, "_cell", "_w / sw AS _share", f"(_x - {centre}) / h AS _t")
        .selectExpr(*keys, "_cell", "_t", "_share * exp(-0.5D * _t * _t) AS _kernel")
        .groupBy(*keys, "_cell")
        .agg(*expressions(sums))
    )
    if reproducible:
        cells = cells.selectExpr(*keys, "_cell", *[f"{_exact_value(f'_m{k}', 61, low)} AS _m{k}" for k in range(TERMS)])

    series = f"_m{TERMS - 1} * {1.0 / math.factorial(TERMS - 1)!r}D"
    for k in range(TERMS - 2, -1, -1):
        series = f"({series}) * _u + _m{k} * {1.0 / math.factorial(k)!r}D"
    terms = [f"_m{k}" for k in range(TERMS)]
    # From here on everything of a group stays in the partition its cells are sent to. The cells
    # are few but stand for many grid points, so Spark must not judge by their size; the number of
    # tasks follows the cores, however many groups there are.
    cores = sample.rows.sparkSession.sparkContext.defaultParallelism
    tasks = max(min(sample.group_count, TASKS_PER_CORE * cores), 1)
    return (
        join_facts(cells, frame, keys)
        .repartition(tasks, *keys)
        .selectExpr(*keys, "h", "low", "step", f"{centre} AS _centre", *terms,
                    f"explode(sequence({first}, {last})) AS i")
        .selectExpr(*keys, "h", "i", *terms, "low + i * step AS _grid_x",
                    "(low + i * step - _centre) / h AS _u")
        .selectExpr(*keys, "i", "h", "_grid_x", f"exp(-0.5D * _u * _u) * ({series}) AS _d", "_u")
        .groupBy(*keys, "i")
        .agg(
            F.first("_grid_x").alias("grid_x"),
            F.first("h").alias("_h"),
            *expressions(_exact_sum("_d", "_d", 56, 56) if reproducible else {"_d": "sum(_d)"}),
            F.expr(f"bool_or(abs(_u) <= {CLOSE}D)").alias("close"),
        )
        .selectExpr(*keys, "i", "grid_x", "close",
                    f"{_exact_value('_d', 56, 56) if reproducible else '_d'} / (_h * {math.sqrt(2 * math.pi)!r}D) AS density")
    )


def mode_of(densities: DataFrame, keys: list[str], tie: float = TIE) -> DataFrame:
    """keys + mode: the first grid point whose density is the greatest but for a share of ``tie``.

    Points of equal density (as between two equal values) differ by rounding, which the order of a
    sum decides; ``tie`` of 0 takes the greatest as it is.
    """
    group = ", ".join(f"`{key}`" for key in keys)
    return (
        densities.selectExpr("*", f"max(density) OVER (PARTITION BY {group}) AS _peak")
        .filter(f"density >= _peak * {1 - tie!r}D")
        .groupBy(*keys)
        .agg(F.min("grid_x").alias("mode"))
    )


@named
def kde_mode(
    sample: Sample,
    table: DataFrame,
    *,
    grid_points: int = GRID_POINTS,
    extend: float = EXTEND,
    tie: float = TIE,
    reproducible: bool = False,
) -> DataFrame:
    """keys + mode. ``table`` has ``h`` and the sample facts; groups with ``h <= 0`` take the value
    of their first row of greatest weight. With ``reproducible`` the mode does not depend on how the
    rows are dealt, whatever the ``tie``."""
    keys = sample.keys
    frame = grid_frame(table, keys, grid_points, extend)
    modes = mode_of(density(sample, frame, grid_points, reproducible), keys, tie)
    flat = heaviest_value(sample, table.filter("h <= 0").select(*keys))
    return modes.unionByName(flat.selectExpr(*keys, "heaviest AS mode"))


@named
def kde_curve(
    sample: Sample,
    table: DataFrame,
    *,
    grid_points: int = GRID_POINTS,
    extend: float = EXTEND,
    logarithm: bool = False,
) -> DataFrame:
    """keys, i, grid_x, density for all grid points of all groups, with ``log_density`` if asked.

    The density is accurate relative to itself at every point, unless rows near a point differ in
    weight by more than a millionfold. Where it is below the least double, more than 38 bandwidths from
    all rows, it is 0, and ``log_density`` goes on.

    A group with ``h <= 0`` has a grid from its least to its greatest value that is 0 everywhere
    but 1 at the point nearest the value of its first row of greatest weight.
    """
    keys = sample.keys
    points = f"explode(sequence(0, {grid_points - 1})) AS i"
    columns = [*keys, "i", "grid_x", "density"] + ["log_density"] * logarithm
    frame = grid_frame(table, keys, grid_points, extend)
    close = pin(density(sample, frame, grid_points).filter("close"), "density")
    tails = tail_density(sample, frame, close.select(*keys, "i"), grid_points)
    smooth = close.withColumn("log_density", F.ln("density")).select(columns).unionByName(tails.select(columns))
    flat_table = table.filter("h <= 0").selectExpr(
        *keys, "lo", f"(hi - lo) / {grid_points - 1} AS step"
    )
    peak = "if(step > 0, cast(ceil((heaviest - lo) / step - 0.5D) AS int), 0)"
    flat = (
        heaviest_value(sample, flat_table)
        .selectExpr(*keys, "lo", "step", f"{peak} AS _peak", points)
        .selectExpr(*keys, "i", "lo + i * step AS grid_x", "if(i = _peak, 1D, 0D) AS density")
    )
    return smooth.unionByName(flat.withColumn("log_density", F.ln("density")).select(columns))

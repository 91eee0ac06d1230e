"""Kernel density far from all rows: in gaps and tails, in logarithms.

A grid point more than ``kde.CLOSE`` bandwidths from every row has a nearest row on its left or right,
and what is nearer to the point than any other row is the edge of a gap. Seen from a point ``D``
bandwidths beyond an edge, a row ``d`` bandwidths behind it weighs ``exp(-D*D/2 - D*d - d*d/2)``, so
rows more than ``WINDOW`` behind the edge add less than 1e-32 of what the edge itself adds. The rows of
a window are folded into cells that grow with their distance from the edge, eight to each doubling of
``d`` down to ``2**FINEST``, with the sums of ``w * exp(-d*d/2) * t**k`` (t = distance from the cell's
centre). As ``t`` is at most 1/16 of the distance, the series of ``exp(-D*t)`` is exact to about 1e-13
where ``exp(-D*d)`` still counts. The factor ``exp(-D*D/2)`` stays in the logarithm.

A group has at most a gap per grid point, and a gap two edges with fewer than 200 cells each, so the
work is one pass over the rows for the edges, one for the cells, and a bounded number of cells.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from priceshape.operators.samples import Sample, expressions, join_facts
from priceshape.scratch import pin

#: Bandwidths behind an edge that count, and the least doubling of the cells.
WINDOW, FINEST = 9.0, -20
TERMS = 16
#: Beyond this distance the rows within 2**FINEST bandwidths of an edge count as at the edge.
FARTHEST = 2.0**24


def tail_density(sample: Sample, frame: DataFrame, close: DataFrame, grid_points: int) -> DataFrame:
    """keys, i, grid_x, density and log_density of the grid points that are not in ``close`` (keys, i).

    ``frame`` has keys, h, sw, base, low and step. The density is accurate relative to itself; where it
    is below the least double it is 0 and its logarithm goes on.
    """
    keys = sample.keys
    counts = close.groupBy(*keys).agg(F.count("*").alias("_n"))
    open_ = pin(join_facts(frame, counts, keys, how="left").filter(f"coalesce(_n, 0) < {grid_points}").drop("_n"), "open")
    if open_.isEmpty():
        columns = [f"`{f.name}` {f.dataType.simpleString()}" for f in open_.select(*keys).schema]
        return sample.rows.sparkSession.createDataFrame(
            [], ", ".join(columns) + ", i int, grid_x double, density double, log_density double")
    rows = sample.attach(sample.rows.filter("_w > 0"), open_)
    extremes = rows.groupBy(*keys, F.expr("cast(floor((_x - low) / step) AS int)").alias("_k")).agg(
        *expressions({"_least": "min(_x)", "_most": "max(_x)"}))
    points = join_facts(open_.selectExpr(*keys, f"explode(sequence(0, {grid_points - 1})) AS i"),
                        close.selectExpr(*keys, "i AS _i"), keys, "i = _i", how="left_anti")
    group = ", ".join(f"`{k}`" for k in keys)
    order = f"OVER (PARTITION BY {group} ORDER BY _at ROWS BETWEEN"
    # Points and the extremes of the steps between them, at most two per point, in order.
    placed = pin(
        extremes.selectExpr(*keys, "_k + 0.5D AS _at", "cast(NULL AS int) AS i", "_least", "_most")
        .unionByName(points.selectExpr(*keys, "cast(i AS double) AS _at", "i"), allowMissingColumns=True)
        .selectExpr(*keys, "i", f"last(_most, true) {order} UNBOUNDED PRECEDING AND CURRENT ROW) AS _left",
                    f"first(_least, true) {order} CURRENT ROW AND UNBOUNDED FOLLOWING) AS _right")
        .filter("i IS NOT NULL"), "points")
    sides = placed.selectExpr(*keys, "i", "stack(2, -1, _left, 1, _right) AS (side, edge)").filter("edge IS NOT NULL")
    edges = join_facts(sides.select(*keys, "side", "edge").distinct(), open_.selectExpr(*keys, "h AS _h", "base AS _base"), keys)
    bucket = f"cast(floor((edge - _base) / (_h * {WINDOW}D)) AS bigint)"
    reached = pin(edges.selectExpr(*keys, "side", "edge", f"explode(array({bucket}, {bucket} + side)) AS _b"), "edges")
    behind = "((_x - edge) * side / h)"
    near = join_facts(
        rows.withColumn("_rb", F.expr(f"cast(floor((_x - base) / (h * {WINDOW}D)) AS bigint)")), reached, keys,
        f"_rb = _b AND {behind} BETWEEN 0 AND {WINDOW}D")
    scale = f"pow(2D, greatest(coalesce(floor(log2(nullif(_d, 0D))), {FINEST}D), {FINEST}D) - 3)"
    powers = {f"_m{k}": "sum(_kernel" + " * _t" * k + ")" for k in range(TERMS)}
    cells = (
        near.selectExpr(*keys, "side", "edge", "_w / sw AS _share", f"{behind} AS _d")
        .withColumn("_scale", F.expr(scale))
        .withColumn("_centre", F.expr("(floor(_d / _scale) + 0.5D) * _scale"))
        .selectExpr(*keys, "side", "edge", "_centre", "_d - _centre AS _t", "_share * exp(-0.5D * _d * _d) AS _kernel")
        .groupBy(*keys, "side", "edge", "_centre").agg(*expressions(powers)))
    terms = [f"_m{k}" for k in range(TERMS)]
    series = f"_m{TERMS - 1} * {1.0 / math.factorial(TERMS - 1)!r}D"
    for k in range(TERMS - 2, -1, -1):
        series = f"({series}) * (-_far) + _m{k} * {1.0 / math.factorial(k)!r}D"
    weight = f"CASE WHEN _far * _centre > 700 THEN 0D WHEN _far > {FARTHEST}D THEN _m0 ELSE exp(-_far * _centre) * ({series}) END"
    located = join_facts(sides, open_, keys).selectExpr(
        *keys, "i", "side AS _side", "edge AS _edge", "h", "low + i * step AS grid_x", "(edge - (low + i * step)) * side / h AS _far")
    summed = join_facts(located, cells, keys, "_side = side AND _edge = edge").groupBy(
        *keys, "i", "h", "grid_x", "_side", "_far").agg(F.expr(f"sum({weight})").alias("_sum"))
    # The nearer side keeps its factor in the logarithm.
    both = summed.groupBy(*keys, "i", "h", "grid_x").agg(
        F.min("_far").alias("_nearest"), F.collect_list(F.struct("_far", "_sum")).alias("_sides"))
    total = "aggregate(_sides, 0D, (a, s) -> a + s._sum * exp(-0.5D * (s._far - _nearest) * (s._far + _nearest)))"
    return both.selectExpr(*keys, "i", "grid_x", f"ln({total} / (h * {math.sqrt(2 * math.pi)!r}D)) - 0.5D * _nearest * _nearest AS log_density") \
        .selectExpr(*keys, "i", "grid_x", "exp(log_density) AS density", "log_density")

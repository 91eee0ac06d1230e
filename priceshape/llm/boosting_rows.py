"""Boosted trees from rows of any number: the tasks add up gradients by node, feature and bin, level by
level, and only these sums (bounded by the tree, not by the rows) come to the driver.

All rows take part in the bins and in every tree. Sums are of whole numbers, so their order does not
matter, and those of one child of a split are their parent's less those of the other: only the rows of
the child with less hessian are added up.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from priceshape.llm.boosting import Trees, splits
from priceshape.llm.common import slices
from priceshape.scratch import pin

#: Gradients are summed in units of this.
UNIT = 2.0**-36
#: Trees after which the margins of the rows are written anew.
STRETCH = 10
#: Rows that are held in one row of the binned table, and such rows that a task takes at once.
PACK, PACKS = 256, 16
#: Partitions of the sums of a level, which the tree bounds; a task gives each place once, so nothing is
#: folded before they are dealt.
DEALT = 4
#: Bits of a single-precision value that are left out in the order of values: cells of 1/512.
CELL_BITS = 14


def _matrix(column: pa.Array, width: int, kind) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width)


def _packed(y: np.ndarray, x: np.ndarray, margin: np.ndarray) -> pa.RecordBatch:
    cuts = range(0, len(y), PACK)
    return pa.RecordBatch.from_arrays(
        [pa.array([a[i:i + PACK].tobytes() for i in cuts], pa.binary()) for a in (y, x, margin)], ["y", "x", "margin"])


def _unpacked(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    y, x, margin = (_matrix(batch.column(c), n, kind) for c, n, kind in (
        ("y", 1, np.int32), ("x", width, np.uint8), ("margin", 1, np.float64)))
    return y[:, 0], x, margin[:, 0]


def _ordered(x: np.ndarray) -> np.ndarray:
    """Whole numbers in the order of single-precision values."""
    bits = np.ascontiguousarray(x + np.float32(0), np.float32).view(np.int32).astype(np.int64)
    return np.where(bits < 0, -(bits & 0x7FFFFFFF), bits) >> CELL_BITS


def bin_edges(rows: DataFrame, width: int, n: int, bins: int) -> np.ndarray:
    """Upper edges (features, bins - 1): the greatest value of the cell that holds the quantile, by counts
    of all rows."""

    def counted(batches):
        for batch in slices(batches, 4096):
            x = _matrix(batch.column(0), width, np.float32)
            for f in range(width):
                cell, place, number = np.unique(_ordered(x[:, f]), return_inverse=True, return_counts=True)
                high = np.full(len(cell), -np.inf, np.float32)
                np.maximum.at(high, place, x[:, f])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(cell), f, np.int32)), pa.array(cell), pa.array(number, pa.int64()),
                     pa.array(high.astype(np.float64))], ["f", "cell", "n", "high"])

    cells = rows.select("x").mapInArrow(counted, "f int, cell long, n long, high double").groupBy("f", "cell").agg(
        F.sum("n").alias("n"), F.max("high").alias("high"))
    # One row per cell of a feature's values: bounded by their precision, not by the rows.
    upto = cells.withColumn("upto", F.sum("n").over(Window.partitionBy("f").orderBy("cell")))
    rank = np.floor(np.linspace(0, 1, bins + 1)[1:-1] * (n - 1)).astype(np.int64)
    wanted = F.exists(F.array(*[F.lit(int(r)) for r in rank]), lambda r: (r < F.col("upto")) & (r >= F.col("upto") - F.col("n")))
    edges = np.zeros((width, bins - 1))
    found = upto.where(wanted).orderBy("f", "cell").select("f", "upto", "high").toPandas()
    for f, part in found.groupby("f"):
        edges[f] = part["high"].to_numpy()[np.searchsorted(part["upto"].to_numpy(), rank, side="right")]
    return edges


def _down(binned: np.ndarray, feature: np.ndarray, cut: np.ndarray, levels: int) -> np.ndarray:
    """Number of the node within its level that each row comes to; a closed node sends everything left."""
    node, rows = np.zeros(len(binned), np.int64), np.arange(len(binned))
    for level in range(levels):
        at = 2**level - 1 + node
        node = 2 * node + (binned[rows, feature[at]] > cut[at])
    return node


def fit_rows(rows: DataFrame, width: int, trees: int = 50, depth: int = 4, bins: int = 48, rate: float = 0.15,
             ridge: float = 1.0, least: float = 4.0) -> Trees:
    """``boosting.fit`` over all rows of ``rows`` (``x``: ``width`` single-precision values, ``y`` 0 or 1)."""
    n, ones = rows.agg(F.count("*"), F.sum("y")).first()
    edges = bin_edges(rows, width, n, bins)
    share = (ones + 1.0) / (n + 2.0)
    base = float(np.log(share / (1 - share)))
    inner, size = 2**depth - 1, width * bins

    def binned(batches):
        for batch in slices(batches, 4096):
            x = _matrix(batch.column("x"), width, np.float32)
            made = np.empty(x.shape, np.uint8)
            for f in range(width):
                made[:, f] = np.searchsorted(edges[f], x[:, f], side="left")
            yield _packed(batch.column("y").to_numpy(), made, np.full(len(x), base))

    schema = "y binary, x binary, margin binary"
    table = pin(rows.select("x", "y").mapInArrow(binned, schema), "binned")
    made: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def moved(margin: np.ndarray, x: np.ndarray, new: list) -> np.ndarray:
        for feature, cut, leaf in new:
            margin = margin + leaf[_down(x, feature, cut, depth)]
        return margin

    def sums(new: list, feature: np.ndarray, cut: np.ndarray, level: int, counted: np.ndarray,
             above: np.ndarray | None) -> np.ndarray:
        """Gradients and hessians (whole numbers) by node of a level, feature and bin: of the ``counted``
        nodes from the rows, of their siblings from those and the level ``above``."""
        def task(batches):
            total = np.zeros((2, 2**level * size), np.int64)
            for batch in slices(batches, PACKS):  # whose sums of whole numbers are exact in double precision
                y, x, margin = _unpacked(batch, width)
                node = _down(x, feature, cut, level)
                at = np.flatnonzero(counted[node])
                y, x, margin, node = y[at], x[at], margin[at], node[at]
                p = 1.0 / (1.0 + np.exp(-moved(margin, x, new)))
                key = (x + (np.arange(width) * bins + (node * size)[:, None])).ravel()
                for k, v in enumerate((p - y, p * (1 - p))):
                    total[k] += np.bincount(key, np.repeat(np.round(v / UNIT), width), total.shape[1]).astype(np.int64)
            there = np.flatnonzero(total.any(0))
            yield pa.RecordBatch.from_arrays(
                [pa.array(there.astype(np.int32)), *(pa.array(t[there]) for t in total)], ["place", "g", "h"])

        found = table.mapInArrow(task, "place int, g long, h long").repartition(DEALT, "place").groupBy("place").agg(
            F.sum("g").alias("g"), F.sum("h").alias("h")).toArrow()
        total = np.zeros((2, 2**level * size), np.int64)
        for k, name in enumerate("gh"):
            total[k, found["place"].to_numpy()] = found[name].to_numpy()
        total = total.reshape(2, 2**level, width, bins)
        if above is not None:
            rest = np.flatnonzero(~counted)
            total[:, rest] = above[:, rest // 2] - total[:, rest ^ 1]
        return total

    written = 0
    for done in range(trees):
        if done - written == STRETCH:
            new = made[written:]

            def ahead(batches, new=new):
                for batch in slices(batches, PACKS):
                    y, x, margin = _unpacked(batch, width)
                    yield _packed(y, x, moved(margin, x, new))

            table, written = pin(table.mapInArrow(ahead, schema), "binned"), done
        feature, cut = np.zeros(inner, np.int64), np.full(inner, bins, np.int64)  # no bin is above: closed
        total, counted = None, np.ones(1, bool)
        for level in range(depth):
            nodes = np.arange(2**level)
            total = sums(made[written:], feature, cut, level, counted, total)
            left = (total * UNIT).cumsum(3)
            f, b, good = splits(*left, ridge, least)
            feature[2**level - 1 + nodes] = np.where(good, f, 0)
            cut[2**level - 1 + nodes] = np.where(good, b, bins)
            whole = left[:, :, 0, -1]
            part = np.where(good, left[:, nodes, f, b], whole)
            fewer = 2 * part[1] <= whole[1]  # a closed node sends everything left
            counted = np.column_stack([fewer, ~fewer]).ravel()
        g, h = np.stack([part, whole - part], axis=2).reshape(2, -1)
        made.append((feature, cut, -rate * g / (h + ridge)))
    threshold = [np.where(cut < bins, edges[feature, np.minimum(cut, bins - 2)], np.inf) for feature, cut, _ in made]
    return Trees(base, np.array([m[0] for m in made]), np.array(threshold), np.array([m[2] for m in made]))

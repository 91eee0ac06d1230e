"""Connected components of an edge table, by alternating large-star and small-star steps.

Each step is one aggregation (with map-side combine) and one join; a node of very many edges is
split by Spark's skew-join handling. Forests found inside the partitions first shrink the table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from priceshape.scratch import pin


def forest(pairs: np.ndarray) -> np.ndarray:
    """Star edges (node, smallest node) of the components of ``pairs`` (n x 2)."""
    names, ends = np.unique(pairs, return_inverse=True)
    ends = ends.reshape(-1, 2)
    root = np.arange(len(names))
    while len(ends):
        low = np.minimum(root[ends[:, 0]], root[ends[:, 1]])
        new = root.copy()
        np.minimum.at(new, root[ends[:, 0]], low)
        np.minimum.at(new, root[ends[:, 1]], low)
        while True:
            jumped = new[new]
            if (jumped == new).all():
                break
            new = jumped
        root = new[root]
        ends = ends[root[ends[:, 0]] != root[ends[:, 1]]]
    moved = root != np.arange(len(names))
    return np.column_stack([names[moved], names[root[moved]]])


def _local(batches):
    """Forest of a partition, folded whenever a million edges have come together."""
    held: list[np.ndarray] = []
    size = 0
    for batch in batches:
        held.append(np.column_stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()]))
        size += batch.num_rows
        if size > 1_000_000:
            held = [forest(np.concatenate(held))]
            size = len(held[0])
            if size > 500_000:
                yield _batch(held.pop())
                size = 0
    if held:
        yield _batch(forest(np.concatenate(held)))


def _batch(edges: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(edges[:, 0]), pa.array(edges[:, 1])], ["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root`` (smallest node of its component) of every node but the roots.

    ``edges`` has two long columns without NULLs; direction, repeats and self-loops don't matter. No
    edges give no rows. Each round is written to the shared folder, which cuts the lineage.
    """
    a, b = edges.columns
    now = pin(edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a <> b")
              .mapInArrow(_local, "a long, b long").distinct(), "edges")
    mark = None
    while True:
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = both.where("b > a").join(least, "a").select(
            F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lowest, "a")
        # Everything that is not the smallest neighbour is tied to it, and so is the node itself.
        now = pin(small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
                  .union(lowest.select("a", F.col("m").alias("b"))).where("a <> b").distinct(),
                  "edges")
        found = now.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
        if found == mark:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        mark = found

"""Covering locality-sensitive hashing of 64-bit fingerprints.

Give every bit a non-zero vector of r + 1 bits, and let mask v keep the bits whose vector has odd
inner product with v. At most r differing bits span at most r dimensions, so some v is orthogonal to
all of them: its mask keeps none, and the two fingerprints share that table's bucket. With the
2**(r + 1) - 1 masks no pair within the radius is missed.

A bucket of more than ``LIMIT`` rows is not compared pair by pair but cut again, by the same
construction on the bits that its mask left out, as often as needed; when r bits or fewer are left,
all of the bucket is within the radius. That is exact too, so no bucket needs a cap.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from priceshape.llm.components import forest
from priceshape.scratch import pin

#: Rows of a bucket that one task compares, 256 at a time.
LIMIT = 8192
_ORDER = np.random.default_rng(5).permutation(64)  # bits in mixed order, the same in every run


def masks(radius: int, used: int = 0) -> list[int]:
    """Masks over the bits not in ``used``; none if ``radius`` bits or fewer are left."""
    left = [int(i) for i in _ORDER if not used >> int(i) & 1]
    if len(left) <= radius:
        return []
    vectors = 2 ** (radius + 1) - 1
    return [sum(1 << bit for k, bit in enumerate(left) if (k % vectors + 1 & v).bit_count() & 1)
            for v in range(1, vectors + 1)]


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.uint64).view(np.int64))


def _deal(radius: int):
    """(table, used, id, fp) rows to rows of the next masks; ``bucket`` mixes table and kept bits."""
    known: dict[int, list[int]] = {}

    def dealt(batches):
        for batch in batches:
            table = batch.column(0).to_numpy()
            used = batch.column(1).to_numpy().view(np.uint64)
            ids = batch.column(2).to_numpy()
            fp = batch.column(3).to_numpy().view(np.uint64)
            for u in np.unique(used):
                u = int(u)
                at = np.flatnonzero(used == np.uint64(u))
                new = known.setdefault(u, masks(radius, u))
                for m in new:
                    kept = np.uint64(u | m)
                    mixed = (fp[at] & kept) + (kept ^ table[at].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
                    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                    yield pa.RecordBatch.from_arrays(
                        [_signed(mixed ^ (mixed >> np.uint64(32))), pa.array(table[at]),
                         _signed(np.full(len(at), kept)), pa.array(ids[at]), _signed(fp[at])],
                        ["bucket", "t", "used", "id", "fp"])

    return dealt


def _near(ids: np.ndarray, fp: np.ndarray, radius: int) -> np.ndarray:
    """Forest of the pairs of one bucket within the radius."""
    edges = np.empty((0, 2), np.int64)
    for i in range(0, len(fp), 256):
        x, y = np.nonzero(np.bitwise_count(fp[i:i + 256, None] ^ fp[None, i:]) <= radius)
        x, y = x[x < y] + i, y[x < y] + i
        if len(x):
            edges = forest(np.concatenate([edges, np.column_stack([ids[x], ids[y]])]))
    return edges


def _link(radius: int, limit: int):
    """Sorted bucket rows to edges (kind 0: a, b) and rows of too large buckets (kind 1)."""

    def out(kind, a, b, t, used):
        n = len(a)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(n, kind, np.int32)), pa.array(a), pa.array(b),
             pa.array(np.zeros(n, np.int32) if t is None else t),
             pa.array(np.zeros(n, np.int64) if used is None else used)],
            ["kind", "a", "b", "t", "used"])

    def done(rows):
        """One whole bucket that stayed below the limit."""
        _, t, used, ids, fp = rows
        edges = _near(ids, fp.view(np.uint64), radius)
        if len(edges):
            yield out(0, edges[:, 0], edges[:, 1], None, None)

    def linked(batches):
        held: list[np.ndarray] | None = None  # the last bucket so far, while it is small
        large: tuple | None = None  # the bucket that is being handed on, and its first id
        for batch in batches:
            cols = [c.to_numpy() for c in batch.columns]
            bucket = cols[0]
            ends = np.flatnonzero(np.diff(bucket)) + 1
            starts = np.concatenate([[0], ends])
            ends = np.concatenate([ends, [len(bucket)]])
            # Buckets inside the batch with exactly two rows are compared all at once.
            whole = np.ones(len(starts), bool)
            whole[0] = whole[-1] = False
            two = starts[whole & (ends - starts == 2)]
            if len(two):
                near = np.bitwise_count((cols[4][two] ^ cols[4][two + 1]).view(np.uint64)) <= radius
                if near.any():
                    yield out(0, cols[3][two[near]], cols[3][two[near] + 1], None, None)
            for i in np.flatnonzero(~whole | (ends - starts > 2)):
                rows = [c[starts[i]:ends[i]] for c in cols]
                if large is not None and large[0] != rows[0][0]:
                    large = None
                if held is not None and held[0][0] != rows[0][0]:
                    yield from done(held)
                    held = None
                if held is not None:
                    rows = [np.concatenate(x) for x in zip(held, rows, strict=True)]
                    held = None
                if large is None and len(rows[0]) <= limit:
                    held = rows
                    continue
                first = large[1] if large else rows[3][0]
                large = (rows[0][0], first)
                if masks(radius, int(rows[2][:1].view(np.uint64)[0])):
                    yield out(1, rows[3], rows[4], rows[1], rows[2])
                else:  # all of it is within the radius
                    yield out(0, rows[3], np.full(len(rows[3]), first), None, None)
        if held is not None:
            yield from done(held)

    return linked


def close_pairs(rows: DataFrame, radius: int, limit: int = LIMIT) -> DataFrame:
    """Edges ``a``, ``b`` between ids, such that exactly the components of the pairs within
    ``radius`` bits in some table are joined.

    ``rows``: ``t`` (int; fingerprints are compared inside a table), ``id`` and ``fp`` (long). Edges
    of a bucket are its forest, so their number is at most the number of rows, whatever the size of
    the groups. Equal fingerprints of different ids are linked.
    """
    found, level = None, rows.select("t", F.lit(0).cast("long").alias("used"), "id", "fp")
    while True:
        dealt = level.mapInArrow(_deal(radius), "bucket long, t int, used long, id long, fp long")
        made = pin(dealt.repartition("bucket").sortWithinPartitions("bucket", "t", "used")
                   .mapInArrow(_link(radius, limit), "kind int, a long, b long, t int, used long"), "links")
        edges = made.where("kind = 0 AND a <> b").select("a", "b")
        found = edges if found is None else found.union(edges)
        level = made.where("kind = 1").select("t", "used", F.col("a").alias("id"), F.col("b").alias("fp"))
        if not level.take(1):
            return found

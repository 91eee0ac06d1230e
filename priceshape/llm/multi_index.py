"""Nearest neighbours by an inverted multi-index.

Two codebooks quantise the halves of a vector; a cell is a pair of centroids. A query visits the cells
in ascending sum of the two distances, taken from a heap, until they hold ``candidates`` entries;
the entries are ranked again by the exact distance on the original vectors. The codebooks are
fitted on a bounded sample, but every vector is in the index.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from priceshape.llm.common import query, slices, table
from priceshape.llm.vectors import clean, matrix, packed, unpacked
from priceshape.scratch import pin

#: Vectors the codebooks are fitted on.
SAMPLE = 16_384
#: Entries of a cell, and queries that visit it, in one task.
CHUNK = 1024


def codebook(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """k-means from spread rows of ``x``; centroids that lose all rows are dropped."""
    x = np.unique(x, axis=0)
    k = min(k, len(x))
    centres = x[np.random.default_rng(1).permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        near = nearest(x, centres)
        n = np.bincount(near, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        centres = sums[n > 0] / n[n > 0, None]
    return centres


def _squares(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum(0, (x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1))


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return _squares(x, centres).argmin(1)


def visit(first: np.ndarray, second: np.ndarray, sizes: np.ndarray, candidates: int) -> list[int]:
    """Cells in ascending ``first[i] + second[j]`` until they hold ``candidates`` entries."""
    a, b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    heap = [(first[a[0]] + second[b[0]], 0, 0)]
    cells, held = [], 0
    while heap and held < candidates:
        _, i, j = heapq.heappop(heap)
        cell = int(a[i]) * len(second) + int(b[j])
        if sizes[cell]:
            cells.append(cell)
            held += int(sizes[cell])
        # (i, j + 1) comes from (i, j), and (i + 1, 0) from (i, 0): each pair is met once.
        if j + 1 < len(b):
            heapq.heappush(heap, (first[a[i]] + second[b[j + 1]], i, j + 1))
        if j == 0 and i + 1 < len(a):
            heapq.heappush(heap, (first[a[i + 1]] + second[b[0]], i + 1, 0))
    return cells


def nearest_vectors(vectors: DataFrame, queries: DataFrame, k: int = 10, candidates: float = 0.55,
                    key: str = "vec_id", vector: str = "embedding", sample: int = SAMPLE) -> DataFrame:
    """The ``k`` nearest found of each query by Euclidean distance, over all vectors but its own.

    ``queries`` has the ids of the query vectors. ``candidates`` is the share of all different
    vectors that the visited cells hold, 50 ``k`` of them at least. Returns ``query_id``, ``rank``
    (from 1), ``vec_id`` and ``score``, nearest first, ties to the smaller id. Vectors that are NULL,
    zero or hold NULL or non-finite components take no part, nor do NULL ids; a repeated id counts
    once. Of equal vectors the k + 1 smallest ids are entries, as no other of them can be a
    result. An empty table gives no rows. The number of centroids grows with the fourth root of the
    table, that of cells with its square root. A large share is needed where vectors have no
    structure (on random directions in 64 dimensions 0.55 finds about 0.96 of the true neighbours);
    a clustered table allows a smaller one.
    """
    spark = vectors.sparkSession
    rows, size = clean(vectors, key, vector, zeros=False)
    result = "query_id long, rank int, vec_id long, score double"
    entries = pin(rows.withColumn("copy", F.row_number().over(Window.partitionBy("v").orderBy("id")))
                  .where(F.col("copy") <= k + 1), "entries")
    n = entries.count()
    if not n:
        return spark.createDataFrame([], result)
    # At most ``sample`` vectors reach the driver.
    picked = entries.where("copy = 1").orderBy(F.xxhash64(F.lit(1), "id"), "id").limit(sample).select("v").toArrow()
    x = matrix(picked.column("v").combine_chunks(), size)
    half = size // 2 or size
    halves = [slice(0, half), slice(half, size)] if half < size else [slice(0, size), slice(0, size)]
    centroids = max(2, round(6 * n**0.25))
    books = [codebook(x[:, h], centroids) for h in halves]
    cells = len(books[0]) * len(books[1])  # grows with the square root of the table

    def placed(batches):
        for batch in slices(batches, 4096):
            v = matrix(batch.column("v"), size)
            near = [nearest(v[:, h], b) for h, b in zip(halves, books, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(near[0], pa.int32()), pa.array(near[1], pa.int64())],
                ["id", "v", "first", "second"])

    index = pin(entries.select("id", "v").mapInArrow(
        placed, "id long, v array<double>, first int, second long"), "index")
    sizes = np.zeros(cells, np.int64)
    for r in index.groupBy("first", "second").count().collect():  # one row per cell
        sizes[r["first"] * len(books[1]) + r["second"]] = r["count"]
    enough = max(50 * k, int(np.ceil(candidates * n)))

    def probed(batches):
        for batch in slices(batches, 512):
            v = matrix(batch.column("v"), size)
            near = (_squares(v[:, h], b) for h, b in zip(halves, books, strict=True))
            at, firsts, seconds = [], [], []
            for row, (f, g) in enumerate(zip(*near, strict=True)):
                by_first: dict[int, list[int]] = {}
                for cell in visit(f, g, sizes, enough):
                    by_first.setdefault(cell // len(g), []).append(cell % len(g))
                at += [row] * len(by_first)
                firsts += by_first
                seconds += by_first.values()
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(pa.array(at, pa.int64())), pa.array(firsts, pa.int32()),
                 pa.array(seconds, pa.list_(pa.int32()))], ["id", "first", "seconds"])

    asked = queries.select(F.col(queries.columns[0]).cast("long").alias("id")).where("id IS NOT NULL").distinct()
    wanted = pin(rows.join(asked, "id").select("id", "v"), "queries")
    probes = pin(wanted.mapInArrow(probed, "id long, first int, seconds array<int>"), "probes")
    # The cells of a centroid of the first book lie together. A crowded one is cut into parts, and so
    # are the queries that visit it.
    def parts_of(frame: DataFrame, name: str) -> DataFrame:
        return frame.groupBy("first").agg(
            F.expr(f"CAST((count(*) + {CHUNK - 1}) div {CHUNK} AS INT)").alias(name))

    parts = pin(parts_of(index, "parts").join(parts_of(probes, "askers"), "first"), "parts")

    def share(n: str, salt: int):
        return F.pmod(F.xxhash64(F.lit(salt), "id"), F.col(n)).cast("int")

    def every(n: str):
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    left = packed(index.join(parts, "first").withColumn("part", share("parts", 2)).select(
        "id", "v", "second", "first", "part", "askers"), ["first", "part", "askers"], ["second"]) \
        .withColumn("asker", every("askers"))
    right = probes.join(parts, "first").withColumn("asker", share("askers", 3)).withColumn("part", every("parts")) \
        .join(wanted, "id").select("first", "part", "asker", "id", "v", "seconds")

    def ranked(key, a: pa.Table, b: pa.Table) -> pa.Table:
        found_q, found_c, found_d = [], [], []
        if a.num_rows and b.num_rows:
            ids, w, second = unpacked(a, size, ["second"])
            v = matrix(b.column("v").combine_chunks(), size)
            for q, x, cells_of in zip(b.column("id").to_pylist(), v, b.column("seconds").to_pylist(), strict=True):
                open_ = np.zeros(len(books[1]), bool)
                open_[cells_of] = True
                inside = np.flatnonzero(open_[second] & (ids != q))
                d = np.sqrt(((w[inside] - x) ** 2).sum(1))
                best = _first(d, ids[inside], k)
                found_q.append(np.full(len(best), q))
                found_c.append(ids[inside[best]])
                found_d.append(d[best])
        join = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
        return pa.table({"query_id": pa.array(join(found_q, np.int64), pa.int64()), "vec_id": pa.array(join(found_c, np.int64), pa.int64()),
                         "score": pa.array(join(found_d, np.float64), pa.float64())})

    near = left.groupBy("first", "part", "asker").cogroup(right.groupBy("first", "part", "asker")).applyInArrow(
        ranked, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")


def _first(d: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """The k smallest by distance, then id, all ties of the kth considered."""
    close = np.arange(len(d)) if len(d) <= k else np.flatnonzero(d <= np.partition(d, k - 1)[k - 1])
    return close[np.lexsort((ids[close], d[close]))][:k]


@query("op1_inverted_multi_index")
def op1(spark, sf_dir):
    """Ten nearest found of every hundredth vector."""
    vectors = table(spark, sf_dir, "embeddings")
    return nearest_vectors(vectors, vectors.where("vec_id % 100 = 0").select("vec_id"))

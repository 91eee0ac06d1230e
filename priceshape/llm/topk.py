"""Exact top-k inner products by distributed histogram selection.

Queries and candidates form a grid of block pairs; a task scores one pair with a matrix product. Each
round adds up histograms of all scores of a query over its present interval, and the bin that holds
its kth score becomes the next interval, until that is a single integer. A block pair reports
only the bins down to its own kth score, as no lower one can hold the global kth. A last pass keeps
the scores above the kth and, of those equal to it, the smallest ids that are needed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from priceshape.llm.common import query, table
from priceshape.llm.vectors import clean, packed, unpacked
from priceshape.scratch import pin

#: Vectors of a candidate block and of a query block, and bins of a round.
CANDIDATES, QUERIES_PER_BLOCK, BINS = 8192, 2048, 1024


def _scores(q: np.ndarray, c: np.ndarray, bound: int) -> np.ndarray:
    """Exact integer products: in doubles while every partial sum fits, else in 64-bit integers."""
    if bound < 1 << 53:
        return (q @ c.T).astype(np.int64)
    return q.astype(np.int64) @ c.astype(np.int64).T


def top_products(vectors: DataFrame, queries: DataFrame, k: int = 5, scale: int = 256,
                 key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The ``k`` highest inner products of each query, over all vectors but its own.

    ``queries`` has the ids of the query vectors. Components become floor(scale * x); the score is
    their integer inner product. Returns ``query_id``, ``rank`` (from 1), ``vec_id`` and ``score``,
    ties to the smaller id; all candidates if there are fewer. Vectors that are NULL or hold NULL or
    non-finite components take no part, nor do NULL ids; a repeated id counts once. Scores that could
    leave the range of a long are an error. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    rows, size = clean(vectors, key, vector, zeros=True)
    result = "query_id long, rank int, vec_id long, score long"
    rows = rows.withColumn("v", F.transform("v", lambda x: F.expr("CAST(1 AS DOUBLE)") * x * scale))
    most = rows.agg(F.count("*"), F.max(F.array_max(F.transform("v", F.abs))),
                    F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + (F.abs(x) + 1) * (F.abs(x) + 1))))).first()
    if not most[0]:
        return spark.createDataFrame([], result)
    largest = (int(most[1]) + 1) ** 2 * size
    if largest >= 1 << 63:
        raise ValueError("inner products could leave the range of a long")
    reach = min(largest, int(most[2] * most[2]) + 2)  # by Cauchy-Schwarz
    asked = queries.select(F.col(queries.columns[0]).cast("long").alias("id")).where("id IS NOT NULL").distinct()
    wanted = pin(rows.join(asked, "id"), "queries")
    groups, of_queries = -(-most[0] // CANDIDATES), -(-wanted.count() // QUERIES_PER_BLOCK)
    if not of_queries:
        return spark.createDataFrame([], result)

    def group(n: int, salt: int):
        return F.pmod(F.xxhash64(F.lit(salt), "id"), F.lit(n)).cast("int")

    blocks = pin(packed(rows.withColumn("cg", group(groups, 1)), ["cg"]), "blocks")
    right = blocks.withColumn("qg", F.explode(F.sequence(F.lit(0), F.lit(of_queries - 1))))

    def passed(state: DataFrame, task, schema: str) -> DataFrame:
        """``task`` over every block pair; ``state`` has the long columns of each query."""
        extra = [c for c in state.columns if c != "id"]
        left = packed(wanted.join(state, "id").withColumn("qg", group(of_queries, 2)), ["qg"], extra) \
            .withColumn("cg", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))

        def run(key, a: pa.Table, b: pa.Table) -> pa.Table:
            out = []
            if a.num_rows and b.num_rows:
                ids, v, *columns = unpacked(b, size, extra)
                candidate, w = unpacked(a, size)
                w = np.floor(w)
                v = np.floor(v)
                for start in range(0, len(ids), 256):
                    part = slice(start, start + 256)
                    s = _scores(v[part], w, largest)
                    own = candidate[None, :] == ids[part][:, None]
                    out.append(task(ids[part], s, own, candidate, *[x[part] for x in columns]))
            names = [f.split()[0] for f in schema.split(", ")]
            whole = [np.concatenate([o[i] for o in out]) if out else np.zeros(0, np.int64) for i in range(len(names))]
            return pa.table({n: pa.array(x, pa.int64()) for n, x in zip(names, whole, strict=True)})

        return right.groupBy("cg", "qg").cogroup(left.groupBy("cg", "qg")).applyInArrow(run, schema)

    def histogram(ids, s, own, candidate, low, width, above):
        step = np.maximum(1, -(-width // BINS))[:, None]
        inside = (s >= low[:, None]) & (s < (low + width)[:, None]) & ~own
        q, c = np.nonzero(inside)
        bins = (s[q, c] - low[q]) // step[q, 0]
        flat = np.bincount(q * BINS + bins, minlength=len(ids) * BINS).reshape(len(ids), BINS)
        higher = flat[:, ::-1].cumsum(axis=1)[:, ::-1] - flat
        q, b = np.nonzero((flat > 0) & (higher < k))
        return ids[q], b.astype(np.int64), flat[q, b]

    # low, width: the interval of the kth score; above: scores beyond it.
    state = pin(wanted.select("id", F.lit(-reach).cast("long").alias("low"), F.lit(2 * reach + 1).cast("long").alias("width"),
                              F.lit(0).cast("long").alias("above")), "state")
    width = 2 * reach + 1
    while width > 1:
        counted = passed(state, histogram, "id long, bin long, n long").groupBy("id", "bin").agg(F.sum("n").alias("n"))
        down = Window.partitionBy("id").orderBy(F.desc("bin"))
        upto = counted.withColumn("upto", F.sum("n").over(down))
        step = F.expr(f"greatest(1L, (width + {BINS - 1}) div {BINS})")
        found = upto.join(state, "id").where(f"above + upto >= {k}").groupBy("id").agg(
            F.max(F.struct("bin", "n", "upto")).alias("b"))
        # A query with fewer than k scores in all keeps the lowest bin and so takes everything.
        state = pin(state.join(found, "id", "left").select(
            "id", F.expr("low + coalesce(b.bin, 0) * " + f"greatest(1L, (width + {BINS - 1}) div {BINS})").alias("low"),
            step.alias("width"), F.expr("above + coalesce(b.upto - b.n, 0)").alias("above"), F.col("b").isNull().alias("few"))
            .select("id", F.when(F.col("few"), F.lit(-reach)).otherwise(F.col("low")).cast("long").alias("low"),
                    "width", F.when(F.col("few"), F.lit(0)).otherwise(F.col("above")).cast("long").alias("above")), "state")
        width = max(1, -(-width // BINS))

    def chosen(ids, s, own, candidate, low, width, above):
        s = np.where(own, np.iinfo(np.int64).min, s)
        q, c = np.nonzero(s > low[:, None])
        out = [(ids[q], candidate[c], s[q, c])]
        q, c = np.nonzero(s == low[:, None])
        order = np.lexsort((candidate[c], q))
        q, c = q[order], c[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        need = place < (k - above)[q]
        q, c = q[need], c[need]
        out.append((ids[q], candidate[c], s[q, c]))
        return tuple(np.concatenate([o[i] for o in out]) for i in range(3))

    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return passed(state, chosen, "query_id long, vec_id long, score long").withColumn(
        "rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


@query("op7_topk_histogram")
def op7(spark, sf_dir):
    """Five highest scores of every fiftieth vector."""
    vectors = table(spark, sf_dir, "embeddings")
    return top_products(vectors, vectors.where("vec_id % 50 = 0").select("vec_id"))

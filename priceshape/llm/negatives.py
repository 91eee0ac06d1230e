"""Hard negatives by exact scores of every anchor with every row.

Rows are quantised and packed into blocks of bit planes (``bitplanes.py``); anchors go in groups. A task
scores one group with one block from subset-sum tables of its anchors. Two rounds: the first gives each
anchor's positives, the second, which knows their scores, the best rows of other labels in the window
of every positive. A pair of block and group reports no more rows than the result may take from it, so
what is shuffled after a round does not grow with the pairs scored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from priceshape.llm import bitplanes
from priceshape.llm.common import col, query, table
from priceshape.scratch import pin

#: Least and most rows of a block and anchors of a group; between them an eighth of all.
BLOCK, ANCHORS = (8_192, 65_536), (128, 4_096)
#: Anchors whose tables are held at once.
TABLES = 64

_BLOCKS = "block int, ids array<long>, labels binary, anchors binary, planes binary, shape array<int>"


def _size(n: int, limits: tuple[int, int]) -> int:
    return min(max(n // 8, limits[0]), limits[1])


def _best(at: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Of the positions ``at`` the ``k`` with the highest scores, of equal ones those that come first."""
    if len(at) <= k:
        return at
    values = score[at]
    last = np.partition(values, len(at) - k)[len(at) - k]
    above = at[values > last]
    return np.concatenate([above, at[values == last][:k - len(above)]])


def _pack(size: int, scale: int):
    """Task that makes one block of its rows, ordered by id (NULL last), shorter vectors filled with 0."""
    def packed(batches):
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        rows = pa.Table.from_batches(held).combine_chunks()
        rows = rows.take(pc.sort_indices(rows, [("_id", "ascending")], null_placement="at_end"))
        vectors = rows.column("_v").combine_chunks()
        flat = np.floor(vectors.flatten().to_numpy(zero_copy_only=False) * float(scale)).astype(np.int64)
        lengths = pc.list_value_length(vectors).to_numpy(zero_copy_only=False)
        values = np.zeros((len(lengths), size), np.int64)
        values[np.arange(size) < lengths[:, None]] = flat
        made = bitplanes.planes(values)
        ids = rows.column("_id").combine_chunks()
        yield pa.RecordBatch.from_arrays([
            pa.array([TaskContext.get().partitionId()], pa.int32()),
            pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
            pa.array([rows.column("_label").to_numpy().astype("<i8").tobytes()], pa.binary()),
            pa.array([rows.column("_anchor").to_numpy().astype(np.uint8).tobytes()], pa.binary()),
            pa.array([made.tobytes()], pa.binary()), pa.array([list(made.shape)], pa.list_(pa.int32()))],
            ["block", "ids", "labels", "anchors", "planes", "shape"])

    return packed


class _Block:
    def __init__(self, rows, at: int):
        self.number = rows.column("block")[at].as_py()
        self.ids = rows.column("ids")[at].values
        self.labels = np.frombuffer(rows.column("labels")[at].as_py(), "<i8")
        self.anchors = np.frombuffer(rows.column("anchors")[at].as_py(), np.uint8)
        self.planes = np.frombuffer(rows.column("planes")[at].as_py(), np.uint8).reshape(
            rows.column("shape")[at].as_py())


def _anchors(batches):
    """The anchors of the blocks, named by block and position."""
    for batch in batches:
        for i in range(batch.num_rows):
            block = _Block(batch, i)
            at = np.flatnonzero(block.anchors)
            if len(at):
                values = bitplanes.components(block.planes[:, :, at])  # of whole groups, so with the zeros
                yield pa.RecordBatch.from_arrays([
                    pa.array((np.int64(block.number) << 32) + at), block.ids.take(pa.array(at)),
                    pa.array(block.labels[at]), pa.array([v.astype("<i8").tobytes() for v in values], pa.binary())],
                    ["anchor", "anchor_id", "label", "v"])


def hard_negatives(vectors: DataFrame, anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30,
                   high: int = 90, scale: int = 256, key: str = "vec_id", vector: str = "embedding",
                   label: str = "label") -> DataFrame:
    """For each anchor and each of its positives the hardest rows of other labels.

    Components become floor(scale * x); a score is the integer inner product with the anchor. Positives
    are the anchor's ``positives`` highest rows of its label other than itself, negatives the
    ``negatives`` highest rows of another label with low * p <= 100 * n <= high * p for the scores n and
    p; ties by smaller id, NULL last; all rows if there are fewer. Returns ``anchor_id``,
    ``positive_id``, ``rank`` (from 1), ``negative_id``, ``positive_score``, ``negative_score``.

    ``anchor`` is a condition on the columns of ``vectors`` (NULL: no anchor). Rows with a NULL label, a
    NULL vector or a NULL or non-finite component take no part. Rows that share an id are rows of their
    own, also as anchors. A vector shorter than others counts as filled with zeros. Labels are
    integers. Scores that could leave the range of a long are an error. Tables without rows, anchors or
    positives give no rows.
    """
    spark = vectors.sparkSession
    finite = F.forall("_v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(
        col(key).cast("long").alias("_id"), col(label).cast("long").alias("_label"),
        col(vector).cast("array<double>").alias("_v"), F.coalesce(anchor, F.lit(False)).alias("_anchor"),
    ).where(F.col("_label").isNotNull() & F.col("_v").isNotNull()).where(finite)
    n, asked, most, size = rows.agg(
        F.count("*"), F.count_if("_anchor"), F.max(F.array_max(F.transform("_v", F.abs))), F.max(F.size("_v"))).first()
    nothing = spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, "
                                        "positive_score long, negative_score long")
    if not n or not asked:
        return nothing
    if (int((most or 0) * scale) + 1) ** 2 * size * max(100, high, low) >= 1 << 63:
        raise ValueError("scores could leave the range of a long")
    parts, groups = -(-n // _size(n, BLOCK)), -(-asked // _size(asked, ANCHORS))
    blocks = pin(rows.repartition(parts).mapInArrow(_pack(size, scale), _BLOCKS), "blocks")
    heads = pin(blocks.mapInArrow(_anchors, "anchor long, anchor_id long, label long, v binary"), "anchors")
    last = blocks.agg(F.max("block")).first()[0]
    left = blocks.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))

    def scored(state: DataFrame, chosen, names: list[str]) -> DataFrame:
        """Every pair of a group of anchors, rows of ``state``, and a block; ``chosen`` gives arrays of
        the columns ``names``, all long."""
        schema = ", ".join(f"{name} long" for name in names)
        right = state.withColumn("part", F.pmod(F.xxhash64("anchor"), F.lit(groups)).cast("int")).withColumn(
            "block", F.explode(F.sequence(F.lit(0), F.lit(last))))

        def run(key, a: pa.Table, b: pa.Table) -> pa.Table:
            out = []
            if a.num_rows and b.num_rows:
                block, b = _Block(a, 0), b.sort_by("label").combine_chunks()
                for start in range(0, b.num_rows, TABLES):
                    some = b.slice(start, TABLES)
                    values = np.frombuffer(b"".join(some.column("v").to_pylist()), "<i8").reshape(
                        some.num_rows, block.planes.shape[1] * bitplanes.GROUP)
                    out += chosen(some, values, block)
            return pa.table({name: pa.concat_arrays([o[i] for o in out]) if out else pa.array([], pa.int64())
                             for i, name in enumerate(names)})

        return left.groupBy("part", "block").cogroup(right.groupBy("part", "block")).applyInArrow(run, schema)

    def nearest(some, values, block):
        anchor, mine = some.column("anchor").to_numpy(), some.column("label").to_numpy()
        named, out = some.column("anchor_id").combine_chunks(), []
        for kind in np.unique(mine):
            own, same = np.flatnonzero(mine == kind), np.flatnonzero(block.labels == kind)
            if not len(same):
                continue
            scores = bitplanes.products(bitplanes.subset_sums(values[own]), block.planes[:, :, same])
            for i, score in zip(own, scores, strict=True):
                itself = anchor[i] - (block.number << 32)
                at = _best(np.flatnonzero(same != itself), score, positives)
                out.append([pa.array(np.full(len(at), anchor[i])), named.take(pa.array(np.full(len(at), i))),
                            block.ids.take(pa.array(same[at])), pa.array(score[at])])
        return out

    order = Window.partitionBy("anchor").orderBy(F.desc("positive_score"), F.asc_nulls_last("positive_id"))
    found = pin(scored(heads, nearest, ["anchor", "anchor_id", "positive_id", "positive_score"])
                .withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= positives), "positives")

    def hardest(some, values, block):
        anchor, mine = some.column("anchor").to_numpy(), some.column("label").to_numpy()
        goals = some.column("goals").to_pylist()
        out = []
        for i, score in enumerate(bitplanes.products(bitplanes.subset_sums(values), block.planes)):
            goal = np.array(goals[i], np.int64)
            hundred = 100 * score
            wide = np.flatnonzero((hundred >= low * goal.min()) & (hundred <= high * goal.max()) & (block.labels != mine[i]))
            for g in goal:
                at = _best(wide[(hundred[wide] >= low * g) & (hundred[wide] <= high * g)], score, negatives)
                out.append([pa.array(np.full(len(at), anchor[i])), pa.array(np.full(len(at), g)),
                            block.ids.take(pa.array(at)), pa.array(score[at])])
        return out

    goals = heads.join(found.groupBy("anchor").agg(F.collect_set("positive_score").alias("goals")), "anchor")
    within = Window.partitionBy("anchor", "positive_score").orderBy(F.desc("negative_score"), F.asc_nulls_last("negative_id"))
    hard = scored(goals, hardest, ["anchor", "positive_score", "negative_id", "negative_score"]).withColumn(
        "rank", F.row_number().over(within)).where(F.col("rank") <= negatives)
    return found.join(hard, ["anchor", "positive_score"]).select(*nothing.columns)


SQL = """
WITH rows AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scores AS (
  SELECT a.vec_id AS anchor_id, a.label AS own, r.vec_id, r.label, list_dot_product(a.v, r.v)::BIGINT AS score
  FROM rows a JOIN rows r ON a.vec_id % 100 = 0 AND a.vec_id <> r.vec_id
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scores WHERE label = own
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id,
       (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id))::INT AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scores USING (anchor_id)
WHERE label <> own AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10
"""


@query("op13_hard_negatives", SQL)
def op13(spark, sf_dir):
    """Ten hardest negatives for each of five positives of every hundredth vector."""
    vectors = table(spark, sf_dir, "embeddings").withColumn(
        "label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives(vectors, F.col("vec_id") % 100 == 0)

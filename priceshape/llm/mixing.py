"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

The words of each source stand in one line, documents in seeded order, cut into blocks of
``block_words``. Blocks are dealt to the sources by highest quotients target / (2 k + 1). The method
is house-monotone, so the quotas of shard i are the seats of the first i + 1 shards less those of
the first i. Which blocks fill a quota is decided by a seeded permutation of the block numbers of a
source; one over all blocks is used up before the next begins, so no block is taken more than
``repeats`` times.

The line of a source is never in one task: documents fall into buckets by hash, the buckets get
their offsets from their sums, and running sums stay inside a bucket.
"""

from __future__ import annotations

import hashlib
import heapq
import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from priceshape.llm.common import col, query, table
from priceshape.scratch import pin

WORD = r"[^\x20\x09-\x0D]+"
#: Documents in a bucket of a source's line.
BUCKET_ROWS = 2048
#: Most sources whose totals the driver plans with.
MAX_SOURCES = 1_000_000


def word_count(text: str = "text"):
    """Number of words between ASCII white space; 0 for NULL."""
    return F.coalesce(F.regexp_count(col(text), F.lit(WORD)), F.lit(0)).cast("long")


def fill_targets(sizes: Sequence[int], weights: Sequence[float], share: float,
                 repeats: int) -> list[float]:
    """Share of each source: by weight, stopped at ``repeats`` times its size, the excess reshared."""
    caps = [float(repeats * s) for s in sizes]
    left, open_, targets = share * sum(sizes), list(range(len(sizes))), [0.0] * len(sizes)
    while open_:
        total = sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] / total > caps[i]]
        if not over:
            for i in open_:
                targets[i] = left * weights[i] / total
            break
        for i in over:
            targets[i] = caps[i]
        left -= sum(caps[i] for i in over)
        closed = set(over)
        open_ = [i for i in open_ if i not in closed]
    return targets


def sainte_lague(votes: Sequence[float], seats: int, most: Sequence[int]) -> list[int]:
    """Seats by highest quotients votes / (2 k + 1), at most ``most`` each; ties go to the first.

    The divisor that gives no more than ``seats`` is found by bisection, so the cost does not depend
    on the number of seats; the few seats left are dealt one by one.
    """
    def held(divisor: float) -> list[int]:
        return [min(m, int((v / divisor + 1) // 2)) if v > 0 else 0
                for v, m in zip(votes, most, strict=True)]

    seats = min(seats, sum(m for v, m in zip(votes, most, strict=True) if v > 0))
    if seats <= 0:
        return [0] * len(votes)
    low, high = 0.0, max(votes) * 2
    for _ in range(200):
        middle = (low + high) / 2
        if middle in (low, high):
            break
        if sum(held(middle)) > seats:
            low = middle
        else:
            high = middle
    given = held(high)
    queue = [(-v / (2 * g + 1), i) for i, (v, g) in enumerate(zip(votes, given, strict=True))
             if v > 0 and g < most[i]]
    heapq.heapify(queue)
    for _ in range(seats - sum(given)):
        _, i = heapq.heappop(queue)
        given[i] += 1
        if given[i] < most[i]:
            heapq.heappush(queue, (-votes[i] / (2 * given[i] + 1), i))
    return given


def _permutation(seed: int, source: str | None, n: int) -> tuple[int, int]:
    """Multiplier (below 2**20, prime to n) and shift of a permutation of 0..n-1."""
    digest = hashlib.sha256(f"{seed}:{source!r}".encode("utf-8", "surrogatepass")).digest()
    factor = int.from_bytes(digest[:8], "big") % min(n, 1 << 20) or 1
    while math.gcd(factor, n) != 1:
        factor = factor + 1 if factor + 1 < min(n, 1 << 20) else 1
    return factor, int.from_bytes(digest[8:16], "big") % n


def mix_sources(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5,
                repeats: int = 2, shards: int = 8, block_words: int = 64, seed: int = 4,
                text: str = "text", source: str = "source", key: str = "doc_id") -> DataFrame:
    """Words of each document that the mix takes.

    Sources in code-point order, NULL last, weigh ``weights``, repeating, and share ``share`` times
    all words; a target stops at ``repeats`` times its source's words and the excess is reshared.
    Returns one row per input row: the key, ``source``, ``size`` (words), ``source_size``,
    ``target``, ``taken`` (words, repeats counted) and ``shard_words`` (words per shard of the mix,
    as an array of ``shard`` and ``words``). NULL and empty texts have size 0 and are never taken;
    the source NULL is a source of its own; repeated rows are separate documents. The words taken
    from a source differ from its target by less than ``repeats`` + 1 blocks. An empty table gives
    no rows; other columns are left out.
    """
    return _mix(docs, weights, share, repeats, shards, block_words, seed, text, source, key).select(
        F.col("_key").alias(key), F.col("_source").alias("source"), F.col("_size").alias("size"),
        "source_size", "target", "taken", "shard_words")


def _mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5,
         repeats: int = 2, shards: int = 8, block_words: int = 64, seed: int = 4,
         text: str = "text", source: str = "source", key: str = "doc_id",
         carry: Sequence[str] = ()) -> DataFrame:
    """What ``mix_sources`` gives, with the place of each row in its source's line (``_order`` and
    ``_from``) and the columns ``carry`` of the row."""
    spark = docs.sparkSession
    slim = pin(docs.select(
        *[col(c) for c in carry], col(key).alias("_key"), col(source).cast("string").alias("_source"),
        word_count(text).alias("_size"),
        F.xxhash64(F.lit(seed), col(key), F.xxhash64(col(text))).alias("_order")), "words")
    totals = slim.groupBy("_source").agg(F.sum("_size").alias("size"), F.count("*").alias("n"))
    found = totals.limit(MAX_SOURCES + 1).collect()
    if len(found) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    found.sort(key=lambda r: (r["_source"] is None, r["_source"] or ""))
    sizes = [r["size"] for r in found]
    targets = fill_targets(sizes, [weights[i % len(weights)] for i in range(len(found))], share,
                           repeats)
    blocks = [-(-s // block_words) for s in sizes]
    most = [repeats * b for b in blocks]
    house = round(sum(targets) / block_words)
    upto = [sainte_lague(targets, house * (i + 1) // shards, most) for i in range(shards)]
    plan = []
    for i, r in enumerate(found):
        factor, shift = _permutation(seed, r["_source"], max(1, blocks[i]))
        plan.append((i, r["_source"], sizes[i], float(targets[i]), max(1, blocks[i]),
                     [u[i] for u in upto], factor, shift, -(-r["n"] // BUCKET_ROWS)))
    plan_frame = spark.createDataFrame(plan, T.StructType([
        T.StructField("_sid", T.IntegerType()), T.StructField("_name", T.StringType()),
        T.StructField("source_size", T.LongType()), T.StructField("target", T.DoubleType()),
        T.StructField("_blocks", T.LongType()), T.StructField("_upto", T.ArrayType(T.LongType())),
        T.StructField("_factor", T.LongType()), T.StructField("_shift", T.LongType()),
        T.StructField("_buckets", T.LongType())]))
    known = slim.join(plan_frame, slim["_source"].eqNullSafe(plan_frame["_name"])).withColumn(
        "_bucket", F.expr("least(_buckets - 1, floor(shiftrightunsigned(_order, 1) / 9223372036854775808D * _buckets))"))
    sums = known.groupBy("_sid", "_bucket").agg(F.sum("_size").alias("_sum"))
    earlier = Window.partitionBy("_sid").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("_sid", "_bucket",
                         F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("_sid", "_bucket").orderBy("_order", "_key", "_size", *map(col, carry)).rowsBetween(
        Window.unboundedPreceding, -1)
    lined = known.join(starts, ["_sid", "_bucket"]).withColumn(
        "_from", F.col("_start") + F.coalesce(F.sum("_size").over(inside), F.lit(0)))
    # Rank of block j of a source in its seeded order, and the words of it in this document.
    pieces = F.expr(f"""
        IF(_size = 0, CAST(array() AS ARRAY<STRUCT<rank: BIGINT, words: BIGINT>>),
           transform(sequence(_from div {block_words}, (_from + _size - 1) div {block_words}),
             j -> struct(pmod(_factor * j + _shift, _blocks) AS rank,
               least(_from + _size, (j + 1) * {block_words}) - greatest(_from, j * {block_words})
                 AS words)))""")
    per_shard = F.expr(f"""
        filter(transform(sequence(0, {shards - 1}), s -> struct(s AS shard,
          aggregate(_pieces, 0L, (a, p) -> a + p.words * aggregate(sequence(0, {repeats - 1}), 0L,
            (b, t) -> b + IF(p.rank + t * _blocks < _upto[s]
                             AND p.rank + t * _blocks >= IF(s = 0, 0L, _upto[s - 1]), 1L, 0L)))
            AS words)), x -> x.words > 0)""")
    taken = F.expr(f"""
        aggregate(_pieces, 0L, (a, p) -> a + p.words * aggregate(sequence(0, {repeats - 1}), 0L,
          (b, t) -> b + IF(p.rank + t * _blocks < _upto[{shards - 1}], 1L, 0L)))""")
    return lined.withColumn("_pieces", pieces).select(
        *[col(c) for c in carry], "_key", "_source", "_size", "_order", "_from",
        "source_size", "target", taken.alias("taken"), per_shard.alias("shard_words"))


def mixed_documents(docs: DataFrame, seed: int = 4, key: str = "doc_id", text: str = "text",
                    source: str = "source", **mix) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it, with all their columns, of any names.

    Whole documents only: the part of a last copy is rounded up with the probability of that part,
    by a seeded hash of key, text and place in the source's line. Each row has its own count, whatever
    other rows share its key. Documents without words are in no mix; an empty table stays empty.
    """
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    at = {c: f"c{names.index(c)}" for c in (key, text, source)}
    # The number is given once, when the table is written.
    numbered = pin(plain.withColumn("_row", F.monotonically_increasing_id()), "numbered")
    chosen = _mix(numbered, seed=seed, key=at[key], text=at[text], source=at[source], carry=["_row"], **mix)
    draw = F.expr("shiftrightunsigned(_draw, 11) / 9007199254740992D")
    copies = chosen.where("taken > 0").select(
        "_row", "_size", "taken", F.xxhash64(F.lit(seed + 1), "_order", "_from").alias("_draw"),
    ).select("_row", (F.expr("taken div _size") + (draw < F.expr("(taken % _size) / _size")).cast("int"))
             .cast("int").alias("_copies")).where("_copies > 0")
    return numbered.join(copies, "_row").withColumn("_copy", F.explode(F.sequence(F.lit(1), "_copies"))).select(
        plain.columns).toDF(*names)


@query("op4_sainte_lague_mix")
def op4(spark, sf_dir):
    """Words that the mix takes of every document."""
    return mix_sources(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken")

"""Two-pass external shuffle into shards.

Pass one scatters the records with a seeded hash into buckets of about ``bucket_bytes`` and brings
each bucket together in one task; pass two shuffles every bucket (Fisher-Yates, Spark's own
``shuffle`` function with a seed) and writes it. The buckets in order make one permutation of all
records, which is cut into shards of equal row counts (law ``rows``). Records cross the network
once; the only thing counted beforehand is the number of rows per bucket.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from priceshape.llm.common import col, query, table
from priceshape.scratch import pin, scratch_path

#: Columns the operator adds; an input column of the same name is kept as ``<name>_input``.
ADDED = ("shard", "slot")


def text_bytes(text: str = "text"):
    """UTF-8 bytes of the text, none for NULL, plus 16 for the record."""
    return F.coalesce(F.octet_length(col(text)), F.lit(0)).cast("long") + 16


def shuffle_to_shards(docs: DataFrame, path: str, shards: int = 40, seed: int = 20,
                      bucket_bytes: int = 16 << 20, text: str = "text",
                      key: str = "doc_id") -> DataFrame:
    """Write ``docs`` in random order to ``path/shard=<n>/`` and return a scan of the files.

    Every input row is written once, with all its columns, the ``shard`` and the gapless ``slot``
    inside it; shard sizes differ by one row at most. NULL keys, NULL or empty texts and repeated
    rows are records like any other: the scatter hash covers the place of a row in the scan too, so
    repeated rows spread over all buckets. Input columns named ``shard`` or ``slot`` come back as
    ``shard_input`` and ``slot_input``. An empty table gives no files and an empty frame.
    A bucket is memory-sized, but never smaller than its longest record.
    """
    if shards < 1 or bucket_bytes < 1:
        raise ValueError("shards and bucket_bytes must be at least 1")
    spark = docs.sparkSession
    taken = {c.lower() for c in docs.columns}
    names = []
    for c in docs.columns:
        name = c
        while name.lower() in ADDED or (name != c and name.lower() in taken):
            name += "_input"
        names.append(name)
    record = F.struct(*[col(c).alias(n) for c, n in zip(docs.columns, names, strict=True)])
    rows = docs.select(
        F.monotonically_increasing_id().alias("_place"), text_bytes(text).alias("_size"),
        col(key).alias("_key"), record.alias("_row"),
    )
    size = rows.agg(F.count("*"), F.coalesce(F.sum("_size"), F.lit(0))).first()
    n, buckets = size[0], max(1, -(-size[1] // bucket_bytes))
    empty = spark.createDataFrame([], rows.select("_row.*", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot")).schema)
    if not n:
        return empty
    scattered = rows.withColumn(
        "_bucket", F.pmod(F.xxhash64(F.lit(seed), "_key", "_place"), F.lit(buckets)))
    counted = scattered.groupBy("_bucket").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    # One row per bucket of bucket_bytes, not per record: small enough for one running sum.
    offsets = pin(counted.select(
        "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")), "offsets")
    whole = scattered.groupBy("_bucket").agg(
        F.array_sort(
            F.collect_list(F.struct("_place", "_row")),
            lambda a, b: F.when(a["_place"] < b["_place"], -1).when(a["_place"] > b["_place"], 1)
            .otherwise(0),
        ).alias("_rows"))
    # The seeded generator goes on from row to row of a task, so the buckets of a task have an order.
    shuffled = whole.join(offsets, "_bucket").sortWithinPartitions("_bucket").select(
        "_offset", F.posexplode(F.shuffle("_rows", seed)).alias("_pos", "_entry"))
    place = F.expr("_offset + _pos")
    shard = F.expr(f"(_offset + _pos) * {shards} div {n}")
    placed = shuffled.select(
        "_entry._row.*", shard.cast("int").alias("shard"),
        (place - F.expr(f"(((_offset + _pos) * {shards} div {n}) * {n} + {shards - 1}) div {shards}"))
        .alias("slot"))
    placed.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    written = spark.read.schema(empty.schema).parquet(path)
    _verify(written, n, shards)
    return written


def _verify(written: DataFrame, n: int, shards: int) -> None:
    """The rows were counted and written in two jobs; a source that changed meanwhile is an error."""
    bad = written.groupBy("shard").agg(F.count("*").alias("c"), F.sum("slot").alias("s")).where(
        F.expr(f"c <> ((shard + 1) * {n} + {shards - 1}) div {shards} - (shard * {n} + {shards - 1}) div {shards}"
               " OR s <> c * (c - 1) div 2"))
    if bad.take(1):
        raise RuntimeError("the input gave other rows on its second reading; write it first")


@query("op2_external_shuffle")
def op2(spark, sf_dir):
    """All documents in 40 shards: a digest of the written files."""
    written = shuffle_to_shards(table(spark, sf_dir, "documents"), scratch_path(spark, "shards"))
    return written.select(
        "doc_id", text_bytes().alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))

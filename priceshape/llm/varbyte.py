"""Token ids in a byte-aligned variable-length file format.

Ids are ranked by frequency over the whole corpus (ties: smaller id), so frequent ones need one byte.
Each value takes 1 to 4 data bytes, low byte first; its length less one stands in two bits of a
separate control stream, four values to a control byte, first value lowest. Control streams start
anew for each document. Documents stand in ascending key order.

A file set is a folder with ``ranks`` (Parquet: ``rank``, ``id``) and ``blocks`` (Parquet, one row per
block): ``part`` (number of the range), ``first`` (ids of the part before the block), ``keys``,
``counts`` (ids of each document), ``control`` and ``data``. Parquet carries the streams to any store
that Spark reads.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from priceshape.llm.common import col, query, slices, table
from priceshape.llm.tokenizing import Words, load, merges_by_id, once
from priceshape.scratch import pin, scratch_path

#: Ids after which a block is closed; a document is never split.
BLOCK_IDS = 65_536

#: Data bytes of the four values of each control byte.
LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3) + 1).astype(np.uint8)


def pack(values: np.ndarray, counts: np.ndarray | None = None) -> tuple[bytes, bytes]:
    """Control and data bytes of unsigned 32-bit values: one stream, or consecutive ones of ``counts``
    values, each with control bytes of its own."""
    values = values.astype("<u4", copy=False)
    if not len(values):
        return b"", b""
    counts = np.array([len(values)]) if counts is None else np.asarray(counts, np.int64)
    code = (values > 0xFF).astype(np.uint8)
    code += values > 0xFFFF
    code += values > 0xFFFFFF
    padded = -(-counts // 4) * 4
    codes = np.zeros(int(padded.sum()), np.uint8)
    codes[np.arange(len(values)) + np.repeat(np.cumsum(padded - counts) - (padded - counts), counts)] = code
    codes = codes.reshape(-1, 4)
    control = codes[:, 0] | codes[:, 1] << 2 | codes[:, 2] << 4 | codes[:, 3] << 6
    used = np.arange(4, dtype=np.uint8) <= code[:, None]
    return control.tobytes(), values.view(np.uint8).reshape(-1, 4)[used].tobytes()


def unpack(control: bytes, data: bytes, counts: np.ndarray) -> np.ndarray:
    """Values of consecutive streams of ``counts`` values each: lengths by table, bytes by gather."""
    counts = np.asarray(counts, np.int64)
    length = LENGTHS[np.frombuffer(control, np.uint8)].ravel().astype(np.int64)
    padded = -(-counts // 4) * 4
    place = np.arange(len(length)) - np.repeat(np.cumsum(padded) - padded, padded)
    length = length[place < np.repeat(counts, padded)]
    at = np.cumsum(length) - length
    byte = np.frombuffer(data + b"\0\0\0", np.uint8)
    values = byte[at].astype(np.uint32)
    for k in range(1, 4):
        more = length > k
        values[more] |= byte[at[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return values


def write_ids(docs: DataFrame, folder: str, path: str, end_id: int = 1, key: str = "doc_id",
              text: str = "text") -> None:
    """Encode every whole text and write the file set.

    NULL and empty texts have the end id alone. Repeated keys stand next to each other in the order
    of their ids, NULL keys first; rows that are equal in all of this are interchangeable and may stand
    in several ranges. An empty table gives a file set without rows. Other columns are left out.
    """
    spark = docs.sparkSession
    kind = docs.schema[key].dataType.simpleString()
    schema = f"_id {kind}, crc long, ids binary, n int, tally binary"
    proven = merges_by_id(path)
    known = max(load(path).get_vocab_size(), end_id + 1)
    width = np.dtype("<u2" if known <= 1 << 16 else "<u4")  # of the ids on their way

    def encoded(batches):
        """Rows with their ids, and at the end of a task one row with the frequencies of its ids."""
        encoder = once(Words, path, proven)
        total = np.zeros(known, np.int64)
        last = None
        for batch in slices(batches):
            flat, size = encoder.encode_all(batch.column("_text").to_pylist(), end_id)
            total += np.bincount(flat, minlength=len(total))
            stored = flat.astype(width).tobytes()
            at = np.concatenate([[0], np.cumsum(size)]) * width.itemsize
            narrow = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(at.astype("<i4").tobytes()), pa.py_buffer(stored)]) \
                if at[-1] < 1 << 31 else pa.array([stored[a:b] for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())
            last = batch.column("_id").slice(0, 1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id"), pa.array([zlib.crc32(x) for x in np.split(flat, np.cumsum(size)[:-1])], pa.int64()), narrow,
                 pa.array(size.astype(np.int32)), pa.nulls(len(size), pa.binary())], ["_id", "crc", "ids", "n", "tally"])
        if last is not None:
            yield pa.RecordBatch.from_arrays(
                [last, pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.int32()),
                 pa.array([total.astype("<i8").tobytes()], pa.binary())], ["_id", "crc", "ids", "n", "tally"])

    raw = pin(docs.select(col(key).alias("_id"), col(text).alias("_text")).mapInArrow(encoded, schema).withColumn(
        "_n", F.monotonically_increasing_id()), "encoded")

    def found(batches):
        for batch in slices(batches):
            for x in batch.column(0).to_pylist():
                n = np.frombuffer(x, "<i8")
                ids = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(n[ids])], ["id", "n"])

    # One row per id of the vocabulary at most: a bounded table.
    counts = raw.where("tally IS NOT NULL").select("tally").mapInArrow(found, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    ranked = [r["id"] for r in counts.orderBy(F.desc("n"), "id").collect()]
    spark.createDataFrame(list(enumerate(ranked)), "rank long, id long").coalesce(1).write.parquet(f"{folder}/ranks")
    rank = np.zeros(max(ranked, default=0) + 1, np.uint32)
    rank[ranked] = np.arange(len(ranked), dtype=np.uint32)

    def blocks(batches):
        part, first = TaskContext.get().partitionId(), 0
        held: list[tuple] = []
        size = 0

        def closed():
            keys = pa.chunked_array([h[0] for h in held]).combine_chunks()
            counts = np.concatenate([h[1] for h in held])
            control, data = pack(rank[np.concatenate([h[2] for h in held])], counts)
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([first], pa.int64()),
                 pa.ListArray.from_arrays([0, len(keys)], keys), pa.array([counts], pa.list_(pa.int64())),
                 pa.array([control], pa.binary()), pa.array([data], pa.binary())],
                ["part", "first", "keys", "counts", "control", "data"])

        for batch in slices(batches):
            counts = batch.column("n").to_numpy().astype(np.int64)
            ids = _flat(batch.column("ids"), width)
            ends = np.cumsum(counts)
            start = 0
            while start < len(counts):
                # Documents up to the one that fills the block.
                before = int(ends[start - 1]) if start else 0
                stop = min(int(np.searchsorted(ends, before + BLOCK_IDS - size)) + 1, len(counts))
                held.append((batch.column("_id").slice(start, stop - start), counts[start:stop], ids[before:ends[stop - 1]]))
                size += int(ends[stop - 1]) - before
                start = stop
                if size >= BLOCK_IDS:
                    yield closed()
                    first, size, held = first + size, 0, []
        if held:
            yield closed()

    raw.where("tally IS NULL").select("_id", "crc", "ids", "n", "_n").repartitionByRange(
        F.asc_nulls_first("_id"), "crc", "_n").sortWithinPartitions(
        F.asc_nulls_first("_id"), "crc", "ids").select("_id", "ids", "n").mapInArrow(
        blocks, _blocks_schema(kind)).write.parquet(f"{folder}/blocks")


def _blocks_schema(kind: str) -> str:
    return f"part int, first long, keys array<{kind}>, counts array<long>, control binary, data binary"


def _flat(column: pa.Array, width: np.dtype) -> np.ndarray:
    """All ids of a binary column, straight from its buffer."""
    offsets = np.frombuffer(column.buffers()[1], "<i8" if pa.types.is_large_binary(column.type) else "<i4")
    low, high = offsets[column.offset], offsets[column.offset + len(column)]
    return np.frombuffer(column.buffers()[2], width, (high - low) // width.itemsize, low) if high > low else np.zeros(0, width)


def read_ids(spark: SparkSession, folder: str, key: str = "doc_id", kind: str = "bigint",
             keep_ids: bool = False) -> DataFrame:
    """Per document of a file set: the key, ``start`` (ids of all documents before it), ``n_tokens``
    and ``ids_crc32`` (of the ids as little-endian unsigned 32-bit integers), with ``ids`` (binary) on
    demand."""
    stored = spark.read.schema(_blocks_schema(kind)).parquet(f"{folder}/blocks")
    totals = stored.select("part", F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x).alias("n")) \
        .groupBy("part").agg(F.sum("n").alias("n"))
    # One row per range, not per document.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = pin(totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before")), "starts")
    # Bounded by the vocabulary.
    ranked = np.array([r["id"] for r in spark.read.schema("rank long, id long").parquet(f"{folder}/ranks")
                       .orderBy("rank").collect()], dtype="<u4")

    def documents(batches):
        for batch in slices(batches, 1):
            counts = batch.column("counts")[0].as_py()
            ids = ranked[unpack(batch.column("control")[0].as_py(), batch.column("data")[0].as_py(), np.array(counts))]
            ends = np.cumsum(counts)
            begin = batch.column("_before")[0].as_py() + batch.column("first")[0].as_py()
            each = [ids[e - n:e].tobytes() for e, n in zip(ends, counts, strict=True)]
            out = [batch.column("keys").flatten(), pa.array(begin + ends - counts), pa.array(counts, pa.int64()),
                   pa.array([zlib.crc32(x) for x in each], pa.int64())]
            names = ["_id", "start", "n_tokens", "ids_crc32"]
            if keep_ids:
                out.append(pa.array(each, pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(out, names)

    return stored.join(starts, "part").select("_before", "first", "keys", "counts", "control", "data").mapInArrow(
        documents, f"_id {kind}, start long, n_tokens long, ids_crc32 long" + (", ids binary" if keep_ids else "")
    ).withColumnRenamed("_id", key)


@query("op10_varbyte_ids")
def op10(spark, sf_dir):
    """All documents as ids in files, read back."""
    folder = scratch_path(spark, "ids")
    write_ids(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("word_bpe_49k.json"))
    return read_ids(spark, folder)

"""SimHash fingerprints, their links by covering hashing, and the removal of near-duplicates."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from priceshape.llm.common import col, query, slices, table
from priceshape.llm.components import components
from priceshape.llm.covering import close_pairs
from priceshape.scratch import pin

SEED = 42


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased, in UTF-8; none for NULL."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingle_hashes(words: list[bytes], size: int) -> np.ndarray:
    """XXH64 (seed 42, big-endian) of each run of ``size`` words, of the whole if there are fewer."""
    if not words:
        return np.empty(0, ">u8")
    joined, digest = b" ".join(words), xxhash.xxh64_digest
    if len(words) <= size:
        return np.frombuffer(digest(joined, SEED), ">u8")
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[:len(words) - size + 1].tolist()
    stops = ends[size - 1:].tolist()
    return np.frombuffer(b"".join([digest(joined[a:b], SEED) for a, b in zip(starts, stops, strict=True)]), ">u8")


def majority(hashes: np.ndarray) -> int:
    """Bits set in over half the hashes, as a signed 64-bit number; 0 for none."""
    if not len(hashes):
        return 0
    total = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 15):
        part = np.ascontiguousarray(hashes[i:i + (1 << 15)].astype(">u8", copy=False))
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1)
        total += bits.sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * total > len(hashes)).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, shingle: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key and ``fp`` (long) of each row, from the whole text; a text without words has 0."""
    rows = docs.select(col(key).alias("_id"), col(text).alias("_text"))

    def made(batches):
        for batch in slices(batches):
            fp = [majority(shingle_hashes(words_of(t), shingle))
                  for t in batch.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(fp, pa.int64())], ["_id", "fp"])

    kind = rows.schema["_id"].dataType.simpleString()
    return rows.mapInArrow(made, f"_id {kind}, fp long").withColumnRenamed("_id", key)


def _roots(distinct: DataFrame, radius: int) -> DataFrame:
    """``fp`` and ``root`` (the smallest fingerprint it is linked to) of distinct fingerprints."""
    links = close_pairs(distinct.select(F.lit(0).alias("t"), F.col("fp").alias("id"), "fp"), radius)
    roots = pin(components(links), "roots")
    return distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"))


def simhash_groups(docs: DataFrame, shingle: int = 3, radius: int = 3, key: str = "doc_id",
                   text: str = "text") -> DataFrame:
    """Groups of documents linked by fingerprints that differ in at most ``radius`` bits.

    One row per input row: the key, ``fingerprint`` (16 hex digits) and ``component_id``, the
    smallest key that can be reached, itself included. NULL and empty texts have fingerprint zero
    and are linked like any other; a NULL key is never a component id unless all keys of the
    component are NULL. Repeated rows come back repeated. Fingerprints are folded before they are
    compared, so copies cost nothing; see ``covering`` for why no link is lost.
    """
    made = pin(fingerprints(docs, shingle, key, text), "fingerprints")
    folded = pin(made.groupBy("fp").agg(F.min(col(key)).alias("_least")), "folded")
    rooted = folded.join(_roots(folded.select("fp"), radius).withColumnRenamed("root", "_root"), "fp")
    least = rooted.groupBy("_root").agg(F.min("_least").alias("component_id"))
    named = pin(rooted.join(least, "_root").select("fp", "component_id"), "components")
    return made.join(named, "fp").select(
        col(key), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 3, key: str = "doc_id",
                         text: str = "text") -> DataFrame:
    """The rows of ``docs`` without all but one of each group of ``simhash_groups``, all columns kept.

    The row of the smallest key stays, a NULL key last; of rows that share it, that of the smallest
    text hash, and of rows that are equal in key and text any one. Texts without words, NULL included,
    are one group with whatever else is near fingerprint zero. Columns may have any names.
    """
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    at, body = (f"c{docs.columns.index(c)}" for c in (key, text))
    words = F.coalesce(col(body), F.lit(""))
    hashes = {"h1": F.xxhash64(words), "h2": F.xxhash64(F.lit(7), words)}
    rows = plain.select(col(at).alias("key"), *[h.alias(n) for n, h in hashes.items()], col(body).alias("text"))

    def made(batches):
        for batch in slices(batches):
            fp = [majority(shingle_hashes(words_of(t), shingle)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(fp, pa.int64())], ["key", "h1", "h2", "fp"])

    kind = rows.schema["key"].dataType.simpleString()
    found = pin(rows.mapInArrow(made, f"key {kind}, h1 long, h2 long, fp long"), "fingerprints")
    named = found.join(_roots(found.select("fp").distinct(), radius), "fp")
    kept = pin(named.groupBy("root").agg(F.min(F.struct(F.col("key").isNull().alias("n"), "key", "h1", "h2")).alias("k"))
               .select("k.key", "k.h1", "k.h2"), "kept")
    # Structs of NULL are equal, so the join goes by the columns by which the rows are dealt already: the
    # texts are shuffled once.
    by = ["h1", "h2", "k"]
    once = plain.withColumns({**hashes, "k": F.struct(col(at).alias("key"))}).dropDuplicates(by)
    kept = kept.select("h1", "h2", F.struct("key").alias("k"))
    return once.join(kept, by, "left_semi").select(plain.columns).toDF(*docs.columns)


@query("op5_simhash_covering")
def op5(spark, sf_dir):
    """Fingerprint and component of every document."""
    return simhash_groups(table(spark, sf_dir, "documents"))

"""No operator overwrites an input column or fails on its name."""

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from priceshape.llm import (
    chat, language, mixing, multi_index, negatives, quality, repair, secrets, sharding, simhash, topk, tree_bpe, varbyte,
)

BYTE, WORD = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
NAMES = ["_h1", "_h2", "_least", "_copy", "_copies", "_taken_row", "_row", "decoded", "_id", "_key", "_n", "ids", "fp", "key",
         "c0", "part", "a b.c", "size", "taken", "slot_input", "label", "score", "_text", "h1", "crc"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, f"word{i % 7} and token = abcdefghij{i:04d} more" if i % 5 else None, f"s{i % 3}", "en" if i % 2 else "de",
             *[f"{n}:{i}" for n in NAMES]) for i in range(40)]
    extra = ", ".join(f"`{n}` string" for n in NAMES)
    return spark.createDataFrame(rows, f"doc_id long, text string, source string, lang string, {extra}").repartition(3)


def own(rows, key="doc_id"):
    """Every row still has the values of its own key in all columns."""
    for r in rows:
        assert all(r[n] == f"{n}:{r[key]}" for n in NAMES)
    return len(rows)


@pytest.mark.parametrize("made", [
    lambda d: simhash.drop_near_duplicates(d),
    lambda d: mixing.mixed_documents(d, block_words=4),
    lambda d: secrets.redact(d, None),
    lambda d: quality.keep_quality(d, quality.train(d.limit(0), d.select("doc_id").withColumn("quality", F.lit(1)))),
], ids=["near_duplicates", "mix", "redact", "quality"])
def test_rows_keep_their_columns(docs, made):
    found = made(docs)
    assert found.columns == docs.columns and own(found.collect()) > 0


def test_shards_keep_their_columns(docs, path):
    rows = sharding.shuffle_to_shards(docs, f"{path}/s", shards=3).collect()
    assert own(rows) == 40


@pytest.mark.parametrize("made", [
    lambda d: simhash.simhash_groups(d), lambda d: mixing.mix_sources(d), lambda d: tree_bpe.encode_documents(d, BYTE),
    lambda d: secrets.find_secrets(secrets.scan(d), None), lambda d: language.predict_languages(d, language.train(d)),
    lambda d: quality.quality_scores(d, quality.train(d, d.select("doc_id").withColumn("quality", F.lit(1)))),
], ids=["simhash", "mix", "bpe", "secrets", "language", "quality"])
def test_one_row_per_document(docs, made):
    assert made(docs).count() == 40


def test_decoding_keeps_other_columns(docs):
    found = tree_bpe.decode_documents(docs.select("doc_id", "label", "`a b.c`", F.lit(None).cast("binary").alias("ids")), BYTE)
    assert found.columns == ["doc_id", "label", "a b.c", "ids", "decoded"]
    assert all(r["a b.c"] == f"a b.c:{r.doc_id}" and r.decoded is None for r in found.collect())


def test_id_files(spark, docs, path):
    varbyte.write_ids(docs, f"{path}/ids", WORD)
    assert varbyte.read_ids(spark, f"{path}/ids").count() == 40


def test_conversations(spark):
    turns = spark.createDataFrame([(i // 4, i % 4, "user" if i % 2 == 0 else "assistant", f"Text {i}.", *["x"] * len(NAMES)) for i in range(16)],
                                  "conv_id long, turn long, role string, text string, " + ", ".join(f"`{n}` string" for n in NAMES))
    assert repair.damage(turns).columns == turns.columns
    assert repair.repair_digests(turns).count() == 4 and chat.conversations(turns).count() == 4


def test_vectors(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=4).tolist(), i % 3, *["x"] * len(NAMES)) for i in range(120)]
    names = [n if n != "label" else "label_" for n in NAMES]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, " + ", ".join(f"`{n}` string" for n in names))
    wanted = frame.where("vec_id % 50 = 0").select("vec_id")
    assert topk.top_products(frame, wanted).count() == 15
    assert multi_index.nearest_vectors(frame, wanted).select("query_id").distinct().count() == 3
    assert negatives.hard_negatives(frame, F.col("vec_id") % 50 == 0).columns[0] == "anchor_id"


def test_recall_of_the_registered_search(spark):
    """The query at its own settings against all distances: nine of ten neighbours at least."""
    folder = "/root/testdata/sf0.1"
    found = {}
    for r in multi_index.op1(spark, folder).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").collect()
    ids = np.array([r.vec_id for r in rows])
    x = np.array([r.embedding for r in rows], np.float64)
    hits = 0
    for query in sorted(found):
        d = ((x - x[ids == query][0]) ** 2).sum(axis=1)
        d[ids == query] = np.inf
        hits += len(found[query] & set(ids[np.lexsort((ids, d))[:10]].tolist()))
    assert len(found) == 20 and hits >= 0.9 * 10 * len(found)

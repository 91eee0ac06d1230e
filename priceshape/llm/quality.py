"""Quality classifier: boosted trees over statistics of the whole text.

The trees are trained on all labelled documents, by the tasks where they are more than ``LOCAL``;
statistics are taken of all documents, where they lie, in Arrow batches. Only they meet the labels: no
shuffle of texts.
"""

from __future__ import annotations

import collections

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from priceshape.llm.boosting import Trees, fit
from priceshape.llm.boosting_rows import fit_rows
from priceshape.llm.common import col, map_rows, query, slices, table
from priceshape.scratch import pin

#: Labelled rows up to which the trees are fitted on the driver.
LOCAL = 20_000
#: Predicted 1 from this score on.
CUT = 0.3

_CLASSES = np.full(256, 7, dtype=np.uint8)  # 7: bytes of other letters and signs
for _i, _chars in enumerate((b" \t\v\f\r\n", bytes(range(97, 123)), bytes(range(65, 91)),
                             b"0123456789", b".,;:?'\"()-", b"!", b"#$%&*+/<=>@[\\]^_`{|}~")):
    _CLASSES[list(_chars)] = _i
_SIGNS = np.array([i for i in range(33, 127) if not chr(i).isalnum()] + [10])


def statistics(text: str | None) -> np.ndarray:
    """Statistics of one text; NULL counts as empty, an empty text gives zeros."""
    data = (text or "").encode("utf-8", "surrogatepass")
    n = len(data)
    words = data.split()
    if not words:
        return np.concatenate([[np.log1p(n)], np.zeros(WIDTH - 1)])
    byte = np.frombuffer(data, dtype=np.uint8)
    counts = np.bincount(byte, minlength=256)
    kind = _CLASSES[byte]
    pairs = np.bincount(kind[:-1] * np.uint8(8) + kind[1:], minlength=64) / n
    share = counts[counts > 0] / n
    tally = collections.Counter(words)
    lines = [line for line in data.split(b"\n") if line.strip()]
    line_tally = collections.Counter(lines)
    lengths = np.fromiter(map(len, words), dtype=np.float64, count=len(words))
    top = tally.most_common(1)[0][1]
    head = [
        np.log1p(n), np.log1p(len(words)), lengths.mean(), lengths.std(), lengths.max(),
        len(tally) / len(words), top / len(words), (lengths <= 2).mean(), (lengths >= 12).mean(),
        len(lines), len(line_tally) / len(lines), max(line_tally.values()) / len(lines),
        sum(len(k) * (v - 1) for k, v in line_tally.items()) / n, n / len(lines),
        -(share * np.log(share)).sum(), len(share), np.bincount(kind, minlength=8)[2] / n,
        sum(v for k, v in tally.items() if v == 1) / len(words),
    ]
    return np.concatenate([head, counts[_SIGNS] / n, np.bincount(kind, minlength=8) / n, pairs])


WIDTH = 18 + len(_SIGNS) + 8 + 64


def _matrix(texts: list[str | None]) -> np.ndarray:
    return np.array([statistics(t) for t in texts]).reshape(len(texts), WIDTH)


def _bucket(key: str):
    return F.pmod(F.crc32(F.coalesce(col(key).cast("string"), F.lit("")).cast("binary")), F.lit(5))


def described(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key and ``statistics`` (single-precision values, binary) of each row, from the whole text."""
    rows = docs.select(col(key).alias("_id"), col(text).alias("_text"))

    def made(batches):
        for batch in slices(batches):
            x = _matrix(batch.column("_text").to_pylist()).astype(np.float32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id"), pa.array([r.tobytes() for r in x], pa.binary())], ["_id", "statistics"])

    kind = rows.schema["_id"].dataType.simpleString()
    return rows.mapInArrow(made, f"_id {kind}, statistics binary").withColumnRenamed("_id", key)


def train(docs: DataFrame, labels: DataFrame, local: int = LOCAL, key: str = "doc_id",
          text: str = "text", label: str = "quality", statistics: str | None = None) -> Trees:
    """Trees fitted on all labelled documents: on the driver up to ``local`` rows, else by the tasks.

    Only keys whose crc32 as text leaves a remainder other than 0 by 5 are learnt from. A repeated
    label counts once, the higher one. Without labels every score is 0.5. ``statistics`` names a column
    of ``described`` that takes the place of the text.
    """
    known = pin(labels.select(col(key).alias("_id"), col(label).cast("int").alias("_y"))
                .where("_id IS NOT NULL AND _y IS NOT NULL").where(_bucket("_id") != 0)
                .groupBy("_id").agg(F.max("_y").alias("_y")), "labels")
    learnt = docs.where(_bucket(key) != 0)
    rows = (learnt.select(col(key).alias("_id"), col(statistics).alias("x")) if statistics
            else described(learnt, key, text).toDF("_id", "x")).join(known, "_id")
    made = pin(rows.select(F.col("_id").cast("string").alias("id"), F.col("_y").alias("y"), "x"), "features")
    if made.count() > local:
        return fit_rows(made, WIDTH)
    some = made.orderBy(F.xxhash64(F.lit(9), "id"), "id", "x").toPandas()
    x = np.frombuffer(b"".join(some["x"]), dtype=np.float32).reshape(len(some), WIDTH)
    return fit(x.astype(np.float64), some["y"].to_numpy(dtype=np.float64))


def quality_scores(docs: DataFrame, model: Trees, cut: float = CUT, key: str = "doc_id",
                   text: str = "text", statistics: str | None = None) -> DataFrame:
    """The key of every document with ``held_out``, ``score`` (0 to 1) and ``predicted`` (0 or 1).

    One row per input row, repeated rows included; NULL and empty texts are scored as empty texts.
    A NULL key counts as the empty text for ``held_out``. Other columns are left out. ``statistics``
    names a column of ``described`` that takes the place of the text.
    """
    rows = docs.select(col(key).alias("_id"), _bucket(key).alias("_b"), col(statistics or text).alias("_x"))

    def scored(batches):
        for batch in slices(batches, 4096 if statistics else 256):
            x = batch.column("_x").to_pylist()
            p = model.score(np.frombuffer(b"".join(x), np.float32).reshape(-1, WIDTH) if statistics
                            else _matrix(x).astype(np.float32))
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id"), pa.array([b == 0 for b in batch.column("_b").to_pylist()], pa.bool_()),
                 pa.array(p, pa.float64()), pa.array((p >= cut).astype(np.int32))],
                ["_id", "held_out", "score", "predicted"])

    schema = f"_id {rows.schema['_id'].dataType.simpleString()}, held_out boolean, score double, predicted int"
    return rows.mapInArrow(scored, schema).withColumnRenamed("_id", key)


def keep_quality(docs: DataFrame, model: Trees, cut: float = CUT, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that the classifier accepts, with all their columns."""
    at = docs.columns.index(text)

    def kept(batches):
        for batch in slices(batches):
            p = model.score(_matrix(batch.column(at).to_pylist()).astype(np.float32))
            yield batch.filter(pa.array(p >= cut))

    return map_rows(docs, kept)


@query("op9_quality_trees")
def op9(spark, sf_dir):
    """Quality score of every document, held-out ones marked."""
    docs = pin(described(table(spark, sf_dir, "documents")), "statistics")
    model = train(docs, table(spark, sf_dir, "labels"), statistics="statistics")
    return quality_scores(docs, model, statistics="statistics")

"""Clean vector tables and blocks of them for numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from priceshape.llm.common import col
from priceshape.scratch import pin


def clean(vectors: DataFrame, key: str, vector: str, zeros: bool) -> tuple[DataFrame, int]:
    """``id`` and ``v`` (array of double) of the vectors that take part, written once, and their length.

    Left out: NULL keys, NULL vectors, vectors with NULL or non-finite components, zero vectors unless
    ``zeros``, and vectors that have not the most frequent length (of equally frequent ones the
    smaller). A repeated key counts once, with its smallest vector.
    """
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(col(key).cast("long").alias("id"), col(vector).cast("array<double>").alias("v"))
    rows = rows.where(F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & finite)
    if not zeros:
        rows = rows.where(F.exists("v", lambda x: x != 0))
    rows = pin(rows.groupBy("id").agg(F.min("v").alias("v")), "vectors")
    common = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    size = common["d"] if common else 0
    return rows.where(F.size("v") == size), size


def matrix(column: pa.Array, size: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), size)


def packed(rows: DataFrame, keys: list[str], extra: list[str] = ()) -> DataFrame:
    """Rows of equal ``keys`` as one row of binary columns: ``ids`` and ``vs``, and those of the other
    long columns ``extra``. The caller bounds the group sizes."""
    def pack(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        flat = group.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        out = {k: group.column(k).slice(0, 1) for k in keys}
        for name, source in [("ids", "id"), *[(e, e) for e in extra]]:
            out[name] = pa.array([group.column(source).to_numpy().astype("<i8").tobytes()], pa.binary())
        out["vs"] = pa.array([flat.astype("<f8").tobytes()], pa.binary())
        return pa.table(out)

    kinds = ", ".join(f"{k} int" for k in keys)
    more = "".join(f", {e} binary" for e in extra)
    return rows.groupBy(*keys).applyInArrow(pack, f"{kinds}, ids binary{more}, vs binary")


def unpacked(group: pa.Table, size: int, extra: list[str] = ()) -> tuple[np.ndarray, ...]:
    """Ids, vectors and extra columns of packed rows."""
    def joined(name, kind):
        return np.frombuffer(b"".join(group.column(name).to_pylist()), kind)

    return (joined("ids", "<i8"), joined("vs", "<f8").reshape(-1, size),
            *[joined(e, "<i8") for e in extra])

"""Hard negatives and bit-plane products against plain loops."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from priceshape.llm import bitplanes, negatives

SCHEMA = "vec_id long, embedding array<float>, label int, block int, `part.x` string, anchor string"


@pytest.mark.parametrize("size", [0, 1, 8, 13, 64])
@pytest.mark.parametrize("most", [0, 1, 200, 1 << 20, 1 << 28])
def test_products_are_exact(size, most):
    rng = np.random.default_rng(size)
    rows, anchors = rng.integers(-most - 1, most + 1, (70, size)), rng.integers(-most, most + 1, (9, size))
    made = bitplanes.planes(rows)
    assert (bitplanes.components(made)[:, :size] == rows).all()
    assert (bitplanes.products(bitplanes.subset_sums(anchors), made, rows=32) == anchors @ rows.T).all()


def plainly(rows, wanted, positives=5, hardest=10):
    kept = [(i, v, label) for i, v, label in rows
            if label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept = [(i, [math.floor(256 * float(np.float32(x))) for x in v], label) for i, v, label in kept]
    order = lambda r: (-r[1], r[0] is None, r[0] or 0)
    out = []
    for at, (anchor, v, label) in enumerate(kept):
        if not wanted(anchor):
            continue
        scores = [(i, sum(a * b for a, b in zip(v, w, strict=False)), other) for k, (i, w, other) in enumerate(kept) if k != at]
        for pid, p, _ in sorted((s for s in scores if s[2] == label), key=order)[:positives]:
            found = sorted((s for s in scores if s[2] != label and 30 * p <= 100 * s[1] <= 90 * p), key=order)[:hardest]
            out += [(anchor, pid, rank, nid, p, n) for rank, (nid, n, _) in enumerate(found, 1)]
    return sorted(map(str, out))


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(5)
    made = [(i, (rng.integers(-2, 6, 5) / 256).tolist(), int(rng.choice([0, 0, 0, 1, 2, 3]))) for i in range(600)]
    made += [(1000 + i, [4 / 256] * 5, 1 + i % 2) for i in range(60)]  # ties in every window
    made += [(100, [5 / 256] * 5, 0), (100, [0.0] * 5, 1), (100, [5 / 256] * 5, 0), made[3], made[3]]
    made += [(2000, [5 / 256] * 3, 0), (2001, [], 2), (None, [4 / 256] * 5, 3), (None, [4 / 256] * 5, 0)]
    made += [(-100, [0.5, -0.25, 0.0, 0.125, 0.5], 0), (3000, None, 1), (3100, [1.0] * 5, None),
             (3200, [1.0, None, 0.0, 0.0, 0.0], 1), (3300, [float("nan")] * 5, 0), (3400, [float("inf")] * 5, 0),
             (4000, [1.0] * 5, 77)]  # an anchor without another of its label
    return made


def found(frame, condition="vec_id % 100 = 0", **more):
    return sorted(str(tuple(r)) for r in negatives.hard_negatives(frame, F.expr(condition), **more).collect())


@pytest.mark.parametrize("sizes", [((8_192, 65_536), (128, 4_096)), ((40, 90), (3, 3))])
def test_equals_the_plain_loop(spark, rows, monkeypatch, sizes):
    monkeypatch.setattr(negatives, "BLOCK", sizes[0])
    monkeypatch.setattr(negatives, "ANCHORS", sizes[1])
    monkeypatch.setattr(negatives, "TABLES", 2)
    frame = spark.createDataFrame([(*r, 9, "extra", "x") for r in rows], SCHEMA).repartition(3)
    assert found(frame) == plainly(rows, lambda i: i is not None and i % 100 == 0)


def test_other_numbers_and_few_rows(spark, rows):
    few = rows[:40]
    frame = spark.createDataFrame([(*r, 9, "extra", "x") for r in few], SCHEMA)
    assert found(frame, "vec_id < 9", positives=50, negatives=2) == plainly(few, lambda i: i < 9, 50, 2)


def test_without_anchors_or_rows(spark):
    frame = spark.createDataFrame([(1, [1.0], 0, 0, "", "")], SCHEMA)
    assert found(frame) == [] and found(frame.where("false")) == []
    empty = spark.createDataFrame([(100, [], 0, 0, "", ""), (2, [], 0, 0, "", ""), (3, [], 1, 0, "", "")], SCHEMA)
    assert found(empty) == ["(100, 2, 1, 3, 0, 0)"]


def test_scores_beyond_a_long_are_an_error(spark):
    frame = spark.createDataFrame([(100, [3e38], 0, 0, "", "")], SCHEMA)
    with pytest.raises(ValueError):
        negatives.hard_negatives(frame, F.col("vec_id") % 100 == 0)

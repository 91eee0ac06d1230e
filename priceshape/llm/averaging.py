"""The character network from windows of any number: shards are fitted in tasks of their own, and the
weights are averaged after every pass.

A shard holds about ``SHARD`` windows, chosen by hash. Each task starts a pass from the average of all
shards and goes over the windows of its own; sums are of whole numbers, so their order does not
matter. A single shard makes its passes in one go, as ``charnet.train`` does. Every window teaches,
and every window takes part in the calibration and the threshold.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from priceshape.llm import charnet
from priceshape.llm.charnet import WINDOW, Net
from priceshape.scratch import pin

#: Windows of a shard.
SHARD = 4_096
#: Weights are summed in units of this.
UNIT = 2.0**-36
#: Cells of margins to 1, and their number at most on either side of 0.
CELLS, REACH = 1024, 1 << 16


def _read(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Windows and labels of a shard, in an order of their own."""
    rows = rows.sort_by([("y", "ascending"), ("o", "ascending"), ("x", "ascending")])
    x = np.frombuffer(b"".join(rows["x"].to_pylist()), np.uint8).reshape(-1, WINDOW)
    return x, rows["y"].to_numpy().astype(np.float64)


def _folds(n: int, folds: int, seed: int) -> list[np.ndarray]:
    order = np.random.default_rng(seed).permutation(n)
    return [order[k::folds] for k in range(folds)]


def train(windows: DataFrame, recall: float = 0.98, rounds: int = 6, folds: int = 3, seed: int = 6,
          shard: int = SHARD) -> Net | None:
    """``charnet.train`` over all rows of ``windows`` (``y`` 0 or 1, ``x``: distinct windows); None
    where one of the labels is missing."""
    found = {r["y"]: r["n"] for r in windows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not (found.get(0) and found.get(1)):
        return None
    number = -(-sum(found.values()) // shard)
    order = F.xxhash64("x")
    dealt = windows.select("y", "x", order.alias("o"), F.pmod(order, F.lit(number)).alias("shard")).repartition(
        number, "shard").groupBy("shard")  # a number of its own: small shards are work enough for a task
    nets: list[np.ndarray] | None = None if number == 1 else [charnet.begin(seed + k)[0].vector() for k in (*range(folds), 0)]

    def fitted(first: int, passes: int):
        def task(rows: pa.Table) -> pa.Table:
            x, y = _read(rows)
            held = _folds(len(x), folds, seed)
            made = []
            for k in range(folds + 1):
                rest = np.setdiff1d(np.arange(len(x)), held[k]) if k < folds else np.arange(len(x))
                begun = None if nets is None else Net.of(nets[k])
                made.append(charnet._fit(x[rest], y[rest], passes, seed + k % folds + 1000 * first, begun).vector())
            return pa.table({"place": pa.array(np.arange(sum(map(len, made))), pa.int32()), "value": np.concatenate(made)})

        return dealt.applyInArrow(task, "place int, value double")

    if nets is None:
        rows = fitted(0, rounds).collect()
        nets = np.split(np.array([r["value"] for r in sorted(rows, key=lambda r: r["place"])]), folds + 1)
    else:
        for first in range(rounds):
            # One row per weight, whatever the number of shards.
            rows = fitted(first, 1).groupBy("place").agg(
                F.sum(F.round(F.col("value") / UNIT).cast("long")).alias("s"), F.count("*").alias("n")).collect()
            nets = np.split(np.array([r["s"] * UNIT / r["n"] for r in sorted(rows, key=lambda r: r["place"])]), folds + 1)

    def scored(rows: pa.Table) -> pa.Table:
        """Margin of every window by the network that has not learnt from its fold."""
        x, y = _read(rows)
        margin = np.zeros(len(x))
        for k, held in enumerate(_folds(len(x), folds, seed)):
            margin[held] = Net.of(nets[k]).margins(x[held])
        return pa.table({"y": pa.array(y, pa.int32()), "margin": margin})

    margins = pin(dealt.applyInArrow(scored, "y int, margin double"), "margins")
    net = Net.of(nets[folds])
    # Bounded by the cells.
    cells = margins.groupBy("y", F.floor(F.greatest(F.least(F.col("margin") * CELLS, F.lit(REACH)), F.lit(-REACH))).alias("cell")).agg(
        F.count("*").alias("n")).orderBy("y", "cell").collect()
    count = np.array([r["n"] for r in cells], np.float64)
    charnet.calibrate(net, np.array([(r["cell"] + 0.5) / CELLS for r in cells]), np.array([r["y"] for r in cells]), count)
    side = 1.0 if net.slope >= 0 else -1.0
    positive = margins.where("y = 1").select((F.col("margin") * side).alias("margin"))
    least = _nth(positive, int((1 - recall) * found[1]))
    net.threshold = float(net.calibrated(np.array([side * least]))[0])
    net.recall = positive.where(F.col("margin") >= least).count() / found[1]
    return net


def _nth(values: DataFrame, n: int) -> float:
    """The value of ``margin`` that has ``n`` before it in ascending order, by counts in ever finer cells."""
    low, high = values.agg(F.min("margin"), F.max("margin")).first()
    while low < high:
        width = (high - low) / CELLS
        cells = values.where(F.col("margin").between(low, high)).groupBy(
            F.floor((F.col("margin") - low) / width).alias("cell")).agg(
            F.count("*").alias("n"), F.min("margin").alias("low"), F.max("margin").alias("high")).orderBy("cell").collect()
        for cell in cells:
            if n < cell["n"]:
                break
            n -= cell["n"]
        if (cell["low"], cell["high"]) == (low, high):  # no finer cell in double precision
            break
        low, high = cell["low"], cell["high"]
    return low

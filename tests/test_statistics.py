"""Statistics against plain definitions on small samples, with skew and edge cases."""

import dataclasses
import fractions
import os
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from priceshape.operators import brackets as brackets_module
from priceshape.operators import kde as kde_module
from priceshape.operators import filters, partials
from priceshape.operators import quantiles as quantiles_module
from priceshape.operators import samples as sample_module
from priceshape.operators.kde import kde_curve, kde_mode
from priceshape.operators.moments import moments
from priceshape.operators.quantiles import linear_quantiles, quantiles
from priceshape.operators.samples import make_sample, value_order
from priceshape.operators.shape import axis_limits, histogram
from priceshape.operators.summary import STATISTICS, describe, stat_summary, summarize
from priceshape.scratch import pin
from tests.reference_stats import describe as expected_statistics


def rows_of(spark, groups):
    """groups: {key: (values, weights)} -> DataFrame g, v, w, i."""
    data = [
        (g, float(v), float(w), i)
        for g, (values, weights) in groups.items()
        for i, (v, w) in enumerate(zip(values, weights, strict=True))
    ]
    return spark.createDataFrame(data, "g string, v double, w double, i int").repartition(5)


def samples():
    rng = np.random.default_rng(7)
    n = 400
    heavy = rng.standard_t(1.2, n) * 3
    return {
        "normal": (rng.normal(0.03, 0.05, n), np.ones(n)),
        "heavy": (heavy, rng.integers(0, 4, n)),
        "ties": (rng.integers(0, 6, n) / 10, rng.random(n)),
        "far": (1e6 + rng.random(n), rng.random(n)),
        "two": (np.array([1.0, 5.0]), np.array([1.0, 3.0])),
        "one": (np.array([2.5]), np.array([1.0])),
        "same": (np.full(10, 0.05), np.ones(10)),
        "hot": (np.concatenate([np.full(900, 0.25), rng.random(100)]), np.ones(1000)),
    }


@pytest.mark.parametrize("task_rows", [1_000_000, 16])
def test_summary_matches_definitions(spark, task_rows):
    groups = samples()
    found = stat_summary(rows_of(spark, groups), ["g"], "v", "w", order_col="i",
                         task_rows=task_rows)
    by_key = {r["g"]: r for r in found.collect()}
    assert set(by_key) == set(groups)
    for key, (x, w) in groups.items():
        want, _, _ = expected_statistics(x, w)
        for name in STATISTICS:
            assert by_key[key][name] == pytest.approx(want[name], rel=1e-8, abs=1e-8), (key, name)
        assert by_key[key]["count"] == len(x)


def test_hot_groups_among_many(spark, monkeypatch):
    """Where the facts are too large to broadcast the hot groups are joined apart; the results are the
    same."""
    groups = samples()
    monkeypatch.setattr(sample_module, "FACT_BYTES", 100_000_000)
    monkeypatch.setattr(sample_module, "HOT_ROWS", 300)
    monkeypatch.setattr(sample_module, "broadcast_threshold", lambda _: 2 * 100_000_100 * (len(groups) - 1))
    rows = rows_of(spark, groups)
    assert make_sample(rows, ["g"], "v", "w", "i").hot is None
    monkeypatch.setattr(sample_module, "broadcast_threshold", lambda _: -1)
    sample = make_sample(rows, ["g"], "v", "w", "i")
    hot = {r["g"] for r in sample.finish(sample.hot).collect()}
    assert hot == {k for k, (x, _) in groups.items() if len(x) > 300}
    table = describe(sample, task_rows=100)
    by_key = {r["g"]: r for r in summarize(sample, table).collect()}
    for key, (x, w) in groups.items():
        want, _, _ = expected_statistics(x, w)
        for name in STATISTICS:
            assert by_key[key][name] == pytest.approx(want[name], rel=1e-8, abs=1e-8), (key, name)
    bins = histogram(sample).groupBy("g").agg(F.sum("weight").alias("s")).collect()
    assert len(bins) == len(groups) and all(r["s"] == pytest.approx(1) for r in bins)


def test_broadcast_threshold(spark):
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    try:
        for text, size in (("-1", -1), ("10485760b", 10 << 20), ("20MB", 20 << 20), ("3k", 3 << 10), ("17", 17)):
            spark.conf.set(name, text)
            assert sample_module.broadcast_threshold(spark) == size
    finally:
        spark.conf.set(name, before)


def test_hot_group_with_wide_keys_and_no_broadcast(spark, monkeypatch):
    monkeypatch.setattr(sample_module, "HOT_ROWS", 1000)
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    try:
        rows = spark.range(9000).selectExpr(
            "repeat(cast(if(id % 3 = 0, 0, id) AS string), 40) AS g", "cast(id AS double) AS v")
        sample = make_sample(rows, ["g"], "v")
        assert sample.hot.count() == 1
        found = quantiles(sample, {"q50": 0.5}, task_rows=100)
        assert found.count() == 6001
        assert found.filter("g = repeat('0', 40)").first()["q50"] == 4497  # the 1500th of its 3000 values
    finally:
        spark.conf.set(name, before)


def test_value_order(spark):
    rows = spark.range(3000).selectExpr("id % 2 AS g", "id % 7 AS v", "id % 3 AS w", "id AS o")
    found = {(r["g"], r["_order"]): (r["rank"], r["cum"])
             for r in value_order(make_sample(rows, ["g"], "v", "w", "o")).collect()}
    for g in (0, 1):
        cum = 0
        for rank, i in enumerate(sorted(range(g, 3000, 2), key=lambda i: (i % 7, i)), 1):
            cum += i % 3
            assert found[g, i] == (rank, cum)
    assert len(found) == 3000
    assert value_order(make_sample(rows.limit(0), [], "v")).count() == 0


def test_unit_weights_and_bandwidth_options(spark):
    x = samples()["normal"][0]
    rows = rows_of(spark, {"a": (x, np.ones(len(x)))})
    for bandwidth in (None, 0.0, 0.4):
        got = stat_summary(rows, [], "v", bandwidth=bandwidth, grid_points=256, trim=0.2).first()
        want, _, _ = expected_statistics(x, trim=0.2, bandwidth=bandwidth, grid=256)
        for name in STATISTICS:
            assert got[name] == pytest.approx(want[name], rel=1e-9), name


def test_one_to_five(spark):
    rows = spark.range(1, 6).selectExpr("cast(id AS double) AS v")
    got = stat_summary(rows, [], "v").first()
    assert got["weighted_mean"] == 3
    assert got["weighted_median"] == 2.5
    assert got["trimmed_mean"] == pytest.approx(3)
    assert got["weighted_std"] == pytest.approx(2**0.5)
    assert got["weighted_skewness"] == pytest.approx(0)
    assert got["weighted_kurtosis"] == pytest.approx(-1.3)


def test_equal_copies_have_no_spread(spark):
    rows = spark.range(10).selectExpr("0.05D AS v", "0.1D AS w")
    for weight in (None, "w"):
        got = stat_summary(rows, [], "v", weight).first()
        assert (got["weighted_std"], got["weighted_skewness"], got["weighted_kurtosis"]) == (0, 0, 0)
        assert got["weighted_kde_bandwidth"] == 0
        assert got["weighted_kde_mode"] == 0.05


def test_weight_scale_and_row_order_do_not_matter(spark):
    x, w = samples()["heavy"]
    base = stat_summary(rows_of(spark, {"a": (x, w)}), ["g"], "v", "w").first()
    order = np.random.default_rng(1).permutation(len(x))
    other = stat_summary(
        rows_of(spark, {"a": (x[order], w[order] * 7.0)}).repartition(1), ["g"], "v", "w").first()
    for name in STATISTICS:
        assert other[name] == pytest.approx(base[name], rel=1e-9), name


@pytest.mark.parametrize("weights", [[-1.0, 2.0], [0.0, 0.0]])
def test_bad_weights_are_errors(spark, weights):
    rows = rows_of(spark, {"a": ([1.0, 2.0], weights)})
    with pytest.raises(Exception, match="weights must"):
        make_sample(rows, ["g"], "v", "w")


def test_null_and_nan_values_are_left_out_and_null_groups_kept(spark):
    rows = spark.sql("""SELECT * FROM VALUES (NULL, 1.0D), (NULL, 3.0D), ('a', 2.0D),
        ('a', double('NaN')), ('a', NULL) AS t(g, v)""")
    got = {r["g"]: (r["count"], r["weighted_mean"]) for r in stat_summary(
        rows, ["g"], "v").collect()}
    assert got == {None: (2, 2.0), "a": (1, 2.0)}


@pytest.mark.parametrize("trim", [-0.1, 0.5])
def test_trim_range(spark, trim):
    sample = make_sample(rows_of(spark, {"a": ([1.0], [1.0])}), ["g"], "v")
    with pytest.raises(ValueError):
        quantiles(sample, {}, {"t": trim})


def test_quantile_ends_and_ties(spark):
    sample = make_sample(rows_of(spark, {"a": ([3.0, 1.0, 2.0, 2.0], [1, 1, 1, 1])}), ["g"], "v")
    got = quantiles(sample, {"q0": 0.0, "q5": 0.5, "q6": 0.6, "q1": 1.0, "over": 1.7}).first()
    assert (got["q0"], got["q5"], got["q6"], got["q1"], got["over"]) == (1.0, 2.0, 2.0, 3.0, 3.0)


def test_hot_group_is_split_not_sorted_whole(spark):
    """A third of all rows in one group: the rows any task sorts stay below the limit."""
    rows = spark.range(30_000).selectExpr(
        "if(id % 3 = 0, 'hot', concat('g', id % 500)) AS g",
        "pow(((id * 7919) % 30011) / 30011D, 9) * 1e6 AS v")
    sample = make_sample(rows, ["g"], "v")
    assert sample.largest_group == 10_000
    got = {r["g"]: r["m"] for r in quantiles(sample, {"m": 0.5}, task_rows=300).collect()}
    hot = np.sort([r["v"] for r in rows.filter("g = 'hot'").collect()])
    assert got["hot"] == pytest.approx(hot[len(hot) // 2 - 1], rel=1e-12)
    assert len(got) == rows.select("g").distinct().count()


@pytest.mark.parametrize("task_rows", [None, 12])
def test_equal_weights_give_type_four_quantiles(spark, task_rows):
    """Random samples with ties, outliers of every size and negative numbers."""
    rng = np.random.default_rng(3)
    groups = {}
    for i in range(40):
        n = int(rng.integers(1, 120))
        x = rng.choice([rng.normal(size=n), rng.integers(-3, 3, n) / 4, rng.normal(size=n) * 1e250,
                        np.exp(rng.normal(size=n) * 40)])
        groups[f"g{i}"] = (x, np.ones(n))
    wanted = {"a": 0.0, "b": 0.1, "c": 0.25, "d": 0.5, "e": 0.77, "f": 1.0}
    sample = make_sample(rows_of(spark, groups), ["g"], "v")
    for row in quantiles(sample, wanted, task_rows=task_rows).collect():
        want = np.quantile(groups[row["g"]][0], list(wanted.values()),
                           method="interpolated_inverted_cdf")
        assert [row[k] for k in wanted] == pytest.approx(want, rel=1e-9), row["g"]


def test_rounds_do_not_follow_the_range(spark, monkeypatch):
    """Values over 600 decades of either sign need no more passes than values of one size."""
    rounds = []
    monkeypatch.setattr(
        quantiles_module, "pin", lambda df, label: (rounds.append(label), pin(df, label))[1])
    rng = np.random.default_rng(11)
    n = 20_000
    wide = rng.choice([-1.0, 1.0], n) * 10.0 ** rng.uniform(-300, 300, n)
    close = 1.0 + rng.random(n) * 1e-13
    for x, most in ((wide, 7), (close, 7), (rng.normal(0.03, 0.05, n), 2)):
        rounds.clear()
        rows = spark.createDataFrame([(float(v),) for v in x], "v double").repartition(4)
        got = quantiles(make_sample(rows, [], "v"), {"a": 0.1, "m": 0.5, "z": 0.99}, task_rows=200)
        want = np.quantile(x, [0.1, 0.5, 0.99], method="interpolated_inverted_cdf")
        assert list(got.first()) == pytest.approx(want, rel=1e-14)
        assert len(rounds) <= most


@pytest.mark.parametrize("name", ["event type", "a-b", "a.b", "n", "lo", "h", "i", "mean", "mode",
                                  "Count", "_x", "weight"])
def test_any_group_name(spark, name):
    rows = spark.createDataFrame([(k, float(v)) for k in "pq" for v in range(9)], "k string, v double")
    sample = make_sample(rows.withColumnRenamed("k", name), [name], "v")
    table = describe(sample)
    for found in (summarize(sample, table, grid_points=64), moments(sample),
                  quantiles(sample, {"q": 0.5}), kde_mode(sample, table, grid_points=64),
                  kde_curve(sample, table, grid_points=8), histogram(sample, bins=3),
                  axis_limits(sample)):
        assert len(set(map(str.lower, found.columns))) == len(found.columns)
        assert found.columns[0] == name and {r[0] for r in found.collect()} == {"p", "q"}


def test_mode_without_a_tie_is_the_greatest(spark):
    x = samples()["normal"][0]
    sample = make_sample(rows_of(spark, {"a": (x, np.ones(len(x)))}), ["g"], "v")
    _, points, heights = expected_statistics(x, grid=512)
    for tie in (0.0, 1e-12):
        got = kde_mode(sample, describe(sample), grid_points=512, tie=tie).first()["mode"]
        assert got == pytest.approx(points[np.argmax(heights)], rel=1e-12)


def test_infinite_values_are_left_out(spark):
    rows = spark.sql("SELECT explode(array(1D, 2D, 3D, double('Infinity'), -double('Infinity'))) v")
    sample = make_sample(rows, [], "v")
    assert (sample.total_rows, sample.largest_group, sample.group_count) == (3, 3, 1)
    assert quantiles(sample, {"m": 0.5}, task_rows=1).first()["m"] == 1.5


def test_linear_quantiles_match_numpy(spark):
    groups = {k: (v[0], np.ones(len(v[0]))) for k, v in samples().items()}
    sample = make_sample(rows_of(spark, groups), ["g"], "v")
    got = linear_quantiles(sample, {"a": 0.0025, "b": 0.37, "c": 1.0}, task_rows=20)
    for row in got.collect():
        want = np.quantile(groups[row["g"]][0], [0.0025, 0.37, 1.0])
        assert [row["a"], row["b"], row["c"]] == pytest.approx(want, rel=1e-12)


def test_density_curve(spark):
    groups = samples()
    sample = make_sample(rows_of(spark, groups), ["g"], "v", "w", "i")
    table = describe(sample)
    curve = kde_curve(sample, table, grid_points=300).toPandas()
    for key in ("normal", "heavy", "ties", "hot", "two"):
        _, points, density = expected_statistics(*groups[key], grid=300)
        part = curve[curve.g == key].sort_values("i")
        assert np.allclose(part.grid_x, points, rtol=1e-12, atol=1e-12)
        assert np.allclose(part.density, density, rtol=1e-9, atol=density.max() * 1e-13)
    flat = curve[curve.g == "same"]
    assert len(flat) == 300 and flat.density.sum() == 1.0


def test_zero_bandwidth_curve_has_one_point(spark):
    rows = rows_of(spark, {"a": ([0.0, 0.0, 10.0, 10.0], [1, 1, 1, 1])})
    sample = make_sample(rows, ["g"], "v", order_col="i")
    table = sample.facts.withColumn("h", F.lit(0.0))
    got = kde_curve(sample, table, grid_points=64).filter("density <> 0").collect()
    assert [(r["i"], r["density"]) for r in got] == [(0, 1.0)]
    assert kde_mode(sample, table).first()["mode"] == 0.0


def test_tiny_bandwidth_keeps_all_values(spark):
    """A bandwidth far below the grid step: only values near a grid point show up."""
    x = np.linspace(0, 100, 41)
    sample = make_sample(rows_of(spark, {"a": (x, np.ones(41))}), ["g"], "v")
    table = sample.facts.withColumn("h", F.lit(1e-3))
    curve = kde_curve(sample, table, grid_points=101).toPandas().sort_values("i")
    _, points, density = expected_statistics(x, bandwidth=1e-3, grid=101)
    assert np.allclose(curve.density, density, rtol=1e-9, atol=1e-12 * density.max())


def test_histogram(spark):
    groups = samples()
    sample = make_sample(rows_of(spark, groups), ["g"], "v", "w")
    got = histogram(sample).toPandas()
    for key, (x, w) in groups.items():
        part = got[got.g == key].sort_values("bin")
        want, edges = np.histogram(x, 30, weights=np.asarray(w, float) / np.sum(w))
        assert np.allclose(part.weight, want, atol=1e-12), key
        assert np.allclose(part.bin_low, edges[:-1]) and np.allclose(part.bin_high, edges[1:])
        assert part.weight.sum() == pytest.approx(1)


def test_axis_limits(spark):
    rows = spark.createDataFrame([(float(v),) for v in (-10, -5, 0, 5, 10)], "v double")
    got = axis_limits(make_sample(rows, [], "v")).first()
    assert got["axis_low"] < -10 and got["axis_high"] > 10
    empty = axis_limits(make_sample(rows.filter("v > 99"), [], "v")).first()
    assert tuple(empty) == (-1.0, 1.0)
    constant = axis_limits(make_sample(rows.filter("v = 5"), [], "v")).first()
    assert tuple(constant) == (2.5, 7.5)


def test_moments_keep_precision_far_from_zero(spark):
    rows = spark.range(1000).selectExpr("1e9 + (id % 2) AS v", "1.0D AS w")
    for weight in (None, "w"):
        got = moments(make_sample(rows, [], "v", weight)).first()
        assert got["variance"] == pytest.approx(0.25, rel=1e-8)
        assert got["kurtosis"] == pytest.approx(-2.0, rel=1e-8)


def test_partition_count_does_not_change_results(spark):
    groups = samples()
    keep = spark.conf.get("spark.sql.shuffle.partitions")
    results = []
    for partitions in ("1", "13"):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        found = stat_summary(rows_of(spark, groups), ["g"], "v", "w", order_col="i")
        results.append({r["g"]: r for r in found.collect()})
    spark.conf.set("spark.sql.shuffle.partitions", keep)
    for key in groups:
        for name in STATISTICS:
            assert results[0][key][name] == pytest.approx(results[1][key][name], rel=1e-9)


def test_density_moves_only_aggregates(spark, path):
    """Every exchange of the mode sits above an aggregation, none carries the rows themselves."""
    spark.range(100).selectExpr("id % 3 AS g", "cast(id AS double) AS v").write.parquet(f"{path}/t")
    sample = make_sample(spark.read.parquet(f"{path}/t"), ["g"], "v")
    mode = kde_mode(sample, describe(sample).filter("h > 0"))
    plan = mode._jdf.queryExecution().executedPlan().toString()
    lines = plan.splitlines()
    for number, line in enumerate(lines):
        if "Exchange hashpartitioning" in line:
            below = " ".join(lines[number + 1:number + 4])
            assert "Aggregate" in below or "Join" in below, line
    assert "SortMergeJoin" not in plan and "CartesianProduct" not in plan


@pytest.mark.parametrize("bad", ["area", "=x", "area=", "colour=red"])
def test_malformed_locks(bad):
    with pytest.raises(ValueError):
        filters.parse_locks([bad])


def test_locks():
    assert filters.parse_locks(["area=0000", " Periodicity = R ", ""]) == {
        "area_code": "0000", "periodicity_code": "R"}
    with pytest.raises(ValueError):
        filters.parse_locks(["area=1", "area_code=2"])


def counted_reads(rows, folder):
    """``rows`` that leave a line per task that reads them, and the number of whole reads so far."""
    parts = rows.rdd.getNumPartitions()

    def noted(batches):
        with open(f"{folder}/{uuid.uuid4().hex}", "w"):
            pass
        yield from batches

    return rows.mapInArrow(noted, rows.schema), lambda: len(os.listdir(folder)) / parts


@pytest.mark.parametrize("weighted", [False, True])
def test_two_reads_whatever_the_values(spark, tmp_path, weighted):
    """A third of the rows in one group, values over 600 decades: the summary and one read more."""
    rng = np.random.default_rng(2)
    n = 24_000
    x = rng.choice([-1.0, 1.0], n) * 10.0 ** rng.uniform(-300, 300, n)
    x[::7] = 0.25
    w = rng.integers(0, 5, n) * rng.random(n) if weighted else np.ones(n)
    g = np.where(np.arange(n) % 3 == 0, 0, 1 + np.arange(n) % 90)
    frame = spark.createDataFrame(
        list(zip(g.tolist(), x.tolist(), w.tolist(), strict=True)), "g int, v double, w double").repartition(6)
    rows, reads = counted_reads(pin(frame, "rows"), str(tmp_path))
    sample = make_sample(rows, ["g"], "v", "w" if weighted else None)
    before = reads()
    got = {r["g"]: r for r in quantiles(sample, {"a": 0.0, "m": 0.5, "y": 0.99, "z": 1.0}, {"t": 0.08}, task_rows=120).collect()}
    assert reads() - before == 2
    assert len(got) == len(set(g.tolist()))
    for key, row in got.items():
        own = g == key
        order = np.argsort(x[own], kind="stable")
        sx, sw = x[own][order], w[own][order]
        cum, total = np.cumsum(sw), sw.sum()
        kept = np.clip(cum, 0.08 * total, 0.92 * total) - np.clip(cum - sw, 0.08 * total, 0.92 * total)
        assert row["t"] == pytest.approx((kept * sx).sum() / kept.sum(), rel=1e-9)
        assert row["z"] == pytest.approx(sx[-1] if sw[-1] > 0 or not weighted else row["z"])
        at = int(np.searchsorted(cum, 0.5 * total, side="right"))
        assert sx[max(at - 1, 0)] <= row["m"] <= sx[at]


def test_runs_bound_the_weight_below_any_value():
    rng = np.random.default_rng(8)
    n = 200_000
    x, w = rng.standard_cauchy(n), rng.random(n) ** 4
    x[:5000], w[7] = 0.5, 0.02 * w.sum()
    g = np.zeros(n, np.int64)
    parts = [brackets_module.runs(g[s], x[s], x[s], w[s]) for s in np.array_split(rng.permutation(n), 5)]
    assert all(len(p[0]) <= 2 * brackets_module.PARTS + 4 for p in parts)
    for lists in (parts, [brackets_module.runs(*map(np.concatenate, zip(*parts, strict=True)))]):
        _, lo, hi, weight = map(np.concatenate, zip(*lists, strict=True))
        assert weight.sum() == pytest.approx(w.sum())
        for v in np.quantile(x, np.linspace(0.01, 0.99, 25)):
            below = w[x < v].sum()
            least, most = weight[hi < v].sum(), weight[lo <= v].sum()
            assert least <= below * (1 + 1e-12) and below <= most * (1 + 1e-12)
            assert most - least - w[x == v].sum() <= 3 * w.sum() / brackets_module.PARTS + w[7]


def test_weights_of_very_different_size(spark):
    """Sums that lose more than the first room to rounding still end with the plain result."""
    rows = spark.range(400).selectExpr("cast(id AS double) AS v", "if(id = 200, 1e20, 1D) AS w")
    got = quantiles(make_sample(rows, [], "v", "w"), {"m": 0.5, "z": 1.0}, task_rows=10).first()
    assert got["m"] == pytest.approx(199.5) and got["z"] == 399.0


def log_density(x, w, h, points):
    """Logarithm of the plain density, the greatest exponent taken out."""
    out = []
    for p in points:
        e = -0.5 * ((p - x) / h) ** 2 + np.log(w / w.sum())
        out.append(e.max() + np.log(np.exp(e - e.max()).sum()) - np.log(h * np.sqrt(2 * np.pi)))
    return np.array(out)


def test_tails_and_gaps_to_a_relative_tolerance(spark):
    """From the edge of a cluster to a hundred thousand bandwidths from any row."""
    rng = np.random.default_rng(12)
    n = 3000
    groups = {
        "clusters": (np.concatenate([rng.normal(0, 1, n), rng.normal(60, 3, n), [500.0, 500.0, 507.0, 1e5]]), 0.4),
        "steps": (np.repeat(np.arange(5) * 9.0, 50) + rng.random(250) * 1e-3, 1.0),
        "cauchy": (rng.standard_cauchy(n), 0.05),
        "edge": (np.concatenate([-np.exp(-rng.uniform(0, 18, n)), [30.0, 39.0]]), 1.0),
        "two": (np.array([0.0, 1e4]), 1.0),
        "dense": (rng.random(n), 0.3),
    }
    weights = {k: np.exp(rng.uniform(-3, 3, len(x))) * (rng.random(len(x)) > 0.1) + (np.arange(len(x)) == 0)
               for k, (x, _) in groups.items()}
    weights["two"] = np.array([1.0, 7.0])
    rows = rows_of(spark, {k: (x, weights[k]) for k, (x, _) in groups.items()})
    sample = make_sample(rows, ["g"], "v", "w")
    bandwidths = spark.createDataFrame([(k, h) for k, (_, h) in groups.items()], "g string, h double")
    table = sample.facts.join(bandwidths, sample.facts[sample.keys[0]] == bandwidths["g"]).drop("g")
    for grid in (64, 700):
        curve = kde_curve(sample, table, grid_points=grid, logarithm=True).toPandas()
        for key, (x, h) in groups.items():
            part = curve[curve.g == key].sort_values("i")
            w = weights[key]
            points = np.linspace(x.min() - 3 * h, x.max() + 3 * h, grid)
            want = log_density(x[w > 0], w[w > 0], h, points)
            assert list(part.i) == list(range(grid))
            # The grid points themselves carry rounding, which the exponent multiplies by the distance.
            far = np.array([np.abs(p - x[w > 0]).min() / h for p in points])
            room = 1e-9 + far * np.abs(points).max() / h * 1e-15
            assert (np.abs(part.log_density.to_numpy() - want) <= room * (1 + far)).all(), key
            seen = want > -700
            assert np.allclose(part.density.to_numpy()[seen], np.exp(want[seen]), rtol=1e-6), key


def test_curve_without_gaps_reads_no_tails(spark, monkeypatch):
    from priceshape.operators import tails

    labels = []
    monkeypatch.setattr(tails, "pin", lambda df, label: (labels.append(label), pin(df, label))[1])
    sample = make_sample(rows_of(spark, {"a": (np.random.default_rng(1).random(500), np.ones(500))}), ["g"], "v")
    assert kde_curve(sample, sample.facts.withColumn("h", F.lit(0.3)), grid_points=50).count() == 50
    assert labels == ["open"]


def test_weighted_moments_in_one_read_far_from_zero(spark, tmp_path):
    """A mean of a hundred million standard deviations; fine groups add up to coarse ones."""
    rng = np.random.default_rng(21)
    n = 6000
    x = 1e6 + 0.01 * rng.standard_gamma(2.0, n)
    w = rng.random(n) * (rng.random(n) > 0.2)
    frame = spark.createDataFrame([(i % 3, None if i % 4 == 0 else f"b{i % 4}", float(a), float(b)) for i, (a, b) in enumerate(zip(x, w, strict=True))],
                                  "g int, h string, v double, w double").repartition(7)
    rows, reads = counted_reads(pin(frame, "rows"), str(tmp_path))
    sample = make_sample(rows, ["g", "h"], "v", "w")
    found = {(r["g"], r["h"]): r for r in moments(sample).collect()}
    assert reads() == 1

    def exact(values, weights):
        values, weights = [fractions.Fraction(float(v)) for v in values], [fractions.Fraction(float(v)) for v in weights]
        total = sum(weights)
        mean = sum(a * b for a, b in zip(values, weights, strict=True)) / total
        m2, m3, m4 = (sum(b * (a - mean) ** k for a, b in zip(values, weights, strict=True)) / total for k in (2, 3, 4))
        return float(mean), float(m2), float(m3) / float(m2) ** 1.5, float(m4 / m2**2) - 3

    group = [(i % 3, None if i % 4 == 0 else f"b{i % 4}") for i in range(n)]
    for key in set(group):
        own = [i for i in range(n) if group[i] == key]
        mean, var, skew, kurt = exact(x[own], w[own])
        r = found[key]
        assert r["mean"] == pytest.approx(mean, rel=1e-15) and r["variance"] == pytest.approx(var, rel=1e-7)
        assert r["skewness"] == pytest.approx(skew, rel=1e-6) and r["kurtosis"] == pytest.approx(kurt, rel=1e-6)
    fine = pin(partials.partial_moments(sample.rows, sample.keys), "fine")
    for r in partials.merged_moments(fine, sample.keys[:1]).collect():
        own = [i for i in range(n) if group[i][0] == r[sample.keys[0]]]
        mean, var, skew, kurt = exact(x[own], w[own])
        assert r["swx"] / r["sw"] == pytest.approx(mean, rel=1e-14) and r["var"] == pytest.approx(var, rel=1e-7)
        assert (r["skew"], r["kurt"]) == pytest.approx((skew, kurt), rel=1e-6) and r["n"] == len(own)


def test_weighted_groups_of_structs(spark):
    rows = spark.range(60).selectExpr("named_struct('a', id % 2) AS g", "cast(id AS double) AS v", "id % 3 + 1 AS w")
    got = {r["g"]["a"]: r for r in moments(make_sample(rows, ["g"], "v", "w")).collect()}
    for a in (0, 1):
        x, w = np.arange(a, 60, 2.0), np.arange(a, 60, 2) % 3 + 1.0
        mean = (x * w).sum() / w.sum()
        assert got[a]["mean"] == pytest.approx(mean) and got[a]["variance"] == pytest.approx((w * (x - mean) ** 2).sum() / w.sum())


@pytest.mark.parametrize("weighted", [False, True])
def test_mode_in_any_order_of_the_rows(spark, weighted):
    """Groups with ties between grid points: to the last bit alike in 1 and 64 parts."""
    rng = np.random.default_rng(31)
    groups = {f"g{k}": (rng.integers(0, 4, 300) / 7, rng.random(300)) for k in range(4)}
    groups |= {"two": (np.array([0.1, 0.7]), np.ones(2)), "normal": (rng.normal(0.03, 0.05, 4000), rng.random(4000) ** 6),
               "mirror": (np.concatenate([v := rng.random(500), -v]), np.ones(1000))}
    rows = pin(rows_of(spark, groups), "rows")
    facts = make_sample(rows, ["g"], "v").facts.withColumn("h", F.lit(0.03))
    found = []
    for parts in (1, 64, 7):
        shuffled = pin(rows.orderBy(F.rand(parts)).repartition(parts), "shuffled")
        sample = make_sample(shuffled, ["g"], "v", "w" if weighted else None)
        # The facts' own sums may differ in their last bits, so one set of facts serves all.
        sample = dataclasses.replace(sample, facts=facts)
        frame = kde_module.grid_frame(facts, sample.keys, 512)
        curve = kde_module.density(sample, frame, 512, reproducible=True).collect()
        found.append((sorted(map(str, curve)), sorted(map(str, kde_mode(
            sample, facts, grid_points=512, tie=0.0, reproducible=True).collect()))))
    assert found[0] == found[1] == found[2]
    modes = {r["g"]: r["mode"] for r in kde_mode(sample, facts, grid_points=512, tie=0.0, reproducible=True).collect()}
    for key, (x, w) in groups.items():
        _, points, density = expected_statistics(x, w if weighted else None, bandwidth=0.03, grid=512)
        ranked = np.sort(density)[::-1]
        if ranked[1] < ranked[0] * (1 - 1e-11):
            assert modes[key] == pytest.approx(points[np.argmax(density)], rel=1e-12, abs=1e-12)
        assert density[np.abs(points - modes[key]).argmin()] >= ranked[0] * (1 - 1e-12)

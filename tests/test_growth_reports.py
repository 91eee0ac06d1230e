"""Growth rules, groups, panels and their options on hand-made tables."""

import json
import pathlib

import pytest
from pyspark.sql import functions as F

from priceshape import cli
from priceshape.operators.growth import global_latest, growth_components, lagged_growth
from priceshape.plans import jobs, reports, views
from priceshape.sources import exports
from tests.conftest import make_tables, series_row


def test_tiny(tiny):
    row = growth_components(tiny).first()
    assert (row["series_id"], row["year"], row["period"]) == ("S1", 2025, "M09")
    assert row["value"] == pytest.approx(0.05, rel=1e-15)


def test_gaps_annual_rows_zero_and_missing_values(spark):
    items = [("AA", "Item", 0, True, 1)]
    ids = ["GAP", "ANN", "ZERO", "NULL", "CASE", "ORPHAN_ITEM"]
    series = [series_row(s, "ZZ" if s == "ORPHAN_ITEM" else "AA") for s in ids]
    observations = [
        # A missing year: the row twelve places back is not the year before.
        ("GAP", 2020, "M01", 10, None), ("GAP", 2022, "M01", 20, None),
        # The annual average ranks after December.
        ("ANN", 2020, "M12", 1, None), ("ANN", 2021, "M12", 3, None),
        ("ANN", 2020, "M13", 4, None), ("ANN", 2021, "M13", 5, None),
        ("ZERO", 2020, "M01", 0, None), ("ZERO", 2021, "M01", 1, None),
        ("NULL", 2020, "M01", 5, None), ("NULL", 2021, "M01", None, None),
        # Codes that differ in case are one period; the last in store order counts.
        ("CASE", 2020, "M02", 4, None), ("CASE", 2020, "m02", 5, None),
        ("CASE", 2021, " m02 ", 10, None),
        ("ORPHAN_ITEM", 2020, "M01", 1, None), ("ORPHAN_ITEM", 2021, "M01", 2, None),
        ("NO_SERIES", 2020, "M01", 1, None), ("NO_SERIES", 2021, "M01", 2, None),
    ]
    tables = make_tables(spark, series, items, observations)
    for selectable_only in (True, False):
        got = {r["series_id"]: (r["year"], r["period"], r["value"])
               for r in growth_components(tables, selectable_only=selectable_only).collect()}
        assert got == {"ANN": (2021, "M13", 0.25), "CASE": (2021, "M02", 1.0)}
    months = {(r["series_id"], r["value"]) for r in growth_components(
        tables, months=("2021-01", "2021-12")).collect()}
    assert months == {("ANN", 2.0), ("CASE", 1.0)}
    assert tuple(global_latest(tables.observation).first()) == (2022, "M01")


def test_latest_is_per_series(spark):
    tables = make_tables(
        spark, [series_row("OLD"), series_row("NEW")], [("AA", "Item", 0, True, 1)],
        [("OLD", 2001, "M05", 1, None), ("OLD", 2002, "M05", 2, None),
         ("NEW", 2023, "M01", 4, None), ("NEW", 2024, "M01", 5, None)])
    got = {r["series_id"]: r["year"] for r in growth_components(tables).collect()}
    assert got == {"OLD": 2002, "NEW": 2024}


def test_lag_counts_rows(spark):
    rows = [("S", 2020 + i // 12, f"M{i % 12 + 1:02d}", i + 1, None) for i in range(14)]
    tables = make_tables(spark, [series_row("S")], [("AA", "Item", 0, True, 1)], rows)
    got = {(r["year"], r["period"]): r["yoy"] for r in lagged_growth(tables.observation).collect()}
    assert got[(2021, "M01")] == 12.0 and got[(2021, "M02")] == 6.0
    assert got[(2020, "M12")] is None


def test_lock_leaves_one_series(two_series):
    locks = {"area_code": "1111"}
    report = reports.compute(two_series, locks=locks)
    header = report.header.first()
    assert (header["component_count"], header["group_count"]) == (1, 1)
    document = json.loads("".join(exports.summary_text(report.groups, report.header, locks)))
    assert document["series_locks"] == {"area_code": "1111"}
    group = document["groups"][0]
    assert group["label"] == "1" and group["count"] == 1
    assert group["examples"][0]["series_id"] == "S1"
    assert group["examples"][0]["yoy_percent"] == "5.00%"
    assert group["stats"]["weighted_mean_percent"] == "5.00%"


def test_small_samples(two_series):
    report = reports.compute(two_series, min_sample_size=5, skip_small_samples=True)
    header = report.header.first()
    assert (header["component_count"], header["group_count"]) == (2, 0)
    assert report.groups.count() == 0
    assert {r["label"]: r["sample_size"] for r in report.warnings.collect()} == {"1": 1, "2": 1}
    kept = reports.compute(two_series, min_sample_size=5)
    assert kept.header.first()["group_count"] == 2 and kept.warnings.count() == 2


def test_no_components_is_an_error(tiny):
    with pytest.raises(ValueError):
        reports.compute(tiny, date="2020-01")


def test_guard_scopes(two_series):
    warned = reports.panel_warnings(two_series, "2025-01", "2025-12", 3)
    assert sorted((r["scope"], r["label"], r["sample_size"]) for r in warned.collect()) == [
        ("group", "2025-09:1", 1), ("group", "2025-09:2", 1), ("period", "2025-09", 2)]
    skipped = reports.panel_warnings(two_series, "2025-01", "2025-12", 3, skip_small_samples=True)
    assert [r["scope"] for r in skipped.collect()] == ["period"]
    whole = reports.panel(two_series, "2025-01", "2025-12", min_sample_size=2,
                          skip_small_samples=True)
    assert whole.count() == 0
    series = reports.metrics_timeseries(two_series, "2025-01", "2025-12", min_sample_size=2,
                                        skip_small_samples=True)
    assert series.first()["component_count"] == 2


def test_panel_columns_and_export(spark, two_series, path):
    columns = ["date", "group_label", "group_by", "selectable_only", "source", "count", "mode",
               "mode_percent", "mean", "median", "trimmed_mean", "std", "skewness", "kurtosis",
               "effective_sample_size"]
    report = reports.panel(two_series, "2025-09", "2025-09")
    assert report.columns == columns
    jobs.export_panel(two_series, "2025-01", "2025-12", f"{path}/panel.csv")
    back = exports.read_csv_report(spark, f"{path}/panel.csv", report.schema)
    rows = back.orderBy("group_label").collect()
    assert [r["group_label"] for r in rows] == ["1", "2"]
    assert str(rows[0]["date"]) == "2025-09-01" and rows[0]["mode_percent"] == "5.00%"
    assert reports.metric_frame(report).first()["mode_percent"] == 5.0
    with pytest.raises(ValueError):
        jobs.export_panel(two_series, "2025-01", "2025-12", f"{path}/panel.txt")
    with pytest.raises(ValueError):
        jobs.export_panel(two_series, "2001-01", "2001-12", f"{path}/none.csv")


def test_group_labels(spark):
    labels = spark.createDataFrame([("10 chars",), ("2 chars",), ("alpha",), ("1",)], "label string")
    ordered = [r["label"] for r in labels.orderBy(*reports.label_order()).collect()]
    assert ordered == ["alpha", "1", "2 chars", "10 chars"]
    with pytest.warns(UserWarning):
        reports.group_label("series-name-length")
    with pytest.raises(ValueError):
        reports.group_label("colour")


def test_views(spark, two_series):
    name = views.create_series_view(two_series, display_level=2)
    rows = spark.sql(f"SELECT id, name, cast(date AS string) AS date FROM {name}").collect()
    assert {tuple(r) for r in rows} == {("S2", "Item BB", "2024-09-01"),
                                        ("S2", "Item BB", "2025-09-01")}
    assert views.series_view(two_series, code_length=2).count() == 4
    with pytest.raises(ValueError):
        views.series_view(two_series)


def test_analysis_frames(two_series, path):
    result = jobs.export_analysis(two_series, path)
    assert result.curves.groupBy("label").count().first()["count"] == 2048
    document = json.loads(next(pathlib.Path(path, "summary").glob("part-*")).read_text())
    assert document["components_total"] == 2 and document["group_count"] == 2
    assert [g["examples"][0]["series_id"] for g in document["groups"]] == ["S1", "S2"]
    assert result.limits.count() == 2
    total = result.histograms.groupBy("label").agg(F.sum("weight").alias("s")).collect()
    assert all(r["s"] == pytest.approx(1) for r in total)


def test_cli_arguments():
    parsed = cli.parser().parse_args(
        ["panel", "--location", "x", "--start", "2020-01", "--end", "2020-02", "--export", "p.csv",
         "--series-lock", "area=0000", "--include-unselectable", "--group-by",
         "item-code-length"])
    assert parsed.selectable_only is False and parsed.series_lock == ["area=0000"]
    with pytest.raises(SystemExit):
        cli.parser().parse_args(["panel", "--location", "x"])

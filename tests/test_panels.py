"""Stored monthly reports against full ones, after several refreshes."""

import pathlib
import random

import pytest
from pyspark.sql import functions as F

from priceshape.plans import reports
from priceshape.plans.panels import MonthlyReport, touched_months
from priceshape.sources.store import Store
from priceshape.streaming.refresh import refresh_from_landing
from tests.conftest import frame, make_tables, series_row

HEADER = "series_id\tyear\tperiod\tvalue\tfootnote_codes\n"


def test_touched_months():
    assert touched_months({(2000, "m03 "), (2000, "M13"), (2001, "M03"), (1999, "S01")}) == {
        (2000, "M03"), (2001, "M03"), (2002, "M03")}


@pytest.fixture
def store(spark, path):
    rng = random.Random(1)
    ids = [f"S{i}" for i in range(8)]
    tables = make_tables(
        spark, [series_row(i, "AA" if k % 2 else "BB") for k, i in enumerate(ids)],
        [("AA", "a", 1, True, 1), ("BB", "b", 2, True, 2)],
        [(i, y, f"M{m:02d}", str(round(rng.uniform(90, 110), 3)), None) for i in ids for y in range(2019, 2023) for m in (3, 4, 13)])
    made = Store(spark, f"{path}/store")
    made.load(tables)
    return made


def plain(df):
    return sorted(str([round(v, 9) if isinstance(v, float) else v for v in r]) for r in df.collect())


@pytest.mark.parametrize("report", [reports.panel, reports.metrics_timeseries])
def test_equal_to_a_full_report_after_three_refreshes(spark, store, path, report):
    stored = MonthlyReport(spark, f"{path}/report", report, "2019-01", "2023-12")
    stored.rebuild(store.read())
    full = lambda: report(store.read(), "2019-01", "2023-12")
    assert plain(stored.read()) == plain(full()) and stored.read().columns == full().columns
    changes = [
        ([("S1", 2020, "M03", "150", None), ("S2", 2020, "M13", "1", None)], {"2020-03", "2021-03"}),
        ([("S1", 2023, "M04", "99", None), ("S3", 2019, "M04", "77", ["A"])], {"2019-04", "2020-04", "2023-04"}),
        ([("S1", 2020, "M03", "150", None), ("S5", 2021, "M04", None, None)], {"2021-04", "2022-04"}),
        ([("S1", 2020, "M03", "150.0", ["P"])], set()),
    ]
    for rows, months in changes:
        changed = store.upsert_observations(frame(spark, "observation", rows))
        assert stored.refresh(store.read(), changed) == months
        assert plain(stored.read()) == plain(full())


def test_untouched_months_are_neither_read_nor_written(spark, store, path):
    stored = MonthlyReport(spark, f"{path}/report", reports.panel, "2019-01", "2022-12")
    stored.rebuild(store.read())
    changed = store.upsert_observations(frame(spark, "observation", [("S1", 2021, "M03", "150", None)]))
    assert changed == {(2021, "M03")}
    root = pathlib.Path(path)
    for part in root.glob("store/observation/year=*/period=*/part-*"):
        if "period=M03" not in str(part) or "year=2019" in str(part):
            part.write_bytes(b"not a Parquet file")
    for part in root.glob("report/month=*/part-*"):
        if "month=2021-03" not in str(part) and "month=2022-03" not in str(part):
            part.write_bytes(b"not a Parquet file")
    spark.catalog.clearCache()
    assert stored.refresh(store.read(), changed) == {"2021-03", "2022-03"}
    got = spark.read.parquet(*[str(p) for p in root.glob("report/month=202[12]-03")])
    assert got.count() == 4


def test_months_without_rows_are_emptied(spark, store, path):
    stored = MonthlyReport(spark, f"{path}/report", reports.metrics_timeseries, "2019-01", "2022-12")
    stored.rebuild(store.read())
    gone = store.read().observation.filter("year = 2021 AND period = 'M04'").withColumn("value", F.lit(None).cast("decimal(18,6)"))
    changed = store.upsert_observations(gone)
    assert stored.refresh(store.read(), changed) == {"2021-04", "2022-04"}
    assert {r["date"] for r in stored.read().collect()} == {"2020-03", "2020-04", "2021-03", "2022-03"}
    stored.rebuild(store.read())
    assert stored.read().count() == 4


def test_landing_refresh_takes_the_reports_along(spark, store, path, tmp_path):
    stored = MonthlyReport(spark, f"{path}/report", reports.panel, "2019-01", "2022-12")
    stored.rebuild(store.read())
    landing = tmp_path / "landing"
    landing.mkdir()

    class Broken(MonthlyReport):
        def refresh(self, tables, changed):
            raise RuntimeError("lost")

    (landing / "1.tsv").write_text(HEADER + "S1\t2021\tM03\t155\t\n")
    with pytest.raises(Exception, match="lost"):
        refresh_from_landing(spark, str(landing), store.root, f"{path}/offsets", reports=[Broken(spark, "", None, "", "")])
    (landing / "2.tsv").write_text(HEADER + "S2\t2020\tM04\t120\tA\n")
    for _ in range(2):
        refresh_from_landing(spark, str(landing), store.root, f"{path}/offsets", reports=[stored])
        assert plain(stored.read()) == plain(reports.panel(store.read(), "2019-01", "2022-12"))

"""Flat files, snapshots, store maintenance and the landing refresh."""

import pathlib
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from priceshape import cli
from priceshape.operators import dedup
from priceshape.plans import jobs
from priceshape.sources import flatfiles, snapshot
from priceshape.sources.store import Store
from priceshape.streaming.refresh import refresh_from_landing
from tests.conftest import frame, make_tables, series_row

FILES = {
    "cu.area": "area_code\tarea_name\n0000\tU.S. city average\n",
    "cu.item": "item_code\titem_name\tdisplay_level\tselectable\tsort_sequence\n"
               "AA0\tAll items - old base\t0\tT\t2\n",
    "cu.period": "period_code\tperiod_abbr\tperiod_name\nM01\tJAN\tJanuary\n",
    "cu.footnote": "footnote_code\tfootnote_text\nD\tData are preliminary\n",
    "cu.series": "series_id\tarea_code\titem_code\tseasonal\tperiodicity_code\tbase_code\t"
                 "base_period\tbegin_year\tbegin_period\tend_year\tend_period\n"
                 "SUUR0000AA0      \t0000\tAA0\tS\tS\tC\t1982-84=100\t1913\tM01\t2023\tM01\n",
    "cu.data.0.Current": "series_id         \tyear\tperiod\t       value\tfootnote_codes\n"
                         "SUUR0000AA0\t1913\tM01\t         9.8\t\n"
                         "SUUR0000AA0\t1913\tM02\t\tD, E\n"
                         "\t\t\t\t\n",
    "cu.data.1.AllItems": "series_id\tyear\tperiod\tvalue\tfootnote_codes\n"
                          "SUUR0000AA0\t1913\tM01\t77\t\nSUUR0000AA0\t1914\tM01\t10.1\n",
}


@pytest.fixture
def folder(tmp_path):
    for name, text in FILES.items():
        (tmp_path / name).write_text(text)
    return str(tmp_path)


def values(df):
    return {
        (r["series_id"], r["year"], r["period"]): (
            None if r["value"] is None else float(r["value"]), tuple(r["footnotes"] or ()))
        for r in df.collect()
    }


def test_flat_files(spark, folder):
    tables = flatfiles.read_dataset(spark, folder, list(FILES)[-2:])
    assert tuple(tables.area.first()) == ("0000", "U.S. city average")
    assert tuple(tables.item.first()) == ("AA0", "All items - old base", 0, True, 2)
    assert tuple(tables.period.first()) == ("M01", "JAN", "January")
    series = tables.series.first()
    assert (series["series_id"], series["series_title"], series["begin_year"]) == (
        "SUUR0000AA0", "", 1913)
    # The first file wins; a short row has no footnotes; a blank value is missing.
    assert values(tables.observation) == {
        ("SUUR0000AA0", 1913, "M01"): (9.8, ()),
        ("SUUR0000AA0", 1913, "M02"): (None, ("D", "E")),
        ("SUUR0000AA0", 1914, "M01"): (10.1, ()),
    }


def test_first_row_of_a_file_wins_and_last_code_wins(spark, tmp_path):
    (tmp_path / "o").write_text("Series ID\tYEAR\tperiod\tvalue\nA\t2000\tM01\t1\nA\t2000\tM01\t2\n")
    only = flatfiles.read_observation_files(spark, str(tmp_path), ["o"])
    assert values(only) == {("A", 2000, "M01"): (1.0, ())}
    (tmp_path / "a").write_text("area_code\tarea_name\n1\told\n1\tnew\n")
    assert flatfiles.read_dimension(spark, f"{tmp_path}/a", "area").first()["area_name"] == "new"


def test_files_in_one_scan(spark, tmp_path):
    """The place in the list decides, however the files are split or named; folders count as files."""
    head = "series_id\tyear\tperiod\tvalue\tfootnote_codes\n"
    names = ["cu.data.1.All", "cu.data.11.US", "a b%c", "cu.data.1"]
    for i, name in enumerate(names):
        text = "".join(f"S{k}\t2000\tM01\t{i}.5\tA\n" for k in range(i * 2, 9))
        if i == 3:
            (tmp_path / name).mkdir()
            (tmp_path / name / "part-0.csv").write_text(head + text)
            (tmp_path / name / "part-1.csv").write_text(head + "S99\t2000\tM01\t7\t\nS0\t2000\tM01\t8\t\n")
        else:
            (tmp_path / name).write_text(head + text)
    for order in (names, names[::-1]):
        for same in (True, False):
            found = flatfiles.read_observation_files(spark, str(tmp_path), order, same_header=same)
            want = {f"S{k}": min((order.index(n), f"{i}.5") for i, n in enumerate(names) if k >= i * 2)[1] for k in range(9)}
            if order[0] == "cu.data.1":
                want["S0"] = "8"
            assert {r["series_id"]: float(r["value"]) for r in found.collect()} == {
                **{k: float(v) for k, v in want.items()}, "S99": 7.0}
            plan = found.select("*")._jdf.queryExecution().executedPlan().toString()
            assert plan.count("FileScan csv") == (1 if same else len(names))


def test_files_with_other_columns_fail_or_are_read_apart(spark, tmp_path):
    (tmp_path / "a").write_text("series_id\tyear\tperiod\tvalue\nA\t2000\tM01\t1\n")
    (tmp_path / "b").write_text("value\tseries_id\tyear\tperiod\n3\tB\t2000\tM01\n")
    with pytest.raises(Exception, match="header"):
        flatfiles.read_observation_files(spark, str(tmp_path), ["a", "b"]).collect()
    apart = flatfiles.read_observation_files(spark, str(tmp_path), ["a", "b"], same_header=False)
    assert values(apart) == {("A", 2000, "M01"): (1.0, ()), ("B", 2000, "M01"): (3.0, ())}


def test_absent_columns_and_bad_values(spark, tmp_path):
    (tmp_path / "i").write_text("item_code\titem_name\nAA\tx\n")
    assert tuple(flatfiles.read_dimension(spark, f"{tmp_path}/i", "item").first()) == (
        "AA", "x", 0, False, 0)
    (tmp_path / "blank").write_text("item_code\titem_name\tdisplay_level\nAA\tx\t\n")
    with pytest.raises(Exception, match="not an integer"):
        flatfiles.read_dimension(spark, f"{tmp_path}/blank", "item").collect()
    (tmp_path / "none").write_text("area_code\n1\n")
    with pytest.raises(ValueError):
        flatfiles.read_dimension(spark, f"{tmp_path}/none", "area")
    (tmp_path / "o").write_text(
        "series_id\tyear\tperiod\tvalue\nA\t2000\tM01\t-\nA\t2000\tM02\t3\nA\tx\tM03\t3\n")
    with pytest.raises(Exception, match="not a"):
        flatfiles.read_observations(spark, f"{tmp_path}/o").collect()
    good, rejects = flatfiles.read_observations_permissive(spark, f"{tmp_path}/o")
    assert good.count() == 1 and {r["period"] for r in rejects.collect()} == {"M01", "M03"}


@pytest.fixture
def tables(spark):
    return make_tables(
        spark, [series_row("S000", "AA0")], [("AA0", "Item", 0, True, 1)],
        [("S000", 2020, "M01", "1.23", ["A"]), ("S000", 2020, "M02", None, None),
         ("S000", 2021, "M01", "2.5", None)])


def test_store_round_trip_and_truncate(spark, tables, path):
    store = Store(spark, f"{path}/store")
    store.ensure_schema()
    assert store.read().observation.count() == 0
    for _ in range(2):
        store.load(tables)
        assert values(store.read().observation) == values(tables.observation)
    with pytest.raises(ValueError, match="already"):
        store.load(tables, truncate=False)


def parts_of(path):
    """Modification times of the written files, by their folder below the table."""
    root = pathlib.Path(f"{path}/store/observation")
    return {str(p.parent.relative_to(root)): p.name for p in root.glob("year=*/period=*/part-*")}


def test_append_adds_files(spark, tables, path):
    store = Store(spark, f"{path}/store")
    store.load(tables)
    before = parts_of(path)
    none = {n: t.filter(F.lit(False)) for n, t in tables.items()}
    more = replace(tables, **{**none, "observation": frame(
        spark, "observation", [("S000", 2021, "M02", "7", None)])})
    store.load(more, truncate=False)
    after = parts_of(path)
    assert set(after) - set(before) == {"year=2021/period=M02"}
    assert {k: after[k] for k in before} == before
    assert len(values(store.read().observation)) == 4


def test_repeated_keys_and_broken_references_fail_and_change_nothing(spark, tables, path):
    store = Store(spark, f"{path}/store")
    store.load(tables)
    kept = parts_of(path)
    doubled = replace(tables, observation=tables.observation.union(tables.observation))
    with pytest.raises(ValueError, match="more than once"):
        store.load(doubled)
    with pytest.raises(ValueError, match="more than once"):
        store.upsert_observations(doubled.observation)
    with pytest.raises(Exception, match="without a month"):
        store.upsert_observations(tables.observation.withColumn("period", F.lit("")))
    with pytest.raises(ValueError, match="more than once"):
        store.load(replace(tables, area=tables.area.union(tables.area)))
    stray = frame(spark, "observation", [("NONE", 2020, "M01", "1", None)])
    with pytest.raises(ValueError, match="missing parents"):
        store.load(replace(tables, observation=stray))
    with pytest.raises(ValueError, match="missing parents"):
        store.upsert_observations(stray)
    assert parts_of(path) == kept
    assert values(store.read().observation) == values(tables.observation)


def test_upsert_rewrites_only_touched_months(spark, tables, path):
    store = Store(spark, f"{path}/store")
    store.load(tables)
    before = parts_of(path)
    change = frame(spark, "observation", [("S000", 2021, "M01", "9", []),
                                          ("S000", 2021, "M03", "4", ["P"])])
    for _ in range(2):  # repeating an upsert changes nothing
        store.upsert_observations(change)
        assert values(store.read().observation) == {
            ("S000", 2020, "M01"): (1.23, ("A",)),
            ("S000", 2020, "M02"): (None, ()),
            ("S000", 2021, "M01"): (9.0, ()),
            ("S000", 2021, "M03"): (4.0, ("P",)),
        }
    after = parts_of(path)
    changed = {k for k in after if after[k] != before.get(k)}
    assert changed == {"year=2021/period=M01", "year=2021/period=M03"}
    assert store.read().observation.filter("year = 2021 AND period = 'M01'").first()[
        "footnotes"] is None
    store.upsert_observations(change.filter(F.lit(False)))
    assert parts_of(path) == after


def test_a_replaced_store_has_nothing_left_of_the_old_one(spark, tables, path):
    store = Store(spark, f"{path}/store")
    store.load(tables)
    other = make_tables(spark, [series_row("S7", "BB")], [("BB", "Other", 1, True, 1)],
                        [("S7", 2020, "M02", "8", None), ("S7", 2030, "M01", "9", None)])
    none = {n: t.filter(F.lit(False)) for n, t in tables.items()}
    store.load(replace(other, footnote=none["footnote"]))
    left = store.read()
    assert values(left.observation) == {("S7", 2020, "M02"): (8.0, ()), ("S7", 2030, "M01"): (9.0, ())}
    assert left.footnote.count() == 0 and [r["item_code"] for r in left.item.collect()] == ["BB"]
    plan = left.observation.filter("year = 2030").select("*")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year" in plan


def test_load_reads_its_source_once(spark, tables, path):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    for truncate, rows in ((True, tables.observation), (False, frame(
            spark, "observation", [("S000", 2022, "M01", "7", None)]))):
        before, n = seen.value, rows.count()
        # Ordering by range samples its input, so the rows are put behind a shuffle.
        source = rows.mapInArrow(counted, rows.schema).repartition(2)
        none = {n: t.filter(F.lit(False)) for n, t in tables.items()}
        load = replace(tables if truncate else replace(tables, **none), observation=source)
        Store(spark, f"{path}/store").load(load, truncate=truncate)
        assert seen.value - before == n


def test_delete_cascades(spark, path):
    ids = [f"S{i:03d}" for i in range(12)]
    full = make_tables(spark, [series_row(i, "AA0") for i in ids], [("AA0", "Item", 0, True, 1)],
                       [(i, y, "M01", "1", None) for i in ids for y in (2020, 2021)]
                       + [("S001", 2022, "M05", "3", None)])
    store = Store(spark, f"{path}/store")
    store.load(full)
    wanted = values(store.read().observation)
    before = parts_of(path)
    store.delete(store.read().series.filter("series_id = 'none'"))
    assert parts_of(path) == before
    store.delete(store.read().series.filter("series_id < 'S006'"))
    left = store.read()
    assert {r["series_id"] for r in left.series.collect()} == set(ids[6:])
    assert values(left.observation) == {k: v for k, v in wanted.items() if k[0] >= "S006"}
    store.delete(left.series)
    assert store.read().observation.count() == 0 and store.read().series.count() == 0


def test_sync_and_merge(spark, tables, path):
    store = Store(spark, f"{path}/store")
    store.load(tables)
    renamed = replace(tables, item=tables.item.withColumn("item_name", F.lit("New")),
                      observation=tables.observation.filter(F.lit(False)))
    store.sync_metadata(renamed)
    assert store.read().item.first()["item_name"] == "New"
    assert store.read().observation.count() == 3
    extra = frame(spark, "observation", [("S000", 2022, "M01", "3", None)])
    store.merge(replace(tables, observation=extra))
    assert store.read().observation.count() == 4
    assert store.read().item.first()["item_name"] == "Item"


def test_snapshot_round_trip(spark, tables, path):
    snapshot.write_snapshot(tables, f"{path}/snap")
    back = snapshot.read_snapshot(spark, f"{path}/snap")
    for name, table in tables.items():
        assert back.get(name).schema.simpleString() == table.schema.simpleString()
        assert sorted(map(str, back.get(name).collect())) == sorted(map(str, table.collect()))


def test_duplicate_policies(spark):
    rows = spark.createDataFrame([("k", 1, "a"), ("k", 2, "b"), ("k", 3, None), ("m", 1, "c")],
                                 "key string, n int, v string")
    assert dict(dedup.first_wins(rows, ["key"], ["n"]).collect()) == {"k": "a", "m": "c"}
    assert dict(dedup.last_wins(rows, ["key"], ["n"]).collect()) == {"k": None, "m": "c"}


def test_copies_are_folded_before_the_shuffle(spark):
    rows = spark.range(9000).selectExpr("if(id % 3 = 0, 0, id) AS key", "id AS n", "id * 2 AS v")
    picked = dedup.first_wins(rows, ["key"], ["n"])
    plan = picked._jdf.queryExecution().executedPlan().toString()
    assert "partial_min_by" in plan
    assert picked.filter("key = 0").first()["v"] == 0


def test_jobs_and_refresh(spark, folder, path, tmp_path_factory):
    root = f"{tmp_path_factory.mktemp('s')}/store"
    store = jobs.load_full(spark, folder, root, files=list(FILES)[-2:])
    assert store.read().observation.count() == 3
    landing = pathlib.Path(tmp_path_factory.mktemp("landing"))
    checkpoint = f"{tmp_path_factory.mktemp('c')}/offsets"
    header = "series_id      \tyear\tperiod\t   value\tfootnote_codes\n"
    (landing / "1.tsv").write_text(header + "SUUR0000AA0\t1913\tM01\t11\t\n\t\t\t\t\n")
    refresh_from_landing(spark, str(landing), root, checkpoint)
    (landing / "2.tsv").write_text(header + "SUUR0000AA0\t1913\tM01\t12\tD\n"
                                   "SUUR0000AA0\t1915\tM01\t13\t\n")
    refresh_from_landing(spark, str(landing), root, checkpoint)
    found = values(store.read().observation)
    assert found[("SUUR0000AA0", 1913, "M01")] == (12.0, ("D",))
    assert found[("SUUR0000AA0", 1915, "M01")] == (13.0, ()) and len(found) == 4
    (landing / "3.tsv").write_text("series_id\tperiod\tyear\tvalue\tfootnote_codes\n"
                                   "SUUR0000AA0\t1913\tM01\t12\tD\n")
    with pytest.raises(Exception):  # columns in another order
        refresh_from_landing(spark, str(landing), root, checkpoint)
    jobs.update_current(spark, folder, root)
    assert values(store.read().observation)[("SUUR0000AA0", 1913, "M01")] == (9.8, ())
    with pytest.raises(ValueError):
        jobs.load_tables(spark, "database", root, current_only=True)
    with pytest.raises(ValueError):
        jobs.load_tables(spark, "flatfiles", root, files=["x"], current_only=True)


def test_cli_store_commands(spark, folder, tmp_path_factory, capsys):
    root = f"{tmp_path_factory.mktemp('s')}/store"
    cli.main(["ensure-schema", "--store", root])
    cli.main(["load-full", "--folder", folder, "--store", root, "--data-file",
              "cu.data.0.Current"])
    cli.main(["sync-metadata", "--folder", folder, "--store", root])
    assert "observation|   2" in capsys.readouterr().out.replace("| ", "|", 0)

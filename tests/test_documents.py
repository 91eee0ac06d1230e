"""One-document JSON: scans by byte ranges against json.loads, and documents written by many tasks."""

import json
import random

import pytest
from pyspark.sql import functions as F

from priceshape.sources import exports, snapshot
from priceshape.sources.documents import Section, read_objects, write_document
from tests.conftest import make_tables, series_row

BITS = ["a", "{", "}", '"', "\\", "]", "[", ": [", '"x": [', "é", "\n", "}}", '{"b": 1}', '\\"', "中"]


def some_object(rng, i):
    made = {"i": i, "s": "".join(rng.choice(BITS) for _ in range(rng.randrange(9)))}
    if rng.random() < 0.3:
        made["n"] = {"k": ["}", {"z": rng.choice(BITS)}], "m": []}
    if rng.random() < 0.2:
        made["footnotes"] = ["A", "{"]
    return made


@pytest.fixture
def small_splits(spark):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(n) for n in names]
    for name, value in zip(names, ("300b", "0"), strict=True):
        spark.conf.set(name, value)
    yield
    for name, value in zip(names, before, strict=True):
        spark.conf.set(name, value)


@pytest.fixture
def many_parts(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def sections(frame):
    found = {}
    for r in frame.orderBy("place").collect():
        found.setdefault(r["section"], []).append(json.loads(r["object"]))
    return found


@pytest.mark.parametrize("indent", [None, 2])
def test_ranges_of_a_document(spark, tmp_path, small_splits, indent):
    rng = random.Random(7)
    document = {"when": 'a{b " }', "areas": [some_object(rng, i) for i in range(7)], "none": [], "void": [],
                "object": {"a": 1}, "series": [some_object(rng, i) for i in range(60)], "nil": None, "last": []}
    path = tmp_path / "snapshot.json"
    path.write_text(json.dumps(document, indent=indent, ensure_ascii=False), encoding="utf-8")
    assert spark.read.option("lineSep", "}").text(str(path)).rdd.getNumPartitions() > 10
    assert sections(read_objects(spark, str(path))) == {k: document[k] for k in ("areas", "series")}


@pytest.mark.parametrize("text", ["", "{}", '{"a": 1}', '{"a": []}', ' {"a": [], "b": {"c": [1]}} \n'])
def test_documents_without_objects(spark, tmp_path, text):
    (tmp_path / "d").write_text(text)
    assert read_objects(spark, str(tmp_path / "d")).count() == 0


def test_written_documents(spark, tmp_path, many_parts):
    """Many tasks write it; put together it is JSON; copies of a row, also of the first, all stay."""
    rows = spark.range(3000).selectExpr("(id * 7919) % 3000 div 3 AS no", "concat('x}\\\"{', id % 5) AS t", "id % 2 AS _hidden")
    rows = rows.unionByName(rows.filter("no = 0")).repartition(6)
    none = rows.limit(0)
    fields = spark.sql("SELECT 'a\"b' AS title, cast(NULL AS int) AS empty, map('k', 'v') AS locks")
    path = str(tmp_path / "d")
    write_document(path, [Section("void", none, F.col("no"), F.col("t")), Section("rows", rows, F.col("no"), F.col("t")),
                          Section("end", none, F.lit(0), F.lit(""))], fields)
    parts = sorted((tmp_path / "d").glob("part-*"))
    document = json.loads("".join(p.read_text() for p in parts))
    assert list(document) == ["title", "empty", "locks", "void", "rows", "end"]
    assert (document["title"], document["empty"], document["locks"], document["void"], document["end"]) == (
        'a"b', None, {"k": "v"}, [], [])
    want = sorted(((r["no"], r["t"]) for r in rows.collect()))
    assert [(o["no"], o["t"]) for o in document["rows"]] == want and len(parts) > 1
    assert [tuple(o.values()) for o in sections(read_objects(spark, path))["rows"]] == want


def test_document_snapshot(spark, tmp_path, small_splits):
    tables = make_tables(
        spark, [series_row("S1", title='a "}{" b'), series_row("S2")], [("AA", "Item, {x}", 1, True, 1)],
        [("S1", 2024, "M09", "100.25", ["A", "P"]), ("S1", 2025, "M09", None, None), ("S2", 2024, "M01", "0.000001", [])])
    path = str(tmp_path / "d")
    snapshot.write_document_snapshot(tables, path)
    whole = json.loads("".join(p.read_text() for p in sorted((tmp_path / "d").glob("part-*"))))
    assert list(whole) == ["areas", "items", "periods", "footnotes", "series", "observations"]
    assert whole["areas"] == [{"code": "0000", "name": "area 0000"}]
    assert whole["observations"][0] == {"series_id": "S1", "year": 2024, "period": "M09", "value": "100.250000", "footnotes": ["A", "P"]}
    (tmp_path / "one.json").write_text(json.dumps(whole, indent=2))
    for source in (path, str(tmp_path / "one.json")):
        back = snapshot.read_document_snapshot(spark, source)
        for name, table in tables.items():
            if name != "observation":
                assert sorted(map(tuple, back.get(name).collect())) == sorted(map(tuple, table.collect())), name
        assert {(r["series_id"], r["year"]): (r["value"] and str(r["value"]), r["footnotes"]) for r in back.observation.collect()} == {
            ("S1", 2024): ("100.250000", ["A", "P"]), ("S1", 2025): (None, []), ("S2", 2024): ("0.000001", [])}


def test_document_snapshot_of_other_writers(spark, tmp_path):
    """Footnotes as text, a repeated code, a missing title; a wrong type fails."""
    document = {"areas": [{"code": "1", "name": "old"}, {"code": "1", "name": "new"}], "items": [], "periods": [], "footnotes": [],
                "series": [{"series_id": "S", "begin_year": 2000}],
                "observations": [{"series_id": "S", "year": 2000, "period": "M01", "value": "NaN", "footnotes": "A,B"}]}
    path = tmp_path / "d.json"
    path.write_text(json.dumps(document))
    back = snapshot.read_document_snapshot(spark, str(path))
    assert back.area.first()["area_name"] == "new" and back.area.count() == 1 and back.item.count() == 0
    assert back.series.first()["series_title"] == "" and back.series.first()["end_year"] is None
    assert tuple(back.observation.first()) == ("S", 2000, "M01", None, ["A", "B"])
    document["observations"][0]["year"] = "x"
    path.write_text(json.dumps(document))
    with pytest.raises(Exception, match="(?i)malformed|parse"):
        snapshot.read_document_snapshot(spark, str(path)).observation.collect()


def test_csv_with_one_header(spark, tmp_path, many_parts):
    rows = spark.range(500).selectExpr("date_format(date_add(date'2000-01-01', cast(id AS int) * 31), 'yyyy-MM') AS date",
                                       "id AS n", "if(id % 3 = 0, NULL, 'a,\"b') AS t").repartition(5)
    for one in (True, False):
        path = tmp_path / f"csv{one}"
        exports.write_csv(rows, str(path), [F.col("date").desc(), "n"], one_header=one)
        parts = sorted(path.glob("part-*"))
        text = "".join(p.read_text() for p in parts)
        assert text.count("date,n,t") == (1 if one else len(parts)) and text.startswith("date,n,t")
        back = exports.read_csv_report(spark, str(path), rows.schema)
        assert sorted((r["n"], r["t"]) for r in back.collect() if r["t"]) == sorted((r["n"], r["t"]) for r in rows.collect() if r["t"])
        assert back.count() == 500 and back.filter("date IS NULL").count() == 0
    dates = [line.split(",")[0] for line in text.splitlines()[1:] if not line.startswith("date")]
    assert dates == sorted(dates, reverse=True)
    exports.write_csv(rows.limit(0), str(tmp_path / "none"), ["n"], one_header=True)
    assert exports.read_csv_report(spark, str(tmp_path / "none"), rows.schema).count() == 0

import pathlib
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))

from priceshape import schemas  # noqa: E402
from priceshape.schemas import SCHEMAS, Tables  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]").appName("tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def path(tmp_path):
    return str(tmp_path)


def frame(spark, name, rows):
    schema = SCHEMAS[name]
    if name == "observation":
        text = [
            (s, y, p, None if v is None else str(v), f) for s, y, p, v, f in rows
        ]
        fields = [
            schemas.T.StructField(f.name, schemas.T.StringType() if f.name == "value"
                                  else f.dataType)
            for f in schema.fields
        ]
        raw = spark.createDataFrame(text, schemas.T.StructType(fields))
        return raw.withColumn("value", raw["value"].cast(schemas.VALUE_TYPE))
    return spark.createDataFrame(rows, schema)


def series_row(series_id, item="AA", area="0000", seasonal="U", base="SA0", title=""):
    return (series_id, title, area, item, seasonal, "R", base, "1982-84=100",
            2020, "M01", 2025, "M09")


def make_tables(spark, series, items, observations):
    areas = sorted({s[2] for s in series})
    return Tables(
        area=frame(spark, "area", [(a, f"area {a}") for a in areas]),
        item=frame(spark, "item", items),
        period=frame(spark, "period", [("M09", "SEP", "September")]),
        footnote=frame(spark, "footnote", [("A", "note")]),
        series=frame(spark, "series", series),
        observation=frame(spark, "observation", observations),
    )


@pytest.fixture
def tiny(spark):
    """One series that grew by five percent."""
    return make_tables(
        spark,
        [series_row("S1")],
        [("AA", "Item AA", 1, True, 1)],
        [("S1", 2024, "M09", "100.0", None), ("S1", 2025, "M09", "105.0", None)],
    )


@pytest.fixture
def two_series(spark):
    return make_tables(
        spark,
        [series_row("S1", "AA", "1111", "U", "BA0"), series_row("S2", "BB", "2222", "S", "BA0")],
        [("AA", "Item AA", 1, True, 1), ("BB", "Item BB", 2, True, 2)],
        [("S1", 2024, "M09", "100", None), ("S1", 2025, "M09", "105", None),
         ("S2", 2024, "M09", "200", None), ("S2", 2025, "M09", "210", None)],
    )

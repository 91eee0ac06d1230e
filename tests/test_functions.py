"""Column functions over parametrised tables, each table in one query."""

import datetime

import pytest
from pyspark.sql import functions as F

from priceshape.functions import fields, periods


def apply(spark, values, function, schema="v string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, {schema}")
    return [r[0] for r in df.orderBy("i").select(function(F.col("v"))).collect()]


def test_to_bool(spark):
    yes = ["T", "t", "True", "true", "1", "Y", "y", " T "]
    no = ["F", "f", "False", "false", "0", "N", "n", "", None]
    assert apply(spark, yes + no, fields.to_bool) == [True] * len(yes) + [False] * len(no)


def test_footnotes(spark):
    texts = ["", " ", "A", " A ", "A,B", "A , B", "A B", None]
    expected = [[], [], ["A"], ["A"], ["A", "B"], ["A", "B"], ["A", "B"], []]
    assert apply(spark, texts, fields.footnote_list) == expected


def test_decimal(spark):
    texts = ["1.23", " 1.23 ", "", " ", "-", "NaN"]
    values = apply(spark, texts, fields.to_value)
    assert [None if v is None else float(v) for v in values] == [1.23, 1.23, None, None, None, None]
    assert apply(spark, texts, fields.is_bad_value) == [False] * 4 + [True, False]


def test_strict_value_raises(spark):
    with pytest.raises(Exception, match="not a number"):
        apply(spark, ["1.0", "-"], fields.strict_value)


def test_strict_int_raises_on_blank(spark):
    with pytest.raises(Exception, match="not an integer"):
        apply(spark, [" "], lambda c: fields.strict_int(c, "year"))


def test_percent_text_rounds_the_binary_value(spark):
    values = [0.12345, 1.0, 0.0, 0.00125, 0.01005, None]
    expected = [f"{v * 100:.2f}%" if v is not None else None for v in values]
    assert apply(spark, values, fields.percent_text, "v double") == expected
    assert expected[:3] == ["12.35%", "100.00%", "0.00%"] or expected[0] == "12.34%"


def test_percent_number(spark):
    assert apply(spark, ["2.58%", "-1.00%", "n/a", None], fields.percent_number) == [
        2.58, -1.0, None, None]


def test_is_annual(spark):
    codes = ["M13", "m13", "R13", "r13", "M01", "S01"]
    assert apply(spark, codes, periods.is_annual) == [True] * 4 + [False] * 2


def test_period_rank(spark):
    codes = ["M01", " m12 ", "M13", "S03", "Q05", "M", "Mx", ""]
    assert apply(spark, codes, periods.period_rank) == [1, 12, 13, 3, 5, 0, 0, 0]


def test_period_date(spark):
    codes = ["M01", "M12", "M13", "Q01", "Q04", "Q05", "S01", "S02", "S03", "m05", "X"]
    got = apply(spark, codes, lambda c: periods.period_date(F.lit(2001), c))
    assert got == [datetime.date(2001, m, d) for m, d in [
        (1, 1), (12, 1), (12, 31), (1, 1), (10, 1), (1, 1), (1, 1), (7, 1), (12, 31), (1, 1),
        (1, 1)]]


def test_period_label(spark):
    got = apply(spark, ["M06", "m6", "M13", "S01"], lambda c: periods.period_label(F.lit(2024), c))
    assert got == ["2024-06", "2024-06", "2024-13", "2024-S01"]


def test_month_sequence(spark):
    rows = periods.month_sequence(spark, "2006-11", "2007-02").orderBy("date").collect()
    assert [tuple(r) for r in rows] == [
        (2006, "M11", "2006-11"), (2006, "M12", "2006-12"),
        (2007, "M01", "2007-01"), (2007, "M02", "2007-02")]
    with pytest.raises(ValueError):
        periods.month_sequence(spark, "2007-02", "2006-11")


@pytest.mark.parametrize("text", ["2024", "2024-13", "24-01", "2024-01-01", "x"])
def test_parse_month_rejects(text):
    with pytest.raises(ValueError):
        periods.parse_month(text)


def test_series_id_parts(spark):
    df = spark.createDataFrame([("CUSR0000SA0",)], "v string")
    row = df.select([c.alias(n) for n, c in fields.series_id_parts(F.col("v")).items()]).first()
    assert tuple(row) == ("CU", "S", "R", "0000", "SA0")

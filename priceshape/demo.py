"""Price observations derived from retail sales tables.

A series is a region and a brand, an observation the average unit price of a month. The tables have
the same shape as survey data, so every operator and report can run on them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from priceshape.schemas import SCHEMAS, VALUE_TYPE, Tables
from priceshape.scratch import pin

# The period codes of the survey and their names.
PERIODS = [
    ("M01", "JAN", "January"), ("M02", "FEB", "February"), ("M03", "MAR", "March"),
    ("M04", "APR", "April"), ("M05", "MAY", "May"), ("M06", "JUN", "June"),
    ("M07", "JUL", "July"), ("M08", "AUG", "August"), ("M09", "SEP", "September"),
    ("M10", "OCT", "October"), ("M11", "NOV", "November"), ("M12", "DEC", "December"),
    ("M13", "AN AV", "Annual Average"),
]


def monthly_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """region key and name, brand, brand number, year, month, price rounded to three decimals."""

    def table(name: str) -> DataFrame:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")

    sales = (
        table("lineitem")
        .select("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")
        .join(table("part").select("p_partkey", "p_brand"), F.expr("l_partkey = p_partkey"))
        .join(table("supplier").select("s_suppkey", "s_nationkey"),
              F.expr("l_suppkey = s_suppkey"))
        .join(table("nation").select("n_nationkey", "n_regionkey"),
              F.expr("s_nationkey = n_nationkey"))
        .join(table("region"), F.expr("n_regionkey = r_regionkey"))
    )
    # Decimal sums do not depend on the order of the rows.
    price = """cast(sum(cast(l_extendedprice AS decimal(18,2))) AS double)
        / cast(sum(cast(l_quantity AS decimal(18,2))) AS double)"""
    return (
        sales.groupBy(
            "r_regionkey",
            "r_name",
            "p_brand",
            F.year("l_shipdate").alias("year"),
            F.month("l_shipdate").alias("month"),
        )
        .agg(F.expr(price).alias("raw"))
        .selectExpr(
            "r_regionkey", "r_name", "p_brand", "cast(substring(p_brand, 7) AS int) AS brand_no",
            "year", "month", "floor(raw * 1000D + 0.5D) / 1000D AS price",
        )
    )


def retail_tables(spark: SparkSession, sf_dir: str) -> Tables:
    """The six tables; series of brands divisible by three also have annual averages."""
    prices = pin(
        monthly_prices(spark, sf_dir).selectExpr(
            "*",
            """concat('CU', if(brand_no % 2 = 0, 'S', 'U'), 'R',
               lpad(cast(r_regionkey AS string), 4, '0'), p_brand) AS series_id""",
        ),
        "prices",
    )
    area = prices.selectExpr(
        "lpad(cast(r_regionkey AS string), 4, '0') AS area_code", "r_name AS area_name"
    ).distinct()
    item = prices.selectExpr(
        "p_brand AS item_code",
        "concat('Goods of ', p_brand) AS item_name",
        "brand_no % 4 AS display_level",
        "brand_no % 5 <> 0 AS selectable",
        "brand_no AS sort_sequence",
    ).distinct()
    series = (
        prices.groupBy("series_id", "r_regionkey", "r_name", "p_brand", "brand_no")
        .agg(
            F.expr("min(struct(year, month))").alias("first"),
            F.expr("max(struct(year, month))").alias("last"),
        )
        .selectExpr(
            "series_id",
            "concat(p_brand, ' in ', r_name) AS series_title",
            "lpad(cast(r_regionkey AS string), 4, '0') AS area_code",
            "p_brand AS item_code",
            "if(brand_no % 2 = 0, 'S', 'U') AS seasonal",
            "'R' AS periodicity_code",
            "if(brand_no % 7 = 0, 'A', 'S') AS base_code",
            "if(brand_no % 2 = 0, '1982-84=100', 'DECEMBER 1997=100') AS base_period",
            "first.year AS begin_year",
            "concat('M', lpad(cast(first.month AS string), 2, '0')) AS begin_period",
            "last.year AS end_year",
            "concat('M', lpad(cast(last.month AS string), 2, '0')) AS end_period",
        )
    )
    monthly = prices.selectExpr(
        "series_id",
        "year",
        "concat('M', lpad(cast(month AS string), 2, '0')) AS period",
        "cast(price AS decimal(18,6)) AS value",
        """CASE WHEN month = 12 THEN array('A', 'P') WHEN month = 1 THEN array('A') END
           AS footnotes""",
    )
    annual = (
        prices.filter("brand_no % 3 = 0")
        .groupBy("series_id", "year")
        .agg(F.expr("cast(sum(cast(price AS decimal(18,6))) AS double) / count(1)").alias("mean"))
        .select(
            "series_id",
            "year",
            F.lit("M13").alias("period"),
            F.expr("floor(mean * 1000D + 0.5D) / 1000D").cast(VALUE_TYPE).alias("value"),
            F.lit(None).cast("array<string>").alias("footnotes"),
        )
    )
    footnote = (
        monthly.selectExpr("explode(footnotes) AS footnote_code")
        .distinct()
        .selectExpr(
            "footnote_code",
            "if(footnote_code = 'A', 'Turn of the year', 'Preliminary') AS footnote_text",
        )
    )
    names = spark.createDataFrame(PERIODS, SCHEMAS["period"])
    observation = monthly.unionByName(annual)
    period = names.join(
        observation.select(F.col("period").alias("period_code")).distinct(),
        "period_code",
        "left_semi",
    )
    return Tables(area, item, period, footnote, series, observation)

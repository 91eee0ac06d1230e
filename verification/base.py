"""Registry of checked queries and the SQL fragments their oracles share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from priceshape.demo import retail_tables
from priceshape.schemas import Tables
from priceshape.scratch import scratch_path
from priceshape.sources.store import Store

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

_stores: dict[tuple[str, str], Store] = {}


def check(name: str, sql: str | None) -> Callable[[Query], Query]:
    """Register a query under ``name`` together with its DuckDB equivalent."""

    def register(query: Query) -> Query:
        QUERIES[name] = query
        if sql is not None:
            ORACLES[name] = sql
        return query

    return register


def store(spark: SparkSession, sf_dir: str) -> Store:
    """Store loaded from the given tables, once per application."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _stores:
        built = Store(spark, scratch_path(spark, "store"))
        built.load(retail_tables(spark, sf_dir))
        _stores[key] = built
    return _stores[key]


def prices(spark: SparkSession, sf_dir: str) -> Tables:
    return store(spark, sf_dir).read()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, columns: list[str], scale: str = "1e6") -> DataFrame:
    return df.withColumns(
        {c: F.expr(f"floor({c} * {scale} + 0.5D) / {scale}") for c in columns}
    )


def r(expression: str, scale: str = "1e6") -> str:
    """The same rounding in SQL."""
    return f"(floor(({expression})::DOUBLE * {scale} + 0.5) / {scale})"


# The derived price tables of priceshape.demo.
_PRICE_TABLES = """
sales AS (
  SELECT r_regionkey, r_name, p_brand, CAST(substr(p_brand, 7) AS INTEGER) AS brand_no,
         CAST(year(l_shipdate) AS INTEGER) AS year, CAST(month(l_shipdate) AS INTEGER) AS month,
         CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE)
           / CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS raw
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
       JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  GROUP BY ALL),
prices AS (
  SELECT *, floor(raw * 1000 + 0.5) / 1000 AS price,
         'CU' || CASE WHEN brand_no % 2 = 0 THEN 'S' ELSE 'U' END || 'R'
           || lpad(CAST(r_regionkey AS VARCHAR), 4, '0') || p_brand AS series_id,
         lpad(CAST(r_regionkey AS VARCHAR), 4, '0') AS area_code
  FROM sales),
area AS (SELECT DISTINCT area_code, r_name AS area_name FROM prices),
item AS (
  SELECT DISTINCT p_brand AS item_code, 'Goods of ' || p_brand AS item_name,
         brand_no % 4 AS display_level, brand_no % 5 <> 0 AS selectable, brand_no AS sort_sequence
  FROM prices),
series AS (
  SELECT series_id, p_brand || ' in ' || r_name AS series_title, area_code, p_brand AS item_code,
         CASE WHEN brand_no % 2 = 0 THEN 'S' ELSE 'U' END AS seasonal, 'R' AS periodicity_code,
         CASE WHEN brand_no % 7 = 0 THEN 'A' ELSE 'S' END AS base_code,
         CASE WHEN brand_no % 2 = 0 THEN '1982-84=100' ELSE 'DECEMBER 1997=100' END AS base_period,
         CAST(min(year * 100 + month) // 100 AS INTEGER) AS begin_year,
         'M' || lpad(CAST(min(year * 100 + month) % 100 AS VARCHAR), 2, '0') AS begin_period,
         CAST(max(year * 100 + month) // 100 AS INTEGER) AS end_year,
         'M' || lpad(CAST(max(year * 100 + month) % 100 AS VARCHAR), 2, '0') AS end_period
  FROM prices GROUP BY series_id, p_brand, r_name, area_code, brand_no),
observation AS (
  SELECT series_id, year, 'M' || lpad(CAST(month AS VARCHAR), 2, '0') AS period,
         CAST(price AS DECIMAL(18,6)) AS value,
         CASE month WHEN 12 THEN 'A,P' WHEN 1 THEN 'A' END AS footnotes
  FROM prices
  UNION ALL
  SELECT series_id, year, 'M13',
         CAST(floor(CAST(sum(CAST(price AS DECIMAL(18,6))) AS DOUBLE) / count(*) * 1000 + 0.5)
           / 1000 AS DECIMAL(18,6)), NULL
  FROM prices WHERE brand_no % 3 = 0 GROUP BY series_id, year)"""

_GROWTH_TABLES = """,
pair AS (
  SELECT c.series_id, c.year, c.period, c.value, p.value AS previous
  FROM observation c JOIN observation p
    ON p.series_id = c.series_id AND p.year = c.year - 1 AND p.period = c.period),
growth AS (
  SELECT pair.series_id, item_code, item_name, display_level, selectable, series_title, area_code,
         seasonal, base_code, pair.year, pair.period,
         CAST(value - previous AS DOUBLE) / CAST(previous AS DOUBLE) AS x
  FROM pair JOIN series USING (series_id) JOIN item USING (item_code) WHERE previous <> 0),
latest AS (
  SELECT series_id, max(year * 100 + CAST(substr(period, 2) AS INTEGER)) AS k
  FROM observation GROUP BY series_id),
latest_growth AS (
  SELECT growth.* FROM growth JOIN latest USING (series_id)
  WHERE year * 100 + CAST(substr(period, 2) AS INTEGER) = k)"""


def price_sql(body: str) -> str:
    return f"WITH {_PRICE_TABLES.strip()}\n{body}"


def growth_sql(body: str) -> str:
    """``body`` may start with further CTEs: ``, name AS (...) SELECT ...``."""
    return f"WITH {_PRICE_TABLES.strip()}{_GROWTH_TABLES}\n{body}"


STAT_COLUMNS = [
    "weighted_mean", "weighted_median", "trimmed_mean", "weighted_std", "weighted_skewness",
    "weighted_kurtosis", "weighted_kde_bandwidth", "weighted_kde_mode", "effective_sample_size",
]


def stat_tables(keys: str, grid: int = 2048, trim: str = "0.08", bandwidth: str | None = None,
                order: str = "o") -> str:
    """CTEs that turn ``sample`` (keys, x, w, o) into ``stat``, by the plain definitions:
    window over the whole group for the ranks, every grid point against every value for the mode."""
    def quantile(q: str) -> str:
        return f"""coalesce(max(CASE WHEN pc <= {q} * sw AND {q} * sw < c
            THEN px + ({q} * sw - pc) / (c - pc) * (x - px) END),
            max(CASE WHEN c <= {q} * sw THEN x END), min(x))"""

    def clip(p: str) -> str:
        return f"least(greatest({p}, {trim} * sw), (1 - {trim}) * sw)"

    keep = f"({clip('c')} - {clip('pc')})"
    rule = """CASE WHEN std = 0 THEN 0 ELSE 0.9 * CASE WHEN q75 - q25 <= 0 THEN std
        ELSE least(std, (q75 - q25) / 1.34) END * pow(ess, -0.2) END"""
    return f""",
s0 AS (SELECT *, sum(w) OVER (PARTITION BY {keys}) AS sw,
        sum(w * x) OVER (PARTITION BY {keys}) / sum(w) OVER (PARTITION BY {keys}) AS m,
        sum(w) OVER (PARTITION BY {keys} ORDER BY x, {order}
          ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS c FROM sample),
s1 AS (SELECT *, coalesce(lag(c) OVER (PARTITION BY {keys} ORDER BY x, {order}), 0) AS pc,
        coalesce(lag(x) OVER (PARTITION BY {keys} ORDER BY x, {order}), x) AS px FROM s0),
s2 AS (SELECT {keys}, count(*) AS n, any_value(sw) AS sw, any_value(m) AS mean, min(x) AS lo,
        max(x) AS hi, min(CASE WHEN w > 0 THEN x END) AS plo, max(CASE WHEN w > 0 THEN x END) AS phi,
        sum(w * pow(x - m, 2)) / any_value(sw) AS v2, sum(w * pow(x - m, 3)) / any_value(sw) AS v3,
        sum(w * pow(x - m, 4)) / any_value(sw) AS v4, pow(sum(w), 2) / sum(w * w) AS ess,
        {quantile('0.25')} AS q25, {quantile('0.5')} AS q50, {quantile('0.75')} AS q75,
        sum({keep} * x) / sum({keep}) AS trimmed
  FROM s1 GROUP BY {keys}),
s3 AS (SELECT *, CASE WHEN plo = phi OR v2 <= 0 THEN 0 ELSE sqrt(v2) END AS std,
        CASE WHEN plo = phi OR v2 <= 0 THEN 0 ELSE v3 / pow(v2, 1.5) END AS skew,
        CASE WHEN plo = phi OR v2 <= 0 THEN 0 ELSE v4 / pow(v2, 2) - 3 END AS kurt FROM s2),
s4 AS (SELECT *, {bandwidth or rule} AS h FROM s3),
merged AS (SELECT {keys}, x, sum(w) AS w FROM sample WHERE w > 0 GROUP BY {keys}, x),
grid AS (SELECT {keys}, i, h, sw, lo - 3 * h + i * ((hi + 3 * h - (lo - 3 * h)) / {grid - 1}) AS g
  FROM s4, generate_series(0, {grid - 1}) AS t(i) WHERE h > 0),
dens AS (SELECT {keys}, i, any_value(g) AS g,
        sum(w / sw * exp(-0.5 * pow((g - x) / h, 2))) / any_value(h) / sqrt(2 * pi()) AS d
  FROM grid JOIN merged USING ({keys}) GROUP BY {keys}, i),
peak AS (SELECT {keys}, min(g) AS mode FROM (
    SELECT *, max(d) OVER (PARTITION BY {keys}) AS top FROM dens) WHERE d >= top * (1 - 1e-12)
  GROUP BY {keys}),
stat AS (SELECT {', '.join(f's4.{k.strip()}' for k in keys.split(','))}, n, sw, lo, hi, std, q25, q75, h,
        mean AS weighted_mean, q50 AS weighted_median, trimmed AS trimmed_mean,
        std AS weighted_std, skew AS weighted_skewness, kurt AS weighted_kurtosis,
        h AS weighted_kde_bandwidth, coalesce(mode, plo) AS weighted_kde_mode,
        ess AS effective_sample_size, v2
  FROM s4 LEFT JOIN peak USING ({keys}))"""


def stat_select(columns: list[str] = STAT_COLUMNS, scale: str = "1e6") -> str:
    return ", ".join(f"{r(c, scale)} AS {c}" for c in columns)

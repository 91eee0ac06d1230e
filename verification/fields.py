"""Checked queries: column functions, filters, joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from priceshape.functions import fields as ff
from priceshape.functions import periods as pf
from priceshape.operators import filters, growth
from priceshape.operators.growth import growth_components, growth_ratio
from priceshape.plans import reports, views
from priceshape.schemas import KEYS
from verification.base import check, growth_sql, price_sql, prices, r, rounded, table


def counted(df, *columns):
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("rows"))


@check(
    "f1_strip",
    """SELECT trim(p_name) AS name, CAST(length(p_name) AS INTEGER) AS size, p_partkey FROM part""",
)
def strip(spark, sf_dir):
    padded = table(spark, sf_dir, "part").selectExpr(
        "p_partkey", "concat(' \\t', p_name, ' \\n ') AS text")
    return padded.select(
        ff.strip(F.col("text")).alias("name"),
        F.length(ff.strip(F.col("text"))).alias("size"),
        "p_partkey",
    )


_FLAG_TEXT = """CASE {n} % 8 WHEN 0 THEN ' t ' WHEN 1 THEN 'True' WHEN 2 THEN '1' WHEN 3 THEN 'y'
    WHEN 4 THEN 'F' WHEN 5 THEN 'no' WHEN 6 THEN '' ELSE '0' END"""


@check(
    "f2_to_bool",
    f"""SELECT text, upper(trim(text)) IN ('T', 'TRUE', '1', 'Y') AS flag, count(*) AS rows
      FROM (SELECT {_FLAG_TEXT.format(n='event_id')} AS text FROM events) GROUP BY ALL""",
)
def to_bool(spark, sf_dir):
    text = table(spark, sf_dir, "events").selectExpr(f"{_FLAG_TEXT.format(n='event_id')} AS text")
    return counted(text, "text", ff.to_bool(F.col("text")).alias("flag"))


_CODES = """CASE l_linenumber % 4 WHEN 0 THEN '' WHEN 1 THEN {a}
    WHEN 2 THEN {b} ELSE {c} END"""
_CODES_SQL = _CODES.format(
    a="l_returnflag", b="' ' || l_returnflag || ' , ' || l_linestatus || ' '",
    c="l_returnflag || ' ' || l_linestatus")


@check(
    "f3_footnote_list",
    f"""SELECT text, count(*) AS rows,
        CAST(any_value(CASE WHEN trim(text) = '' THEN 0
          WHEN regexp_matches(trim(text), '[, ]') THEN 2 ELSE 1 END) AS INTEGER) AS codes,
        any_value(regexp_replace(trim(text), '[, ]+', '|', 'g')) AS listed
      FROM (SELECT {_CODES_SQL} AS text FROM lineitem) GROUP BY text""",
)
def footnote_list(spark, sf_dir):
    codes = ff.footnote_list(F.col("text"))
    return counted(
        table(spark, sf_dir, "lineitem").selectExpr(f"{_CODES_SQL} AS text"),
        "text", F.size(codes).alias("codes"), F.array_join(codes, "|").alias("listed"),
    )


_VALUE_TEXT = """CASE WHEN l_linenumber % 5 = 0 THEN ' ' WHEN l_linenumber % 5 = 1 THEN '-'
    ELSE ' ' || CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS {string}) END"""


@check(
    "f4_decimal_parse",
    f"""SELECT text, CAST(TRY_CAST(nullif(trim(text), '') AS DECIMAL(18,6)) AS DOUBLE) AS value,
        trim(text) = '-' AS bad, count(*) AS rows
      FROM (SELECT {_VALUE_TEXT.format(string='VARCHAR')} AS text FROM lineitem) GROUP BY ALL""",
)
def decimal_parse(spark, sf_dir):
    text = table(spark, sf_dir, "lineitem").selectExpr(
        f"{_VALUE_TEXT.format(string='string')} AS text")
    return counted(text, "text", ff.to_value(F.col("text")).cast("double").alias("value"),
                   ff.is_bad_value(F.col("text")).alias("bad"))


# Period codes of every kind, derived from order dates.
_ANY_CODE = """CASE o_orderkey % 9 WHEN 0 THEN 'M13' WHEN 1 THEN ' m' || {month} || ' '
    WHEN 2 THEN 'S0' || {half} WHEN 3 THEN 'Q0' || {quarter} WHEN 4 THEN 'S03' WHEN 5 THEN 'Q05'
    WHEN 6 THEN 'R13' WHEN 7 THEN 'Mx' ELSE 'M' || {month} END"""
_SPARK_CODE = _ANY_CODE.format(
    month="lpad(cast(month(o_orderdate) AS string), 2, '0')",
    half="cast(if(month(o_orderdate) > 6, 2, 1) AS string)",
    quarter="cast(quarter(o_orderdate) AS string)",
)
_DUCK_CODE = _ANY_CODE.format(
    month="lpad(CAST(month(o_orderdate) AS VARCHAR), 2, '0')",
    half="CASE WHEN month(o_orderdate) > 6 THEN '2' ELSE '1' END",
    quarter="CAST(quarter(o_orderdate) AS VARCHAR)",
)
CODES_SQL = (f"codes AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS year, {_DUCK_CODE} AS period, "
             "count(*) AS rows FROM orders GROUP BY ALL)")
RANK_SQL = """CASE WHEN regexp_matches(upper(trim(period)), '^.[0-9]+$')
    THEN CAST(substr(trim(period), 2) AS INTEGER) ELSE 0 END"""


def codes(spark, sf_dir):
    return counted(table(spark, sf_dir, "orders"), F.year("o_orderdate").alias("year"),
                   F.expr(_SPARK_CODE).alias("period"))


def code_columns():
    return F.col("year"), F.col("period")


@check("f5_normalize_period",
       f"WITH {CODES_SQL} SELECT *, upper(trim(period)) AS code FROM codes")
def normalize_period(spark, sf_dir):
    _, period = code_columns()
    return codes(spark, sf_dir).withColumn("code", pf.normalize_period(period))


@check("f6_period_rank",
       f"WITH {CODES_SQL} SELECT *, CAST({RANK_SQL} AS INTEGER) AS rank FROM codes")
def period_rank(spark, sf_dir):
    _, period = code_columns()
    return codes(spark, sf_dir).withColumn("rank", pf.period_rank(period))


@check(
    "f7_period_sort_key",
    f"""WITH {CODES_SQL} SELECT year, period, CAST({RANK_SQL} AS INTEGER) AS rank,
      upper(trim(period)) AS code,
      year = (SELECT max(year) FROM codes) AND {RANK_SQL} = (SELECT max({RANK_SQL}) FROM codes
        WHERE year = (SELECT max(year) FROM codes)) AS last_rank FROM codes""",
)
def period_sort_key(spark, sf_dir):
    year, period = code_columns()
    keyed = codes(spark, sf_dir).withColumn("key", pf.period_sort_key(year, period))
    last = keyed.agg(F.max("key").alias("last"))
    # The right side is one row.
    joined = keyed.withColumn("_one", F.lit(0)).join(last.withColumn("_one", F.lit(0)), "_one")
    return joined.selectExpr(
        "year", "period", "key.rank AS rank", "key.code AS code",
        "key.year = last.year AND key.rank = last.rank AS last_rank")


@check(
    "f8_period_date",
    f"""WITH {CODES_SQL} SELECT year, period, rows, CAST(CASE
        WHEN regexp_matches(period, '^M(0[1-9]|1[0-2])$')
          THEN make_date(year, CAST(substr(period, 2, 2) AS INTEGER), 1)
        WHEN period IN ('M13', 'S03') THEN make_date(year, 12, 31)
        WHEN regexp_matches(period, '^Q0[1-4]$')
          THEN make_date(year, (CAST(substr(period, 2, 2) AS INTEGER) - 1) * 3 + 1, 1)
        WHEN period = 'S02' THEN make_date(year, 7, 1)
        ELSE make_date(year, 1, 1) END AS VARCHAR) AS date FROM codes""",
)
def period_date(spark, sf_dir):
    year, period = code_columns()
    return codes(spark, sf_dir).withColumn("date", pf.period_date(year, period).cast("string"))


@check(
    "f9_month_date",
    f"""WITH {CODES_SQL} SELECT year, period, rows,
        CAST(make_date(year, CAST(right(period, 2) AS INTEGER), 1) AS VARCHAR) AS date
      FROM codes WHERE regexp_matches(period, '^M(0[1-9]|1[0-2])$')""",
)
def month_date(spark, sf_dir):
    year, period = code_columns()
    dated = codes(spark, sf_dir).withColumn("date", pf.month_date(year, period).cast("string"))
    return dated.filter("date IS NOT NULL")


@check(
    "f10_period_label",
    f"""WITH {CODES_SQL} SELECT *, CASE WHEN regexp_matches(upper(trim(period)), '^M[0-9]+$')
      THEN year || '-' || lpad(CAST(CAST(substr(trim(period), 2) AS INTEGER) AS VARCHAR), 2, '0')
      ELSE year || '-' || upper(trim(period)) END AS label FROM codes""",
)
def period_label(spark, sf_dir):
    year, period = code_columns()
    return codes(spark, sf_dir).withColumn("label", pf.period_label(year, period))


@check(
    "f11_parse_month",
    """SELECT CAST(year(o_orderdate) AS INTEGER) AS year, strftime(o_orderdate, '%Y-%m-01') AS date,
         count(*) AS rows FROM orders WHERE o_orderdate >= DATE '1996-03-01'
         AND o_orderdate < DATE '1999-08-01' GROUP BY ALL""",
)
def parse_month(spark, sf_dir):
    start, end = pf.parse_month("1996-03")[2], pf.parse_month("1999-08")[2]
    orders = table(spark, sf_dir, "orders").filter(
        (F.col("o_orderdate") >= F.lit(start)) & (F.col("o_orderdate") < F.lit(end)))
    text = F.date_format("o_orderdate", "yyyy-MM")
    return counted(orders, F.year("o_orderdate").alias("year"),
                   F.to_date(text, "yyyy-MM").cast("string").alias("date"))


@check(
    "f12_month_sequence",
    """SELECT CAST(year(m) AS INTEGER) AS year, 'M' || strftime(m, '%m') AS period,
         strftime(m, '%Y-%m') AS date, coalesce(n, 0) AS shipped
       FROM generate_series(DATE '1994-06-01', DATE '2002-03-01', INTERVAL 1 MONTH) AS g(m)
       LEFT JOIN (SELECT date_trunc('month', l_shipdate) AS d, count(*) AS n FROM lineitem
         GROUP BY ALL) ON d = m""",
)
def month_sequence(spark, sf_dir):
    shipped = table(spark, sf_dir, "lineitem").groupBy(
        F.date_format("l_shipdate", "yyyy-MM").alias("date")).agg(F.count(F.lit(1)).alias("n"))
    months = pf.month_sequence(spark, "1994-06", "2002-03")
    return months.join(shipped, "date", "left").select(
        "year", "period", "date", F.coalesce("n", F.lit(0)).alias("shipped"))


@check("f13_is_annual", f"""WITH {CODES_SQL} SELECT *,
    regexp_matches(upper(period), '^(M13|R13)') AS annual FROM codes""")
def is_annual(spark, sf_dir):
    _, period = code_columns()
    return codes(spark, sf_dir).withColumn("annual", pf.is_annual(period))


@check("f14_is_seasonally_adjusted",
       price_sql("SELECT series_id, seasonal = 'S' AS adjusted FROM series"))
def is_seasonally_adjusted(spark, sf_dir):
    return prices(spark, sf_dir).series.select(
        "series_id", ff.is_seasonally_adjusted(F.lower("seasonal")).alias("adjusted"))


@check(
    "f15_growth_ratio",
    f"""SELECT a.l_orderkey, a.l_linenumber,
        {r("CASE WHEN a.l_discount <> 0 THEN CAST(CAST(b.l_discount AS DECIMAL(18,6)) - CAST(a.l_discount AS DECIMAL(18,6)) AS DOUBLE) / a.l_discount END")} AS ratio
      FROM lineitem a JOIN lineitem b
        ON a.l_orderkey = b.l_orderkey AND a.l_linenumber + 1 = b.l_linenumber
      WHERE a.l_discount <> 0""",
)
def ratio(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber", "cast(l_discount AS decimal(18,6)) AS v")
    following = line.selectExpr("l_orderkey", "l_linenumber - 1 AS l_linenumber", "v AS next")
    joined = line.join(following, ["l_orderkey", "l_linenumber"])
    ratios = joined.select(
        "l_orderkey", "l_linenumber", growth_ratio(F.col("next"), F.col("v")).alias("ratio"))
    return rounded(ratios.filter("ratio IS NOT NULL"), ["ratio"])


@check(
    "f16_percent_text",
    """SELECT l_discount AS fraction, printf('%.2f%%', l_discount * 100) AS text, count(*) AS rows
       FROM lineitem GROUP BY ALL
       UNION ALL SELECT value / 1000, printf('%.2f%%', value / 1000 * 100), count(*)
       FROM events GROUP BY ALL""",
)
def percent_text(spark, sf_dir):
    discounts = counted(table(spark, sf_dir, "lineitem"), F.col("l_discount").alias("fraction"))
    values = counted(table(spark, sf_dir, "events"), F.expr("value / 1000D").alias("fraction"))
    return discounts.unionByName(values).select(
        "fraction", ff.percent_text("fraction").alias("text"), "rows")


@check(
    "f17_percent_number",
    """SELECT text, TRY_CAST(rtrim(text, '%') AS DOUBLE) AS number, count(*) AS rows
       FROM (SELECT CASE WHEN event_id % 11 = 0 THEN 'n/a'
         ELSE CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR) || '%' END AS text FROM events)
       GROUP BY ALL""",
)
def percent_number(spark, sf_dir):
    text = table(spark, sf_dir, "events").selectExpr(
        "if(event_id % 11 = 0, 'n/a', concat(cast(cast(value AS decimal(18,2)) AS string), '%')) "
        "AS text")
    return counted(text, "text", ff.percent_number(F.col("text")).alias("number"))


@check("f19_item_code_length",
       "SELECT CAST(length(p_brand) AS INTEGER) AS size, count(*) AS rows FROM part GROUP BY ALL")
def item_code_length(spark, sf_dir):
    padded = table(spark, sf_dir, "part").selectExpr("concat(' ', p_brand, '  ') AS code")
    return counted(padded, ff.item_code_length(F.col("code")).alias("size"))


@check(
    "f20_series_id_parts",
    price_sql("""SELECT series_id, 'CU' AS survey, seasonal, periodicity_code, area_code, item_code,
      true AS consistent FROM series"""),
)
def series_id_parts(spark, sf_dir):
    parts = ff.series_id_parts(F.col("series_id"))
    same = F.lit(True)
    for name in ("seasonal", "periodicity_code", "area_code", "item_code"):
        same = same & (parts[name] == F.col(name))
    return prices(spark, sf_dir).series.select(
        "series_id", *[c.alias(n) for n, c in parts.items()], same.alias("consistent"))


# Filters


@check("p1_selectable_only", price_sql("SELECT * FROM item WHERE selectable"))
def selectable_only(spark, sf_dir):
    return filters.selectable_items(prices(spark, sf_dir).item)


@check("p2_series_locks", price_sql("""SELECT * FROM series WHERE area_code = '0002'
    AND seasonal = 'U' AND base_period = 'DECEMBER 1997=100' AND periodicity_code = 'R'"""))
def series_locks(spark, sf_dir):
    locks = filters.parse_locks(
        ["area=0002", " Seasonality = u ", "base_period=december 1997=100", "periodicity=r", ""])
    return filters.apply_locks(prices(spark, sf_dir).series, locks)


COMPONENT_SQL = f"""SELECT series_id, item_code, item_name, display_level, series_title,
  {r('x')} AS value, year, period FROM """


@check("p3_target_period", growth_sql(
    COMPONENT_SQL + "growth WHERE selectable AND year = 2000 AND period = 'M06'"))
def target_period(spark, sf_dir):
    found = growth_components(prices(spark, sf_dir), months=("2000-06", "2000-06"))
    return rounded(found, ["value"])


@check("p4_month_range", growth_sql(COMPONENT_SQL + """growth WHERE selectable
    AND period <> 'M13' AND year || substr(period, 2) BETWEEN '199811' AND '200002'"""))
def month_range(spark, sf_dir):
    found = growth_components(prices(spark, sf_dir), months=("1998-11", "2000-02"))
    return rounded(found, ["value"])


@check(
    "p5_sample_guard",
    """SELECT l_shipdate::DATE::VARCHAR AS day, count(*) AS rows FROM lineitem
       GROUP BY ALL HAVING count(*) >= 25""",
)
def sample_guard(spark, sf_dir):
    days = table(spark, sf_dir, "lineitem").select(
        F.to_date("l_shipdate").cast("string").alias("day"))
    return counted(filters.sample_guard(days, ["day"], 25, skip=True), "day")


@check(
    "p5_sample_warnings",
    """SELECT 'group' AS scope, l_shipdate::DATE::VARCHAR AS label, count(*) AS sample_size,
         25 AS min_sample_size FROM lineitem GROUP BY ALL HAVING count(*) < 25""",
)
def sample_warnings(spark, sf_dir):
    days = table(spark, sf_dir, "lineitem").select(
        F.to_date("l_shipdate").cast("string").alias("day"))
    return filters.sample_warnings(counted(days, "day"), "group", ["day"], "rows", 25)


VIEW_SQL = """SELECT series_id AS id, item_name AS name, CAST(CASE WHEN period = 'M13'
    THEN make_date(year, 12, 31) ELSE make_date(year, CAST(substr(period, 2) AS INTEGER), 1) END
    AS VARCHAR) AS date, CAST(value AS DOUBLE) AS value
  FROM observation JOIN series USING (series_id) JOIN item USING (item_code)"""


def plain_view(df):
    return df.select("id", "name", F.col("date").cast("string").alias("date"),
                     F.col("value").cast("double").alias("value"))


@check("p6_view_filter", price_sql(VIEW_SQL + " WHERE length(item_code) = 7"))
def view_filter(spark, sf_dir):
    view = views.series_view(prices(spark, sf_dir), code_length=7, selectable_only=False)
    return plain_view(view)


NATIONAL_SQL = """SELECT series_id, item_code, area_code, year, period, CAST(value AS DOUBLE)
  AS value FROM observation JOIN series USING (series_id)
  WHERE area_code = '0000' AND seasonal = 'U' AND periodicity_code = 'R'"""


@check("p7_national_slice", price_sql(NATIONAL_SQL))
def national_slice(spark, sf_dir):
    return views.national_slice(prices(spark, sf_dir)).withColumn(
        "value", F.col("value").cast("double"))


@check("p8_missing_dimension_rows", growth_sql(COMPONENT_SQL + """growth WHERE year = 2000
    AND period <> 'M13' AND item_code NOT LIKE '%3' AND area_code <> '0004'"""))
def missing_dimension_rows(spark, sf_dir):
    from dataclasses import replace

    tables = prices(spark, sf_dir)
    partial = replace(
        tables,
        item=tables.item.filter("item_code NOT LIKE '%3'"),
        series=tables.series.filter("area_code <> '0004'"),
    )
    found = growth_components(partial, months=("2000-01", "2000-12"), selectable_only=False)
    return rounded(found, ["value"])


# Joins


@check("j1_observation_series", price_sql("""SELECT area_code, seasonal, count(*) AS rows,
    CAST(sum(value) AS DOUBLE) AS total FROM observation JOIN series USING (series_id)
    GROUP BY ALL"""))
def observation_series(spark, sf_dir):
    tables = prices(spark, sf_dir)
    return tables.observation.join(tables.series, "series_id").groupBy(
        "area_code", "seasonal").agg(
            F.count(F.lit(1)).alias("rows"), F.sum("value").cast("double").alias("total"))


@check("j2_series_item", price_sql("""SELECT series_id, item_code, item_name, display_level,
    series_title FROM series JOIN item USING (item_code)"""))
def series_item(spark, sf_dir):
    return growth.component_series(prices(spark, sf_dir), selectable_only=False)


@check("j3_year_over_year", growth_sql("""SELECT series_id, year, period,
    CAST(value AS DOUBLE) AS value, CAST(previous AS DOUBLE) AS previous FROM pair"""))
def year_over_year(spark, sf_dir):
    return growth.yoy_pairs(prices(spark, sf_dir).observation).filter(
        "previous IS NOT NULL").selectExpr(
            "series_id", "year", "period", "cast(value AS double) AS value",
            "cast(previous AS double) AS previous")


@check("j4_series_detail_view", price_sql(VIEW_SQL))
def series_detail_view(spark, sf_dir):
    detail = views.series_details(prices(spark, sf_dir))
    return plain_view(detail.withColumnsRenamed({"series_id": "id", "item_name": "name"}))


@check("j5_using_join", price_sql("""SELECT series_id, count(*) AS rows, CAST(max(value) AS DOUBLE)
    AS highest FROM series JOIN observation USING (series_id) GROUP BY ALL"""))
def using_join(spark, sf_dir):
    tables = prices(spark, sf_dir)
    return tables.series.join(tables.observation, on="series_id").groupBy("series_id").agg(
        F.count(F.lit(1)).alias("rows"), F.max("value").cast("double").alias("highest"))


@check(
    "j6_anti_and_semi",
    """SELECT CASE WHEN c_custkey IN (SELECT o_custkey FROM orders) THEN 'ordered' ELSE 'idle' END
         AS kind, count(*) AS customers FROM customer GROUP BY ALL""",
)
def anti_and_semi(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").selectExpr("c_custkey AS o_custkey")
    orders = table(spark, sf_dir, "orders").select("o_custkey")
    kept = customers.join(orders, "o_custkey", "left_semi").select(F.lit("ordered").alias("kind"))
    idle = customers.join(orders, "o_custkey", "left_anti").select(F.lit("idle").alias("kind"))
    return kept.unionByName(idle).groupBy("kind").agg(F.count(F.lit(1)).alias("customers"))


@check("j8_months_by_components", growth_sql("""SELECT year || '-' || substr(period, 2) AS date,
    count(*) AS components FROM growth WHERE selectable AND period <> 'M13'
    GROUP BY ALL"""))
def months_by_components(spark, sf_dir):
    found = growth_components(prices(spark, sf_dir), months=("1996-01", "2001-11"))
    months = pf.month_sequence(spark, "1996-01", "2001-11")
    return found.join(months, ["year", "period"]).groupBy("date").agg(
        F.count(F.lit(1)).alias("components"))


# Windows, orders


@check("w2_lag_twelve", price_sql(f"""SELECT series_id, year, period, {r('yoy')} AS yoy FROM (
    SELECT series_id, year, period, CAST(value AS DOUBLE) / CAST(lag(value, 12) OVER (
      PARTITION BY series_id ORDER BY year, period) AS DOUBLE) - 1 AS yoy FROM observation)
    WHERE yoy IS NOT NULL"""))
def lag_twelve(spark, sf_dir):
    lagged = growth.lagged_growth(prices(spark, sf_dir).observation).drop("value")
    return rounded(lagged.filter("yoy IS NOT NULL"), ["yoy"])


@check(
    "w3_keep_one_per_key",
    """SELECT l_partkey, l_suppkey, arg_min(l_extendedprice, (l_shipdate, l_orderkey, l_linenumber))
         AS first_price, arg_max(l_extendedprice, (l_shipdate, l_orderkey, l_linenumber))
         AS last_price FROM lineitem GROUP BY ALL""",
)
def keep_one_per_key(spark, sf_dir):
    from priceshape.operators.dedup import first_wins, last_wins

    keys, order = ["l_partkey", "l_suppkey"], ["l_shipdate", "l_orderkey", "l_linenumber"]
    rows = table(spark, sf_dir, "lineitem").select(*keys, *order, "l_extendedprice")
    first = first_wins(rows, keys, order).withColumnRenamed("l_extendedprice", "first_price")
    last = last_wins(rows, keys, order).withColumnRenamed("l_extendedprice", "last_price")
    return first.join(last, keys)


@check("w4_extreme_examples", growth_sql(f"""SELECT * FROM (
    SELECT CAST(display_level AS VARCHAR) AS label, series_id, {r('x')} AS value,
      row_number() OVER (PARTITION BY display_level ORDER BY abs(x) DESC, series_id) AS rank
    FROM latest_growth WHERE selectable) WHERE rank <= 5"""))
def extreme_examples(spark, sf_dir):
    found = growth_components(prices(spark, sf_dir)).withColumn(
        "label", reports.group_label("display-level"))
    best = reports.extreme_examples(found, ["label"]).select(
        "label", "series_id", "value", F.col("rank").cast("long").alias("rank"))
    return rounded(best, ["value"])


@check("s1_label_order", """SELECT label, number, count(*) AS rows FROM (
    SELECT length(p_name) || ' chars' AS label, CAST(length(p_name) AS INTEGER) AS number FROM part
    UNION ALL SELECT 'type ' || p_type || 'x9', 0 FROM part
    UNION ALL SELECT 'size ' || p_size || ' of 7', p_size FROM part) GROUP BY ALL""")
def label_order(spark, sf_dir):
    labels = table(spark, sf_dir, "part").selectExpr(
        "explode(array(concat(length(p_name), ' chars'), concat('type ', p_type, 'x9'), "
        "concat('size ', p_size, ' of 7'))) AS label")
    number, text = reports.label_order()
    return counted(labels, "label", number.alias("number")).orderBy(number, text)


@check("s2_key_order", price_sql("SELECT * FROM series"))
def key_order(spark, sf_dir):
    return prices(spark, sf_dir).series.orderBy(*KEYS["series"])


@check("s3_right_tail_rows", price_sql(f"""SELECT series_id, {r('yoy')} AS yoy FROM (
    SELECT series_id, year, period, CAST(value AS DOUBLE) / CAST(lag(value, 12) OVER (
      PARTITION BY series_id ORDER BY year, period) AS DOUBLE) - 1 AS yoy
    FROM observation JOIN series USING (series_id)) WHERE year = 2000 AND period = 'M06'
    ORDER BY yoy DESC NULLS LAST, series_id LIMIT 15"""))
def right_tail_rows(spark, sf_dir):
    lagged = growth.lagged_growth(prices(spark, sf_dir).observation)
    top = lagged.filter("year = 2000 AND period = 'M06' AND yoy IS NOT NULL").orderBy(
        F.col("yoy").desc(), "series_id").limit(15)
    return rounded(top.select("series_id", "yoy"), ["yoy"])


@check("s5_limit_sample", price_sql("""SELECT series_id, CAST(make_date(year, CAST(substr(period, 2) AS INTEGER), 1)
    AS VARCHAR) AS month_date, CAST(value AS DOUBLE) AS value FROM observation WHERE period <> 'M13' ORDER BY series_id, year, period LIMIT 5"""))
def limit_sample(spark, sf_dir):
    year, period = code_columns()
    return prices(spark, sf_dir).observation.filter("period <> 'M13'").orderBy(
        "series_id", "year", "period").limit(5).select(
        "series_id", pf.month_date(year, period).cast("string").alias("month_date"),
        F.col("value").cast("double").alias("value"))

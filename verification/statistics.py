"""Checked queries: distribution statistics on sales, orders and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from priceshape.functions.periods import latest_month_text
from priceshape.operators import growth
from priceshape.operators.kde import kde_curve, kde_mode
from priceshape.operators.moments import moments, normalized_weights
from priceshape.operators.quantiles import cut_statistics, linear_quantiles, quantiles
from priceshape.operators.samples import make_sample, value_order
from priceshape.operators.shape import axis_limits, histogram
from priceshape.operators.summary import describe, stat_summary
from priceshape.plans import reports
from verification.base import (
    STAT_COLUMNS,
    check,
    growth_sql,
    price_sql,
    prices,
    r,
    rounded,
    stat_select,
    stat_tables,
    table,
)

# Event values weighted by a small number that is sometimes zero; the event id breaks ties.
EVENT_SAMPLE = """WITH sample AS (SELECT event_type, value AS x, event_id AS o,
    CAST(user_id % 5 AS DOUBLE) AS w FROM events)"""
UNIT_SAMPLE = EVENT_SAMPLE.replace("CAST(user_id % 5 AS DOUBLE)", "1.0::DOUBLE")


def weighted_events(spark, sf_dir):
    events = table(spark, sf_dir, "events").selectExpr(
        "event_type", "value", "event_id", "cast(user_id % 5 AS double) AS weight")
    return make_sample(events, ["event_type"], "value", "weight", "event_id")


def unit_events(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return make_sample(events, ["event_type"], "value", order_col="event_id")


def event_sql(columns: dict[str, str], sample: str = EVENT_SAMPLE, **options) -> str:
    chosen = ", ".join(f"{r(e)} AS {n}" for n, e in columns.items())
    return f"{sample}{stat_tables('event_type', **options)} SELECT event_type, {chosen} FROM stat"


@check("a1_normalized_weights", """SELECT event_id, floor(user_id % 5 / sum(user_id % 5)
    OVER (PARTITION BY event_type) * 1e9 + 0.5) / 1e9 AS weight FROM events""")
def weights(spark, sf_dir):
    rows = normalized_weights(weighted_events(spark, sf_dir)).selectExpr(
        "_order AS event_id", "weight")
    return rounded(rows, ["weight"], "1e9")


def _moment(column: str, **options):
    def query(spark, sf_dir):
        found = moments(weighted_events(spark, sf_dir), **options)
        return rounded(found.select("event_type", column), [column])

    return query


check("a2_weighted_mean", event_sql({"mean": "weighted_mean"}))(_moment("mean"))
check("a3_weighted_variance", event_sql({"variance": "v2"}))(_moment("variance"))
check("a4_weighted_std", event_sql({"std": "std"}))(_moment("std"))
check("a5_weighted_skewness", event_sql({"skewness": "weighted_skewness"}))(_moment("skewness"))
check("a6_weighted_kurtosis", event_sql({"kurtosis": "weighted_kurtosis"}))(_moment("kurtosis"))
check("a6_plain_kurtosis", event_sql({"kurtosis": "weighted_kurtosis + 3"}))(
    _moment("kurtosis", fisher=False))
check("a10_effective_sample_size", event_sql({"ess": "effective_sample_size"}))(_moment("ess"))


@check("a7_weighted_quantile", event_sql({"q25": "q25", "q75": "q75"}))
def weighted_quantile(spark, sf_dir):
    found = quantiles(weighted_events(spark, sf_dir), {"q25": 0.25, "q75": 0.75})
    return rounded(found, ["q25", "q75"])


@check("a7_split_cells", event_sql({"q25": "q25", "q50": "weighted_median", "q75": "q75",
                                    "trimmed": "trimmed_mean"}))
def split_cells(spark, sf_dir):
    """The same statistics when a task may sort only a few rows, so that cells must be split."""
    found = quantiles(weighted_events(spark, sf_dir), {"q25": 0.25, "q50": 0.5, "q75": 0.75},
                      {"trimmed": 0.08}, task_rows=40)
    return rounded(found, ["q25", "q50", "q75", "trimmed"])


@check("a8_weighted_median", event_sql({"median": "weighted_median"}))
def weighted_median(spark, sf_dir):
    return rounded(quantiles(weighted_events(spark, sf_dir), {"median": 0.5}), ["median"])


@check("a9_weighted_trimmed_mean",
       event_sql({"trimmed": "trimmed_mean"}, trim="0.2"))
def weighted_trimmed_mean(spark, sf_dir):
    return rounded(quantiles(weighted_events(spark, sf_dir), {}, {"trimmed": 0.2}), ["trimmed"])


@check("a11_kde_bandwidth", event_sql({"h": "h"}))
def kde_bandwidth(spark, sf_dir):
    sample = weighted_events(spark, sf_dir)
    return rounded(sample.finish(describe(sample)).select("event_type", "h"), ["h"])


@check("a12_kde_mode", event_sql({"mode": "weighted_kde_mode"}))
def kde_mode_rule(spark, sf_dir):
    sample = weighted_events(spark, sf_dir)
    return rounded(kde_mode(sample, describe(sample)), ["mode"])


@check("a12_kde_mode_any_order", event_sql({"mode": "weighted_kde_mode"}))
def kde_mode_any_order(spark, sf_dir):
    """Sums of whole numbers: the mode of the same rows in any partitions."""
    sample = weighted_events(spark, sf_dir)
    return rounded(kde_mode(sample, describe(sample), reproducible=True), ["mode"])


@check("a12_kde_mode_fixed_bandwidth",
       event_sql({"mode": "weighted_kde_mode"}, grid=512, bandwidth="2.5"))
def kde_mode_fixed(spark, sf_dir):
    sample = weighted_events(spark, sf_dir)
    table_ = sample.facts.withColumn("h", F.lit(2.5))
    return rounded(kde_mode(sample, table_, grid_points=512), ["mode"])


@check("a12_kde_mode_zero_bandwidth", """SELECT event_type,
    arg_min(value, (-(user_id % 5), event_id)) AS mode FROM events GROUP BY ALL""")
def kde_mode_zero(spark, sf_dir):
    sample = weighted_events(spark, sf_dir)
    return kde_mode(sample, sample.facts.withColumn("h", F.lit(0.0)))


@check("a13_kde_curve", f"""{EVENT_SAMPLE}{stat_tables('event_type')}
    SELECT event_type, CAST(i AS INTEGER) AS i, {r('g')} AS grid_x, {r('d', '1e9')} AS density
    FROM dens""")
def curve(spark, sf_dir):
    sample = weighted_events(spark, sf_dir)
    found = kde_curve(sample, describe(sample))
    return rounded(rounded(found, ["grid_x"]), ["density"], "1e9")


@check("a13_kde_curve_zero_bandwidth", """WITH f AS (SELECT event_type, min(value) AS lo,
      max(value) AS hi, arg_min(value, (-(user_id % 5), event_id)) AS v FROM events GROUP BY ALL),
    g AS (SELECT *, lo + i * ((hi - lo) / 63) AS grid_x FROM f, generate_series(0, 63) AS t(i))
    SELECT event_type, CAST(i AS INTEGER) AS i, floor(grid_x * 1e6 + 0.5) / 1e6 AS grid_x,
      CASE WHEN i = first_value(i) OVER (PARTITION BY event_type ORDER BY abs(grid_x - v), i)
        THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS density FROM g""")
def curve_zero(spark, sf_dir):
    sample = weighted_events(spark, sf_dir)
    found = kde_curve(sample, sample.facts.withColumn("h", F.lit(0.0)), grid_points=64)
    return rounded(found, ["grid_x"])


@check("a13_kde_tails", f"""WITH f AS (SELECT o_orderpriority AS priority, min(o_totalprice) AS lo,
      max(o_totalprice) AS hi, sum(o_custkey % 4) AS sw FROM orders GROUP BY ALL),
    g AS (SELECT *, lo - 600 + i * ((hi + 600 - (lo - 600)) / 127) AS x FROM f, generate_series(0, 127) AS t(i)),
    e AS (SELECT priority, i, -0.5 * ((x - o_totalprice) / 200) ** 2 + ln((o_custkey % 4) / sw) AS e
      FROM g JOIN orders ON o_orderpriority = priority WHERE o_custkey % 4 > 0),
    m AS (SELECT *, max(e) OVER (PARTITION BY priority, i) AS most FROM e)
    SELECT priority, CAST(i AS INTEGER) AS i,
      {r('any_value(most) + ln(sum(exp(e - most))) - ln(200 * sqrt(2 * pi()))', '1e3')} AS log_density
    FROM m GROUP BY priority, i""")
def tails(spark, sf_dir):
    """Logarithms of densities whose grid points may be hundreds of bandwidths from all rows."""
    orders = table(spark, sf_dir, "orders")
    sample = make_sample(orders.withColumnRenamed("o_orderpriority", "priority"), ["priority"], "o_totalprice",
                         F.expr("o_custkey % 4"))
    found = kde_curve(sample, sample.facts.withColumn("h", F.lit(200.0)), grid_points=128, logarithm=True)
    return rounded(found.select("priority", "i", "log_density"), ["log_density"], "1e3")


@check("j7_grid_join", f"""{UNIT_SAMPLE}{stat_tables('event_type', grid=256)}
    SELECT event_type, CAST(i AS INTEGER) AS i, {r('d', '1e9')} AS density FROM dens""")
def grid_join(spark, sf_dir):
    sample = unit_events(spark, sf_dir)
    found = kde_curve(sample, describe(sample), grid_points=256)
    return rounded(found.drop("grid_x"), ["density"], "1e9")


@check("a14_summary_weighted", f"""{EVENT_SAMPLE}{stat_tables('event_type')}
    SELECT event_type, n AS count, {stat_select()} FROM stat""")
def summary_weighted(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("weight", F.expr("user_id % 5"))
    found = stat_summary(events, ["event_type"], "value", "weight", order_col="event_id")
    return rounded(found, STAT_COLUMNS)


@check("a14_summary_unit_weights", f"""{UNIT_SAMPLE}{stat_tables('event_type')}
    SELECT event_type, n AS count, {stat_select()} FROM stat""")
def summary_unit_weights(spark, sf_dir):
    found = stat_summary(table(spark, sf_dir, "events"), ["event_type"], "value")
    return rounded(found, STAT_COLUMNS)


@check("a14_summary_group_name", f"""{UNIT_SAMPLE}{stat_tables('event_type')}
    SELECT event_type AS "event type", n AS count, {stat_select()} FROM stat""")
def summary_group_name(spark, sf_dir):
    """A group column whose name is no plain identifier."""
    events = table(spark, sf_dir, "events").withColumnRenamed("event_type", "event type")
    return rounded(stat_summary(events, ["event type"], "value"), STAT_COLUMNS)


@check("a14_summary_ties",f"""WITH sample AS (SELECT l_returnflag, l_linestatus, l_discount AS x,
      1.0::DOUBLE AS w, l_orderkey * 100 + l_linenumber AS o FROM lineitem)
    {stat_tables('l_returnflag, l_linestatus')}
    SELECT l_returnflag, l_linestatus, n AS count, {stat_select()} FROM stat""")
def summary_ties(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    found = stat_summary(lines, ["l_returnflag", "l_linestatus"], "l_discount")
    return rounded(found, STAT_COLUMNS)


@check("a14_summary_ungrouped", f"""WITH sample AS (SELECT 0 AS k, o_totalprice / 1000 AS x,
      1.0::DOUBLE AS w, o_orderkey AS o FROM orders){stat_tables('k')}
    SELECT n AS count, {stat_select()} FROM stat""")
def summary_ungrouped(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return rounded(stat_summary(orders, [], F.expr("o_totalprice / 1000")), STAT_COLUMNS)


@check("a14_summary_constant_groups", f"""WITH sample AS (SELECT l_linenumber,
      CAST(l_linenumber AS DOUBLE) / 20 AS x, l_quantity AS w, l_orderkey * 100 + l_linenumber AS o
      FROM lineitem){stat_tables('l_linenumber')}
    SELECT l_linenumber, n AS count, {stat_select()} FROM stat""")
def summary_constant_groups(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").withColumn("x", F.expr("l_linenumber / 20D"))
    return rounded(stat_summary(lines, ["l_linenumber"], "x", "l_quantity"), STAT_COLUMNS)


@check("a15_histogram", f"""WITH f AS (SELECT event_type, min(value) AS lo, max(value) AS hi,
      sum(user_id % 5) AS sw FROM events GROUP BY ALL),
    b AS (SELECT event_type, least(CAST(floor((value - lo) / (hi - lo) * 30) AS INTEGER), 29) AS bin,
      sum(user_id % 5) AS w FROM events JOIN f USING (event_type) GROUP BY ALL)
    SELECT event_type, CAST(i AS INTEGER) AS bin, {r('lo + i * ((hi - lo) / 30)')} AS bin_low,
      {r('CASE WHEN i = 29 THEN hi ELSE lo + (i + 1) * ((hi - lo) / 30) END')} AS bin_high,
      {r('coalesce(w, 0) / sw', '1e9')} AS weight
    FROM (SELECT * FROM f, generate_series(0, 29) AS t(i)) AS g LEFT JOIN b
      ON b.event_type = g.event_type AND b.bin = g.i""".replace(
    "SELECT event_type, CAST(i", "SELECT g.event_type, CAST(i"))
def weighted_histogram(spark, sf_dir):
    found = histogram(weighted_events(spark, sf_dir))
    return rounded(rounded(found, ["bin_low", "bin_high"]), ["weight"], "1e9")


@check("a15_histogram_constant_groups", """SELECT l_linenumber, CAST(i AS INTEGER) AS bin,
      floor((l_linenumber - 0.5 + i / 4) * 1e6 + 0.5) / 1e6 AS bin_low,
      CASE WHEN i = 2 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS weight
    FROM (SELECT DISTINCT l_linenumber FROM lineitem), generate_series(0, 3) AS t(i)""")
def histogram_constant(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    found = histogram(make_sample(lines, ["l_linenumber"], "l_linenumber"), bins=4)
    return rounded(found.drop("bin_high"), ["bin_low"])


_AXIS = """, e AS (SELECT *, q1 - q0 AS span FROM q)
    SELECT {key}floor(greatest(q0 - span * 0.05, lo - span) * 1e6 + 0.5) / 1e6 AS axis_low,
      floor(least(q1 + span * 0.05, hi + span) * 1e6 + 0.5) / 1e6 AS axis_high FROM e"""


@check("a16_axis_limits", """WITH q AS (SELECT event_type, quantile_cont(value, 0.0025) AS q0,
    quantile_cont(value, 0.9975) AS q1, min(value) AS lo, max(value) AS hi
    FROM events GROUP BY ALL)""" + _AXIS.format(key="event_type, "))
def limits(spark, sf_dir):
    return rounded(axis_limits(unit_events(spark, sf_dir)), ["axis_low", "axis_high"])


@check("a16_axis_limits_ungrouped", """WITH q AS (SELECT quantile_cont(o_totalprice, 0.0025) AS q0,
    quantile_cont(o_totalprice, 0.9975) AS q1, min(o_totalprice) AS lo, max(o_totalprice) AS hi
    FROM orders)""" + _AXIS.format(key=""))
def limits_ungrouped(spark, sf_dir):
    sample = make_sample(table(spark, sf_dir, "orders"), [], "o_totalprice")
    return rounded(axis_limits(sample, task_rows=500), ["axis_low", "axis_high"])


@check("a16_linear_quantiles", """SELECT l_returnflag,
    floor(quantile_cont(l_extendedprice, 0.1) * 1e4 + 0.5) / 1e4 AS p10,
    floor(quantile_cont(l_extendedprice, 0.5) * 1e4 + 0.5) / 1e4 AS p50 FROM lineitem GROUP BY ALL""")
def linear(spark, sf_dir):
    sample = make_sample(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice")
    found = linear_quantiles(sample, {"p10": 0.1, "p50": 0.5}, task_rows=2000)
    return rounded(found, ["p10", "p50"], "1e4")


@check("w1_running_weight", """SELECT event_type, event_id, row_number() OVER v AS rank,
    CAST(sum(user_id % 5) OVER v AS DOUBLE) AS cum FROM events WINDOW v AS (
      PARTITION BY event_type ORDER BY value, event_id
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def running_weights(spark, sf_dir):
    return value_order(weighted_events(spark, sf_dir)).selectExpr(
        "event_type", "_order AS event_id", "rank", "cum")


@check("w1_weight_at_cut", """WITH c AS (SELECT event_type, value, sum(user_id % 5) OVER (
      PARTITION BY event_type ORDER BY value, event_id
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS c,
      sum(user_id % 5) OVER (PARTITION BY event_type) AS sw FROM events)
    SELECT event_type, CAST(min(CASE WHEN c > 0.5 * sw THEN c END) AS DOUBLE) AS reached,
      CAST(coalesce(max(CASE WHEN c <= 0.5 * sw THEN c END), 0) AS DOUBLE) AS before
    FROM c GROUP BY ALL""")
def running_weight(spark, sf_dir):
    """Running weight at the row that passes half of the weight, and before it."""
    half = "(0.5D * group_w)"
    passing = f"CASE WHEN prev_cum <= {half} AND {half} < cum THEN"
    return cut_statistics(
        weighted_events(spark, sf_dir), [half],
        {"reached": f"max({passing} cum END)", "before": f"max({passing} prev_cum END)"},
    )


@check("s4_value_order", """SELECT event_type, value, CAST(user_id % 5 AS DOUBLE) AS weight,
    row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) AS rank FROM events""")
def values_in_order(spark, sf_dir):
    return value_order(weighted_events(spark, sf_dir)).selectExpr(
        "event_type", "_x AS value", "_w AS weight", "rank")


# Grouping, counting, latest periods


@check("a17_display_level_groups", growth_sql("""SELECT CAST(display_level AS VARCHAR) AS label,
    count(*) AS count FROM latest_growth WHERE selectable GROUP BY ALL"""))
def display_level_groups(spark, sf_dir):
    found = growth.growth_components(prices(spark, sf_dir))
    return found.groupBy(reports.group_label("display-level").alias("label")).agg(
        F.count(F.lit(1)).alias("count"))


@check("a18_code_length_groups", growth_sql("""SELECT length(item_code) || ' chars' AS label,
    count(*) AS count FROM latest_growth WHERE selectable GROUP BY ALL"""))
def code_length_groups(spark, sf_dir):
    found = growth.growth_components(prices(spark, sf_dir))
    return found.groupBy(reports.group_label("item-code-length").alias("label")).agg(
        F.count(F.lit(1)).alias("count"))


@check("a19_volume_summary", price_sql("""SELECT 'series' AS table, count(*) AS rows FROM series
    UNION ALL SELECT 'observation', count(*) FROM observation
    UNION ALL SELECT 'area', count(*) FROM area UNION ALL SELECT 'item', count(*) FROM item"""))
def volume_summary(spark, sf_dir):
    return reports.volume_summary(prices(spark, sf_dir))


@check("a20_ordered_periods", price_sql("""SELECT DISTINCT year, period,
    CAST(substr(period, 2) AS INTEGER) AS rank FROM observation"""))
def ordered_periods(spark, sf_dir):
    return growth.ordered_periods(prices(spark, sf_dir).observation)


@check("a20_global_latest", price_sql("""SELECT year, period FROM observation
    ORDER BY year DESC, CAST(substr(period, 2) AS INTEGER) DESC LIMIT 1"""))
def global_latest(spark, sf_dir):
    return growth.global_latest(prices(spark, sf_dir).observation)


@check("a21_latest_per_series", price_sql("""SELECT series_id, CAST(k // 100 AS INTEGER) AS year,
    'M' || lpad(CAST(k % 100 AS VARCHAR), 2, '0') AS period FROM (SELECT series_id,
    max(year * 100 + CAST(substr(period, 2) AS INTEGER)) AS k FROM observation GROUP BY ALL)"""))
def latest_per_series(spark, sf_dir):
    return growth.latest_period(prices(spark, sf_dir).observation)


@check("a22_latest_month_text", price_sql("""SELECT CAST(substr(ym, 1, 4) AS INTEGER) AS year,
    'M' || substr(ym, 6, 2) AS period
    FROM (SELECT max(year || '-' || right(period, 2)) AS ym FROM observation)"""))
def latest_month(spark, sf_dir):
    return latest_month_text(prices(spark, sf_dir).observation)


@check("a23_chart_range", """SELECT floor((least(min(l_discount), min(l_tax), min(l_quantity))
    - 0.5) * 1e6 + 0.5) / 1e6 AS low, floor((greatest(max(l_discount), max(l_tax), max(l_quantity))
    + 0.5) * 1e6 + 0.5) / 1e6 AS high FROM lineitem""")
def chart_range(spark, sf_dir):
    found = reports.chart_range(
        table(spark, sf_dir, "lineitem"), ["l_discount", "l_tax", "l_quantity"], 0.5)
    return rounded(found, ["low", "high"])

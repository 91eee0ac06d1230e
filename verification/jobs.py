"""Checked queries: the user-level reports."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from priceshape.operators import growth
from priceshape.plans import reports, views
from priceshape.plans.panels import MonthlyReport
from priceshape.scratch import scratch_path
from priceshape.sources.store import Store
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
)
from verification.fields import COMPONENT_SQL, VIEW_SQL, plain_view

START, END = "1996-01", "2001-11"
DATE = "year || '-' || substr(period, 2)"
SERIES_ORDER = "series_id"


def sample(source: str, keys: str) -> str:
    return f", sample AS (SELECT {keys}, x, 1.0::DOUBLE AS w, series_id AS o FROM {source})"


@check("g1_growth_components", growth_sql(COMPONENT_SQL + "latest_growth WHERE selectable"))
def growth_components(spark, sf_dir):
    return rounded(growth.growth_components(prices(spark, sf_dir)), ["value"])


@check("g1_growth_components_locked", growth_sql(COMPONENT_SQL + """latest_growth
    WHERE area_code = '0000' AND seasonal = 'U'"""))
def growth_components_locked(spark, sf_dir):
    found = growth.growth_components(
        prices(spark, sf_dir), selectable_only=False,
        locks={"area_code": "0000", "seasonal": "u"})
    return rounded(found, ["value"])


def with_examples_sql(source: str, label: str) -> str:
    """Statistics of every label with its most extreme components as text."""
    return f""", best AS (SELECT label, string_agg(concat_ws('|', series_id, item_code, item_name, series_title,
          printf('%.4f', x), printf('%.2f%%', x * 100)), ',' ORDER BY rank) AS examples FROM (
        SELECT *, {label} AS label, row_number() OVER (
          PARTITION BY {label} ORDER BY abs(x) DESC, series_id) AS rank
        FROM {source}) WHERE rank <= 5 GROUP BY label)
    SELECT label, n AS count, {stat_select()}, examples FROM stat JOIN best USING (label)"""


def with_examples(groups):
    return rounded(groups.withColumn("examples", F.expr("""array_join(transform(examples, e -> concat_ws('|',
        e.series_id, e.item_code, e.item_name, e.series_title, format_string('%.4f', e.yoy), e.yoy_percent)), ',')""")),
        STAT_COLUMNS)


LEVEL = "CAST(display_level AS VARCHAR)"


@check("g2_group_summary", growth_sql(
    sample("latest_growth WHERE selectable", f"{LEVEL} AS label")
    + stat_tables("label", order="o") + with_examples_sql("latest_growth WHERE selectable", LEVEL)))
def group_summary(spark, sf_dir):
    return with_examples(reports.group_summary(growth.growth_components(prices(spark, sf_dir))))


@check("g3_compute_groups", growth_sql(
    sample("growth WHERE selectable AND year = 2000 AND period = 'M06'",
           "length(item_code) || ' chars' AS label")
    + stat_tables("label") + with_examples_sql(
        "growth WHERE selectable AND year = 2000 AND period = 'M06'", "length(item_code) || ' chars'")))
def compute_groups(spark, sf_dir):
    report = reports.compute(prices(spark, sf_dir), date="2000-06", group_by="item-code-length")
    return with_examples(report.groups)


@check("g3_compute_header", growth_sql("""SELECT (SELECT year || '-' || substr(period, 2)
      FROM observation ORDER BY year DESC, substr(period, 2) DESC LIMIT 1) AS date,
    'display-level' AS group_by, 'database' AS source, true AS selectable_only, CAST(sum(n) AS BIGINT) AS component_count,
    count(*) FILTER (n >= 24) AS group_count, 24 AS min_sample_size, true AS skip_small_samples
    FROM (SELECT display_level, count(*) AS n FROM latest_growth WHERE selectable GROUP BY ALL)"""))
def compute_header(spark, sf_dir):
    return reports.compute(
        prices(spark, sf_dir), min_sample_size=24, skip_small_samples=True).header


@check("g4_right_tail", price_sql(f"""SELECT series_id, item_name, display_level, {r('yoy')} AS yoy
    FROM (SELECT series_id, item_code, year, period, CAST(value AS DOUBLE) / CAST(lag(value, 12)
      OVER (PARTITION BY series_id ORDER BY year, period) AS DOUBLE) - 1 AS yoy
      FROM observation JOIN series USING (series_id) WHERE area_code = '0000' AND seasonal = 'U'
      AND periodicity_code = 'R') JOIN item USING (item_code)
    WHERE year = 2000 AND period = 'M06' ORDER BY yoy DESC NULLS FIRST, series_id LIMIT 15"""))
def right_tail(spark, sf_dir):
    return rounded(views.right_tail(prices(spark, sf_dir), "2000-06"), ["yoy"])


def percent_sql(column: str, name: str) -> str:
    return f"printf('%.2f%%', {column} * 100) AS {name}_percent"


def _panel_sql(where: str, key: str, group_by: str, selectable: str, keep: str) -> str:
    named = {
        "mode": "weighted_kde_mode", "mean": "weighted_mean", "median": "weighted_median",
        "trimmed_mean": "trimmed_mean", "std": "weighted_std", "skewness": "weighted_skewness",
        "kurtosis": "weighted_kurtosis", "effective_sample_size": "effective_sample_size",
    }
    columns = ", ".join(f"{r(e)} AS {n}" for n, e in named.items())
    columns += ", " + percent_sql("weighted_kde_mode", "mode")
    return growth_sql(
        sample(f"growth WHERE {where}", f"{DATE} AS date, {key} AS group_label")
        + stat_tables("date, group_label")
        + f""" SELECT date, group_label, '{group_by}' AS group_by, {selectable} AS selectable_only,
        'database' AS source, n AS count, {columns} FROM stat WHERE {keep}""")


PANEL_ROUNDED = ["mode", "mean", "median", "trimmed_mean", "std", "skewness", "kurtosis",
                 "effective_sample_size"]


@check("g5_panel", _panel_sql(
    "selectable AND period <> 'M13'", "CAST(display_level AS VARCHAR)", "display-level", "true",
    "true"))
def panel(spark, sf_dir):
    return rounded(reports.panel(prices(spark, sf_dir), START, END), PANEL_ROUNDED)


def _followed(spark, sf_dir, report):
    """A stored report that was made while some months had other values, after two upserts that mend them."""
    tables = prices(spark, sf_dir)
    wrong = "(year = 1999 AND period = 'M05') OR (year = 1997 AND period IN ('M01', 'M13') AND series_id LIKE '%3')"
    target = Store(spark, scratch_path(spark, "store"))
    raised = F.expr(f"cast(if({wrong}, value * 2, value) AS decimal(18,6))")
    target.load(replace(tables, observation=tables.observation.withColumn("value", raised)))
    stored = MonthlyReport(spark, scratch_path(spark, "report"), report, START, END)
    stored.rebuild(target.read())
    for year in (1997, 1999):
        changes = tables.observation.filter(f"year = {year} AND period IN ('M01', 'M05', 'M07', 'M13')")
        changed = target.upsert_observations(changes)
        stored.refresh(target.read(), changed)
    return stored.read()


@check("g5_panel_refresh", _panel_sql(
    "selectable AND period <> 'M13'", "CAST(display_level AS VARCHAR)", "display-level", "true",
    "true"))
def panel_refresh(spark, sf_dir):
    return rounded(_followed(spark, sf_dir, reports.panel), PANEL_ROUNDED)


@check("g5_panel_code_length", _panel_sql(
    "period <> 'M13'", "length(item_code) || ' chars'", "item-code-length",
    "false", "n >= 40"))
def panel_code_length(spark, sf_dir):
    found = reports.panel(
        prices(spark, sf_dir), START, END, group_by="item-code-length", selectable_only=False,
        min_sample_size=40, skip_small_samples=True)
    return rounded(found, PANEL_ROUNDED)


TIME_COLUMNS = [c for c in STAT_COLUMNS if c != "weighted_kde_bandwidth"]


@check("g6_metrics_timeseries", growth_sql(
    sample("growth WHERE selectable AND period <> 'M13'", f"{DATE} AS date, year, period")
    + stat_tables("date, year, period")
    + f""" SELECT date, year, period, true AS selectable_only, 'flatfiles' AS source,
    n AS component_count, {stat_select(TIME_COLUMNS)}, {', '.join(percent_sql(c, c) for c in reports.PERCENT_STATISTICS)}
    FROM stat"""))
def metrics_timeseries(spark, sf_dir):
    found = reports.metrics_timeseries(prices(spark, sf_dir), START, END)
    return rounded(found, TIME_COLUMNS)


@check("g6_metrics_refresh", growth_sql(
    sample("growth WHERE selectable AND period <> 'M13'", f"{DATE} AS date, year, period")
    + stat_tables("date, year, period")
    + f""" SELECT date, year, period, true AS selectable_only, 'flatfiles' AS source,
    n AS component_count, {stat_select(TIME_COLUMNS)}, {', '.join(percent_sql(c, c) for c in reports.PERCENT_STATISTICS)}
    FROM stat"""))
def metrics_refresh(spark, sf_dir):
    return rounded(_followed(spark, sf_dir, reports.metrics_timeseries), TIME_COLUMNS)


_ANALYSIS = growth_sql(
    sample("latest_growth WHERE selectable", "CAST(display_level AS VARCHAR) AS label")
    + stat_tables("label"))


@check("g7_analyze_summaries",
       _ANALYSIS + with_examples_sql("latest_growth WHERE selectable", LEVEL))
def analyze_summaries(spark, sf_dir):
    return with_examples(reports.analyze(prices(spark, sf_dir)).summaries)


@check("g7_analyze_limits", growth_sql(""", q AS (SELECT CAST(display_level AS VARCHAR) AS label,
      quantile_cont(x, 0.0025) AS q0, quantile_cont(x, 0.9975) AS q1, min(x) AS lo, max(x) AS hi
      FROM latest_growth WHERE selectable GROUP BY ALL), e AS (SELECT *, q1 - q0 AS span FROM q)
    SELECT label, floor(greatest(q0 - span * 0.05, lo - span) * 1e6 + 0.5) / 1e6 AS axis_low,
      floor(least(q1 + span * 0.05, hi + span) * 1e6 + 0.5) / 1e6 AS axis_high FROM e"""))
def analyze_limits(spark, sf_dir):
    return rounded(reports.analyze(prices(spark, sf_dir)).limits, ["axis_low", "axis_high"])


@check("g7_analyze_header", growth_sql("""SELECT 'display-level' AS group_by,
    CAST(sum(n) AS BIGINT) AS components_total, count(*) AS group_count, 0 AS min_sample_size,
    false AS skip_small_samples
    FROM (SELECT display_level, count(*) AS n FROM latest_growth WHERE selectable GROUP BY ALL)"""))
def analyze_header(spark, sf_dir):
    return reports.analyze(prices(spark, sf_dir)).header


@check("p5_panel_warnings", growth_sql(""", cell AS (SELECT year || '-' || substr(period, 2) AS date,
      display_level, count(*) AS n FROM growth WHERE selectable AND period <> 'M13' GROUP BY ALL),
    month AS (SELECT date, sum(n) AS n FROM cell GROUP BY ALL)
    SELECT 'period' AS scope, date AS label, CAST(n AS BIGINT) AS sample_size,
      25 AS min_sample_size FROM month WHERE n < 25
    UNION ALL SELECT 'group', date || ':' || display_level, n, 25 FROM cell WHERE n < 25"""))
def panel_warnings(spark, sf_dir):
    return reports.panel_warnings(prices(spark, sf_dir), START, END, 25)


@check("g7_analyze_curves", _ANALYSIS + f""" SELECT label, CAST(i AS INTEGER) AS i,
    {r('g')} AS grid_x, {r('d', '1e9')} AS density FROM dens""")
def analyze_curves(spark, sf_dir):
    curves = reports.analyze(prices(spark, sf_dir)).curves
    return rounded(rounded(curves, ["grid_x"]), ["density"], "1e9")


@check("g7_analyze_histograms", growth_sql(""", f AS (SELECT display_level, min(x) AS lo,
      max(x) AS hi, count(*) AS n FROM latest_growth WHERE selectable GROUP BY ALL),
    b AS (SELECT display_level, least(CAST(floor((x - lo) / (hi - lo) * 30) AS INTEGER), 29) AS bin,
      count(*) AS c FROM latest_growth JOIN f USING (display_level) WHERE selectable GROUP BY ALL)
    SELECT CAST(g.display_level AS VARCHAR) AS label, CAST(i AS INTEGER) AS bin,
      floor((lo + i * ((hi - lo) / 30)) * 1e6 + 0.5) / 1e6 AS bin_low,
      floor((lo + (i + 1) * ((hi - lo) / 30)) * 1e6 + 0.5) / 1e6 AS bin_high,
      floor(coalesce(c, 0) / n * 1e9 + 0.5) / 1e9 AS weight
    FROM (SELECT * FROM f, generate_series(0, 29) AS t(i)) AS g LEFT JOIN b
      ON b.display_level = g.display_level AND b.bin = g.i"""))
def analyze_histograms(spark, sf_dir):
    bins = reports.analyze(prices(spark, sf_dir)).histograms
    return rounded(rounded(bins, ["bin_low", "bin_high"]), ["weight"], "1e9")


@check("g8_series_view", price_sql(VIEW_SQL + " WHERE display_level = 1 AND selectable"))
def series_view(spark, sf_dir):
    name = views.create_series_view(prices(spark, sf_dir), display_level=1)
    return plain_view(spark.sql(f"SELECT id, name, date, value FROM {name}"))


@check("g14_timeseries_frame", growth_sql(
    sample("growth WHERE selectable AND period <> 'M13'", f"{DATE} || '-01' AS date")
    + stat_tables("date") + " SELECT date, "
    + ", ".join(f"CAST(rtrim(printf('%.2f%%', {c} * 100), '%') AS DOUBLE) AS {c}_percent"
                for c in reports.PERCENT_STATISTICS) + " FROM stat"))
def timeseries_frame(spark, sf_dir):
    found = reports.timeseries_frame(
        reports.metrics_timeseries(prices(spark, sf_dir), START, END))
    return found.withColumn("date", F.col("date").cast("string"))


@check("g14_metric_frame", growth_sql(
    sample("growth WHERE selectable AND period <> 'M13'",
           f"{DATE} || '-01' AS date, CAST(display_level AS VARCHAR) AS group_label")
    + stat_tables("date, group_label")
    + f""" SELECT date, group_label, {r('weighted_kde_mode')} AS mode, {r('weighted_mean')} AS mean,
    {r('weighted_median')} AS median, {r('trimmed_mean')} AS trimmed_mean,
    {r('weighted_mean - std')} AS band_low, {r('weighted_mean + std')} AS band_high,
    CAST(rtrim(printf('%.2f%%', weighted_kde_mode * 100), '%') AS DOUBLE) AS mode_percent
    FROM stat"""))
def metric_frame(spark, sf_dir):
    found = reports.metric_frame(reports.panel(prices(spark, sf_dir), START, END))
    return rounded(found.withColumn("date", F.col("date").cast("string")),
                   ["mode", "mean", "median", "trimmed_mean", "band_low", "band_high"])

"""Checked queries: flat files, snapshots, exports, store maintenance."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from priceshape.operators import dedup, integrity
from priceshape.plans import jobs, reports
from priceshape.schemas import KEYS, Tables
from priceshape.scratch import scratch_path
from priceshape.sources import documents, exports, flatfiles, snapshot
from priceshape.sources.store import Store, delete_series, with_defaults
from priceshape.streaming.refresh import refresh_from_landing
from verification.base import check, price_sql, prices, r, rounded, table

_folders: dict[tuple[str, str], str] = {}


def as_text(df: DataFrame) -> DataFrame:
    """All columns as padded text; arrays become comma lists."""
    columns = []
    for field in df.schema.fields:
        column = F.col(field.name)
        if isinstance(field.dataType, T.ArrayType):
            column = F.concat_ws(",", column)
        elif isinstance(field.dataType, T.BooleanType):
            column = F.when(column, "T").otherwise("F")
        columns.append(F.concat(column.cast("string"), F.lit("  ")).alias(field.name))
    return df.select(columns)


def write_padded(df: DataFrame, path: str) -> None:
    df.write.csv(path, sep="\t", header=True, quote='"', escape='"', emptyValue="",
                 ignoreTrailingWhiteSpace=False, ignoreLeadingWhiteSpace=False)


def flat_folder(spark: SparkSession, sf_dir: str) -> str:
    """The price tables as flat files; the observation files overlap with different values."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key in _folders:
        return _folders[key]
    folder, tables = scratch_path(spark, "flat"), prices(spark, sf_dir)
    for name, file in flatfiles.DIMENSION_FILES.items():
        write_padded(as_text(tables.get(name)), f"{folder}/{file}")
    write_padded(as_text(tables.series), f"{folder}/{flatfiles.SERIES_FILE}")
    text = tables.observation.withColumnRenamed("footnotes", "footnote_codes")
    parts = [
        ("year >= 2000", 0),
        ("year >= 1998 AND period <> 'M13'", 1),
    ]
    # Every row is in two neighbours of the other files.
    rest = len(flatfiles.DATA_FILES) - len(parts)
    brand = "cast(split_part(series_id, '#', 2) AS int)"
    for i in range(rest):
        parts.append((f"{brand} % {rest} = {i} OR ({brand} + 1) % {rest} = {i}", i + 2))

    def write(file, part):
        condition, shift = part
        rows = text.filter(condition).withColumn("value", F.expr(f"value + {shift}"))
        write_padded(as_text(rows), f"{folder}/{file}")

    with ThreadPoolExecutor(8) as pool:  # many small jobs side by side
        list(pool.map(write, flatfiles.DATA_FILES, parts))
    _folders[key] = folder
    return folder


def flat_observations(df: DataFrame) -> DataFrame:
    return df.select(
        "series_id", "year", "period", F.col("value").cast("double").alias("value"),
        F.coalesce(F.concat_ws(",", "footnotes"), F.lit("")).alias("footnotes"),
    )


FLAT_OBSERVATION = """SELECT series_id, year, period, CAST(value AS DOUBLE) AS value,
  coalesce(footnotes, '') AS footnotes FROM observation"""

FIRST_WINS = """SELECT series_id, year, period,
  CAST(value + CASE WHEN year >= 2000 THEN 0
    WHEN year >= 1998 AND period <> 'M13' THEN 1 ELSE 2 END AS DOUBLE) AS value,
  coalesce(footnotes, '') AS footnotes FROM observation"""

_REST, _BRAND = len(flatfiles.DATA_FILES) - 2, "CAST(split_part(series_id, '#', 2) AS INTEGER)"
FIRST_FILE = FIRST_WINS.replace(
    "ELSE 2 END", f"ELSE 2 + least({_BRAND} % {_REST}, ({_BRAND} + 1) % {_REST}) END")


@check(
    "r1_tab_separated_scan",
    """SELECT p_brand AS brand_name, CAST(p_partkey AS VARCHAR) AS period,
         coalesce(p_type, '') AS part_type FROM part WHERE p_partkey % 7 <> 0""",
)
def tab_separated_scan(spark, sf_dir):
    parts = table(spark, sf_dir, "part")
    messy = parts.select(
        F.concat(F.lit("  "), "p_brand").alias("Brand Name"),
        F.concat(F.col("p_partkey").cast("string"), F.lit(" ")).alias("period_code"),
        F.concat("p_type", F.lit("   ")).alias("PART type"),
        "p_partkey",
    )
    # Every seventh row is blank but for its separators.
    cells = [
        F.when(F.col("p_partkey") % 7 == 0, F.lit(" ")).otherwise(F.col(f"`{c}`")).alias(c)
        for c in messy.columns[:3]
    ]
    path = scratch_path(spark, "tsv")
    write_padded(messy.select(cells), path)
    return flatfiles.read_tsv(spark, path).drop(*flatfiles.FILE_ORDER)


def _dimension_scan(name: str):
    def scan(spark, sf_dir):
        file = {**flatfiles.DIMENSION_FILES, "series": flatfiles.SERIES_FILE}[name]
        return flatfiles.read_dimension(spark, f"{flat_folder(spark, sf_dir)}/{file}", name)

    return scan


check("r2_area_scan", price_sql("SELECT * FROM area"))(_dimension_scan("area"))
check("r3_item_scan", price_sql("SELECT * FROM item"))(_dimension_scan("item"))
check(
    "r4_period_scan",
    price_sql("""SELECT period AS period_code,
      CASE WHEN period = 'M13' THEN 'AN AV'
        ELSE upper(strftime(make_date(2000, CAST(substr(period, 2) AS INTEGER), 1), '%b'))
        END AS period_abbr,
      CASE WHEN period = 'M13' THEN 'Annual Average'
        ELSE strftime(make_date(2000, CAST(substr(period, 2) AS INTEGER), 1), '%B')
        END AS period_name
      FROM (SELECT DISTINCT period FROM observation)"""),
)(_dimension_scan("period"))
check(
    "r5_footnote_scan",
    price_sql("""SELECT DISTINCT code AS footnote_code,
      CASE code WHEN 'A' THEN 'Turn of the year' ELSE 'Preliminary' END AS footnote_text
      FROM (SELECT unnest(string_split(footnotes, ',')) AS code FROM observation)"""),
)(_dimension_scan("footnote"))
check("r6_series_scan", price_sql("SELECT * FROM series"))(_dimension_scan("series"))


@check("r7_observation_scan", price_sql(FLAT_OBSERVATION + " WHERE year >= 2000"))
def observation_scan(spark, sf_dir):
    path = f"{flat_folder(spark, sf_dir)}/{flatfiles.CURRENT_FILES[0]}"
    return flat_observations(flatfiles.read_observations(spark, path))


@check(
    "r7_observation_rejects",
    """SELECT l_returnflag AS series_id, CAST(year(l_shipdate) AS VARCHAR) AS year,
         CASE WHEN l_linenumber % 3 = 0 THEN '-' ELSE 'n/a' END AS value, count(*) AS rows
       FROM lineitem WHERE l_linenumber % 3 < 2 GROUP BY ALL""",
)
def observation_rejects(spark, sf_dir):
    text = """CASE l_linenumber % 3 WHEN 0 THEN '-' WHEN 1 THEN 'n/a'
        ELSE cast(l_extendedprice AS string) END AS value"""
    rows = table(spark, sf_dir, "lineitem").selectExpr(
        "l_returnflag AS series_id", "cast(year(l_shipdate) AS string) AS year", "'M01' AS period",
        text,
    )
    path = scratch_path(spark, "tsv")
    flatfiles.write_tsv(rows, path)
    _, rejects = flatfiles.read_observations_permissive(spark, path)
    return rejects.groupBy("series_id", "year", "value").agg(F.count(F.lit(1)).alias("rows"))


@check("r8_multi_file_scan", price_sql(FIRST_FILE))
def multi_file_scan(spark, sf_dir):
    folder = flat_folder(spark, sf_dir)
    return flat_observations(flatfiles.read_observation_files(spark, folder))


@check("r8_current_only_scan", price_sql(FLAT_OBSERVATION + " WHERE year >= 2000"))
def current_only_scan(spark, sf_dir):
    folder = flat_folder(spark, sf_dir)
    return flat_observations(flatfiles.read_observation_files(spark, folder, current_only=True))


@check("r9_store_scan", price_sql(FLAT_OBSERVATION))
def store_scan(spark, sf_dir):
    return flat_observations(prices(spark, sf_dir).observation)


SNAPSHOT = price_sql("""SELECT series_id, series_title, item_name, display_level, selectable, year, period,
      CAST(value AS DOUBLE) AS value, coalesce(footnotes, '') AS footnotes
      FROM observation JOIN series USING (series_id) JOIN item USING (item_code)""")


def _snapshot_rows(back: Tables) -> DataFrame:
    joined = back.observation.join(back.series, "series_id").join(back.item, "item_code")
    return joined.select(
        "series_id", "series_title", "item_name", "display_level", "selectable", "year", "period",
        F.col("value").cast("double").alias("value"),
        F.coalesce(F.concat_ws(",", "footnotes"), F.lit("")).alias("footnotes"),
    )


@check("r10_snapshot_scan", SNAPSHOT)
def snapshot_scan(spark, sf_dir):
    path = scratch_path(spark, "snapshot")
    snapshot.write_snapshot(prices(spark, sf_dir), path)
    return _snapshot_rows(snapshot.read_snapshot(spark, path))


@check("r10_document_scan", SNAPSHOT)
def document_scan(spark, sf_dir):
    """The snapshot as one JSON document, written by many tasks and read by ranges of bytes."""
    path = scratch_path(spark, "document")
    snapshot.write_document_snapshot(prices(spark, sf_dir), path)
    return _snapshot_rows(snapshot.read_document_snapshot(spark, path))


@check(
    "k9_snapshot_write",
    price_sql("SELECT series_id, year, period, CAST(value AS VARCHAR) AS value FROM observation"),
)
def snapshot_write(spark, sf_dir):
    path = scratch_path(spark, "snapshot")
    snapshot.write_snapshot(prices(spark, sf_dir), path)
    raw = spark.read.schema(snapshot.json_schema("observation")).json(f"{path}/observation")
    return raw.drop("footnotes")


REPORT_SQL = """SELECT strftime(l_shipdate, '%Y-%m-01') AS date, l_returnflag AS label,
  count(*) AS count, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS quantity
  FROM lineitem GROUP BY ALL"""


def _report(spark, sf_dir):
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.date_format("l_shipdate", "yyyy-MM").alias("date"),
                 F.col("l_returnflag").alias("label"))
        .agg(
            F.count(F.lit(1)).alias("count"),
            F.expr("cast(sum(cast(l_quantity AS decimal(18,2))) AS double)").alias("quantity"),
        )
    )


@check("k10_csv_export", REPORT_SQL)
def csv_export(spark, sf_dir):
    report, path = _report(spark, sf_dir), scratch_path(spark, "csv")
    exports.write_csv(report, path, ["date", "label"])
    back = exports.read_csv_report(spark, path, report.schema)
    return back.withColumn("date", F.col("date").cast("string"))


@check("k10_csv_one_header", REPORT_SQL)
def csv_one_header(spark, sf_dir):
    report, path = _report(spark, sf_dir), scratch_path(spark, "csv")
    exports.write_csv(report, path, ["date", "label"], one_header=True)
    back = exports.read_csv_report(spark, path, report.schema)
    return back.withColumn("date", F.col("date").cast("string"))


@check("r11_csv_report_scan",
       "SELECT min(date) AS first, max(date) AS last, count(*) AS rows, "
       f"CAST(sum(count) AS BIGINT) AS items FROM ({REPORT_SQL})")
def csv_report_scan(spark, sf_dir):
    return csv_export(spark, sf_dir).agg(
        F.min("date").alias("first"), F.max("date").alias("last"),
        F.count(F.lit(1)).alias("rows"), F.sum("count").alias("items"),
    )


@check("k11_parquet_export", REPORT_SQL)
def parquet_export(spark, sf_dir):
    path = scratch_path(spark, "parquet")
    exports.write_parquet(_report(spark, sf_dir), path, ["date", "label"])
    return spark.read.parquet(path).withColumn("date", F.concat("date", F.lit("-01")))


@check(
    "k1_ensure_schema",
    price_sql("""SELECT item_code, item_name, 0 AS display_level, false AS selectable, 0 AS sort_sequence,
      0 AS other_rows, 'series_id,year,period,value,footnotes' AS observation_columns FROM item"""),
)
def older_store(spark, sf_dir):
    """A store whose item table lacks columns, and which has no other tables yet."""
    target = Store(spark, scratch_path(spark, "store"))
    prices(spark, sf_dir).item.select("item_code", "item_name").write.parquet(f"{target.root}/item")
    for _ in range(2):
        target.ensure_schema()
    tables = target.read()
    others = sum(table.count() for name, table in tables.items() if name != "item")
    return tables.item.withColumns({
        "other_rows": F.lit(others), "observation_columns": F.lit(",".join(tables.observation.columns))})


@check("k2_full_load", SNAPSHOT)
def full_load(spark, sf_dir):
    """The second load replaces all of the first, months that it does not have included."""
    tables = prices(spark, sf_dir)
    target = Store(spark, scratch_path(spark, "store"))
    other = tables.observation.selectExpr("* EXCEPT (year, value)", "year + 9 AS year", "cast(1 AS decimal(18,6)) AS value")
    target.load(replace(tables, observation=other.unionByName(tables.observation.filter("year < 1995"))))
    target.load(tables)
    return _snapshot_rows(target.read())


@check("k3_append_load", price_sql(FLAT_OBSERVATION))
def append_load(spark, sf_dir):
    tables = prices(spark, sf_dir)
    low = tables.item.filter("sort_sequence <= 12")
    high = tables.item.filter("sort_sequence > 12")

    def part(items: DataFrame, dims: bool) -> Tables:
        series = tables.series.join(items.select("item_code"), "item_code", "left_semi")
        series = series.select(tables.series.columns)
        observation = tables.observation.join(series.select("series_id"), "series_id", "left_semi")
        shared = {n: tables.get(n).filter(F.lit(dims)) for n in ("area", "period", "footnote")}
        return Tables(**shared, item=items, series=series, observation=observation)

    target = Store(spark, scratch_path(spark, "store"))
    target.load(part(low, True), truncate=False)
    target.load(part(high, False), truncate=False)
    return flat_observations(target.read().observation)


def _loaded(spark, sf_dir) -> Store:
    target = Store(spark, scratch_path(spark, "store"))
    target.load(prices(spark, sf_dir))
    return target


def _empty(tables: Tables) -> Tables:
    return Tables(**{n: t.filter(F.lit(False)) for n, t in tables.items()})


@check(
    "k4_upsert_dimensions",
    price_sql("""SELECT item_code,
      CASE WHEN sort_sequence % 3 = 0 THEN upper(item_name) ELSE item_name END AS item_name,
      CASE WHEN sort_sequence % 3 = 0 THEN display_level + 1 ELSE display_level END
        AS display_level,
      selectable, sort_sequence FROM item
      UNION ALL SELECT item_code || 'X', upper(item_name), display_level + 1, selectable,
        sort_sequence FROM item WHERE sort_sequence % 3 = 0"""),
)
def upsert_dimensions(spark, sf_dir):
    target = _loaded(spark, sf_dir)
    tables = prices(spark, sf_dir)
    changed = tables.item.filter("sort_sequence % 3 = 0").selectExpr(
        "item_code", "upper(item_name) AS item_name", "display_level + 1 AS display_level",
        "selectable", "sort_sequence",
    )
    added = changed.withColumn("item_code", F.concat("item_code", F.lit("X")))
    target.sync_metadata(replace(_empty(tables), item=changed.unionByName(added)))
    return target.read().item


@check(
    "k5_upsert_series",
    price_sql("""SELECT * REPLACE (
      CASE WHEN seasonal = 'S' THEN 'adjusted' ELSE series_title END AS series_title,
      CASE WHEN seasonal = 'S' THEN end_year + 1 ELSE end_year END AS end_year) FROM series"""),
)
def upsert_series(spark, sf_dir):
    target, tables = _loaded(spark, sf_dir), prices(spark, sf_dir)
    changed = tables.series.filter("seasonal = 'S'").withColumns(
        {"series_title": F.lit("adjusted"), "end_year": F.expr("end_year + 1")}
    )
    target.sync_metadata(replace(_empty(tables), series=changed))
    return target.read().series


UPSERTED = """SELECT series_id, year, period,
  CAST(value + CASE WHEN year = 2000 THEN 5 ELSE 0 END AS DOUBLE) AS value,
  CASE WHEN year = 2000 THEN '' ELSE coalesce(footnotes, '') END AS footnotes FROM observation
  UNION ALL SELECT series_id, 2010, period, CAST(value + 5 AS DOUBLE), ''
  FROM observation WHERE year = 2000"""


def _changes(tables: Tables) -> DataFrame:
    """Year 2000 with other values, twice (the later copy has +5), and the same for a new year."""
    base = tables.observation.filter("year = 2000").withColumn(
        "footnotes", F.array().cast("array<string>")
    )
    base = base.unionByName(base.withColumn("year", F.lit(2010)))
    copies = base.withColumn("_n", F.explode(F.array(F.lit(1), F.lit(2))))
    return copies.withColumn("value", F.expr("cast(value + _n * 4 - 3 AS decimal(18,6))"))


@check("k6_upsert_observations", price_sql(UPSERTED))
def upsert_observations(spark, sf_dir):
    target = _loaded(spark, sf_dir)
    target.upsert_observations(_changes(prices(spark, sf_dir)), ["_n"])
    return flat_observations(target.read().observation)


@check("k7_sync_metadata", price_sql(
    "SELECT area_code, upper(area_name) AS area_name, n AS observations FROM area, "
    "(SELECT count(*) AS n FROM observation)"))
def sync_metadata(spark, sf_dir):
    target, tables = _loaded(spark, sf_dir), prices(spark, sf_dir)
    target.sync_metadata(replace(
        _empty(tables), area=tables.area.withColumn("area_name", F.upper("area_name"))
    ))
    after = target.read()
    # One row of counts for a handful of areas.
    count = after.observation.agg(F.count(F.lit(1)).alias("observations"))
    return after.area.withColumn("_one", F.lit(1)).join(
        count.withColumn("_one", F.lit(1)), "_one").drop("_one")


@check("k8_merge", price_sql(UPSERTED))
def merge(spark, sf_dir):
    target, tables = _loaded(spark, sf_dir), prices(spark, sf_dir)
    unique = dedup.last_wins(_changes(tables), KEYS["observation"], ["_n"])
    target.merge(replace(tables, observation=unique.select(tables.observation.columns)))
    return flat_observations(target.read().observation)


@check("k8_landing_refresh", price_sql(UPSERTED.replace("+ 5", "+ 2").replace("THEN 5", "THEN 2")))
def landing_refresh(spark, sf_dir):
    target, tables = _loaded(spark, sf_dir), prices(spark, sf_dir)
    changes = _changes(tables).filter("_n = 1").selectExpr(
        "series_id", "cast(year AS string) AS year", "period",
        "cast(value + 1 AS string) AS value", "'' AS footnote_codes",
    )
    landing = scratch_path(spark, "landing")
    flatfiles.write_tsv(changes, landing)
    refresh_from_landing(spark, landing, target.root, scratch_path(spark, "offsets"))
    return flat_observations(target.read().observation)


@check(
    "k13_summary_document",
    f"""WITH lines AS (SELECT l_suppkey % 300 AS label, CAST(l_discount AS DOUBLE) AS v FROM lineitem),
      groups AS (SELECT label, count(*) AS n, avg(v) AS m, stddev_pop(v) AS s FROM lines GROUP BY label)
      SELECT 'group ' || label || ' {{"}}' AS label, n AS count,
        row_number() OVER (ORDER BY label) - 1 AS place, {r("m")} AS weighted_mean, {r("s")} AS weighted_std,
        CASE WHEN m < 0 THEN '-' ELSE '' END || printf('%.2f%%', round(abs(m) * 100, 2)) AS weighted_mean_percent,
        count(*) OVER () AS component_count, 'L' || label AS example
      FROM groups""",
)
def summary_document(spark, sf_dir):
    """Three hundred groups through the written document, with braces and quotes in their labels."""
    lines = table(spark, sf_dir, "lineitem").selectExpr(
        "concat('group ', l_suppkey % 300, ' {\"}') AS label", "l_suppkey % 300 AS no", "cast(l_discount AS double) AS value")
    numbers = lines.select("label", "no").distinct()
    groups = reports.stat_summary(lines, ["label"], "value").join(numbers, "label").withColumn("examples", F.expr(
        """array(named_struct('series_id', concat('L', no), 'item_code', 'I', 'item_name', '}', 'series_title', '',
           'yoy', 0.5D, 'yoy_percent', '50%'))""")).drop("no")
    header = groups.agg(F.count(F.lit(1)).alias("component_count"))
    path = scratch_path(spark, "document")
    exports.write_summary(path, groups, header, {"area_code": "0000"})
    fields = spark.read.text(path).where("value LIKE '{%'").selectExpr(
        "from_json(concat(value, '}'), 'component_count bigint') AS f")
    schema = """label string, count bigint, stats struct<weighted_mean:double,weighted_std:double,
        weighted_mean_percent:string>, examples array<struct<series_id:string>>"""
    found = documents.read_objects(spark, path).where("section = 'groups'").select(
        "place", F.from_json("object", schema).alias("o"))
    first = Window.orderBy("place")
    rows = found.join(fields).select(
        "o.label", "o.count", (F.row_number().over(first) - 1).cast("long").alias("place"), "o.stats.*",
        F.col("f.component_count").alias("component_count"), F.expr("o.examples[0].series_id").alias("example"))
    return rounded(rows, ["weighted_mean", "weighted_std"])


@check(
    "k14_orphans",
    price_sql("""SELECT 'series.area_code' AS reference, area_code AS key, count(*) AS rows
      FROM series WHERE area_code IN ('0001', '0003') AND item_code NOT LIKE '%7' GROUP BY ALL
      UNION ALL SELECT 'observation.series_id', series_id, count(*) FROM observation
      JOIN series USING (series_id) WHERE item_code LIKE '%7' GROUP BY ALL"""),
)
def orphans(spark, sf_dir):
    tables = prices(spark, sf_dir)
    return integrity.orphans(replace(
        tables,
        area=tables.area.filter("area_code NOT IN ('0001', '0003')"),
        series=tables.series.filter("item_code NOT LIKE '%7'"),
    ))


@check(
    "k14_cascade",
    price_sql("""SELECT area_code, count(*) AS rows FROM observation JOIN series USING (series_id)
      WHERE area_code NOT IN ('0001', '0003') GROUP BY ALL"""),
)
def cascade(spark, sf_dir):
    tables = prices(spark, sf_dir)
    kept = integrity.cascade(
        replace(tables, area=tables.area.filter("area_code NOT IN ('0001', '0003')"))
    )
    return kept.observation.join(kept.series, "series_id").groupBy("area_code").agg(
        F.count(F.lit(1)).alias("rows"))


@check(
    "k14_delete_cascade",
    price_sql("""SELECT seasonal, count(DISTINCT series_id) AS series, count(*) AS rows
      FROM observation JOIN series USING (series_id) WHERE base_code <> 'A' GROUP BY ALL"""),
)
def delete_cascade(spark, sf_dir):
    tables = prices(spark, sf_dir)
    kept = delete_series(tables, tables.series.filter("base_code = 'A'"))
    return kept.observation.join(kept.series, "series_id").groupBy("seasonal").agg(
        F.countDistinct("series_id").alias("series"), F.count(F.lit(1)).alias("rows"))


@check(
    "k14_store_delete",
    price_sql(FLAT_OBSERVATION.replace("FROM observation", "FROM observation JOIN series USING (series_id)")
              + " WHERE base_code <> 'A'"),
)
def store_delete(spark, sf_dir):
    """Observations left after a delete, in a store that was loaded in two parts."""
    tables = prices(spark, sf_dir)
    target = Store(spark, scratch_path(spark, "store"))
    early = tables.observation.filter("period < 'M06'")
    target.load(replace(tables, observation=early))
    none = {name: t.limit(0) for name, t in tables.items() if name != "observation"}
    target.load(replace(tables, **none, observation=tables.observation.filter("period >= 'M06'")), truncate=False)
    target.delete(tables.series.filter("base_code = 'A'"))
    return flat_observations(target.read().observation)


@check("d1_first_file_wins", price_sql(FIRST_WINS))
def first_file_wins(spark, sf_dir):
    observation = prices(spark, sf_dir).observation
    parts = [
        observation.filter("year >= 2000"),
        observation.filter("year >= 1998 AND period <> 'M13'"),
        observation,
    ]
    shifted = [
        p.selectExpr("* EXCEPT (value)", f"value + {i} AS value", "0 AS _row")
        for i, p in enumerate(parts)
    ]
    return flat_observations(dedup.union_first_wins(shifted, KEYS["observation"], ["_row"]))


@check(
    "d2_upsert_union",
    """SELECT o_custkey, arg_max(o_totalprice, o_orderkey) AS price FROM orders GROUP BY o_custkey
       UNION ALL SELECT c_custkey, c_acctbal FROM customer
       WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)""",
)
def upsert_union(spark, sf_dir):
    existing = table(spark, sf_dir, "customer").selectExpr(
        "c_custkey AS o_custkey", "c_acctbal AS price")
    incoming = dedup.last_wins(
        table(spark, sf_dir, "orders").selectExpr(
            "o_custkey", "o_totalprice AS price", "o_orderkey AS _n"),
        ["o_custkey"], ["_n"],
    )
    return dedup.upsert(existing, incoming, ["o_custkey"])


@check(
    "d3_last_wins_by_code",
    """SELECT p_brand AS code, arg_max(p_name, p_partkey) AS name FROM part GROUP BY ALL""",
)
def last_wins_by_code(spark, sf_dir):
    rows = table(spark, sf_dir, "part").selectExpr("p_brand AS code", "p_name AS name",
                                                   "p_partkey AS _n")
    return dedup.last_wins(rows, ["code"], ["_n"])


@check(
    "d4_first_wins_rows",
    """SELECT user_id, event_type, arg_min(value, event_id) AS value FROM events GROUP BY ALL""",
)
def first_wins_rows(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", "value", "event_id")
    return dedup.first_wins(rows, ["user_id", "event_type"], ["event_id"])


@check("g9_fetch_dataset", price_sql(f"""SELECT series_id, series_title, item_name, display_level, selectable,
    year, period, value, footnotes FROM ({FIRST_FILE}) JOIN series USING (series_id) JOIN item USING (item_code)"""))
def fetch_dataset(spark, sf_dir):
    folder, output = flat_folder(spark, sf_dir), scratch_path(spark, "snapshot")
    jobs.fetch_dataset(spark, folder, output, document=True)
    return _snapshot_rows(jobs.load_tables(spark, "document", output))


@check("g10_load_full", price_sql(FIRST_FILE))
def load_full(spark, sf_dir):
    loaded = jobs.load_full(spark, flat_folder(spark, sf_dir), scratch_path(spark, "store"))
    return flat_observations(loaded.read().observation)


@check("g11_update_current", price_sql(
    "SELECT series_id, year, period, CAST(value + CASE WHEN year >= 2000 THEN 0 ELSE 9 "
    "END AS DOUBLE) AS value, coalesce(footnotes, '') AS footnotes FROM observation"))
def update_current(spark, sf_dir):
    tables = prices(spark, sf_dir)
    target = Store(spark, scratch_path(spark, "store"))
    raised = tables.observation.withColumn("value", F.expr("cast(value + 9 AS decimal(18,6))"))
    target.load(replace(tables, observation=raised))
    jobs.update_current(spark, flat_folder(spark, sf_dir), target.root)
    return flat_observations(target.read().observation)


@check("g12_sync_metadata", price_sql("SELECT * FROM series"))
def sync_metadata_job(spark, sf_dir):
    tables = prices(spark, sf_dir)
    target = Store(spark, scratch_path(spark, "store"))
    target.load(replace(tables, series=tables.series.withColumn("series_title", F.lit("old"))))
    jobs.sync_metadata(spark, flat_folder(spark, sf_dir), target.root)
    return target.read().series


@check("g13_ensure_schema", SNAPSHOT)
def ensure_schema_job(spark, sf_dir):
    target = jobs.ensure_schema(spark, scratch_path(spark, "store"))
    target.merge(prices(spark, sf_dir))
    target.ensure_schema()
    return _snapshot_rows(target.read())

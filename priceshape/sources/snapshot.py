"""JSON snapshots: one line-delimited folder per table, or one document with an array per table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from priceshape.functions.fields import footnote_list
from priceshape.operators.dedup import last_wins
from priceshape.schemas import KEYS, SCHEMAS, VALUE_TYPE, Tables
from priceshape.scratch import pin
from priceshape.sources.documents import Section, read_objects, write_document

# In JSON a value is text, so that no decimal digit is lost.
_JSON_OBSERVATION = T.StructType(
    [
        T.StructField(f.name, T.StringType() if f.name == "value" else f.dataType)
        for f in SCHEMAS["observation"].fields
    ]
)


def json_schema(name: str) -> T.StructType:
    return _JSON_OBSERVATION if name == "observation" else SCHEMAS[name]


def _from_json(table: DataFrame, name: str) -> DataFrame:
    if name == "observation":
        value = F.expr("nullif(nullif(trim(value), ''), 'NaN')").cast(VALUE_TYPE)
        table = table.withColumn("value", value)
    return table.select(SCHEMAS[name].fieldNames())


def write_snapshot(tables: Tables, folder: str) -> None:
    for name, table in tables.items():
        if name == "observation":
            table = table.withColumn("value", F.col("value").cast("string"))
        table.write.json(f"{folder}/{name}", ignoreNullFields=False)


def read_snapshot(spark: SparkSession, folder: str) -> Tables:
    parts = {}
    for name in SCHEMAS:
        table = spark.read.schema(json_schema(name)).json(f"{folder}/{name}")
        parts[name] = _from_json(table, name)
    return Tables(**parts)


# The arrays of a snapshot document and the names of their columns, where they differ.
DOCUMENT = {
    "area": ("areas", {"area_code": "code", "area_name": "name"}),
    "item": ("items", {"item_code": "code", "item_name": "name"}),
    "period": ("periods", {"period_code": "code", "period_abbr": "abbr", "period_name": "name"}),
    "footnote": ("footnotes", {"footnote_code": "code", "footnote_text": "text"}),
    "series": ("series", {}),
    "observation": ("observations", {}),
}


def write_document_snapshot(tables: Tables, path: str) -> None:
    """The six tables as one JSON document, in part files that form it in the order of their names.

    Objects stand in the order of their keys, values are text (``NaN`` where missing).
    """
    sections = []
    for name, table in tables.items():
        array, renamed = DOCUMENT[name]
        if name == "observation":
            table = table.withColumns({"value": F.coalesce(F.col("value").cast("string"), F.lit("NaN")),
                                       "footnotes": F.coalesce("footnotes", F.array().cast("array<string>"))})
        key = F.concat_ws("\x01", *[renamed.get(k, k) for k in KEYS[name]])
        sections.append(Section(array, table.withColumnsRenamed(renamed), F.lit(None), key))
    write_document(path, sections)


def read_document_snapshot(spark: SparkSession, path: str) -> Tables:
    """Tables of a snapshot document: a file of any size and layout, or its part files in a folder.

    Of several objects with one code the last counts, observations are taken as they are. Footnotes may
    be a list or a text; an object that is not of its table's form fails the query.
    """
    objects = pin(read_objects(spark, path), "document")
    parts = {}
    for name in SCHEMAS:
        array, renamed = DOCUMENT[name]
        fields = [T.StructField(renamed.get(f.name, f.name), T.StringType() if f.name in ("value", "footnotes") else f.dataType)
                  for f in SCHEMAS[name].fields]
        rows = objects.where(F.col("section") == array).select(
            "place", F.from_json("object", T.StructType(fields), {"mode": "FAILFAST"}).alias("o")).select("place", "o.*")
        rows = rows.withColumnsRenamed({new: old for old, new in renamed.items()})
        if name == "observation":
            listed = F.from_json("footnotes", "array<string>")
            rows = rows.withColumn("footnotes", F.when(F.col("footnotes").startswith("["), listed).otherwise(
                footnote_list(F.coalesce("footnotes", F.lit("")))))
        else:
            if name == "series":
                rows = rows.withColumn("series_title", F.coalesce("series_title", F.lit("")))
            rows = last_wins(rows, KEYS[name], ["place"])
        parts[name] = _from_json(rows, name)
    return Tables(**parts)

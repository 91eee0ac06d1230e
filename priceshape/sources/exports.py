"""Report files: CSV, Parquet and JSON documents."""

from __future__ import annotations

import json

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from priceshape.functions.fields import percent_text
from priceshape.operators.summary import STATISTICS
from priceshape.plans.reports import PERCENT_STATISTICS, label_order
from priceshape.sources.documents import Section, document_lines, write_document


def write_csv(df: DataFrame, path: str, order: list[Column], *, one_header: bool = False) -> None:
    """CSV in the given row order (part files in name order), each part with a header line.

    With ``one_header`` only the first part has it, so that the parts form one CSV file when put
    together in the order of their names; ``read_csv_report`` reads both forms.
    """
    if not one_header:
        df.orderBy(*order).write.csv(path, header=True)
        return
    names = df.sparkSession.createDataFrame([tuple(df.columns)], ", ".join(f"_{i} string" for i in range(len(df.columns))))
    head = names.select(F.lit(0).alias("__head"), F.to_csv(F.struct("*")).alias("__line"))
    lines = df.withColumn("__head", F.lit(1)).withColumn(
        "__line", F.to_csv(F.struct(*[F.col(f"`{c}`") for c in df.columns])))
    lines.unionByName(head, allowMissingColumns=True).orderBy("__head", *order).select("__line").write.text(path)


def write_parquet(df: DataFrame, path: str, order: list[Column]) -> None:
    df.orderBy(*order).write.parquet(path)


def read_csv_report(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """An exported report; its ``date`` text becomes the first day of the month."""
    text = T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields])
    rows = spark.read.csv(path, schema=text)
    is_header = " AND ".join(f"`{name}` <=> '{name}'" for name in text.names)
    rows = rows.where(f"NOT ({is_header})").select(*[
        F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema.fields])
    return rows.withColumn("date", F.to_date("date", "yyyy-MM"))


def summary_document(
    groups: DataFrame, header: DataFrame, locks: dict[str, str] | None = None
) -> tuple[list[Section], DataFrame]:
    """Sections and fields of the document of a run: its header, the locks, and an object per group.

    The groups stand in the order of their labels and may be any number.
    """
    percents = [percent_text(name).alias(f"{name}_percent") for name in PERCENT_STATISTICS]
    example = "struct(e.series_id, e.item_code, e.item_name, e.series_title, e.yoy,"
    example += " e.yoy_percent)"
    entries = groups.select(
        "label",
        "count",
        F.struct(
            *[name for name in STATISTICS if name != "weighted_kde_bandwidth"], *percents
        ).alias("stats"),
        F.expr(f"transform(examples, e -> {example})").alias("examples"),
    )
    lock_map = F.from_json(F.lit(json.dumps(locks or {})), "map<string,string>").alias("series_locks")
    fields = header.select(F.current_timestamp().alias("generated_at"), "*", lock_map)
    return [Section("groups", entries, *label_order("label"))], fields


def write_summary(path: str, groups: DataFrame, header: DataFrame, locks: dict[str, str] | None = None) -> None:
    """The document of a run as part files that form it in the order of their names."""
    sections, fields = summary_document(groups, header, locks)
    write_document(path, sections, fields)


def summary_text(groups: DataFrame, header: DataFrame, locks: dict[str, str] | None = None) -> Iterator[str]:
    """The lines of the document of a run, one range of them at a time."""
    return (row["line"] for row in document_lines(*summary_document(groups, header, locks)).toLocalIterator())

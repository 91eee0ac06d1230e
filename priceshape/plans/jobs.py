"""User-level jobs: load, refresh, analyse, export."""

from __future__ import annotations

from pyspark.sql import SparkSession

from priceshape.operators.filters import parse_locks
from priceshape.plans import reports
from priceshape.schemas import Tables
from priceshape.sources import exports
from priceshape.sources.flatfiles import read_dataset
from priceshape.sources.snapshot import (
    read_document_snapshot, read_snapshot, write_document_snapshot, write_snapshot,
)
from priceshape.sources.store import Store, export_ordered


def fetch_dataset(
    spark: SparkSession, folder: str, output: str | None = None, *, document: bool = False, **options
) -> Tables:
    """Read flat files and, if asked, write them as a JSON snapshot, in folders or as one document."""
    tables = read_dataset(spark, folder, **options)
    if output:
        (write_document_snapshot if document else write_snapshot)(tables, output)
    return tables


def ensure_schema(spark: SparkSession, root: str) -> Store:
    store = Store(spark, root)
    store.ensure_schema()
    return store


def load_full(
    spark: SparkSession,
    folder: str,
    root: str,
    *,
    truncate: bool = True,
    files: list[str] | None = None,
) -> Store:
    """Full history from flat files into the store."""
    store = Store(spark, root)
    store.load(read_dataset(spark, folder, files), truncate=truncate)
    return store


def update_current(spark: SparkSession, folder: str, root: str) -> Store:
    """Upsert the current partition and the metadata."""
    store = Store(spark, root)
    store.merge(read_dataset(spark, folder, current_only=True))
    return store


def sync_metadata(spark: SparkSession, folder: str, root: str) -> Store:
    store = Store(spark, root)
    store.sync_metadata(read_dataset(spark, folder, current_only=True))
    return store


def load_tables(
    spark: SparkSession,
    source: str,
    location: str,
    *,
    files: list[str] | None = None,
    current_only: bool = False,
) -> Tables:
    """Tables from a store (``database``), flat files (``flatfiles``) or a snapshot (``snapshot`` in
    folders, ``document`` as one JSON document)."""
    if source == "database":
        if files or current_only:
            raise ValueError("file selection applies to flat files only")
        return Store(spark, location).read()
    if source == "flatfiles":
        if files and current_only:
            raise ValueError("give either files or current_only")
        return read_dataset(spark, location, files, current_only=current_only)
    if source in ("snapshot", "document"):
        return (read_snapshot if source == "snapshot" else read_document_snapshot)(spark, location)
    raise ValueError(f"unknown source {source!r}")


def export_snapshot(spark: SparkSession, root: str, output: str, *, document: bool = False) -> None:
    write = write_document_snapshot if document else write_snapshot
    write(export_ordered(Store(spark, root).read()), output)


def compute_report(
    tables: Tables, output: str | None, locks: list[str] = (), **options
) -> reports.Report:
    parsed = parse_locks(locks)
    report = reports.compute(tables, locks=parsed, **options)
    if output:
        exports.write_summary(output, report.groups, report.header, parsed)
    return report


def _export(df, path: str, order) -> None:
    if df.isEmpty():
        raise ValueError("no rows for the requested range")
    if path.endswith(".csv"):
        exports.write_csv(df, path, order)
    elif path.endswith((".parquet", ".pq")):
        exports.write_parquet(df, path, order)
    else:
        raise ValueError("the export path must end with .csv or .parquet")


def export_panel(tables: Tables, start: str, end: str, path: str, locks=(), **options) -> None:
    df = reports.panel(tables, start, end, locks=parse_locks(locks), **options)
    _export(df, path, reports.panel_order())


def export_timeseries(tables: Tables, start: str, end: str, path: str, locks=(), **options) -> None:
    df = reports.metrics_timeseries(tables, start, end, locks=parse_locks(locks), **options)
    _export(df, path, ["date"])


def export_analysis(tables: Tables, folder: str, locks=(), **options) -> reports.Analysis:
    """Summary document, axis limits, and per group label density curves and histograms."""
    parsed = parse_locks(locks)
    result = reports.analyze(tables, locks=parsed, **options)
    if result.limits.isEmpty() and not options.get("skip_small_samples"):
        raise ValueError("no growth components to analyse")
    exports.write_summary(f"{folder}/summary", result.summaries, result.header, parsed)
    result.limits.write.parquet(f"{folder}/limits")
    result.curves.write.partitionBy("label").parquet(f"{folder}/curves")
    result.histograms.write.partitionBy("label").parquet(f"{folder}/histograms")
    return result

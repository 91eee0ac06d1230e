"""Incremental refresh of a store from a landing folder of observation files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from priceshape.functions.fields import footnote_list, strict_int, strict_value, strip
from priceshape.plans.panels import MonthlyReport
from priceshape.sources.store import Store

_MONTHS = "year int, period string"

# Column order of an observation file.
OBSERVATION_COLUMNS = ["series_id", "year", "period", "value", "footnote_codes"]


def refresh_from_landing(
    spark: SparkSession,
    landing: str,
    root: str,
    checkpoint: str,
    *,
    files_per_batch: int = 100,
    reports: Sequence[MonthlyReport] = (),
) -> None:
    """Upsert every file that arrived since the last run, then stop.

    Rows of a later file replace rows of an earlier one. A batch that is repeated after a failure
    writes the same keys again, so the store ends in the same state. The months that a batch touched
    are noted below ``checkpoint`` before the store changes; stored ``reports`` follow them after it,
    and a note that a failure left is followed with the next batch, or at the start of the next run.
    """
    schema = T.StructType([T.StructField(c, T.StringType()) for c in OBSERVATION_COLUMNS])
    lines = (
        spark.readStream.schema(schema)
        # A file whose header names other columns, or in another order, stops the refresh.
        .options(sep="\t", header=True, enforceSchema=False, ignoreLeadingWhiteSpace=True,
                 ignoreTrailingWhiteSpace=True, maxFilesPerTrigger=files_per_batch)
        .csv(landing)
        .select("*", "_metadata.file_modification_time", "_metadata.file_path",
                "_metadata.file_block_start")
    )
    store = Store(spark, root)

    def merge(batch: DataFrame, _: int) -> None:
        cells = {c: strip(F.coalesce(F.col(c), F.lit(""))) for c in OBSERVATION_COLUMNS}
        rows = batch.filter(F.concat(*cells.values()) != "").select(
            cells["series_id"].alias("series_id"),
            strict_int(cells["year"], "year").alias("year"),
            cells["period"].alias("period"),
            strict_value(cells["value"]).alias("value"),
            footnote_list(cells["footnote_codes"]).alias("footnotes"),
            F.col("file_modification_time").alias("_time"),
            F.col("file_path").alias("_file"),
            F.col("file_block_start").alias("_block"),
            F.monotonically_increasing_id().alias("_row"),
        )
        months = store.upsert_observations(rows, ["_time", "_file", "_block", "_row"], note=note)
        follow(months)

    def note(months: set[tuple[int, str]]) -> None:
        if reports and months:
            spark.createDataFrame(sorted(months), _MONTHS).coalesce(1).write.mode("append").parquet(pending)

    def follow(months: set[tuple[int, str]]) -> None:
        for report in reports if months else ():
            report.refresh(store.read(), months)
        if reports and months:
            spark.createDataFrame([], _MONTHS).write.mode("overwrite").parquet(pending)

    pending = f"{checkpoint.rstrip('/')}-months"
    if reports:
        spark.createDataFrame([], _MONTHS).write.mode("append").parquet(pending)
        follow({tuple(r) for r in spark.read.schema(_MONTHS).parquet(pending).distinct().collect()})
    query = (
        lines.writeStream.foreachBatch(merge)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()

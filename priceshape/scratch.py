"""Materialised intermediate tables in the shared scratch folder.

A table that several later passes read is written once as Parquet below the folder named by
``spark.checkpoint.dir``. The written files survive the loss of executors, and their size is known
to the planner: Spark broadcasts a join side read from them only when the files are smaller than
``spark.sql.autoBroadcastJoinThreshold`` and otherwise shuffles both sides, so no operator of this
package carries a broadcast hint.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_roots: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """Shared folder of this application; local sessions that name none get a temporary one."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    app = spark.sparkContext.applicationId
    if configured:
        return f"{configured.rstrip('/')}/priceshape-{app}"
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    if app not in _local_roots:
        _local_roots[app] = tempfile.mkdtemp(prefix="priceshape-")
    return _local_roots[app]


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path nobody has written to."""
    return f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"


def pin(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write ``df`` once and return a scan of the written table (lineage ends there)."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)

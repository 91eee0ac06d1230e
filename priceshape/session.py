"""Session for the command line and for local runs."""

from __future__ import annotations

from pyspark.sql import SparkSession


def get_session(app: str = "priceshape", **conf: str) -> SparkSession:
    """The running session, or a new one with adaptive execution and UTC."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        # Call sites of single column calls are not worth their cost in long plans.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()

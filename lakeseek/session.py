"""Session defaults."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; on a cluster master comes from spark-submit."""
    builder = SparkSession.builder.appName("lakeseek")
    if master:
        builder = builder.master(master)
    defaults = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"}
    return builder.config(map=defaults | conf).getOrCreate()

"""Session settings that the operators expect."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(master: str | None = None, app: str = "tidemark", partitions: int | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; ANSI errors stay on, as operators use try_* where text may be bad."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    told = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.ui.enabled": "false"}
    if partitions:
        told["spark.sql.shuffle.partitions"] = str(partitions)
    return b.config(map=told | conf).getOrCreate()

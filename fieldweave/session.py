"""SparkSession factory with the settings that the column expressions rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(app: str = "fieldweave", master: str | None = None, **extra: str) -> SparkSession:
    """A session in UTC with ANSI semantics and adaptive execution.

    ``master`` and any ``extra`` setting (dots written as double underscores)
    override the defaults; on a cluster both come from spark-submit.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.ansi.enabled", "true")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in extra.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()

"""A Spark session with the settings this library's plans count on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "tamarisk", master: str | None = None, **conf: str) -> SparkSession:
    """Adaptive execution, skew splitting, Arrow and UTC; a master and further settings where given."""
    b = SparkSession.builder.appName(name)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    for k, v in settings.items():
        b = b.config(k, v)
    return b.getOrCreate()

"""Session settings the jobs rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def local_session(
    cores: int | str = "*", app: str = "vacantia", memory: str = "8g", working: str | None = None
) -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own.

    ``working`` is the folder for working tables.
    """
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config(map={"spark.checkpoint.dir": working} if working else {})
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return pin_session(spark)


def pin_session(spark: SparkSession) -> SparkSession:
    """Times are UTC; skewed join partitions are split at run time."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    return spark

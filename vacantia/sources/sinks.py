"""Full-refresh sinks: one write into a new version, then one row that publishes it.

A table is a folder with ``versions/<name>`` and ``published``, a log of small files with
one row per refresh. A reader takes the version that was published last. A refresh that
fails on the way leaves a version that nobody reads; the table is as it was. Superseded
versions stay for readers that began earlier and are the owner's to remove.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from vacantia.errors import ContractError
from vacantia.functions.columns import country_key
from vacantia.operators.contract import check_columns, with_violations
from vacantia.schema import COUNTRIES, COUNTRY_KEY, METRIC_COLUMNS, POSTING_COLUMNS
from vacantia.sources.tables import current_version, version_path

_LOG = "version string, rows bigint, at_ns bigint"


def publish(spark: SparkSession, path: str, version: str, rows: int) -> None:
    """Make a version that is written as a whole the current one."""
    entry = spark.createDataFrame([(version, rows, time.time_ns())], _LOG)
    entry.coalesce(1).write.mode("append").parquet(f"{path}/published")


def replace_table(
    df: DataFrame,
    path: str,
    columns: list[str],
    partition_by: str | None = None,
) -> int:
    """Replace the table at ``path`` and return the number of rows written."""
    check_columns(df.columns, columns)
    version, counted = uuid.uuid4().hex, Observation()
    writer = df.select(*columns).observe(counted, F.count(F.lit(1)).alias("rows")).write
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(version_path(path, version))
    rows = counted.get["rows"]
    publish(df.sparkSession, path, version, rows)
    return rows


def write_postings(
    silver: DataFrame,
    path: str,
    *,
    on_bad: str = "raise",
    cluster_by: tuple[str, ...] = (),
) -> int:
    """Replace the silver table in one write and return its number of rows.

    Rows that break the contract are counted by the write itself and lie in a folder of
    their own within the version (``read_rejected``). With ``on_bad="raise"`` such a
    version is not published; with ``"quarantine"`` it is, without these rows.
    ``cluster_by`` range-partitions the files on those columns and the key, which lets
    searches skip files by their statistics. The country without regard to case is stored
    as well, with a Bloom filter, for searches that ignore case.
    """
    if on_bad not in ("raise", "quarantine"):
        raise ValueError(f"on_bad must be raise or quarantine, not {on_bad}")
    check_columns(silver.columns, POSTING_COLUMNS)
    version, counted = uuid.uuid4().hex, Observation()
    broken = F.size("violations") > 0
    checked = with_violations(silver).withColumn(COUNTRY_KEY, country_key())
    if cluster_by:
        order = [*cluster_by, "job_id"]
        checked = checked.repartitionByRange(*order).sortWithinPartitions(*order)
    checked = checked.observe(
        counted,
        F.count_if(~broken).alias("rows"),
        F.count_if(broken).alias("broken"),
        F.min(F.when(broken, F.struct("job_id", "violations"))).alias("first"),
    )
    writer = checked.withColumn("rejected", broken).write.partitionBy("rejected")
    # Tells row groups apart that hold a country from those that do not, whatever the order of rows.
    writer = writer.option(f"parquet.bloom.filter.enabled#{COUNTRY_KEY}", "true")
    writer = writer.option(f"parquet.bloom.filter.expected.ndv#{COUNTRY_KEY}", str(COUNTRIES))
    writer.parquet(version_path(path, version))
    found = counted.get
    if found["broken"] and on_bad == "raise":
        first = found["first"]
        raise ContractError(f"posting {first['job_id']} breaks {first['violations']}")
    publish(silver.sparkSession, path, version, found["rows"])
    return found["rows"]


def read_rejected(spark: SparkSession, path: str) -> DataFrame:
    """Rows that the current version of a silver table left out, with their ``violations``."""
    rows = spark.read.parquet(version_path(path, current_version(spark, path)))
    return rows.where(F.col("rejected").cast("boolean")).drop("rejected", COUNTRY_KEY)


def write_metrics(gold: DataFrame, path: str) -> int:
    """Replace the gold table, one folder per dimension."""
    return replace_table(gold, path, METRIC_COLUMNS, partition_by="dimension")

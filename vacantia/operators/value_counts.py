"""Medians kept up to date: a stored table of counts that takes in signed changes.

``path/parts/<name>`` hold rows ``(keys, value, n)`` with ``n`` above or below 0;
``path/published`` lists, refresh by refresh, the parts that together are the table. A
refresh adds one part with the counts of what came less what went. Counts of equal keys and
value are summed on read; when more than ``most_parts`` have gathered, they are written as
one. The median is found on the sums, so a refresh never reads the rows behind the counts.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vacantia.sources.buckets import is_published

MOST_PARTS = 8
_LIST = "version string, at_ns bigint, part string"


def _parts(spark: SparkSession, path: str) -> list[str]:
    if not is_published(spark, path):
        return []
    log = spark.read.schema(_LIST).parquet(f"{path}/published")
    version = log.agg(F.max_by("version", F.struct("at_ns", "version"))).first()[0]
    return sorted(row.part for row in log.where(F.col("version") == F.lit(version)).collect())  # few


def _summed(rows: DataFrame) -> DataFrame:
    keys = [name for name in rows.columns if name != "n"]
    return rows.groupBy(*keys).agg(F.sum("n").alias("n")).where(F.col("n") != 0)


def _publish(spark: SparkSession, path: str, parts: list[str]) -> None:
    version, at = uuid.uuid4().hex, time.time_ns()
    spark.createDataFrame([(version, at, part) for part in parts], _LIST).coalesce(1).write.mode("append").parquet(f"{path}/published")


def add_changes(changes: DataFrame, path: str, most_parts: int = MOST_PARTS) -> None:
    """Take ``changes`` (key columns, value, ``n``) into the table at ``path``.

    Counts are combined in each task before they are shuffled, so a key with very many
    changes is spread over all tasks by its values.
    """
    spark = changes.sparkSession
    parts = _parts(spark, path)
    part = uuid.uuid4().hex
    _summed(changes).write.parquet(f"{path}/parts/{part}")
    parts.append(part)
    if len(parts) > most_parts:
        whole = uuid.uuid4().hex
        _summed(_read(spark, path, parts)).write.parquet(f"{path}/parts/{whole}")
        parts = [whole]
    _publish(spark, path, parts)


def _read(spark: SparkSession, path: str, parts: list[str]) -> DataFrame:
    return spark.read.parquet(*(f"{path}/parts/{part}" for part in parts))


def read_counts(spark: SparkSession, path: str) -> DataFrame:
    """The table: how often each key has each value now."""
    counts = _summed(_read(spark, path, _parts(spark, path)))
    wrong = F.raise_error(F.concat(F.lit("a value was taken away more often than it came: "), F.to_json(F.struct("*")))).cast("boolean")
    return counts.where(F.when(F.col("n") > 0, True).otherwise(wrong))

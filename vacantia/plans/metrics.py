"""Market metrics read from the gold table."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacantia.errors import RequestError
from vacantia.operators.medians import mask_small_groups
from vacantia.schema import DIMENSIONS, METRICS, MIN_GROUP_SIZE


def market_metrics(gold: DataFrame, dimension: str = "seniority", k: int = MIN_GROUP_SIZE) -> DataFrame:
    """Values of one dimension in ascending order, NULL last, small groups masked."""
    check_dimension(dimension)
    return (
        gold.where(F.col("dimension") == F.lit(dimension))
        .select(
            "dimension_value",
            mask_small_groups("median_salary", "posting_count", k).alias("median_salary"),
            "posting_count",
            "as_of",
        )
        .orderBy(F.asc_nulls_last("dimension_value"))
    )


def metrics_as_of(metrics: DataFrame) -> datetime:
    """Build time of the metrics in UTC; the current time when there are none."""
    first = metrics.select(F.unix_micros("as_of").alias("us")).take(1)
    if not first:
        return datetime.now(timezone.utc)
    return datetime.fromtimestamp(0, timezone.utc) + timedelta(microseconds=first[0]["us"])


def check_dimension(dimension: str) -> None:
    if dimension not in DIMENSIONS:
        raise RequestError("INVALID_REQUEST", "unknown dimension", "dimension")


def check_metric(metric: str) -> None:
    if metric not in METRICS:
        raise RequestError("INVALID_REQUEST", "unknown metric", "metric")

"""Table readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vacantia.schema import COUNTRY_KEY, METRIC_COLUMNS, METRIC_SCHEMA, POSTING_COLUMNS, POSTING_SCHEMA

_STORED_POSTINGS = T.StructType(
    [*POSTING_SCHEMA, T.StructField(COUNTRY_KEY, T.StringType()), T.StructField("rejected", T.BooleanType())]
)


def jdbc_options(
    url: str,
    table: str,
    *,
    driver: str | None = None,
    properties: dict[str, str] | None = None,
    partition_column: str | None = None,
    bounds: tuple[int, int] | None = None,
    partitions: int = 64,
    fetch_size: int = 10_000,
    single_task: bool = False,
) -> dict[str, str]:
    """Options of a JDBC read, split into parallel key ranges.

    The bounds only set the stride: rows outside of them are read as well. A table
    that one task is to read as a whole must be declared so.
    """
    if (partition_column is None) != single_task:
        raise ValueError("name a partition column with bounds, or ask for a single task")
    options = {"url": url, "dbtable": table, "fetchsize": str(fetch_size), **(properties or {})}
    if driver:
        options["driver"] = driver
    if partition_column is not None:
        if bounds is None:
            raise ValueError("a partitioned read needs bounds")
        options |= {
            "partitionColumn": partition_column,
            "lowerBound": str(bounds[0]),
            "upperBound": str(bounds[1]),
            "numPartitions": str(partitions),
        }
    return options


def read_jdbc(spark: SparkSession, url: str, table: str, **kwargs) -> DataFrame:
    """Scan an operational table; the columns selected next are pushed into it."""
    return spark.read.format("jdbc").options(**jdbc_options(url, table, **kwargs)).load()


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def version_path(path: str, version: str) -> str:
    return f"{path}/versions/{version}"


def current_version(spark: SparkSession, path: str) -> str:
    """The version published last; one row reaches the driver."""
    log = spark.read.schema("version string, at_ns bigint").parquet(f"{path}/published")
    return log.agg(F.max_by("version", F.struct("at_ns", "version"))).first()[0]


def read_postings(spark: SparkSession, path: str, with_key: bool = False) -> DataFrame:
    """The silver table in contract order; ``with_key`` for searches that ignore case."""
    rows = spark.read.schema(_STORED_POSTINGS).parquet(version_path(path, current_version(spark, path)))
    return rows.where(~F.col("rejected")).select(*POSTING_COLUMNS, *([COUNTRY_KEY] if with_key else []))


def read_metrics(spark: SparkSession, path: str, dimension: str | None = None) -> DataFrame:
    """The gold table, of one dimension when given."""
    version = version_path(path, current_version(spark, path))
    gold = spark.read.schema(METRIC_SCHEMA).parquet(version).select(*METRIC_COLUMNS)
    return gold if dimension is None else gold.where(F.col("dimension") == F.lit(dimension))

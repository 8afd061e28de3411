"""Pages by number: a stored copy of a result in each order, with its files counted.

``path/<sort>/versions/<name>/rows`` holds the matches in one global order, cut into files of
at most ``rows_per_file`` rows; ``.../files`` has a row for each of them: the rank it starts
with, how many rows it holds and the first and last ``(key, job_id)``, its fences. A page by
number looks its files up by rank and reads one or two of them, however far down it lies; a
page behind a cursor looks them up by the fences.
"""

from __future__ import annotations

import uuid
from itertools import accumulate

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vacantia.errors import RequestError
from vacantia.operators.filters import Filters
from vacantia.operators.ordering import ordering
from vacantia.plans.search import check_limit, matching
from vacantia.schema import DEFAULT_LIMIT, DEFAULT_SORT, POSTING_COLUMNS, POSTING_SCHEMA
from vacantia.sources.sinks import publish
from vacantia.sources.tables import current_version, version_path

ROWS_PER_FILE = 1_000_000
_ROWS = T.StructType([*POSTING_SCHEMA, T.StructField("sort_key", T.LongType()), T.StructField("ticket", T.LongType())])
_FILES = (
    "file string, ticket bigint, start bigint, rows bigint, "
    "first struct<sort_key:bigint,job_id:bigint>, last struct<sort_key:bigint,job_id:bigint>"
)


def build_rank_index(
    silver: DataFrame,
    path: str,
    sort: str = DEFAULT_SORT,
    filters: Filters = Filters(),
    *,
    rows_per_file: int = ROWS_PER_FILE,
    ignore_case: bool = False,
) -> int:
    """Store the matches in order, and return their number.

    One range shuffle on key and id, so a key that very many rows share is split. The
    driver receives one row per file.
    """
    spark, order = silver.sparkSession, ordering(sort)
    version = uuid.uuid4().hex
    place = version_path(f"{path}/{sort}", version)
    rows = matching(silver, filters.checked(), ignore_case).withColumn("sort_key", order.key())
    ordered = rows.repartitionByRange("sort_key", "job_id").sortWithinPartitions("sort_key", "job_id")
    # A task's tickets are consecutive, and grow from one task to the next.
    numbered = ordered.withColumn("ticket", F.monotonically_increasing_id())
    numbered.write.option("maxRecordsPerFile", rows_per_file).parquet(f"{place}/rows")
    fence = F.struct("sort_key", "job_id")
    files = (
        spark.read.schema(_ROWS).parquet(f"{place}/rows")
        .groupBy(F.col("_metadata.file_path").alias("file"))
        .agg(F.min("ticket").alias("ticket"), F.count(F.lit(1)).alias("rows"), F.min(fence).alias("first"), F.max(fence).alias("last"))
        .orderBy("ticket")
        .collect()
    )
    starts = list(accumulate((row.rows for row in files), initial=0))
    table = [(row.file, row.ticket, start, row.rows, row.first, row.last) for row, start in zip(files, starts)]
    spark.createDataFrame(table, _FILES).coalesce(1).write.parquet(f"{place}/files")
    publish(spark, f"{path}/{sort}", version, starts[-1])
    return starts[-1]


def _files(spark: SparkSession, path: str, sort: str) -> DataFrame:
    place = f"{path}/{ordering(sort) and sort}"
    return spark.read.schema(_FILES).parquet(f"{version_path(place, current_version(spark, place))}/files")


def _ranked(spark: SparkSession, files: list[Row], first: int, last: int) -> DataFrame:
    """Rows of the given files with ranks ``first`` to ``last``, counted from 1."""
    found = None
    for row in files:  # one or two
        low, high = max(first, row.start + 1), min(last, row.start + row.rows)
        ticket = F.col("ticket")
        rows = spark.read.schema(_ROWS).parquet(row.file).where(
            ticket.between(row.ticket + low - row.start - 1, row.ticket + high - row.start - 1)
        )
        rows = rows.select(*POSTING_COLUMNS, (ticket - F.lit(row.ticket - row.start - 1)).alias("rank"))
        found = rows if found is None else found.unionByName(rows)
    if found is None:
        return spark.createDataFrame([], T.StructType([*POSTING_SCHEMA, T.StructField("rank", T.LongType())]))
    return found


def page_by_number(
    spark: SparkSession, path: str, number: int, sort: str = DEFAULT_SORT, page_size: int = DEFAULT_LIMIT
) -> DataFrame:
    """Page ``number``, from 1, with the ``rank`` of its rows and ``page_no``; empty behind the last page."""
    check_limit(page_size)
    if number < 1:
        raise RequestError("INVALID_REQUEST", "pages are counted from 1", "page_no")
    first, last = (number - 1) * page_size + 1, number * page_size
    files = _files(spark, path, sort).where((F.col("start") < last) & (F.col("start") + F.col("rows") >= first)).collect()
    rows = _ranked(spark, files, first, last)
    return rows.withColumn("page_no", F.lit(number).cast("bigint"))


def page_behind(
    spark: SparkSession, path: str, key: int, job_id: int, sort: str = DEFAULT_SORT, limit: int = DEFAULT_LIMIT
) -> DataFrame:
    """The first ``limit`` rows behind ``(key, job_id)`` in the order, with their ``rank``."""
    check_limit(limit)
    cursor = F.struct(F.lit(key).cast("bigint").alias("sort_key"), F.lit(job_id).cast("bigint").alias("job_id"))
    behind = _files(spark, path, sort).where(F.col("last") > cursor).orderBy("start")
    place = behind.limit(1).collect()
    if not place:
        return _ranked(spark, [], 1, 0)
    head = spark.read.schema(_ROWS).parquet(place[0].file).where(F.struct("sort_key", "job_id") <= cursor)
    passed = place[0].start + head.count()
    first, last = passed + 1, passed + limit
    files = behind.where((F.col("start") < last) & (F.col("start") + F.col("rows") >= first)).collect()
    return _ranked(spark, files, first, last)

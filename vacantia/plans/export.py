"""Export of a complete search result with global page numbers."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacantia.operators.filters import Filters
from vacantia.operators.ordering import ordering
from vacantia.plans.search import matching
from vacantia.schema import DEFAULT_LIMIT, DEFAULT_SORT, POSTING_COLUMNS
from vacantia.sources.workspace import stage_sorted


def numbered_result(
    silver: DataFrame,
    filters: Filters = Filters(),
    sort: str = DEFAULT_SORT,
    page_size: int = DEFAULT_LIMIT,
    *,
    partitions: int | None = None,
    ignore_case: bool = False,
) -> DataFrame:
    """Every match once, with its ``rank`` in the result and its ``page_no``.

    One range shuffle on the full order writes the sorted rows; the rank of a row
    is its place within its partition plus the rows of all partitions before it.
    Only one count per partition passes through the driver.
    """
    order = ordering(sort)
    rows = matching(silver, filters.checked(), ignore_case)
    staged = stage_sorted(rows, order.columns(), "export", partitions)
    sizes = sorted((r["part"], r["count"]) for r in staged.groupBy("part").count().collect())
    starts = accumulate((n for _, n in sizes), initial=0)
    offsets = staged.sparkSession.createDataFrame(
        [(part, start) for (part, _), start in zip(sizes, starts)], "part bigint, start bigint"
    )
    rank = F.col("start") + F.col("part_row") + 1
    return (
        staged.join(offsets, "part")
        .withColumn("rank", rank)
        .withColumn("page_no", F.floor((F.col("rank") - 1) / page_size) + 1)
        .select(*POSTING_COLUMNS, "rank", "page_no")
    )


def write_result(numbered: DataFrame, path: str, partition_pages: bool = False) -> int:
    """Write a numbered result and return its row count.

    ``partition_pages`` makes one folder per page and is meant for small results.
    """
    writer = numbered.write.mode("overwrite")
    (writer.partitionBy("page_no") if partition_pages else writer).parquet(path)
    return numbered.sparkSession.read.parquet(path).count()

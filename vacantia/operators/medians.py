"""Exact median per group without holding a group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEVEL_BITS = 22  # one window sees at most 2**22 distinct prefixes of a group
LEVELS = 3  # covers every non-negative value below 2**66


def _narrow(candidates: DataFrame) -> DataFrame:
    """Keep the bucket in which the wanted rank falls; make the rank local to it."""
    running = (
        Window.partitionBy("group", "pick")
        .orderBy("bucket")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    before = F.col("running") - F.col("n")
    return candidates.withColumn("running", F.sum("n").over(running)).where(
        (before <= F.col("rank")) & (F.col("rank") < F.col("running"))
    ).select("group", "pick", "bucket", "total", (F.col("rank") - before).alias("rank"))


def exact_median(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``keys``, ``median`` (double) and ``n`` (rows) per group of ``rows``.

    ``value`` is a non-negative whole number below 2**66, of an integer type or a
    decimal without fraction. NULL values are ignored, as SQL's median does; a group
    without any other value is not returned. Equal values are counted
    first, combined on the map side and shuffled by group and value, so a group
    with a third of all rows spreads over all tasks. The counts are summed over
    two coarser prefixes of the value; walking down from the coarsest prefix, each
    window sees at most 2**LEVEL_BITS rows per group. A group may be NULL.
    """
    return median_of_counts(rows.withColumn("n of the row", F.lit(1).cast("bigint")), keys, value, "n of the row")


def median_of_counts(rows: DataFrame, keys: list[str], value: str, n: str) -> DataFrame:
    """``exact_median`` of rows that each stand for ``n`` equal ones."""
    # A struct is never NULL itself, so NULL groups join by plain equality; with the
    # bucket not nullable either, no join adds a filter and all levels read one shuffle.
    group = F.struct(*keys).alias("group")
    number = F.col(value).cast("decimal(20,0)")
    bucket = F.coalesce(number, F.lit(0).cast("decimal(20,0)")).alias("bucket")
    counted = (
        rows.where(F.col(value).isNotNull())
        .select(group, bucket, F.col(n).alias("n"))
        .groupBy("group", "bucket")
        .agg(F.sum("n").alias("n"))
    )
    zero = F.lit(0).cast("decimal(20,0)")
    prefix = F.coalesce(F.floor(F.col("bucket") / F.lit(1 << LEVEL_BITS)).cast("decimal(20,0)"), zero)
    levels = [counted]
    while len(levels) < LEVELS:
        levels.append(levels[-1].groupBy("group", prefix.alias("bucket")).agg(F.sum("n").alias("n")))

    total = F.sum("n").over(Window.partitionBy("group"))
    middle = F.expr("array_distinct(array((total - 1) div 2, total div 2))")
    found = _narrow(
        levels[-1]
        .withColumn("total", total)
        .select("*", F.explode(middle).alias("rank"))
        .withColumn("pick", F.col("rank"))
    )
    for finer in reversed(levels[:-1]):
        wanted = found.withColumnsRenamed({"group": "of_group", "bucket": "of_bucket"})
        match = (F.col("group") == F.col("of_group")) & (prefix == F.col("of_bucket"))
        found = _narrow(finer.join(wanted, match))
    return (
        found.groupBy("group")
        .agg(F.avg("bucket").cast("double").alias("median"), F.first("total").alias("n"))
        .select("group.*", "median", "n")
    )


def mask_small_groups(value: Column | str, count: Column | str, k: int) -> Column:
    """The value, or NULL when it comes from fewer than ``k`` rows."""
    value = F.col(value) if isinstance(value, str) else value
    count = F.col(count) if isinstance(count, str) else count
    return F.when(count >= k, value)

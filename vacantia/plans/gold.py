"""Silver postings to the long market table."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vacantia.functions.columns import salary_sum
from vacantia.operators.medians import exact_median, median_of_counts
from vacantia.operators.value_counts import add_changes, read_counts
from vacantia.schema import DIMENSIONS, METRIC_COLUMNS

GROUP = ["dimension", "dimension_value"]


def priced_by_dimension(silver: DataFrame, dimensions: tuple[str, ...] = DIMENSIONS, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per posting with both salaries and dimension: the doubled midpoint.

    The sum of the two salaries stands in for their midpoint, which keeps the
    values whole until the end. Columns in ``carry`` come along.
    """
    pairs = F.inline(
        F.array(
            *[
                F.struct(
                    F.lit(name).alias("dimension"),
                    F.col(name).cast("string").alias("dimension_value"),
                )
                for name in dimensions
            ]
        )
    )
    return silver.dropna(subset=["salary_min", "salary_max"]).select(
        pairs, salary_sum().alias("salary_sum"), *carry
    )


def build_gold(
    silver: DataFrame,
    as_of: datetime | None = None,
    dimensions: tuple[str, ...] = DIMENSIONS,
) -> DataFrame:
    """Median representative salary and posting count of every dimension value.

    One scan feeds all dimensions. True values are kept; masking happens on read.
    ``as_of`` is one instant per run, by default the current one.
    """
    return _long_table(exact_median(priced_by_dimension(silver, dimensions), GROUP, "salary_sum"), as_of)


def take_in_changes(changes: DataFrame, path: str, dimensions: tuple[str, ...] = DIMENSIONS) -> None:
    """Bring the stored counts at ``path`` up to date with postings that came (``sign`` 1) or went (-1)."""
    priced = priced_by_dimension(changes, dimensions, carry=("sign",))
    add_changes(priced.select(*GROUP, "salary_sum", F.col("sign").cast("bigint").alias("n")), path)


def gold_of_counts(spark: SparkSession, path: str, as_of: datetime | None = None) -> DataFrame:
    """The market table from the stored counts; no posting is read."""
    return _long_table(median_of_counts(read_counts(spark, path), GROUP, "salary_sum", "n"), as_of)


def _long_table(medians: DataFrame, as_of: datetime | None) -> DataFrame:
    as_of = as_of or datetime.now(timezone.utc)
    return medians.select(
        "dimension",
        "dimension_value",
        (F.col("median") / F.lit(2.0)).alias("median_salary"),
        F.col("n").alias("posting_count"),
        F.lit(as_of).cast("timestamp").alias("as_of"),
    ).select(*METRIC_COLUMNS)

"""Scalar expressions of the posting model, all inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vacantia.schema import URL_PREFIX

def whole_number(column: str | Column, as_type: str = "bigint") -> Column:
    """Text to a non-negative integer of the type; text that is no such number gives NULL."""
    number = F.trim(column).try_cast(as_type)
    return F.when(number >= 0, number)


def salary_sum(low: str = "salary_min", high: str = "salary_max") -> Column:
    """Sum of the offered range, twice its midpoint; as a decimal, so that no sum overflows."""
    return F.col(low).cast("decimal(19,0)") + F.col(high).cast("decimal(19,0)")


def seniority_of(years: str | Column) -> Column:
    """Up to 1 year junior, up to 3 mid, beyond senior; NULL stays NULL."""
    years = F.col(years) if isinstance(years, str) else years
    return (
        F.when(years <= 1, "junior")
        .when(years <= 3, "mid")
        .when(years.isNotNull(), "senior")
    )


def posting_url(job_id: str | Column) -> Column:
    job_id = F.col(job_id) if isinstance(job_id, str) else job_id
    return F.concat(F.lit(URL_PREFIX), job_id.cast("string"))


def representative_salary(low: str = "salary_min", high: str = "salary_max") -> Column:
    """Midpoint of the offered range, as a double."""
    return salary_sum(low, high).cast("double") / F.lit(2.0)


def country_key(country: str | Column = "country") -> Column:
    """A country without regard to case; NULL is ''."""
    return F.lower(F.coalesce(country, F.lit("")))


def key_digest(raw: str | Column) -> Column:
    """SHA-256 hex of a credential."""
    return F.sha2(raw, 256)


def own_shuffle(text: str | Column) -> Column:
    """The same text under another expression.

    A join on it shuffles anew instead of using the partitions that an aggregation or a
    window left. Only such a plain shuffle can be split by the adaptive planner when
    very many rows of the other side have one key.
    """
    return F.concat(text, F.lit(""))


def utc_micros(column: str | Column) -> Column:
    """Microseconds since the epoch; zone-less timestamps are read as UTC.

    What has no time has no place in an order, so NULL is an error.
    """
    column = F.col(column) if isinstance(column, str) else column
    missing = F.raise_error("a row without a time cannot be ordered").cast("bigint")
    return F.coalesce(F.unix_micros(column.cast("timestamp")), missing)

"""Validation of whole tables of requests; every rule is a column expression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantia.schema import (
    DEFAULT_LIMIT,
    DEFAULT_SORT,
    DIMENSIONS,
    FILTER_NAMES,
    MAX_COUNTRY_LENGTH,
    MAX_EXPERIENCE_YEARS,
    MAX_LIMIT,
    MAX_SALARY_FILTER,
    METRICS,
    REQUIRED_FILTERS,
    SENIORITIES,
    SORTS,
)

_NO_FAULT = "struct<code:string,field:string>"


def _fault(test: Column, code: str, field: str | Column) -> Column:
    field = F.lit(field) if isinstance(field, str) else field
    return F.when(test, F.struct(F.lit(code).alias("code"), field.alias("field")))


def _names(values: tuple[str, ...]) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def _not_a_number_in(text: Column, highest: int) -> Column:
    number = text.try_cast("bigint")
    return text.isNotNull() & ~F.coalesce(number.between(0, highest), F.lit(False))


def search_request_fault(required: tuple[str, ...] = REQUIRED_FILTERS) -> Column:
    """First broken rule of a row with ``filters`` map, ``sort`` and ``limit``, or NULL.

    Order: limit too large, unknown filter, missing required filter, then value
    ranges, sort and a limit below one. A filter with a NULL value is not active, and
    a NULL map has no filters.
    """
    given = F.coalesce(F.col("filters"), F.create_map().cast("map<string,string>"))
    filters = F.map_filter(given, lambda _, value: value.isNotNull())
    active = F.map_keys(filters)
    unknown = F.array_min(F.array_except(active, _names(FILTER_NAMES)))
    missing = F.array_min(F.array_except(_names(required), active))
    value = {name: F.try_element_at(filters, F.lit(name)) for name in FILTER_NAMES}
    return F.coalesce(
        _fault(F.col("limit") > MAX_LIMIT, "LIMIT_EXCEEDED", "limit"),
        _fault(unknown.isNotNull(), "INVALID_FILTER", F.concat(F.lit("filters."), unknown)),
        _fault(
            missing.isNotNull(), "MISSING_REQUIRED_FILTER", F.concat(F.lit("filters."), missing)
        ),
        _fault(~value["seniority"].isin(*SENIORITIES), "INVALID_FILTER", "filters.seniority"),
        _fault(
            _not_a_number_in(value["experience_max"], MAX_EXPERIENCE_YEARS),
            "INVALID_FILTER",
            "filters.experience_max",
        ),
        _fault(
            _not_a_number_in(value["salary_min"], MAX_SALARY_FILTER),
            "INVALID_FILTER",
            "filters.salary_min",
        ),
        _fault(
            F.char_length(value["country"]) > MAX_COUNTRY_LENGTH,
            "INVALID_FILTER",
            "filters.country",
        ),
        _fault(~F.col("sort").isin(*SORTS), "INVALID_REQUEST", "sort"),
        _fault(F.col("limit") < 1, "INVALID_REQUEST", "limit"),
        F.lit(None).cast(_NO_FAULT),
    )


def market_request_fault() -> Column:
    """First broken rule of a row with ``dimension`` and ``metric``, or NULL."""
    known_dimension = F.coalesce(F.col("dimension").isin(*DIMENSIONS), F.lit(False))
    known_metric = F.coalesce(F.col("metric").isin(*METRICS), F.lit(False))
    return F.coalesce(
        _fault(~known_dimension, "INVALID_REQUEST", "dimension"),
        _fault(~known_metric, "INVALID_REQUEST", "metric"),
        F.lit(None).cast(_NO_FAULT),
    )


def validate(requests: DataFrame, fault: Column) -> DataFrame:
    """``request_id, ok, code, field`` of every request."""
    return requests.select("request_id", fault.alias("fault")).select(
        "request_id",
        F.col("fault").isNull().alias("ok"),
        F.col("fault.code").alias("code"),
        F.col("fault.field").alias("field"),
    )


def typed_search_requests(requests: DataFrame, fault: Column | None = None) -> DataFrame:
    """The valid requests with one typed column per filter."""
    fault = search_request_fault() if fault is None else fault
    text = {name: F.try_element_at(F.col("filters"), F.lit(name)) for name in FILTER_NAMES}
    return requests.where(fault.isNull()).select(
        "request_id",
        text["seniority"].alias("seniority"),
        text["experience_max"].try_cast("int").alias("experience_max"),
        text["salary_min"].try_cast("bigint").alias("salary_min"),
        text["country"].alias("country"),
        F.coalesce("sort", F.lit(DEFAULT_SORT)).alias("sort"),
        F.coalesce("limit", F.lit(DEFAULT_LIMIT)).cast("int").alias("limit"),
    )

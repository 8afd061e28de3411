"""Posting search: filters, order, keyset page, total."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from vacantia.errors import RequestError
from vacantia.operators.filters import Filters
from vacantia.operators.ordering import ordering
from vacantia.schema import COUNTRY_KEY, DEFAULT_LIMIT, DEFAULT_SORT, MAX_LIMIT, POSTING_COLUMNS


@dataclass(frozen=True)
class Cursor:
    """Key of the last row seen, bound to the search it belongs to."""

    fingerprint: str
    key: int
    job_id: int


@dataclass(frozen=True)
class Page:
    items: list[Row]
    next_cursor: Cursor | None
    total: int | None
    as_of: datetime


def fingerprint(filters: Filters, sort: str, ignore_case: bool = False) -> str:
    """Identity of a search; the page size is not part of it."""
    shape = json.dumps([filters.active(), sort, ignore_case], sort_keys=True)
    return hashlib.sha256(shape.encode()).hexdigest()


def matching(silver: DataFrame, filters: Filters, ignore_case: bool = False) -> DataFrame:
    """All postings that pass the filters, in contract columns.

    Of a stored table read with its key column the country is compared on that.
    """
    stored_key = COUNTRY_KEY if COUNTRY_KEY in silver.columns else None
    return silver.where(filters.predicate(ignore_case, stored_key)).select(*POSTING_COLUMNS)


def count_matching(silver: DataFrame, filters: Filters, ignore_case: bool = False) -> int:
    """Exact number of matches, whatever the page."""
    return matching(silver, filters, ignore_case).count()


def check_limit(limit: int) -> None:
    if limit > MAX_LIMIT:
        raise RequestError("LIMIT_EXCEEDED", f"at most {MAX_LIMIT} rows per page", "limit")
    if limit < 1:
        raise RequestError("INVALID_REQUEST", "at least one row per page", "limit")


def page_rows(
    silver: DataFrame,
    filters: Filters = Filters(),
    sort: str = DEFAULT_SORT,
    limit: int = DEFAULT_LIMIT,
    cursor: Cursor | None = None,
    *,
    extra: int = 0,
    ignore_case: bool = False,
) -> DataFrame:
    """The page as a lazy frame: each task keeps ``limit`` rows, the final merge likewise."""
    check_limit(limit)
    order = ordering(sort)
    rows = matching(silver, filters.checked(), ignore_case)
    if cursor is not None:
        if cursor.fingerprint != fingerprint(filters, sort, ignore_case):
            raise RequestError("INVALID_PAGE_TOKEN", "the cursor belongs to another search", "page_token")
        rows = rows.where(order.after(cursor.key, cursor.job_id))
    return rows.orderBy(*order.columns()).limit(limit + extra)


def search(
    silver: DataFrame,
    filters: Filters = Filters(),
    sort: str = DEFAULT_SORT,
    limit: int = DEFAULT_LIMIT,
    cursor: Cursor | None = None,
    *,
    as_of: datetime | None = None,
    with_total: bool = True,
    ignore_case: bool = False,
) -> Page:
    """One page. At most ``limit`` + 1 rows reach the driver; the extra one tells
    whether more follow."""
    frame = page_rows(silver, filters, sort, limit, cursor, extra=1, ignore_case=ignore_case)
    # Collecting the limit itself would send the best rows of every task to the
    # driver; below the coalesce they are merged on an executor.
    rows = frame.withColumn("sort_key", ordering(sort).key()).coalesce(1).collect()
    items = rows[:limit]
    following = None
    if len(rows) > limit:
        last = items[-1]
        following = Cursor(fingerprint(filters, sort, ignore_case), last["sort_key"], last["job_id"])
    total = count_matching(silver, filters, ignore_case) if with_total else None
    contract = Row(*POSTING_COLUMNS)
    return Page(
        items=[contract(*(row[name] for name in POSTING_COLUMNS)) for row in items],
        next_cursor=following,
        total=total,
        as_of=as_of or datetime.now(timezone.utc),
    )


def with_position(page: DataFrame, sort: str, start: int = 1) -> DataFrame:
    """Add the position within the result; ``page`` must be a limited page."""
    place = F.row_number().over(Window.orderBy(*ordering(sort).columns()))
    return page.withColumn("pos", (place + F.lit(start - 1)).cast("bigint"))

"""The three result orders, their keys and their keyset predicates."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from vacantia.errors import RequestError


@dataclass(frozen=True)
class Ordering:
    """Order by one column, then by ``job_id``; NULL counts as 0."""

    column: str
    descending: bool = False

    def key(self) -> Column:
        """Ascending sort key, negated for a descending order."""
        value = F.coalesce(F.col(self.column), F.lit(0)).cast("bigint")
        return -value if self.descending else value

    def columns(self) -> list[Column]:
        return [self.key().asc(), F.col("job_id").asc()]

    def after(self, key: int, job_id: int) -> Column:
        """Rows strictly behind ``(key, job_id)``, on the bare column so that it is pushed down."""
        column = F.col(self.column)
        value = F.lit(-key if self.descending else key)
        tie = F.col("job_id") > F.lit(job_id)
        beyond = column < value if self.descending else column > value
        behind = beyond | ((column == value) & tie)
        if key < 0:
            return behind | column.isNull()
        if key == 0:
            return behind | (column.isNull() & tie)
        return behind


ORDERINGS = {
    "salary_max_desc": Ordering("salary_max", descending=True),
    "salary_min_asc": Ordering("salary_min"),
    "experience_asc": Ordering("years_exp"),
}


def ordering(sort: str) -> Ordering:
    if sort not in ORDERINGS:
        raise RequestError("INVALID_REQUEST", "unknown sort", "sort")
    return ORDERINGS[sort]

"""Search filters as predicates that reach the scan."""

from __future__ import annotations

from dataclasses import asdict, dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column
from pyspark.sql import functions as F

from vacantia.errors import RequestError
from vacantia.functions.columns import country_key
from vacantia.schema import (
    FILTER_NAMES,
    MAX_COUNTRY_LENGTH,
    MAX_EXPERIENCE_YEARS,
    MAX_SALARY_FILTER,
    REQUIRED_FILTERS,
    SENIORITIES,
)


@dataclass(frozen=True)
class Filters:
    """Optional filters; ``None`` means not applied, all others are ANDed."""

    seniority: str | None = None
    experience_max: int | None = None
    salary_min: int | None = None
    country: str | None = None

    @classmethod
    def of(cls, values: dict, required: tuple[str, ...] = REQUIRED_FILTERS) -> Filters:
        """Filters from a request, refusing unknown and missing names."""
        unknown = sorted(set(values) - set(FILTER_NAMES))
        if unknown:
            raise RequestError("INVALID_FILTER", "unknown filter", f"filters.{unknown[0]}")
        missing = sorted(n for n in required if values.get(n) is None)
        if missing:
            raise RequestError("MISSING_REQUIRED_FILTER", "filter required", f"filters.{missing[0]}")
        return cls(**values).checked()

    def active(self) -> dict:
        return {name: value for name, value in asdict(self).items() if value is not None}

    def checked(self) -> Filters:
        """Self, if every active value lies in its range."""
        valid = {
            "seniority": lambda v: v in SENIORITIES,
            "experience_max": lambda v: 0 <= v <= MAX_EXPERIENCE_YEARS,
            "salary_min": lambda v: 0 <= v <= MAX_SALARY_FILTER,
            "country": lambda v: len(v) <= MAX_COUNTRY_LENGTH,
        }
        for name, value in self.active().items():
            if not valid[name](value):
                raise RequestError("INVALID_FILTER", "value out of range", f"filters.{name}")
        return self

    def predicate(self, ignore_case: bool = False, stored_key: str | None = None) -> Column:
        """Conjunction of the active filters on bare columns, values as literals.

        ``salary_min`` asks for postings whose upper salary reaches the value. A country is
        compared without regard to case on the column ``stored_key`` where the table has one.
        """
        tests = []
        if self.seniority is not None:
            tests.append(F.col("seniority") == F.lit(self.seniority))
        if self.experience_max is not None:
            tests.append(F.col("years_exp") <= F.lit(self.experience_max))
        if self.salary_min is not None:
            tests.append(F.col("salary_max") >= F.lit(self.salary_min))
        if self.country is not None:
            if ignore_case:
                country = F.col(stored_key) if stored_key else country_key()
                # Both sides by the same function: its lower case need not be Python's.
                tests.append(country == country_key(F.lit(self.country)))
            else:
                tests.append(F.col("country") == F.lit(self.country))
        return reduce(and_, tests, F.lit(True))

import random

import pytest

from conftest import random_postings
from vacantia.errors import RequestError
from vacantia.operators.filters import Filters
from vacantia.operators.ordering import ORDERINGS
from vacantia.plans.search import Cursor, count_matching, fingerprint, search
from vacantia.schema import POSTING_COLUMNS


def ids(page):
    return [row["job_id"] for row in page.items]


@pytest.mark.parametrize(
    ("filters", "expected"),
    [
        ({"country": "Denmark"}, [1, 3]),
        ({"seniority": "senior"}, [1]),
        ({"salary_min": 70_000}, [1, 2]),
        ({"experience_max": 3}, [2, 3]),
        ({"experience_max": 3, "country": "Denmark"}, [3]),
        ({"country": "denmark"}, []),
        ({"country": ""}, []),
        ({"country": "Denmark'; DROP TABLE postings; --"}, []),
        ({"country": "O'Hare"}, []),
        ({}, [1, 2, 3]),
    ],
)
def test_filters(three, filters, expected):
    page = search(three, Filters.of(filters))
    assert ids(page) == expected
    assert page.total == len(expected)
    assert page.next_cursor is None


def test_country_without_case(three):
    assert ids(search(three, Filters(country="denmark"), ignore_case=True)) == [1, 3]


def test_contract_columns_only(three):
    wide = three.selectExpr("*", "'x' AS email")
    assert list(search(wide).items[0].asDict()) == POSTING_COLUMNS


@pytest.mark.parametrize(
    ("filters", "code", "field"),
    [
        ({"city": "HN"}, "INVALID_FILTER", "filters.city"),
        ({"seniority": "lead+"}, "INVALID_FILTER", "filters.seniority"),
        ({"experience_max": 51}, "INVALID_FILTER", "filters.experience_max"),
        ({"salary_min": -1}, "INVALID_FILTER", "filters.salary_min"),
        ({"country": "x" * 101}, "INVALID_FILTER", "filters.country"),
    ],
)
def test_refused_filters(filters, code, field):
    with pytest.raises(RequestError) as error:
        Filters.of(filters)
    assert (error.value.code, error.value.field) == (code, field)


def test_required_filter():
    with pytest.raises(RequestError) as error:
        Filters.of({}, required=("country",))
    assert error.value.code == "MISSING_REQUIRED_FILTER"
    assert Filters.of({"country": "DK"}, required=("country",)).country == "DK"


@pytest.mark.parametrize(("limit", "code"), [(101, "LIMIT_EXCEEDED"), (0, "INVALID_REQUEST")])
def test_refused_limits(three, limit, code):
    with pytest.raises(RequestError) as error:
        search(three, limit=limit)
    assert (error.value.code, error.value.field) == (code, "limit")


def test_refused_sort(three):
    with pytest.raises(RequestError):
        search(three, sort="newest")


def test_cursor_belongs_to_its_search(three):
    cursor = search(three, limit=1).next_cursor
    for filters, sort in ((Filters(seniority="mid"), "salary_max_desc"), (Filters(), "experience_asc")):
        with pytest.raises(RequestError) as error:
            search(three, filters, sort, cursor=cursor)
        assert error.value.code == "INVALID_PAGE_TOKEN"


@pytest.mark.parametrize("sort", ORDERINGS)
def test_walk_with_changing_page_size_is_the_full_sort(spark, sort):
    rng = random.Random(7)
    silver = random_postings(spark, rng, 60).cache()
    key = {
        "salary_max_desc": lambda r: (-(r["salary_max"] or 0), r["job_id"]),
        "salary_min_asc": lambda r: (r["salary_min"] or 0, r["job_id"]),
        "experience_asc": lambda r: (r["years_exp"], r["job_id"]),
    }[sort]
    expected = [r["job_id"] for r in sorted(silver.collect(), key=key)]
    seen, cursor = [], None
    while True:
        page = search(silver, sort=sort, limit=rng.randint(5, 14), cursor=cursor, with_total=False)
        seen += ids(page)
        cursor = page.next_cursor
        if cursor is None:
            break
    assert seen == expected


def test_cursor_within_the_zero_key(spark):
    silver = random_postings(spark, random.Random(3), 80, salaries=2)
    zero = sorted(r["job_id"] for r in silver.where("coalesce(salary_max, 0) = 0").collect())
    middle = zero[len(zero) // 2]
    cursor = Cursor(fingerprint(Filters(), "salary_max_desc"), 0, middle)
    page = search(silver, limit=100, cursor=cursor)
    assert ids(page) == [i for i in zero if i > middle]
    assert page.total == count_matching(silver, Filters()) == 80

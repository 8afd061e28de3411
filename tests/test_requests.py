import random

import pytest
from pyspark.sql import Row

from conftest import postings, random_postings
from vacantia.operators import saved_searches
from vacantia.operators.filters import Filters
from vacantia.operators.ordering import ORDERINGS
from vacantia.operators.requests import (
    market_request_fault,
    search_request_fault,
    typed_search_requests,
    validate,
)
from vacantia.operators.saved_searches import saved_search_hits, saved_search_totals
from vacantia.plans.search import search

REQUESTS = "request_id bigint, filters map<string,string>, sort string, limit int"
SEARCHES = (
    "request_id bigint, seniority string, experience_max int, salary_min bigint,"
    " country string, sort string, limit int"
)

CASES = [
    ({}, "salary_max_desc", 20, None),
    ({"city": "HN", "area": "x"}, "salary_max_desc", 101, ("LIMIT_EXCEEDED", "limit")),
    ({"city": "HN", "area": "x"}, "newest", 0, ("INVALID_FILTER", "filters.area")),
    ({"seniority": "lead+"}, "salary_max_desc", 20, ("INVALID_FILTER", "filters.seniority")),
    ({"experience_max": "51"}, "salary_max_desc", 20, ("INVALID_FILTER", "filters.experience_max")),
    ({"experience_max": "many"}, "salary_max_desc", 20, ("INVALID_FILTER", "filters.experience_max")),
    ({"salary_min": "-1"}, "salary_max_desc", 20, ("INVALID_FILTER", "filters.salary_min")),
    ({"salary_min": "1000000000"}, "salary_max_desc", 20, None),
    ({"salary_min": "1000000001"}, "salary_max_desc", 20, ("INVALID_FILTER", "filters.salary_min")),
    ({"country": "x" * 100}, "salary_max_desc", 20, None),
    ({"country": "x" * 101}, "salary_max_desc", 20, ("INVALID_FILTER", "filters.country")),
    ({"country": None}, "salary_max_desc", 20, None),
    ({}, "newest", 20, ("INVALID_REQUEST", "sort")),
    ({}, "salary_max_desc", 0, ("INVALID_REQUEST", "limit")),
    (None, None, None, None),
    (None, "newest", 20, ("INVALID_REQUEST", "sort")),
]


def test_search_rules(spark):
    rows = [(i, filters, sort, limit) for i, (filters, sort, limit, _) in enumerate(CASES)]
    found = validate(spark.createDataFrame(rows, REQUESTS), search_request_fault()).collect()
    faults = {r["request_id"]: None if r["ok"] else (r["code"], r["field"]) for r in found}
    assert faults == {i: case[3] for i, case in enumerate(CASES)}


def test_required_filters(spark):
    rows = [(1, {}, None, None), (2, {"country": "DK"}, None, None), (3, {"city": "x"}, None, None), (4, None, None, None)]
    fault = search_request_fault(required=("country",))
    found = validate(spark.createDataFrame(rows, REQUESTS), fault).collect()
    assert {r["request_id"]: r["code"] for r in found} == {
        1: "MISSING_REQUIRED_FILTER", 2: None, 3: "INVALID_FILTER", 4: "MISSING_REQUIRED_FILTER"
    }


def test_market_rules(spark):
    rows = [(1, "seniority", "median_salary"), (2, "email", "x"), (3, "country", "avg"), (4, None, None)]
    df = spark.createDataFrame(rows, "request_id bigint, dimension string, metric string")
    found = validate(df, market_request_fault()).collect()
    assert {r["request_id"]: r["field"] for r in found} == {1: None, 2: "dimension", 3: "metric", 4: "dimension"}


def test_typed_requests_have_defaults(spark):
    df = spark.createDataFrame([(1, {"salary_min": "5"}, None, None), (2, {"x": "y"}, None, None)], REQUESTS)
    assert typed_search_requests(df).collect() == [
        Row(request_id=1, seniority=None, experience_max=None, salary_min=5, country=None,
            sort="salary_max_desc", limit=20)
    ]


def odd_postings(spark):
    """Negative, missing and enormous salaries; experience below 0 and beyond any limit."""
    salaries = [5, 0, -1, -5, None, 100, 10**9, 10**9 + 1, 2**63 - 1]
    rows = [(1000 + i, "t", "c", "DK", "mid", y, 1, s) for i, (s, y) in enumerate(zip(salaries, [0, -3, 50, 51, 70, 2, 3, 49, 1]))]
    return postings(spark, rows)


def test_saved_searches_equal_single_searches(spark):
    rng = random.Random(11)
    silver = random_postings(spark, rng, 400, hot=120).union(odd_postings(spark)).cache()
    searches = [
        (
            i,
            rng.choice([None, None, "junior", "mid", "senior"]),
            rng.choice([None, None, 0, 2, 4, 50]),
            rng.choice([None, None, 0, 1, 5, 11, 12, 1_000_000_000]),
            rng.choice([None, None, "DK", "SE", "dk"]),
            rng.choice(list(ORDERINGS)),
            rng.choice([1, 7, 100]),
        )
        for i in range(40)
    ]
    searches += [(100 + i, None, None, None, None, sort, 100) for i, sort in enumerate(ORDERINGS)]
    searches += [(200 + i, None, y, s, None, "experience_asc", 100) for i, (y, s) in enumerate([(50, None), (None, 0), (50, 10**9), (49, 5)])]
    df = spark.createDataFrame(searches, SEARCHES)
    hits = {}
    for row in saved_search_hits(df, silver).collect():
        hits.setdefault(row["request_id"], []).append((row["pos"], row["job_id"]))
    totals = {r["request_id"]: r["total"] for r in saved_search_totals(df, silver).collect()}
    assert totals.keys() == {row[0] for row in searches}
    rows = silver.collect()
    for request_id, seniority, years, salary, country, sort, limit in searches:
        chosen = [
            p for p in rows
            if (seniority is None or p["seniority"] == seniority)
            and (years is None or p["years_exp"] <= years)
            and (salary is None or (p["salary_max"] is not None and p["salary_max"] >= salary))
            and (country is None or p["country"] == country)
        ]
        key = {
            "salary_max_desc": lambda p: (-(p["salary_max"] or 0), p["job_id"]),
            "salary_min_asc": lambda p: (p["salary_min"] or 0, p["job_id"]),
            "experience_asc": lambda p: (p["years_exp"], p["job_id"]),
        }[sort]
        expected = [p["job_id"] for p in sorted(chosen, key=key)][:limit]
        assert totals[request_id] == len(chosen)
        assert [job for _, job in sorted(hits.get(request_id, []))] == expected
        assert [pos for pos, _ in sorted(hits.get(request_id, []))] == list(range(1, len(expected) + 1))


def test_saved_search_is_the_search_page(spark):
    silver = random_postings(spark, random.Random(2), 120).cache()
    df = spark.createDataFrame([(1, "mid", None, 3, "DK", "salary_min_asc", 5)], SEARCHES)
    page = search(silver, Filters(seniority="mid", salary_min=3, country="DK"), "salary_min_asc", 5)
    hits = saved_search_hits(df, silver).orderBy("pos").collect()
    assert [r["job_id"] for r in hits] == [r["job_id"] for r in page.items]
    assert saved_search_totals(df, silver).first()["total"] == page.total


@pytest.mark.parametrize("salaries", [4, 3000])
def test_hopeless_postings_are_ruled_out_without_changing_a_page(spark, monkeypatch, salaries):
    rng = random.Random(salaries)
    silver = random_postings(spark, rng, 6000, countries=("DK", None), salaries=salaries, hot=2000).cache()
    sorts = list(ORDERINGS)
    searches = [
        (i, rng.choice([None, "mid"]), rng.choice([None, 4]), rng.choice([None, 0, 2, 900, 2500]),
         rng.choice([None, "DK"]), sorts[i % 3], 100)
        for i in range(24)
    ]
    df = spark.createDataFrame(searches, SEARCHES)
    found = sorted(map(tuple, saved_search_hits(df, silver).collect()))

    counts = []

    def spy(placed):
        kept = original(placed)
        counts.append((placed.count(), kept.count()))
        return kept

    original = saved_searches._promising
    monkeypatch.setattr(saved_searches, "_promising", spy)
    saved_search_hits(df, silver).count()
    assert counts[0][1] < counts[0][0]

    monkeypatch.setattr(saved_searches, "_promising", lambda placed: placed)
    assert found == sorted(map(tuple, saved_search_hits(df, silver).collect()))
    for request_id, seniority, years, salary, country, sort, limit in searches:
        filters = Filters(seniority, years, salary, country)
        page = [r["job_id"] for r in search(silver, filters, sort, limit, with_total=False).items]
        assert [job for request, _, job in found if request == request_id] == page


def test_no_searches_and_no_postings(spark, three):
    df = spark.createDataFrame([(1, None, None, 5, None, "salary_min_asc", 5)], SEARCHES)
    assert saved_search_hits(df, three.limit(0)).count() == 0
    assert saved_search_totals(df, three.limit(0)).first()["total"] == 0
    assert saved_search_hits(df.limit(0), three).count() == 0
    assert saved_search_totals(df.limit(0), three).count() == 0


@pytest.mark.parametrize("column, value", [("limit", 101), ("limit", 0), ("limit", None), ("experience_max", 51), ("experience_max", -1), ("salary_min", -1), ("salary_min", 10**9 + 1)])
def test_searches_outside_the_contract_stop_the_job(spark, three, column, value):
    search_row = {"request_id": 1, "seniority": None, "experience_max": 3, "salary_min": 5, "country": None, "sort": "salary_min_asc", "limit": 5}
    df = spark.createDataFrame([tuple((search_row | {column: value}).values())], SEARCHES)
    for answer in (saved_search_hits, saved_search_totals):
        with pytest.raises(Exception, match=column):
            answer(df, three).collect()


def test_any_number_of_bounds(spark):
    silver = random_postings(spark, random.Random(5), 300, salaries=9000).cache()
    df = spark.range(6000).selectExpr(
        "id request_id", "cast(null as string) seniority", "cast(null as int) experience_max", "id salary_min",
        "cast(null as string) country", "'salary_max_desc' sort", "1 limit",
    )
    upper = sorted(r["salary_max"] for r in silver.collect() if r["salary_max"] is not None)
    from bisect import bisect_left

    totals = saved_search_totals(df, silver).collect()
    assert len(totals) == 6000
    assert all(r["total"] == len(upper) - bisect_left(upper, r["request_id"]) for r in totals)


def test_totals_merge_what_grows_with_the_searches(spark):
    """A broadcast of cells or of shapes passes through the driver."""
    edges = [0, 1, 2, 1023, 1024, 1025, 2**20 - 1, 2**20, 2**20 + 1, 10**9 - 2**20, 10**9 - 1024, 10**9 - 1, 10**9, 10**9 + 1, None, -1]
    silver = postings(spark, [(i, "t", "c", "DK", "mid", i % 4, 1, salary) for i, salary in enumerate(edges)])
    bounds = [salary for salary in edges if salary is not None and 0 <= salary <= 10**9]
    searches = [(2 * i + j, None, years, salary, None, "experience_asc", 1) for i, salary in enumerate([*bounds, None]) for j, years in enumerate((None, 1))]
    totals = saved_search_totals(spark.createDataFrame(searches, SEARCHES), silver)
    found = {r["request_id"]: r["total"] for r in totals.collect()}
    assert "Broadcast" not in totals._jdf.queryExecution().executedPlan().toString()
    for request_id, _, years, bound, *_ in searches:
        assert found[request_id] == sum(
            (years is None or i % 4 <= years) and (bound is None or (salary is not None and salary >= bound)) for i, salary in enumerate(edges)
        )

import random

import pytest

from conftest import random_postings
from vacantia.operators.filters import Filters
from vacantia.operators.ordering import ORDERINGS
from vacantia.plans.export import numbered_result, write_result
from vacantia.plans.search import search
from vacantia.sources.workspace import stage_sorted


def expected_ids(silver, sort):
    key = {
        "salary_max_desc": lambda r: (-(r["salary_max"] or 0), r["job_id"]),
        "salary_min_asc": lambda r: (r["salary_min"] or 0, r["job_id"]),
        "experience_asc": lambda r: (r["years_exp"], r["job_id"]),
    }[sort]
    return [r["job_id"] for r in sorted(silver.collect(), key=key)]


@pytest.mark.parametrize("sort", ORDERINGS)
@pytest.mark.parametrize("partitions", [None, 1, 7])
def test_ranks_and_pages(spark, sort, partitions):
    silver = random_postings(spark, random.Random(5), 150, hot=50).cache()
    numbered = numbered_result(silver, sort=sort, page_size=20, partitions=partitions)
    rows = sorted(numbered.collect(), key=lambda r: r["rank"])
    assert [r["rank"] for r in rows] == list(range(1, 151))
    assert [r["job_id"] for r in rows] == expected_ids(silver, sort)
    assert [r["page_no"] for r in rows] == [(i // 20) + 1 for i in range(150)]


def test_hot_key_is_spread(spark):
    """All rows share one sort key; the range shuffle still fills every partition."""
    silver = random_postings(spark, random.Random(5), 4000, hot=4000)
    order = ORDERINGS["salary_max_desc"].columns()
    sizes = [r["count"] for r in stage_sorted(silver, order, "t", 4).groupBy("part").count().collect()]
    assert len(sizes) == 4 and max(sizes) < 2000


def test_first_page_is_the_search_page(spark):
    silver = random_postings(spark, random.Random(6), 80).cache()
    filters = Filters(country="DK", experience_max=4)
    page = [r["job_id"] for r in search(silver, filters, limit=10).items]
    numbered = numbered_result(silver, filters, page_size=10).where("page_no = 1").orderBy("rank")
    assert [r["job_id"] for r in numbered.collect()] == page


def test_empty_result(spark, three):
    assert numbered_result(three, Filters(country="nowhere")).count() == 0


def test_write(spark, three, tmp_path):
    numbered = numbered_result(three, page_size=2)
    assert write_result(numbered, str(tmp_path / "flat")) == 3
    assert write_result(numbered, str(tmp_path / "paged"), partition_pages=True) == 3
    assert (tmp_path / "paged" / "page_no=2").is_dir()

import random
from pathlib import Path

import pytest

from conftest import random_postings
from vacantia.errors import RequestError
from vacantia.operators.filters import Filters
from vacantia.operators.ordering import ORDERINGS
from vacantia.plans.export import numbered_result
from vacantia.sources.rank_index import build_rank_index, page_behind, page_by_number


def plain(df):
    return sorted((r["rank"], r["page_no"], r["job_id"], r["salary_max"]) for r in df.collect())


@pytest.mark.parametrize("sort", ORDERINGS)
def test_pages_are_those_of_the_export(spark, tmp_path, sort):
    silver = random_postings(spark, random.Random(3), 500, hot=200)
    path = str(tmp_path / "index")
    assert build_rank_index(silver, path, sort, rows_per_file=37) == 500
    whole = plain(numbered_result(silver, sort=sort, page_size=20))
    for number in (1, 2, 13, 25, 26):
        page = page_by_number(spark, path, number, sort)
        assert plain(page) == [row for row in whole if row[1] == number]
        # However far down it lies, a page reads the files that hold it.
        assert len(page.inputFiles()) <= 2
    for row in (whole[0], whole[99], whole[-21], whole[-1]):
        key = next(r for r in silver.where(f"job_id = {row[2]}").withColumn("k", ORDERINGS[sort].key()).collect())["k"]
        found = page_behind(spark, path, key, row[2], sort, limit=50).collect()
        assert sorted((r["rank"], r["job_id"]) for r in found) == [(r[0], r[2]) for r in whole if row[0] < r[0] <= row[0] + 50]


def test_an_index_of_a_search_and_its_refresh(spark, tmp_path):
    silver = random_postings(spark, random.Random(5), 120)
    path = str(tmp_path / "index")
    build_rank_index(silver, path, filters=Filters(seniority="mid"), rows_per_file=10)
    wanted = [r for r in plain(numbered_result(silver, Filters(seniority="mid"), page_size=7)) if r[1] == 3]
    assert plain(page_by_number(spark, path, 3, page_size=7)) == wanted
    assert build_rank_index(silver.where("job_id < 3"), path) == 2
    assert page_by_number(spark, path, 1).count() == 2
    assert len(list(Path(path, "salary_max_desc", "versions").iterdir())) == 2
    assert build_rank_index(silver.limit(0), path) == 0
    assert page_by_number(spark, path, 1).count() == 0 == page_behind(spark, path, 0, 0).count()


def test_bad_pages_are_refused(spark, tmp_path):
    for number, size in ((0, 20), (1, 0), (1, 101)):
        with pytest.raises(RequestError):
            page_by_number(spark, str(tmp_path), number, page_size=size)
    with pytest.raises(RequestError):
        build_rank_index(random_postings(spark, random.Random(1), 3), str(tmp_path), "newest")

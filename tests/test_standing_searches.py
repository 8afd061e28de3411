import random

from pyspark.sql import functions as F

from conftest import random_postings
from vacantia.operators import saved_searches
from vacantia.operators.ordering import ORDERINGS
from vacantia.operators.saved_searches import saved_search_hits
from vacantia.operators.standing_searches import read_standing_hits, start_standing_searches, update_standing_searches

SEARCHES = "request_id int, seniority string, experience_max int, salary_min long, country string, sort string, limit int"


def some_searches(spark, rng, n=40):
    rows = [
        (
            i,
            rng.choice([None, "junior", "senior"]),
            rng.choice([None, 1, 4]),
            rng.choice([None, 0, 6]),
            rng.choice([None, "DK", "SE", "nowhere"]),
            rng.choice(list(ORDERINGS)),
            rng.choice([1, 3, 20, 100]),
        )
        for i in range(n)
    ]
    return spark.createDataFrame(rows, SEARCHES)


def changes_of(before, after):
    came = after.exceptAll(before).withColumn("sign", F.lit(1))
    return came.unionByName(before.exceptAll(after).withColumn("sign", F.lit(-1)))


def pages(df):
    return sorted((r.request_id, r.pos, r.job_id) for r in df.collect())


def test_pages_after_every_change_are_those_of_a_full_run(spark, tmp_path):
    rng = random.Random(2)
    path = str(tmp_path / "hits")
    searches = some_searches(spark, rng).cache()
    silver = random_postings(spark, rng, 150).cache()
    start_standing_searches(searches, silver, path)
    assert pages(read_standing_hits(spark, path)) == pages(saved_search_hits(searches, silver))
    n, refilled = F.col("job_id"), []
    steps = (
        lambda s: s.unionByName(random_postings(spark, rng, 20).withColumn("job_id", n + 1000)),  # rows came
        lambda s: s.where(n % 5 != 2),  # rows went
        lambda s: s.withColumn("salary_max", F.when(n % 7 == 1, n % 13).otherwise(F.col("salary_max"))),  # rows changed
        lambda s: s.limit(0),
    )
    for step in steps:
        after = spark.createDataFrame(step(silver).collect(), silver.schema).cache()
        refilled.append(update_standing_searches(searches, after, changes_of(silver, after), path))
        assert pages(read_standing_hits(spark, path)) == pages(saved_search_hits(searches, after))
        silver = after
    # What came can only push rows off a page; what went can leave a gap.
    assert refilled[0] == 0 < refilled[1] < 40


def test_nothing_changed_and_no_searches(spark, three, tmp_path):
    path = str(tmp_path / "hits")
    searches = some_searches(spark, random.Random(1), 5)
    start_standing_searches(searches, three, path)
    before = pages(read_standing_hits(spark, path))
    assert update_standing_searches(searches, three, three.limit(0).withColumn("sign", F.lit(1)), path) == 0
    assert pages(read_standing_hits(spark, path)) == before
    start_standing_searches(searches.limit(0), three, path)
    assert read_standing_hits(spark, path).count() == 0


def test_postings_between_asked_bounds_are_cut_before_they_are_widened(spark, monkeypatch):
    rng, counts, real = random.Random(5), {}, saved_searches.stage

    def counting(df, name):
        staged = real(df, name)
        counts[name] = staged.count()
        return staged

    monkeypatch.setattr(saved_searches, "stage", counting)
    asked = [(level, years, low) for level in (None, "mid") for years in (None, 3) for low in (None, 0, 4, 5, 9)]
    rows = [(i, level, years, low, None, sort, 100) for i, (level, years, low, sort) in enumerate((*a, s) for a in asked for s in ORDERINGS)]
    silver = random_postings(spark, rng, 9000, countries=("DK",)).cache()
    hits = saved_search_hits(spark.createDataFrame(rows, SEARCHES), silver)
    postings, want = silver.collect(), []
    for i, level, years, low, _, sort, limit in rows:
        order = ORDERINGS[sort]
        found = sorted(
            ((getattr(p, order.column) or 0) * (-1 if order.descending else 1), p.job_id)
            for p in postings
            if level in (None, p.seniority)
            and (years is None or p.years_exp <= years)
            and (low is None or (p.salary_max is not None and p.salary_max >= low))
        )
        want += [(i, pos, job_id) for pos, (_, job_id) in enumerate(found[:limit], 1)]
    assert pages(hits) == sorted(want)
    # Seven years, three orders, four stretches between bounds and the postings that no bound accepts.
    assert counts["short-lists"] <= 7 * 3 * 5 * 100 < 3 * 9000


def test_searches_that_ask_the_same_share_a_page(spark, tmp_path):
    rng, path = random.Random(7), str(tmp_path / "hits")
    rows = [(i, "mid", None, 3, None, "salary_min_asc", limit) for i, limit in enumerate((2, 5, 100, 5))]
    searches = spark.createDataFrame(rows, SEARCHES)
    silver = random_postings(spark, rng, 200).cache()
    start_standing_searches(searches, silver, path)
    assert pages(read_standing_hits(spark, path)) == pages(saved_search_hits(searches, silver))
    stored = spark.read.parquet(f"{path}/versions/*/pages")
    assert stored.groupBy("page_id").count().count() == 1
    after = silver.where(F.col("job_id") % 3 != 0).cache()
    update_standing_searches(searches, after, changes_of(silver, after), path)
    assert pages(read_standing_hits(spark, path)) == pages(saved_search_hits(searches, after))


def test_searches_that_share_an_id_share_a_page(spark, tmp_path):
    path = str(tmp_path / "hits")
    row = (1, "mid", None, None, None, "salary_min_asc", 4)
    searches = spark.createDataFrame([row, row, (2, *row[1:])], SEARCHES)
    silver = random_postings(spark, random.Random(8), 60).cache()
    start_standing_searches(searches, silver, path)
    assert pages(read_standing_hits(spark, path)) == pages(saved_search_hits(searches, silver))
    assert update_standing_searches(searches, silver, silver.limit(0).withColumn("sign", F.lit(1)), path) == 0
    first = [(pos, job_id) for i, pos, job_id in pages(read_standing_hits(spark, path)) if i == 2]
    # The rows of both searches are numbered together, once for each of them.
    both = [(pos + 1, first[pos // 2][1]) for pos in range(4) for _ in range(2)]
    assert [(pos, job_id) for i, pos, job_id in pages(read_standing_hits(spark, path)) if i == 1] == both

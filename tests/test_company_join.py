import random
import uuid

import pytest

from vacantia.plans.silver import build_silver, build_silver_with_faults
from vacantia.sources.bucketed import SALT, read_for_join, store_for_join

POSTS = "id_jobpost int, id_company int, jobtitle string, minimumsalary string, maximumsalary string, experience string, qualification string"
COMPANIES = "id_company int, companyname string, country string, email string"


def tables(spark, seed=1, posts=400):
    rng = random.Random(seed)
    key = lambda: rng.choice([7, 7, 7, rng.randint(0, 30), None])
    rows = [(i, key(), "t", "1", "2", "3", "q") for i in range(posts)]
    known = [(k, f"c{k}", "DK", "x@y") for k in range(28)] + [(7, "again", "SE", "x@y"), (None, "nobody", "NO", "x@y")]
    return spark.createDataFrame(rows, POSTS).repartition(5), spark.createDataFrame(known, COMPANIES)


def plain(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture
def names(spark):
    made = [f"{name}_{uuid.uuid4().hex}" for name in ("posts", "companies")]
    yield made
    for name in made:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def test_stored_tables_are_merged_without_a_shuffle(spark, tmp_path, names):
    posts, companies = tables(spark)
    store_for_join(posts, companies, *names, str(tmp_path), buckets=8)
    stored = read_for_join(spark, *names)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        silver = build_silver(*stored)
        assert plain(silver) == plain(build_silver(posts, companies))
        plan = spark._jvm.PythonSQLUtils.explainString(silver._jdf.queryExecution(), "simple")
        assert "SortMergeJoin" in plan and "Exchange" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    # The postings of the busy company are dealt over several buckets.
    assert stored[0].where("id_company = 7").select(SALT).distinct().count() > 3
    assert stored[0].where("id_company <> 7").select(SALT).distinct().count() == 1
    assert stored[0].count() == 400


def test_what_the_join_loses_and_multiplies_is_told(spark):
    posts, companies = tables(spark)
    silver, faults = build_silver_with_faults(posts, companies)
    assert plain(silver) == plain(build_silver(posts, companies))
    found = {r.id_company: (r.fault, r.postings, r.companies) for r in faults.collect()}
    counts = {r.id_company: r["count"] for r in posts.groupBy("id_company").count().collect()}
    assert found == {
        k: ("repeated" if k == 7 else "orphan", n, 2 if k == 7 else 0) for k, n in counts.items() if k is None or k >= 28 or k == 7
    }


def test_empty_sides(spark, tmp_path, names):
    posts, companies = tables(spark)
    silver, faults = build_silver_with_faults(posts.limit(0), companies)
    assert silver.count() == 0 == faults.count()
    silver, faults = build_silver_with_faults(posts, companies.limit(0))
    assert silver.count() == 0 and faults.where("fault <> 'orphan'").count() == 0
    store_for_join(posts.limit(0), companies, *names, str(tmp_path), buckets=2)
    assert build_silver(*read_for_join(spark, *names)).count() == 0

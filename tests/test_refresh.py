import random

import pytest
from pyspark.sql import functions as F

from conftest import postings, random_postings
from vacantia.errors import ContractError
from vacantia.operators.value_counts import read_counts
from vacantia.plans.gold import build_gold, gold_of_counts, take_in_changes
from vacantia.sources.buckets import (
    bucket_folders,
    changes_between,
    read_broken,
    read_bucketed,
    refresh_postings,
)

from test_tables import bad_rows


def plain(df):
    return sorted(map(tuple, df.collect()), key=str)


def changed(silver):
    """Some postings go, some change, some come, one loses its country."""
    n = F.col("job_id")
    kept = silver.where(n % 50 != 7).withColumns(
        {
            "salary_max": F.when(n % 40 == 3, F.lit(99)).otherwise(F.col("salary_max")),
            "country": F.when(n == 11, F.lit(None)).otherwise(F.col("country")),
        }
    )
    came = silver.where(n % 60 == 5).withColumn("job_id", n + 100_000)
    return kept.unionByName(came)


def test_a_refresh_rewrites_only_what_changed(spark, tmp_path):
    path = str(tmp_path / "silver")
    silver = random_postings(spark, random.Random(1), 400).cache()
    first = refresh_postings(silver, path, buckets=64, cluster_by=("country",))
    assert (first.rows, first.inserted, first.deleted) == (400, 400, 0)
    assert plain(read_bucketed(spark, path)) == plain(silver)
    old = bucket_folders(spark, path)

    same = refresh_postings(silver, path)
    assert (same.rewritten, same.inserted, same.deleted) == ([], 0, 0)
    assert bucket_folders(spark, path) == old

    after = changed(silver)
    second = refresh_postings(after, path)
    assert plain(read_bucketed(spark, path)) == plain(after)
    assert plain(read_bucketed(spark, path, first.version)) == plain(silver)
    new = bucket_folders(spark, path)
    assert {b for b in old if old[b] != new.get(b)} == set(second.rewritten) and 0 < len(second.rewritten) < len(old)
    gone = {tuple(r) for r in silver.collect()} - {tuple(r) for r in after.collect()}
    came = {tuple(r) for r in after.collect()} - {tuple(r) for r in silver.collect()}
    assert (second.inserted, second.deleted) == (len(came), len(gone))
    moved = changes_between(spark, path, first.version)
    assert {tuple(r[:-1]) for r in moved.where("sign = 1").collect()} == came
    assert {tuple(r[:-1]) for r in moved.where("sign = -1").collect()} == gone

    none = refresh_postings(silver.limit(0), path)
    assert none.rows == 0 and read_bucketed(spark, path).count() == 0
    assert refresh_postings(silver, path).rows == 400


def test_nulls_are_told_apart_and_copies_are_counted(spark, tmp_path):
    path = str(tmp_path / "silver")
    a = postings(spark, [(1, "t", "c", None, "mid", 2, 5, None), (2, "t", "c", "DK", "mid", 2, 1, 2), (2, "t", "c", "DK", "mid", 2, 1, 2)])
    b = postings(spark, [(1, "t", "c", None, "mid", 2, None, 5), (2, "t", "c", "DK", "mid", 2, 1, 2)])
    first = refresh_postings(a, path, buckets=4)
    second = refresh_postings(b, path)
    assert (second.rows, second.inserted, second.deleted) == (2, 1, 2)
    signs = [(r["job_id"], r["sign"]) for r in changes_between(spark, path, first.version).collect()]
    assert sorted(signs) == [(1, -1), (1, 1), (2, -1)]
    assert changes_between(spark, path, None, first.version).count() == 3


def test_broken_rows_stop_a_refresh_or_are_set_aside(spark, three, tmp_path):
    path = str(tmp_path / "silver")
    refresh_postings(three, path, buckets=3)
    with pytest.raises(ContractError, match="posting 2"):
        refresh_postings(bad_rows(spark), path)
    assert plain(read_bucketed(spark, path)) == plain(three)
    assert refresh_postings(bad_rows(spark), path, on_bad="quarantine").rows == 1
    assert [r["job_id"] for r in read_bucketed(spark, path).collect()] == [1]
    assert {r["job_id"]: r["violations"] for r in read_broken(spark, path).collect()} == {2: ["title"], 3: ["company_name", "years_exp", "seniority"]}
    with pytest.raises(ContractError):
        refresh_postings(three.withColumn("email", F.lit("x")), path)


def test_a_write_that_fails_leaves_the_old_table(spark, three, tmp_path):
    path = str(tmp_path / "silver")
    refresh_postings(three, path, buckets=2)
    fails = F.when(F.col("job_id") == 3, F.raise_error("disk lost").cast("string")).otherwise(F.lit("new"))
    with pytest.raises(Exception, match="disk lost"):
        refresh_postings(three.withColumn("title", fails), path)
    assert plain(read_bucketed(spark, path)) == plain(three)


@pytest.mark.parametrize("seed", range(2))
def test_gold_from_counts_equals_a_full_build(spark, tmp_path, seed):
    table, counts = str(tmp_path / "silver"), str(tmp_path / "counts")
    rng = random.Random(seed)
    last = None
    for step in range(4):
        silver = random_postings(spark, random.Random(rng.randint(0, 3)), rng.choice((0, 60, 200)), hot=rng.choice((0, 30)))
        version = refresh_postings(silver, table, buckets=8).version
        take_in_changes(changes_between(spark, table, last, version), counts)
        last = version
        full = build_gold(silver).drop("as_of")
        assert plain(gold_of_counts(spark, counts).drop("as_of")) == plain(full)


def test_parts_of_counts_are_put_together(spark, tmp_path):
    counts = str(tmp_path / "counts")
    one = postings(spark, [(1, "t", "c", "DK", "mid", 2, 10, 20)])
    for i in range(11):
        take_in_changes(one.withColumn("sign", F.lit(1 if i % 2 == 0 else -1)), counts)
    assert len(list((tmp_path / "counts" / "parts").iterdir())) == 12  # a whole one in between
    assert [(r.dimension_value, r.n) for r in read_counts(spark, counts).orderBy("dimension").collect()] == [("DK", 1), ("mid", 1)]
    with pytest.raises(Exception, match="taken away"):
        take_in_changes(one.withColumn("sign", F.lit(-3)), counts)
        read_counts(spark, counts).collect()

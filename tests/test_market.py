import random
import statistics
from datetime import datetime, timezone

import pytest

from conftest import postings, random_postings
from vacantia.errors import RequestError
from vacantia.operators.medians import exact_median
from vacantia.plans.gold import build_gold
from vacantia.plans.metrics import check_metric, market_metrics, metrics_as_of
from vacantia.schema import METRIC_COLUMNS

AS_OF = datetime(2025, 3, 1, tzinfo=timezone.utc)


@pytest.mark.parametrize("top", [3, 10**6, 2**45, 2**63 - 1])
def test_exact_median(spark, top):
    rng = random.Random(top)
    rows = [(rng.choice(["a", "b", None]), rng.randint(0, 1), rng.randint(0, top)) for _ in range(400)]
    rows += [("one", 0, 5), ("two", 1, 7), ("two", 1, 8)]
    rows += [("hot", 0, top // 2)] * 300
    df = spark.createDataFrame(rows, "a string, b int, v bigint")
    found = {(r["a"], r["b"]): (r["median"], r["n"]) for r in exact_median(df, ["a", "b"], "v").collect()}
    groups = {}
    for a, b, v in rows:
        groups.setdefault((a, b), []).append(v)
    assert found.keys() == groups.keys()
    for key, values in groups.items():
        assert found[key][1] == len(values)
        assert found[key][0] == pytest.approx(statistics.median(values), rel=1e-15)


def test_nulls_are_no_values(spark):
    df = spark.createDataFrame([("a", 4), ("a", None), ("a", None), ("b", None)], "g string, v bigint")
    assert [tuple(r) for r in exact_median(df, ["g"], "v").collect()] == [("a", 4.0, 1)]


def test_sums_beyond_bigint(spark):
    top = 2**63 - 1
    silver = postings(spark, [(i, "t", "c", "DK", "mid", 2, top - i, top) for i in range(4)])
    gold = {r["dimension"]: r["median_salary"] for r in build_gold(silver, AS_OF).collect()}
    assert gold == {"country": pytest.approx(top, rel=1e-15), "seniority": pytest.approx(top, rel=1e-15)}


def test_gold_against_plain_python(spark):
    silver = random_postings(spark, random.Random(1), 300)
    gold = build_gold(silver, AS_OF)
    assert gold.columns == METRIC_COLUMNS
    groups = {}
    for row in silver.collect():
        if row["salary_min"] is None or row["salary_max"] is None:
            continue
        middle = (row["salary_min"] + row["salary_max"]) / 2
        for dimension in ("seniority", "country"):
            groups.setdefault((dimension, row[dimension]), []).append(middle)
    found = {(r["dimension"], r["dimension_value"]): r for r in gold.collect()}
    assert found.keys() == groups.keys()
    assert ("country", None) in found
    for key, values in groups.items():
        assert found[key]["median_salary"] == statistics.median(values)
        assert found[key]["posting_count"] == len(values)


@pytest.mark.parametrize(("size", "shown"), [(4, None), (5, 3.0), (6, 3.5)])
def test_small_groups_are_masked_on_read(spark, size, shown):
    rows = [(i, "t", "c", "DK", "mid", 2, i, i) for i in range(1, size + 1)]
    gold = build_gold(postings(spark, rows), AS_OF).cache()
    row = market_metrics(gold, "country").collect()[0]
    assert (row["median_salary"], row["posting_count"]) == (shown, size)
    assert gold.where("dimension = 'country'").first()["median_salary"] == (size + 1) / 2


def test_metrics_order_and_as_of(spark):
    rows = [(i, "t", "c", c, "mid", 2, 1, 1) for i, c in enumerate(["SE", None, "DK"])]
    gold = build_gold(postings(spark, rows), AS_OF)
    metrics = market_metrics(gold, "country")
    assert [r["dimension_value"] for r in metrics.collect()] == ["DK", "SE", None]
    assert metrics_as_of(metrics) == AS_OF
    assert metrics_as_of(metrics.limit(0)).tzinfo is not None


def test_refused_names(spark, three):
    with pytest.raises(RequestError):
        market_metrics(build_gold(three, AS_OF), "email")
    check_metric("median_salary")
    with pytest.raises(RequestError):
        check_metric("avg_password")


def test_no_postings(spark, three):
    assert build_gold(three.limit(0), AS_OF).count() == 0

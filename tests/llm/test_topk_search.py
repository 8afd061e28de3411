import math
import random
from collections import Counter

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from vacantia.llm.topk_search import top_k

SCHEMA = "vec_id bigint, embedding array<double>, score string, rank int"


def brute(rows, k, scale=1024):
    usable = {}
    for vec_id, v in rows:
        if vec_id is None or not v or any(x is None or not math.isfinite(x) for x in v):
            continue
        whole = [math.floor(scale * x) for x in v]
        if max(map(abs, whole)) <= 1 << 26:
            usable[vec_id] = max(usable.get(vec_id, []), whole)
    out = set()
    for q, a in usable.items():
        if q % 10:
            continue
        scores = [(-sum(x * y for x, y in zip(a, b)), i) for i, b in usable.items() if i != q and len(b) == len(a)]
        out |= {(q, rank, i, -s) for rank, (s, i) in enumerate(sorted(scores)[:k], 1)}
    return out


def found(spark, rows, k):
    vectors = spark.createDataFrame([(*row, "x", 1) for row in rows], SCHEMA)
    return {tuple(row) for row in top_k(vectors, F.col("vec_id") % 10 == 0, k).collect()}


def test_matches_brute_force(spark):
    rng = random.Random(1)
    rows = [(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(400)]
    rows += [(400 + i, [rng.choice((0.0, 0.5, 1.0)) for _ in range(6)]) for i in range(300)]
    assert found(spark, rows, 10) == brute(rows, 10)


def test_a_third_of_all_vectors_is_one(spark):
    rng = random.Random(2)
    rows = [(i, [1.0, 2.0, 3.0] if i % 3 == 0 else [rng.uniform(-3, 3) for _ in range(3)]) for i in range(300)]
    assert found(spark, rows, 7) == brute(rows, 7)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (10, None), (20, []), (30, [1.0, None]), (40, [nan, 1.0]), (50, [inf, 1.0])]
    rows += [(None, [1.0, 2.0]), (1, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [3.0, 1.0]), (2, [-3.0, 1.0]), (3, [1.0, 2.0, 3.0])]
    rows += [(60, [1e300, 1.0]), (70, [0.0, 0.0]), (80, [-0.0005, 5e4]), (90, [1.0, 2.0, 3.0, 4.0])]
    assert found(spark, rows, 3) == brute(rows, 3)


def test_fewer_rows_than_k_and_empty_table(spark):
    rows = [(0, [1.0]), (1, [2.0])]
    assert found(spark, rows, 10) == {(0, 1, 1, 1024 * 2048)}
    assert found(spark, [], 10) == set()


def brute_every_row(rows, k, scale=1024):
    usable = [
        (i, [math.floor(scale * x) for x in v])
        for i, v in rows
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = Counter()
    for q in {i for i, _ in usable if i % 10 == 0}:
        scores = [
            (-sum(x * y for x, y in zip(a, b)), i)
            for own, a in usable
            if own == q
            for i, b in usable
            if i != q and len(a) == len(b)
        ]
        out.update((q, rank, i, -s) for rank, (s, i) in enumerate(sorted(scores)[:k], 1))
    return out


def found_every_row(spark, rows, k):
    vectors = spark.createDataFrame([(*row, "x", 1) for row in rows], SCHEMA)
    return Counter(tuple(row) for row in top_k(vectors, F.col("vec_id") % 10 == 0, k, every_row=True).collect())


def test_wide_vectors_and_large_components_take_part(spark):
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 1) for _ in range(3072)]) for i in range(25)]
    rows += [(i, [rng.gauss(0, 1) for _ in range(2048)]) for i in range(30, 45)]
    rows += [(100 + i, [rng.choice((7e4, -2e5, 1e6, 0.25)), rng.gauss(0, 1), rng.gauss(0, 1e5)]) for i in range(60)]
    # Products that a long cannot hold, with a sum that it can.
    rows += [(200, [4e6, 4e6, 1.0, 1.0]), (201, [4e6, -4e6, 2.0, 1.0]), (202, [-4e6, 4e6, 1.0, 3.0])]
    wanted = brute_every_row(rows, 4)
    assert len(wanted) == 46 and found_every_row(spark, rows, 4) == wanted
    assert found(spark, rows[:40], 4) == {tuple(row) for row in brute_every_row(rows[:40], 4)}


def test_rows_that_repeat_an_id_are_all_candidates(spark):
    rng = random.Random(6)
    rows = [(rng.choice((0, 1, 2, 10, 20, *range(21, 60))), [float(rng.randint(-2, 2)) for _ in range(3)]) for _ in range(250)]
    rows += [(0, [2.0, 2.0, 2.0])] * 5 + [(3, [2.0, 2.0, 2.0])] * 4 + [(30, [9.0, float(i), 9.0]) for i in range(40)]
    for k in (1, 5):
        assert found_every_row(spark, rows, k) == brute_every_row(rows, k)


@pytest.mark.parametrize("rows", [[(0, [1e300]), (1, [1.0])], [(0, [1e15, 1.0]), (1, [1e15, 1.0])]])
def test_what_a_long_cannot_hold_stops_the_job(spark, rows):
    with pytest.raises(PySparkException, match="does not fit a long"):
        found_every_row(spark, rows, 1)

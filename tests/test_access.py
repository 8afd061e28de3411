import hashlib
import random
from datetime import datetime, timedelta

import numpy as np
import pytest

from vacantia.operators.bucket_levels import LevelMap, Quota, map_of_run, spend
from vacantia.operators.credentials import audit_credentials
from vacantia.operators.token_bucket import admit_requests
from vacantia.plans.access import decide_access

START = datetime(2024, 1, 1)
LOG = "client_id string, event_id bigint, ts timestamp"


def log_of(spark, events):
    rows = [(c, i, START + timedelta(microseconds=us)) for i, (c, us) in enumerate(events)]
    return spark.createDataFrame(rows, LOG)


def one_after_another(events, quota, start=None):
    """The limiter as it would run request by request, in exact arithmetic."""
    level, last, decisions = {}, {}, {}
    for i, (client, us) in sorted(enumerate(events), key=lambda e: (e[1][0], e[1][1], e[0])):
        if client not in level:
            level[client], last[client] = (start or {}).get(client, (quota.full, us))
        now = max(us, last[client])
        tokens = min(quota.full, level[client] + (now - last[client]) * quota.tokens)
        decisions[i] = tokens >= quota.per_us
        level[client] = tokens - quota.per_us if decisions[i] else tokens
        last[client] = now
    return decisions, level


def decisions_of(df):
    return {r["event_id"]: r["admitted"] for r in df.collect()}


@pytest.mark.parametrize(
    ("capacity", "events", "expected"),
    [
        (3, [("c", 0)] * 4, [True, True, True, False]),
        (1, [("c", 0), ("c", 0), ("c", 1_000_000)], [True, False, True]),
        (1, [("c1", 0), ("c2", 0), ("c1", 0)], [True, True, False]),
        (1, [("c", 0), ("c", 999_999), ("c", 1_000_000), ("c", 2_000_000)], [True, False, True, True]),
    ],
)
def test_limiter_examples(spark, capacity, events, expected):
    quota = Quota(tokens=1, per_us=1_000_000, capacity=capacity)
    found = decisions_of(admit_requests(log_of(spark, events), quota))
    assert [found[i] for i in range(len(events))] == expected


def test_default_quota():
    assert Quota.per_minute(120) == Quota(120, 60_000_000, 120)
    assert Quota.per_minute(120, burst=10).capacity == 10


@pytest.mark.parametrize("seed", range(40))
def test_level_maps_equal_the_run(seed):
    rng = random.Random(seed)
    for _ in range(25):
        quota = Quota(rng.randint(1, 5), rng.randint(1, 30), rng.randint(1, 6))
        longest = rng.choice([3, 10, 40, 200])
        gaps = [rng.randint(0, longest) for _ in range(rng.randint(1, 60))]
        gains = quota.refills(np.array(gaps))
        found = map_of_run(gains, quota, block=rng.choice([1, 3, 7, 1000]))
        for level in range(quota.full + 1):
            run = [level] + [-1] * (len(gains) - 1)
            _, left = spend(run, [0, *gains[1:].tolist()], quota)
            assert found.at(level) == left[-1]
            short = found.first_token(quota)
            assert short is None or short.at(level % quota.per_us) == left[-1]


def test_long_busy_run_has_a_tiny_map():
    quota = Quota.per_minute(120)
    gains = quota.refills(np.random.default_rng(1).integers(0, 2000, 5000))
    assert len(map_of_run(gains, quota).pieces) > 100
    assert len(map_of_run(gains, quota).first_token(quota).pieces) <= 3


def test_level_map_joins_pieces():
    assert LevelMap([(0, 3, True, 5), (4, 9, True, 9)]).pieces == [(0, 9, True, 5)]
    assert LevelMap([(0, 3, False, 5), (4, 9, False, 5)]).pieces == [(0, 9, False, 5)]
    assert LevelMap([(0, 3, False, 5), (4, 9, True, 5)]).pieces == [(0, 3, False, 5), (4, 9, True, 5)]


@pytest.mark.parametrize("mean_gap", [10, 400, 1000, 5000])
def test_hot_client_over_many_chunks(spark, mean_gap):
    """One client fills dozens of chunks; small clients share chunks with it."""
    rng = random.Random(mean_gap)
    quota = Quota(tokens=1, per_us=1000, capacity=4)
    us, events = 0, []
    for _ in range(600):
        us += int(rng.expovariate(1 / mean_gap))
        events.append(("hot", us))
    events += [(f"c{rng.randint(0, 30)}", rng.randint(0, us)) for _ in range(300)]
    rng.shuffle(events)
    expected, level = one_after_another(events, quota)
    found = admit_requests(log_of(spark, events), quota, rows_per_chunk=16).cache()
    assert decisions_of(found) == expected
    assert len(set(expected.values())) == 2 or mean_gap in (10, 5000)
    last = found.where("client_id = 'hot'").orderBy("ts", "event_id").collect()[-1]
    assert last["level"] == level["hot"]
    assert last["tokens_left"] == level["hot"] / 1000


def test_resume_from_earlier_levels(spark):
    rng = random.Random(9)
    quota = Quota(tokens=1, per_us=1000, capacity=3)
    events = [(rng.choice("ab"), rng.randint(0, 60_000)) for _ in range(200)]
    start = {"a": (500, 20_000), "zz": (1, 1)}
    base = int((START - datetime(1970, 1, 1)).total_seconds() * 1_000_000)
    known = spark.createDataFrame(
        [(c, level, base + us) for c, (level, us) in start.items()],
        "client_id string, start_level bigint, start_us bigint",
    )
    found = admit_requests(log_of(spark, events), quota, start=known, rows_per_chunk=10)
    assert decisions_of(found) == one_after_another(events, quota, start)[0]


def digest(key):
    return hashlib.sha256(key.encode()).hexdigest()


@pytest.fixture
def registry(spark):
    rows = [
        ("open", digest("k-open"), None),
        ("dated", digest("k-dated"), datetime(2024, 1, 15)),
        ("twin-b", digest("k-twin"), datetime(2020, 1, 1)),
        ("twin-a", digest("k-twin"), None),
    ]
    return spark.createDataFrame(rows, "client_id string, key_sha256 string, expires_at timestamp")


def test_credential_statuses(spark, registry):
    rows = [
        (1, datetime(2024, 1, 1), None, None, "missing"),
        (2, datetime(2024, 1, 1), "", None, "missing"),
        (3, datetime(2024, 1, 1), "k-other", None, "unknown"),
        (4, datetime(2024, 1, 15), "k-dated", "dated", "ok"),
        (5, datetime(2024, 1, 15, 0, 0, 1), "k-dated", "dated", "expired"),
        (6, datetime(2030, 1, 1), "k-open", "open", "ok"),
        (7, datetime(2024, 1, 1), "k-twin", "twin-a", "ok"),
    ]
    log = spark.createDataFrame([r[:3] for r in rows], "event_id int, ts timestamp, raw_key string")
    audited = audit_credentials(log, registry)
    assert "raw_key" not in audited.columns and "key_sha256" not in audited.columns
    found = {r["event_id"]: (r["client_id"], r["status"]) for r in audited.collect()}
    assert found == {r[0]: (r[3], r[4]) for r in rows}


def test_refused_requests_do_not_use_up_the_quota(spark, registry):
    at = datetime(2024, 1, 1)
    keys = ["k-open", None, "k-other", "k-open", "k-open", None]
    rows = [(i, at + timedelta(seconds=i), key) for i, key in enumerate(keys)]
    log = spark.createDataFrame(rows, "event_id int, ts timestamp, raw_key string")
    found = decide_access(log, registry, Quota(1, 3_600_000_000, 2)).collect()
    assert [s for _, s in sorted((r["event_id"], r["status"]) for r in found)] == [
        "ok", "missing", "unknown", "ok", "limited", "missing"
    ]


def test_no_requests(spark):
    assert admit_requests(log_of(spark, [("c", 0)]).limit(0), Quota.per_minute(120)).count() == 0


def test_requests_of_nobody_and_without_a_time(spark):
    log = spark.createDataFrame([(None, 1, START), ("c", 2, START)], LOG)
    assert decisions_of(admit_requests(log, Quota.per_minute(1))) == {1: None, 2: True}
    with pytest.raises(Exception, match="without a time"):
        admit_requests(spark.createDataFrame([("c", 1, None)], LOG), Quota.per_minute(1))


def test_long_runs_are_described_in_seconds():
    import time

    rng = np.random.default_rng(1)
    quota = Quota(tokens=1, per_us=1000, capacity=100_000)
    begin = time.perf_counter()
    run = map_of_run(rng.integers(0, 3000, 100_000), quota)
    run.first_token(quota)
    assert time.perf_counter() - begin < 20


def test_log_with_a_map_column(spark, registry):
    log = spark.sql("SELECT 1 event_id, timestamp'2024-01-01' ts, cast(null as string) raw_key, map('a', 1) props UNION ALL SELECT 2, timestamp'2024-01-01', 'k-open', map('a', 2)")
    assert {r.event_id: r.status for r in audit_credentials(log, registry).collect()} == {1: "missing", 2: "ok"}

import random
from datetime import datetime, timedelta

import pytest

from vacantia.operators.bucket_levels import Quota
from vacantia.operators.token_bucket import admit_requests
from vacantia.streaming.token_bucket import read_decisions, start_admission

LOG = "client_id string, event_id bigint, ts timestamp"
START = datetime(2024, 1, 1)
QUOTA = Quota(tokens=1, per_us=10_000_000, capacity=3)


def write_file(spark, folder, rows):
    spark.createDataFrame(rows, LOG).coalesce(1).write.mode("append").parquet(folder)


def run(spark, source, out, checkpoint, **more):
    log = spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(source)
    start_admission(log, QUOTA, out, checkpoint, **more).awaitTermination()


def test_stream_equals_batch_over_files_and_a_restart(spark, tmp_path):
    rng = random.Random(4)
    source, out, checkpoint = (str(tmp_path / name) for name in ("in", "out", "checkpoint"))
    seconds = sorted(rng.sample(range(1800), 250))
    rows = [(rng.choice("aaab"), i, START + timedelta(seconds=s)) for i, s in enumerate(seconds)]
    for first in range(0, 200, 50):
        write_file(spark, source, rows[first : first + 50])
    run(spark, source, out, checkpoint)
    assert read_decisions(spark, out).count() == 200
    write_file(spark, source, rows[200:])
    run(spark, source, out, checkpoint)
    found = read_decisions(spark, out)
    batch = admit_requests(spark.createDataFrame(rows, LOG), QUOTA)
    columns = ["client_id", "event_id", "admitted", "tokens_left"]
    assert sorted(found.select(*columns).collect()) == sorted(batch.select(*columns).collect())
    assert found.where("late").count() == 0
    assert found.where("not admitted").count() > 20


def test_late_requests_neither_refill_nor_turn_back_the_clock(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / name) for name in ("in", "out", "checkpoint"))

    def at(second):
        return START + timedelta(seconds=second)

    write_file(spark, source, [("a", i, at(100)) for i in range(3)])
    run(spark, source, out, checkpoint)
    write_file(spark, source, [("a", 3, at(50)), ("a", 4, at(105)), ("a", 5, at(110))])
    run(spark, source, out, checkpoint)
    found = {r["event_id"]: (r["admitted"], r["late"]) for r in read_decisions(spark, out).collect()}
    assert found == {
        0: (True, False), 1: (True, False), 2: (True, False),
        3: (False, True), 4: (False, False), 5: (True, False),
    }


def test_a_client_with_most_of_a_batch_and_requests_of_nobody(spark, tmp_path):
    rng = random.Random(8)
    source, out, checkpoint = (str(tmp_path / name) for name in ("in", "out", "checkpoint"))
    rows = [(rng.choice(["hot", "hot", "b", None]), i, START + timedelta(seconds=3 * i)) for i in range(300)]
    write_file(spark, source, rows[:200])
    write_file(spark, source, rows[200:])
    run(spark, source, out, checkpoint, rows_per_chunk=16)
    found = read_decisions(spark, out).collect()
    wanted = admit_requests(spark.createDataFrame(rows, LOG), QUOTA).collect()
    assert {(r.event_id, r.admitted, r.level) for r in found} == {(r.event_id, r.admitted, r.level) for r in wanted}
    assert len(found) == 300 and sum(r.admitted is None for r in found) == sum(c is None for c, *_ in rows)


def test_levels_of_full_buckets_are_forgotten_at_a_fold(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("vacantia.streaming.token_bucket.FOLD", 2)
    source, out, checkpoint = (str(tmp_path / name) for name in ("in", "out", "checkpoint"))
    write_file(spark, source, [(f"c{i}", i, START) for i in range(50)])
    run(spark, source, out, checkpoint, keep_us=1)
    assert spark.read.parquet(f"{out}/levels/batch-0").count() == 50
    write_file(spark, source, [("late", 99, START + timedelta(days=3))])
    run(spark, source, out, checkpoint, keep_us=1)
    # A batch only adds the levels of its own clients.
    assert spark.read.parquet(f"{out}/levels/batch-1").count() == 1
    assert spark.read.parquet(f"{out}/levels/folded-1").count() == 1


def test_folds_do_not_show(spark, tmp_path, monkeypatch):
    """Many batches, several folds and a restart are one sequential log."""
    monkeypatch.setattr("vacantia.streaming.token_bucket.FOLD", 3)
    rng = random.Random(12)
    source, out, checkpoint = (str(tmp_path / name) for name in ("in", "out", "checkpoint"))
    rows = [(rng.choice("aabcdefgh"), i, START + timedelta(seconds=4 * i)) for i in range(140)]
    for first in range(0, 140, 20):
        write_file(spark, source, rows[first : first + 20])
        if first in (80, 120):
            run(spark, source, out, checkpoint)
    found = read_decisions(spark, out)
    wanted = admit_requests(spark.createDataFrame(rows, LOG), QUOTA)
    columns = ["client_id", "event_id", "admitted", "level"]
    assert sorted(found.select(*columns).collect()) == sorted(wanted.select(*columns).collect())
    assert found.select("batch").distinct().count() == 7


def test_a_request_without_a_time_stops_the_stream(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / name) for name in ("in", "out", "checkpoint"))
    write_file(spark, source, [("a", 1, START), ("a", 2, None)])
    with pytest.raises(Exception, match="without a time"):
        run(spark, source, out, checkpoint)

"""Token-bucket admission on a stream, by the batch operator.

Every micro-batch is decided like a log of its own that starts from the levels the
batches before it left, so a client with most of a batch is cut into chunks as there.
Levels are a log-structured table in shared storage: a batch adds the levels of the clients
it has decided, and nothing else is written; every ``FOLD``-th batch folds what has gathered
into one table and forgets buckets that have long been full. Which tables a batch reads
follows from its number alone, so one that is run again after a failure reads the same
levels and writes the same folders anew.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vacantia.operators.bucket_levels import Quota
from vacantia.operators.token_bucket import ROWS_PER_CHUNK, admit_requests
from vacantia.sources.workspace import stage

DAY_US = 86_400_000_000


#: Batches whose levels are folded into one table.
FOLD = 16


def _levels_path(path: str, batch: int, folded: bool = False) -> str:
    return f"{path}/levels/{'folded' if folded else 'batch'}-{batch}"


def _is_folded(batch: int) -> bool:
    return batch % FOLD == FOLD - 1


def _levels_before(spark: SparkSession, path: str, batch: int, client: str) -> DataFrame | None:
    """Level and time of every client that earlier batches have left, the newest of each."""
    first = batch // FOLD * FOLD  # of the batches since the last fold
    parts = [_levels_path(path, n) for n in range(first, batch)]
    if first:
        parts.append(_levels_path(path, first - 1, folded=True))
    if not parts:
        return None
    rows = spark.read.parquet(*parts)
    # A client's time never goes back; of equal times the later batch counts.
    newest = F.max_by("start_level", F.struct("start_us", "batch")).alias("start_level")
    return rows.groupBy(client).agg(newest, F.max("start_us").alias("start_us"), F.max("batch").alias("batch"))


def _levels_before_fold(spark: SparkSession, path: str, batch: int, client: str) -> DataFrame:
    """All levels, those of ``batch`` included."""
    own = spark.read.parquet(_levels_path(path, batch))
    before = _levels_before(spark, path, batch, client)
    if before is None:
        return own
    kept = before.join(own.select(client), client, "left_anti").select(*own.columns)
    return kept.unionByName(own)


def _left_by(decided: DataFrame, start: DataFrame | None, client: str, at: str, tie: str, batch: int) -> DataFrame:
    """Level and time of the clients that a batch has decided."""
    us = F.unix_micros(at)
    left = (
        decided.where(F.col(client).isNotNull())
        .groupBy(client)
        .agg(F.max_by("level", F.struct(us, tie)).alias("start_level"), F.max(us).alias("start_us"))
    )
    if start is not None:  # late requests do not turn a client's clock back
        known = start.select(client, F.col("start_us").alias("known_us"))
        left = left.join(known, client, "left").withColumn("start_us", F.greatest("start_us", "known_us")).drop("known_us")
    return left.withColumn("batch", F.lit(batch).cast("bigint"))


def _without_full(levels: DataFrame, quota: Quota, keep_us: int) -> DataFrame:
    """The levels but for buckets that have long been full: a new bucket is full too."""
    clock = levels.agg(F.max("start_us")).first()[0]
    if clock is None:
        return levels
    idle = F.lit(clock) - F.col("start_us")
    refill = F.least(idle, F.lit(quota.full // quota.tokens + 1)) * quota.tokens
    return levels.where((F.col("start_level") + refill < quota.full) | (idle < keep_us))


def start_admission(
    log: DataFrame,
    quota: Quota,
    path: str,
    checkpoint: str,
    *,
    client: str = "client_id",
    at: str = "ts",
    tie: str = "event_id",
    keep_us: int = DAY_US,
    rows_per_chunk: int = ROWS_PER_CHUNK,
) -> StreamingQuery:
    """Decide the streamed ``log`` into ``path`` until the available input is used up.

    Started again with the same checkpoint it goes on where it stopped. Within a
    micro-batch requests are taken in time order. A request older than one already
    decided for its client is ``late``; levels of full buckets are forgotten once they
    are ``keep_us`` behind the newest request, at the next fold, and nothing is late
    against them. A request without a time stops the stream, as it stops the batch.
    """

    def decide(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        levels = _levels_before(spark, path, number, client)
        start = None
        if levels is not None:
            asking = batch.select(client).distinct()
            start = stage(levels.join(asking, client, "left_semi").select(client, "start_level", "start_us"), "start-levels")
        decided = admit_requests(
            batch, quota, client=client, at=at, tie=tie, start=start, rows_per_chunk=rows_per_chunk
        )
        target = f"{path}/decisions/batch={number}"
        decided.write.mode("overwrite").parquet(target)
        written = spark.read.schema(decided.schema).parquet(target)
        _left_by(written, start, client, at, tie, number).write.mode("overwrite").parquet(_levels_path(path, number))
        if _is_folded(number):
            whole = stage(_levels_before_fold(spark, path, number, client), "levels")
            _without_full(whole, quota, keep_us).write.mode("overwrite").parquet(_levels_path(path, number, folded=True))

    return (
        log.writeStream.foreachBatch(decide)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_decisions(spark: SparkSession, path: str) -> DataFrame:
    """All decisions so far, with the number of their ``batch``."""
    return spark.read.parquet(f"{path}/decisions")

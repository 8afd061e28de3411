"""Token-bucket admission over a whole request log.

The decisions of one client depend on each other, so a client with a third of
all requests would be one huge sequential group. Instead the log is sorted by
client and time over all tasks and cut into chunks of bounded size. A chunk
tells how it maps the bucket level it is entered with to the level it is left
with; composing these few numbers per chunk gives every chunk its entry level,
and then all chunks decide in parallel. The result is the sequential one.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vacantia.functions.columns import utc_micros
from vacantia.operators.bucket_levels import LevelMap, Quota, map_of_run, spend
from vacantia.sources.workspace import stage_sorted

ROWS_PER_CHUNK = 1_000_000
_CHUNK = ["part", "slice"]
_ENTRIES = "part bigint, slice bigint, entry_level bigint, entry_us bigint"


def _sorted_log(log: DataFrame, client: str, at: str, tie: str, start: DataFrame | None, rows: int):
    events = log.select(
        F.col(client).alias("client"), utc_micros(at).alias("us"), F.col(tie).alias("tie")
    ).dropna(subset=["client"])
    if start is None:
        nothing = F.lit(None).cast("bigint")
        events = events.withColumns({"start_level": nothing, "start_us": nothing})
        clock = F.col("us")
    else:
        known = start.select(F.col(client).alias("client"), "start_level", "start_us")
        events = events.join(known, "client", "left")
        clock = F.greatest("us", "start_us")
    events = events.withColumn("clock", clock)
    order = [F.col("client").asc(), F.col("us").asc(), F.col("tie").asc()]
    slices = F.floor(F.col("part_row") / rows).cast("bigint")
    return stage_sorted(events, order, "token-bucket").withColumn("slice", slices)


def _levels(chunk: pd.DataFrame, quota: Quota) -> tuple[np.ndarray, np.ndarray]:
    """Starting level (or -1 inside a client's run) and gain of every request."""
    clock, client = chunk["clock"].to_numpy(), chunk["client"].to_numpy()
    new = np.concatenate([[True], client[1:] != client[:-1]])
    has_start = chunk["start_level"].notna().to_numpy()
    start_us = chunk["start_us"].fillna(0).to_numpy().astype(np.int64)
    start_level = chunk["start_level"].fillna(quota.full).to_numpy().astype(np.int64)
    before = np.where(new, np.where(has_start, start_us, clock), np.roll(clock, 1))
    return np.where(new, start_level, -1), quota.refills(clock - before)


def _describe_chunks(quota: Quota) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Per chunk: how its last client leaves it, and whom its first client enters as."""

    def describe(chunk: pd.DataFrame) -> pd.DataFrame:
        chunk = chunk.sort_values("part_row")
        client = chunk["client"].to_numpy()
        first, last = client[0], client[-1]
        run = chunk[client == last]
        levels, gains = _levels(run, quota)
        single = bool(first == last)
        if single:
            leaving = map_of_run(gains, quota)
            short = leaving.first_token(quota)
        else:
            _, left = spend(levels.tolist(), gains.tolist(), quota)
            leaving, short = LevelMap.fixed(quota, int(left[-1])), None
        here = {"part": chunk["part"].iloc[0], "slice": chunk["slice"].iloc[0]}
        rows = [
            here
            | {
                "client": last,
                "enters": single,
                "leaves": True,
                "first_us": run["clock"].iloc[0],
                "last_us": run["clock"].iloc[-1],
                "first_level": min(quota.full, int(levels[0] + gains[0])),
                "pieces": [int(n) for piece in (short or leaving).pieces for n in piece],
                "below": quota.per_us if short else quota.full + 1,
            }
        ]
        if not single:
            rows.append(
                here
                | {"client": first, "enters": True, "leaves": False, "first_us": 0, "last_us": 0,
                   "first_level": 0, "pieces": [], "below": 1}
            )
        return pd.DataFrame(rows)

    return describe


def _map_from(numbers: np.ndarray) -> LevelMap:
    rows = np.asarray(numbers, dtype=np.int64).reshape(-1, 4).tolist()
    return LevelMap([(low, high, bool(moves), value) for low, high, moves, value in rows])


def _chain(quota: Quota) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Walk the chunks of one client in order; a few numbers per chunk."""

    def chain(links: pd.DataFrame) -> pd.DataFrame:
        entries = []
        level, at = None, None
        for link in links.sort_values(_CHUNK).itertuples():
            if link.enters and level is not None:
                entries.append((link.part, link.slice, level, at))
            if link.leaves:
                if level is None:
                    begin = link.first_level
                else:
                    gain = int(quota.refills(np.array([link.first_us - at]))[0])
                    begin = min(quota.full, level + gain)
                leaving = _map_from(link.pieces)
                level, at = leaving.at(begin % link.below), int(link.last_us)
        return pd.DataFrame(entries, columns=["part", "slice", "entry_level", "entry_us"])

    return chain


def _decide(quota: Quota) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    def decide(chunk: pd.DataFrame, entry: pd.DataFrame) -> pd.DataFrame:
        columns = ["client", "us", "tie", "admitted", "late", "level"]
        if chunk.empty:
            return pd.DataFrame(columns=columns)
        chunk = chunk.sort_values("part_row")
        levels, gains = _levels(chunk, quota)
        if not entry.empty:
            levels[0] = entry["entry_level"].iloc[0]
            since = chunk["clock"].to_numpy()[:1] - entry["entry_us"].to_numpy()[:1]
            gains[0] = quota.refills(since)[0]
        admitted, left = spend(levels.tolist(), gains.tolist(), quota)
        late = chunk["us"].to_numpy() < chunk["clock"].to_numpy()
        return chunk.assign(admitted=admitted, late=late, level=left)[columns]

    return decide


def admit_requests(
    log: DataFrame,
    quota: Quota,
    *,
    client: str = "client_id",
    at: str = "ts",
    tie: str = "event_id",
    start: DataFrame | None = None,
    rows_per_chunk: int = ROWS_PER_CHUNK,
) -> DataFrame:
    """``client, tie, ts, admitted, late, tokens_left, level`` for every request.

    A request without a client is no client's to pay for: its decision, ``late``,
    ``tokens_left`` and ``level`` are NULL.

    Requests of one client are taken in the order of ``at``, then ``tie``, which
    is unique. Buckets start full, or from ``start`` (``client, start_level,
    start_us``) where it has the client. A request earlier than its client's
    starting time is ``late``: it neither refills the bucket nor turns the clock back.
    """
    staged = _sorted_log(log, client, at, tie, start, rows_per_chunk)
    key = staged.schema["client"].dataType
    links = T.StructType(
        [
            T.StructField("part", T.LongType()),
            T.StructField("slice", T.LongType()),
            T.StructField("client", key),
            T.StructField("enters", T.BooleanType()),
            T.StructField("leaves", T.BooleanType()),
            T.StructField("first_us", T.LongType()),
            T.StructField("last_us", T.LongType()),
            T.StructField("first_level", T.LongType()),
            T.StructField("pieces", T.ArrayType(T.LongType())),
            T.StructField("below", T.LongType()),
        ]
    )
    decisions = T.StructType(
        [
            T.StructField("client", key),
            T.StructField("us", T.LongType()),
            T.StructField("tie", staged.schema["tie"].dataType),
            T.StructField("admitted", T.BooleanType()),
            T.StructField("late", T.BooleanType()),
            T.StructField("level", T.LongType()),
        ]
    )
    entries = (
        staged.groupBy(*_CHUNK)
        .applyInPandas(_describe_chunks(quota), links)
        .groupBy("client")
        .applyInPandas(_chain(quota), _ENTRIES)
    )
    decided = (
        staged.groupBy(*_CHUNK).cogroup(entries.groupBy(*_CHUNK)).applyInPandas(_decide(quota), decisions)
    )
    nothing = {name: F.lit(None).cast("boolean") for name in ("admitted", "late")}
    nothing["level"] = F.lit(None).cast("bigint")
    nobody = log.where(F.col(client).isNull()).select(
        F.col(client).alias("client"), utc_micros(at).alias("us"), F.col(tie).alias("tie")
    )
    return decided.unionByName(nobody.withColumns(nothing)).select(
        F.col("client").alias(client),
        F.col("tie").alias(tie),
        F.timestamp_micros("us").alias(at),
        "admitted",
        "late",
        (F.col("level") / F.lit(float(quota.per_us))).alias("tokens_left"),
        "level",
    )

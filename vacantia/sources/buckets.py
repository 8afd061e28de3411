"""Silver in hash buckets, refreshed where rows changed.

A table is a folder with ``versions/<name>/bucket=<n>`` and ``published``, a log with one
small file per refresh that lists the folder of every bucket. A refresh compares digests of
the new rows with the stored ones, bucket by bucket and row by row, writes the buckets that
differ into a new version and publishes a list that names old folders for all others. So
files without a change stay the same files, and a refresh that fails leaves the old list.
Rows that only one of two lists has are read from the buckets that differ alone.

The number of buckets is fixed by the first load. Rows that repeat a key are compared as
often as they stand there.
"""

from __future__ import annotations

import time
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vacantia.errors import ContractError
from vacantia.operators.contract import check_columns, with_violations
from vacantia.schema import POSTING_COLUMNS, POSTING_SCHEMA
from vacantia.sources.tables import version_path

KEY = "job_id"
ROWS_PER_BUCKET = 1_000_000
_LIST = "version string, at_ns bigint, buckets int, bucket int, folder string, rows bigint"
_DIGEST = ["digest_one", "digest_two"]
_STORED = T.StructType(
    [
        *POSTING_SCHEMA,
        T.StructField("violations", T.ArrayType(T.StringType())),
        *(T.StructField(name, T.LongType()) for name in _DIGEST),
    ]
)


@dataclass(frozen=True)
class Refresh:
    """What a refresh found: accepted rows of the table, and rows that came or went."""

    version: str
    rows: int
    inserted: int
    deleted: int
    rewritten: list[int]


def _digests() -> list[Column]:
    """128 bits of a row; NULL is told apart from every value and place."""
    parts = [x for f in POSTING_SCHEMA for x in ((F.col(f.name), F.col(f.name).isNull()) if f.nullable else (F.col(f.name),))]
    return [F.xxhash64(F.lit(seed), *parts).alias(name) for seed, name in enumerate(_DIGEST)]


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64(KEY), F.lit(buckets)).cast("int").alias("bucket")


def _listed(spark: SparkSession, path: str, version: str | None = None) -> list:
    """Buckets of a version, by default the one published last; one row per bucket."""
    log = spark.read.schema(_LIST).parquet(f"{path}/published")
    if version is None:
        version = log.agg(F.max_by("version", F.struct("at_ns", "version"))).first()[0]
    return log.where(F.col("version") == F.lit(version)).collect()


def is_published(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/published")
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def _rows_of(spark: SparkSession, folders: list[str]) -> DataFrame:
    return spark.read.schema(_STORED).parquet(*folders) if folders else spark.createDataFrame([], _STORED)


def _accepted(rows: DataFrame) -> DataFrame:
    return rows.where(F.size("violations") == 0)


def _surplus(spark: SparkSession, checked: DataFrame, broken: Column, before: list, buckets: int) -> DataFrame:
    """Per bucket how many rows came and went, and how many new ones are broken or there at all."""
    new = checked.select(KEY, *_DIGEST, broken.alias("broken"), F.lit(1).cast("bigint").alias("sign"))
    old = _rows_of(spark, list(_folders(before).values())).select(
        KEY, *_DIGEST, F.lit(False).alias("broken"), F.lit(-1).cast("bigint").alias("sign")
    )
    # Per row its surplus in the new table; the shuffle is on key and digest, so no key is hot.
    surplus = new.unionByName(old).groupBy(KEY, *_DIGEST).agg(
        F.sum("sign").alias("more"), F.count_if("broken").alias("broken"), F.count_if(F.col("sign") > 0).alias("now")
    )
    return surplus.groupBy(_bucket(buckets)).agg(
        F.sum(F.greatest("more", F.lit(0))).alias("inserted"),
        F.sum(F.greatest(-F.col("more"), F.lit(0))).alias("deleted"),
        F.sum("broken").alias("broken"),
        F.sum("now").alias("now"),
    )


def refresh_postings(
    silver: DataFrame,
    path: str,
    *,
    buckets: int | None = None,
    on_bad: str = "raise",
    cluster_by: tuple[str, ...] = (),
) -> Refresh:
    """Make the stored table equal to ``silver``, rewriting only buckets that differ.

    Rows that break the contract stop the refresh before anything is published; with
    ``on_bad="quarantine"`` they are stored aside (``read_broken``). ``silver`` is computed
    once for its digests and once more for the buckets that are written. The driver
    receives one row per bucket.
    """
    if on_bad not in ("raise", "quarantine"):
        raise ValueError(f"on_bad must be raise or quarantine, not {on_bad}")
    check_columns(silver.columns, POSTING_COLUMNS)
    spark = silver.sparkSession
    before = _listed(spark, path) if is_published(spark, path) else []
    if before:
        buckets = before[0].buckets
    elif buckets is None:
        buckets = max(1, -(-silver.count() // ROWS_PER_BUCKET))
    checked = with_violations(silver).select("*", *_digests())
    broken = F.size("violations") > 0
    if before:
        found = _surplus(spark, checked, broken, before, buckets).collect()
    else:
        # All rows came, so nothing is compared.
        number, none = F.count(F.lit(1)), F.lit(0).cast("bigint")
        found = checked.groupBy(_bucket(buckets)).agg(
            number.alias("inserted"), F.max(none).alias("deleted"), F.count_if(broken).alias("broken"), number.alias("now")
        ).collect()
    if on_bad == "raise" and any(row.broken for row in found):
        first = checked.where(broken).agg(F.min(F.struct(KEY, "violations")).alias("x")).first().x
        raise ContractError(f"posting {first[KEY]} breaks {first['violations']}")
    version = uuid.uuid4().hex
    changed = sorted(row.bucket for row in found if row.inserted or row.deleted)
    listed = {row.bucket: (row.folder, row.rows) for row in before if row.folder is not None}
    if changed:
        rows = checked.withColumn("bucket", _bucket(buckets)).where(F.col("bucket").isin(changed))
        rows = rows.repartition("bucket").sortWithinPartitions("bucket", *cluster_by, KEY)
        rows.write.partitionBy("bucket").parquet(version_path(path, version))
        for row in found:
            if row.inserted or row.deleted:
                listed.pop(row.bucket, None)
                if row.now:
                    folder = f"{version_path(path, version)}/bucket={row.bucket}"
                    listed[row.bucket] = folder, row.now - row.broken
    at = time.time_ns()
    log = [(version, at, buckets, bucket, *rest) for bucket, rest in sorted(listed.items())] or [(version, at, buckets, None, None, 0)]
    spark.createDataFrame(log, _LIST).coalesce(1).write.mode("append").parquet(f"{path}/published")
    total = sum(rows for _, rows in listed.values())
    return Refresh(version, total, sum(r.inserted for r in found), sum(r.deleted for r in found), changed)


def _folders(rows: list) -> dict[int, str]:
    return {row.bucket: row.folder for row in rows if row.folder is not None}


def bucket_folders(spark: SparkSession, path: str, version: str | None = None) -> dict[int, str]:
    """The folder of every bucket of a version."""
    return _folders(_listed(spark, path, version))


def read_bucketed(spark: SparkSession, path: str, version: str | None = None) -> DataFrame:
    """The accepted rows of a version in contract order."""
    folders = bucket_folders(spark, path, version)
    return _accepted(_rows_of(spark, list(folders.values()))).select(*POSTING_COLUMNS)


def read_broken(spark: SparkSession, path: str) -> DataFrame:
    """Rows that the current version left out, with their ``violations``."""
    rows = _rows_of(spark, list(bucket_folders(spark, path).values()))
    return rows.where(F.size("violations") > 0).select(*POSTING_COLUMNS, "violations")


def changes_between(spark: SparkSession, path: str, before: str | None, after: str | None = None) -> DataFrame:
    """Accepted rows that one version has and the other has not, with ``sign`` 1 (came) or -1 (went).

    Only buckets whose folders differ are read. Without ``before`` every row came. A row
    that came several times stands there as often.
    """
    old = bucket_folders(spark, path, before) if before else {}
    new = bucket_folders(spark, path, after)
    gone = [f for b, f in old.items() if new.get(b) != f]
    came = [f for b, f in new.items() if old.get(b) != f]
    both = _accepted(_rows_of(spark, came)).withColumn("sign", F.lit(1)).unionByName(
        _accepted(_rows_of(spark, gone)).withColumn("sign", F.lit(-1))
    )
    surplus = both.groupBy(KEY, *_DIGEST).agg(F.sum("sign").alias("more"), F.any_value(F.struct(*POSTING_COLUMNS)).alias("row"))
    moved = surplus.where(F.col("more") != 0)
    times = F.explode(F.array_repeat(F.signum("more").cast("int"), F.abs("more").cast("int"))).alias("sign")
    return moved.select("row", times).select("row.*", "sign")

"""Exact dedup against a persistent digest index.

The index is a Parquet table of ``(digest, keep_id)``, bucketed and sorted by digest.
New rows are reduced to one row per digest, the digests the index has already are
removed by a sort-merge anti-join that reads the index without a shuffle, and the rest
is appended.

Rules:

* A null text counts as the empty text. Texts are equal when their bytes are.
* Inside one batch the row with the largest id stays; a text that an earlier batch
  brought stays with the id it got then.
* A null id never wins against an id; a group without any id has a null ``keep_id`` and
  all its rows are kept, since nothing tells them apart from one another.
* Rows that repeat both id and text are one document and carry the same decision.
* An empty table gives an empty result. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A digest with more than this share of all rows is joined by broadcast; there can be
#: at most ``HOT_PARTS`` such digests, whatever the data.
HOT_PARTS = 1000
#: Rows that a bucket of the index is meant for, and the fewest buckets.
ROWS_PER_BUCKET, FEWEST_BUCKETS = 2_000_000, 64


def text_digest(text: str) -> Column:
    return F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256))


def bucket_count(rows: int) -> int:
    """Buckets for an index of so many rows: a power of two, so that it can be doubled."""
    return max(FEWEST_BUCKETS, 1 << (-(-rows // ROWS_PER_BUCKET) - 1).bit_length()) if rows else FEWEST_BUCKETS


class DigestIndex:
    """A digest table at ``path``; a later session opens it again by the same path.

    ``buckets`` is that of the first opening; ``bucket_count`` finds it for the rows that
    the index is to hold.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path, buckets
        self.table = f"digest_index_{hashlib.sha256(path.encode()).hexdigest()[:24]}"
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.table} (digest BINARY, keep_id BIGINT) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{path}'"
        )

    def rows(self) -> DataFrame:
        return self.spark.table(self.table)

    def close(self) -> None:
        """Take the table out of the catalog; its files stay, and frames that read them work on."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")

    def add(self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> None:
        """Append the digests of ``docs`` that the index does not have yet."""
        batch = (
            docs.select(F.col(doc_id).cast("long").alias("id"), text_digest(text).alias("digest"))
            .groupBy("digest")
            .agg(F.max("id").alias("keep_id"))
        )
        known = self.rows().select("digest")
        # By bucket and not by digest: a task then writes whole buckets, however many tasks there are.
        bucket = F.pmod(F.hash("digest"), F.lit(self.buckets))
        fresh = batch.hint("merge").join(known, "digest", "left_anti").repartitionById(self.buckets, bucket)
        (
            fresh.write.format("parquet")
            .bucketBy(self.buckets, "digest")
            .sortBy("digest")
            .option("path", self.path)
            .mode("append")
            .saveAsTable(self.table)
        )

    def resolve(self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
        """Every row of ``docs`` with the id that stays for its text.

        Columns: the id, ``keep_id``, ``group_size`` (rows of ``docs`` with this text),
        ``kept`` and ``digest``; all rows must have been added before.
        """
        ids = docs.select(F.col(doc_id).alias("id"), text_digest(text).alias("digest"))
        sizes = ids.groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"))
        groups = sizes.join(self.rows(), "digest")
        # One pass over the sizes; the limit holds for any data: fewer than HOT_PARTS
        # digests can each have more than a thousandth of the rows.
        total = F.lit(docs.count())
        hot = groups.where(F.col("group_size") * HOT_PARTS > total)
        rest = groups.where(F.col("group_size") * HOT_PARTS <= total)
        marked = ids.join(
            F.broadcast(hot.select("digest", F.col("keep_id").alias("hot_id"), F.col("group_size").alias("hot_size"))),
            "digest",
            "left",
        )
        found = ["id", "keep_id", "group_size", "digest"]
        frequent = marked.where(F.col("hot_size").isNotNull()).select(
            "id", F.col("hot_id").alias("keep_id"), F.col("hot_size").alias("group_size"), "digest"
        )
        others = marked.where(F.col("hot_size").isNull()).select("id", "digest").join(rest, "digest")
        return frequent.select(found).unionByName(others.select(found)).select(
            F.col("id").alias(doc_id),
            "keep_id",
            "group_size",
            F.coalesce(F.col("id") == F.col("keep_id"), F.col("keep_id").isNull()).alias("kept"),
            "digest",
        )

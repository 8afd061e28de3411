"""Postings and companies stored for their join: bucketed and sorted on the company key.

Tables of the same number of buckets are merged in place, without a shuffle. A company with
more postings than a bucket should have would make one bucket, and one task, very long;
its postings are dealt over several salts, and its row is stored once for each of them.
There are at most as many such companies as buckets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SALT = "join_salt"


def _store(df: DataFrame, name: str, path: str, buckets: int) -> None:
    # One file per bucket; Spark deals rows to buckets and to partitions by the same hash.
    dealt = df.repartition(buckets, "id_company", SALT).sortWithinPartitions("id_company", SALT)
    writer = dealt.write.format("parquet").mode("overwrite").option("path", path)
    writer.bucketBy(buckets, "id_company", SALT).sortBy("id_company", SALT).saveAsTable(name)


def store_for_join(posts: DataFrame, companies: DataFrame, posts_name: str, companies_name: str, path: str, buckets: int) -> None:
    """Store both as tables of the catalog with files below ``path``."""
    counts = posts.where(F.col("id_company").isNotNull()).groupBy("id_company").agg(F.count(F.lit(1)).alias("postings"))
    total = counts.agg(F.sum("postings")).first()[0] or 0
    most = max(1, -(-total // buckets))
    salts = F.ceil(F.col("postings") / F.lit(most)).cast("int").alias("salts")
    hot = counts.where(F.col("postings") > most).select("id_company", salts)  # fewer than buckets
    none = F.coalesce("salts", F.lit(1))
    salt = F.pmod(F.xxhash64("id_jobpost"), none).cast("int").alias(SALT)
    salted = posts.join(F.broadcast(hot), "id_company", "left").select(*posts.columns, salt)
    every = F.explode(F.sequence(F.lit(0), none - 1)).alias(SALT)
    repeated = companies.join(F.broadcast(hot), "id_company", "left").select(*companies.columns, every)
    _store(salted, posts_name, f"{path}/posts", buckets)
    _store(repeated, companies_name, f"{path}/companies", buckets)


def read_for_join(spark: SparkSession, posts_name: str, companies_name: str) -> tuple[DataFrame, DataFrame]:
    return spark.table(posts_name), spark.table(companies_name)

"""The given tables seen as postings, companies, searches and logs.

Orders play the postings and customers the companies; each customer is also a
saved search, and the events are the request log. The rules below only shape
values: every row of the given tables takes part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vacantia.functions.columns import key_digest
from vacantia.sources.tables import read_table


def posts(spark: SparkSession, folder: str) -> DataFrame:
    def part_of_price(divisor: int) -> Column:
        return F.floor(F.col("o_totalprice") / divisor).cast("bigint").cast("string")

    key = F.col("o_orderkey")
    return read_table(spark, folder, "orders").select(
        key.alias("id_jobpost"),
        F.col("o_custkey").alias("id_company"),
        F.concat_ws("/", "o_orderstatus", "o_orderpriority").alias("jobtitle"),
        F.when(key % 11 != 0, part_of_price(4)).alias("minimumsalary"),
        F.when(key % 13 != 0, part_of_price(2)).alias("maximumsalary"),
        F.substring("o_orderpriority", 1, 1).alias("experience"),
        F.col("o_orderstatus").alias("qualification"),
        F.col("o_orderdate").alias("createdat"),
    )


def companies(spark: SparkSession, folder: str) -> DataFrame:
    nation = read_table(spark, folder, "nation")
    return (
        read_table(spark, folder, "customer")
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            F.col("c_custkey").alias("id_company"),
            F.col("c_name").alias("companyname"),
            F.col("n_name").alias("country"),
            F.col("c_acctbal").alias("sensitive"),
        )
    )


def untidy_companies(spark: SparkSession, folder: str) -> DataFrame:
    """Companies of which some are missing and some stand there twice."""
    key = F.col("id_company")
    whole = companies(spark, folder)
    branch = F.concat("companyname", F.lit(" (branch)"))
    return whole.where(key % 10 != 3).unionByName(whole.where(key % 25 == 1).withColumn("companyname", branch))


def untidy_posts(spark: SparkSession, folder: str) -> DataFrame:
    """Postings with unusable numbers and missing titles among them."""
    key = F.col("id_jobpost")
    low = F.col("minimumsalary")
    return posts(spark, folder).withColumns(
        {
            "minimumsalary": F.when(key % 23 == 0, F.lit("9223372036854775807"))
            .when(key % 29 == 0, F.lit("9223372036854775808"))
            .when(key % 6 == 0, F.concat(F.lit("  "), low, F.lit(" ")))
            .when(key % 6 == 1, F.concat(low, F.lit(".5")))
            .when(key % 6 == 2, F.concat(F.lit("-"), low))
            .when(key % 6 == 3, F.lit(""))
            .when(key % 6 == 4, F.concat(low, F.lit(" EUR")))
            .otherwise(low),
            "experience": F.when(key % 17 == 0, "n/a").otherwise(F.col("experience")),
            "jobtitle": F.when(key % 19 != 0, F.col("jobtitle")),
        }
    )


def searches(spark: SparkSession, folder: str) -> DataFrame:
    """One well-formed search per customer, as filter texts."""
    key, balance = F.col("c_custkey"), F.col("c_acctbal")
    level = F.element_at(F.array(*map(F.lit, ("junior", "mid", "senior"))), (key % 4).cast("int"))
    bound = (F.floor(balance / 100) * 2500).cast("bigint")
    values = {
        "seniority": F.when(key % 4 != 0, level),
        "experience_max": F.when(key % 3 == 0, (key % 7).cast("string")),
        "salary_min": F.when((balance >= 0) & (key % 5 < 3), bound.cast("string")),
        "country": F.when(key % 2 == 0, F.col("n_name")),
    }
    nation = read_table(spark, folder, "nation")
    return (
        read_table(spark, folder, "customer")
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            key.alias("request_id"),
            F.create_map(*[c for name, v in values.items() for c in (F.lit(name), v)]).alias("filters"),
            F.when(key % 11 % 3 == 0, "salary_max_desc")
            .when(key % 11 % 3 == 1, "salary_min_asc")
            .otherwise("experience_asc")
            .alias("sort"),
            (key % 100 + 1).cast("int").alias("limit"),
        )
    )


def doubtful_searches(spark: SparkSession, folder: str) -> DataFrame:
    """One search per customer, many of them breaking a rule."""
    key = F.col("c_custkey")
    values = {
        "seniority": F.when(key % 9 == 0, "lead+").when(key % 9 < 5, "mid"),
        "experience_max": F.when(key % 4 != 0, (key % 55).cast("string")),
        "salary_min": F.floor("c_acctbal").cast("bigint").cast("string"),
        "country": F.when(key % 8 == 0, F.repeat("c_name", 6)).when(key % 8 < 4, F.col("c_name")),
        "city": F.when(key % 10 == 0, F.col("c_mktsegment")),
    }
    filters = F.create_map(*[c for name, v in values.items() for c in (F.lit(name), v)])
    return read_table(spark, folder, "customer").select(
        key.alias("request_id"),
        F.when(key % 7 != 0, filters).alias("filters"),
        F.when(key % 6 == 0, "newest").otherwise("experience_asc").alias("sort"),
        (key % 120).cast("int").alias("limit"),
    )


def market_requests(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("c_custkey")
    return read_table(spark, folder, "customer").select(
        key.alias("request_id"),
        F.when(key % 3 == 0, "seniority").when(key % 3 == 1, "country")
        .otherwise(F.lower("c_mktsegment")).alias("dimension"),
        F.when(key % 4 == 0, "median_salary").when(key % 4 < 3, "posting_count")
        .alias("metric"),
    )


def priced_searches(spark: SparkSession, folder: str) -> DataFrame:
    """One search per order, with a bound of its own; valid requests in typed columns."""
    key = F.col("o_orderkey")
    level = F.element_at(F.array(*map(F.lit, ("junior", "mid", "senior"))), (key % 4).cast("int"))
    return read_table(spark, folder, "orders").select(
        key.alias("request_id"),
        F.when(key % 4 != 0, level).alias("seniority"),
        F.when(key % 3 == 0, (key % 7).cast("int")).alias("experience_max"),
        F.floor(F.col("o_totalprice") / 3).cast("bigint").alias("salary_min"),
        F.lit(None).cast("string").alias("country"),
        F.when(key % 2 == 0, "salary_max_desc").otherwise("salary_min_asc").alias("sort"),
        (key % 5 + 1).cast("int").alias("limit"),
    )


def events_by_client(spark: SparkSession, folder: str) -> DataFrame:
    """The request log of the limiter; some requests name no client."""
    user = F.when(F.col("event_id") % 19 != 0, F.col("user_id")).alias("user_id")
    return read_table(spark, folder, "events").select("event_id", user, "ts")


def request_log(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "events").select(
        "event_id",
        F.col("ts").cast("timestamp").alias("ts"),
        F.when(F.col("event_id") % 17 != 0, F.concat(F.lit("key-"), F.col("user_id"))).alias("raw_key"),
    )


def client_registry(spark: SparkSession, folder: str) -> DataFrame:
    """Clients of the log; every fifth now has another key, every third has an end date."""
    user = F.col("user_id")
    key = F.concat(F.when(user % 5 == 0, "new-key-").otherwise("key-"), user)
    return (
        read_table(spark, folder, "events")
        .select("user_id")
        .distinct()
        .select(
            user.alias("client_id"),
            key_digest(key).alias("key_sha256"),
            F.when(user % 3 == 0, F.lit("2024-01-15").cast("timestamp")).alias("expires_at"),
        )
    )

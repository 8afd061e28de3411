"""Operational tables to the silver posting table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacantia.functions.columns import posting_url, seniority_of, whole_number
from vacantia.schema import POSTING_COLUMNS
from vacantia.sources.bucketed import SALT
from vacantia.sources.workspace import stage


def _offered(posts: DataFrame, *more: str) -> DataFrame:
    return posts.select(
        F.col("id_company"),
        F.col("id_jobpost").cast("bigint").alias("job_id"),
        F.col("jobtitle").alias("title"),
        whole_number("minimumsalary").alias("salary_min"),
        whole_number("maximumsalary").alias("salary_max"),
        whole_number("experience", "int").cast("int").alias("years_exp"),
        F.col("qualification"),
        *more,
    )


def _employers(companies: DataFrame, *more: str) -> DataFrame:
    return companies.select(F.col("id_company"), F.col("companyname").alias("company_name"), F.col("country"), *more)


def _in_contract(joined: DataFrame) -> DataFrame:
    return (
        joined.withColumn("seniority", seniority_of("years_exp"))
        .withColumn("url", posting_url("job_id"))
        .select(*POSTING_COLUMNS)
    )


def build_silver(posts: DataFrame, companies: DataFrame) -> DataFrame:
    """Join postings with their companies and derive the contract columns.

    Only the named columns are read, so sensitive ones never leave the source.
    Neither side is hinted: the planner broadcasts the companies when their size
    allows it, otherwise the join shuffles and the adaptive planner splits the
    partitions of companies with very many postings. Tables that were stored for this
    join (``store_for_join``) are merged bucket by bucket, without a shuffle.
    """
    salted = [SALT] if SALT in posts.columns and SALT in companies.columns else []
    joined = _offered(posts, *salted).join(_employers(companies, *salted), ["id_company", *salted], "inner")
    return _in_contract(joined)


def build_silver_with_faults(posts: DataFrame, companies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Silver, and what the inner join loses or multiplies: ``id_company, fault, postings, companies``.

    ``fault`` is ``orphan`` for a key without a company (or NULL), whose postings are not in
    silver, and ``repeated`` for a key with several companies, whose postings are in silver
    once for each. One outer join reads each side once and is written to the shared folder;
    both results read that table. Faults are counted per key and company before they are
    shuffled by key.
    """
    row = F.monotonically_increasing_id().alias("company_row")
    employers = companies.select("*", row)
    joined = stage(_offered(posts).join(_employers(employers, "company_row"), "id_company", "left"), "posts-with-companies")
    silver = _in_contract(joined.where(F.col("company_row").isNotNull()))
    matches = joined.groupBy("id_company", "company_row").agg(F.count(F.lit(1)).alias("rows"))
    per_key = matches.groupBy("id_company").agg(F.max("rows").alias("postings"), F.count("company_row").alias("companies"))
    fault = F.when(F.col("companies") == 0, "orphan").otherwise("repeated").alias("fault")
    return silver, per_key.where(F.col("companies") != 1).select("id_company", fault, "postings", "companies")

"""Registered queries and the SQL each one is checked against."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vacantia.functions.columns import representative_salary
from vacantia.operators.bucket_levels import Quota
from vacantia.operators.contract import split_rows
from vacantia.operators.credentials import audit_credentials
from vacantia.operators.filters import Filters
from vacantia.operators.ordering import ordering
from vacantia.operators.requests import (
    market_request_fault,
    search_request_fault,
    typed_search_requests,
    validate,
)
from vacantia.operators.saved_searches import saved_search_hits, saved_search_totals
from vacantia.operators.standing_searches import (
    read_standing_hits,
    start_standing_searches,
    update_standing_searches,
)
from vacantia.operators.token_bucket import admit_requests
from vacantia.plans.access import decide_access
from vacantia.plans.export import numbered_result
from vacantia.plans.gold import build_gold, gold_of_counts, take_in_changes
from vacantia.plans.metrics import market_metrics
from vacantia.plans.search import Cursor, fingerprint, matching, page_rows, search, with_position
from vacantia.plans.silver import build_silver, build_silver_with_faults
from vacantia.session import pin_session
from vacantia.sources import samples
from vacantia.sources.bucketed import read_for_join, store_for_join
from vacantia.sources.buckets import changes_between, read_bucketed, refresh_postings
from vacantia.sources.rank_index import build_rank_index, page_behind, page_by_number
from vacantia.sources.sinks import write_metrics, write_postings
from vacantia.sources.tables import read_metrics, read_postings
from vacantia.sources.workspace import new_path, stage
from vacantia.streaming.token_bucket import read_decisions, start_admission

RUN_AT = datetime(2024, 2, 1, tzinfo=timezone.utc)
QUOTA = Quota(tokens=1, per_us=12 * 3600 * 1_000_000, capacity=3)
HOSTILE = "NATION_1'; DROP TABLE orders; --"

Query = Callable[[SparkSession, str], DataFrame]

# ---------------------------------------------------------------- SQL building blocks

POSTS_SQL = """
posts AS (
  SELECT o_orderkey AS id_jobpost, o_custkey AS id_company,
         concat(o_orderstatus, '/', o_orderpriority) AS jobtitle,
         CASE WHEN o_orderkey % 11 = 0 THEN NULL
              ELSE CAST(CAST(floor(o_totalprice / 4) AS BIGINT) AS VARCHAR) END AS minimumsalary,
         CASE WHEN o_orderkey % 13 = 0 THEN NULL
              ELSE CAST(CAST(floor(o_totalprice / 2) AS BIGINT) AS VARCHAR) END AS maximumsalary,
         substring(o_orderpriority, 1, 1) AS experience,
         o_orderstatus AS qualification, o_orderdate AS createdat
  FROM orders),
company AS (
  SELECT c_custkey AS id_company, c_name AS companyname, n_name AS country
  FROM customer JOIN nation ON c_nationkey = n_nationkey)"""


def _silver_sql(source: str = "posts") -> str:
    return f"""
silver AS (
  SELECT job_id, title, company_name, country,
         CASE WHEN years_exp <= 1 THEN 'junior' WHEN years_exp <= 3 THEN 'mid'
              WHEN years_exp IS NOT NULL THEN 'senior' END AS seniority,
         years_exp, salary_min, salary_max, qualification,
         concat('/view-job-post.php?id=', CAST(job_id AS VARCHAR)) AS url
  FROM (SELECT p.id_jobpost AS job_id, jobtitle AS title, companyname AS company_name, country,
               CASE WHEN regexp_full_match(trim(experience), '[0-9]+')
                    THEN CAST(trim(experience) AS INTEGER) END AS years_exp,
               CASE WHEN regexp_full_match(trim(minimumsalary), '[0-9]+')
                    THEN TRY_CAST(trim(minimumsalary) AS BIGINT) END AS salary_min,
               CASE WHEN regexp_full_match(trim(maximumsalary), '[0-9]+')
                    THEN CAST(trim(maximumsalary) AS BIGINT) END AS salary_max,
               qualification
        FROM {source} p JOIN company c ON c.id_company = p.id_company))"""


SILVER_SQL = f"WITH {POSTS_SQL}, {_silver_sql()}"

FAULTY_SQL = f"""WITH {POSTS_SQL.replace("company AS (", "whole AS (")},
company AS (SELECT * FROM whole WHERE id_company % 10 <> 3
            UNION ALL SELECT id_company, companyname || ' (branch)', country FROM whole WHERE id_company % 25 = 1)"""

UNTIDY_SQL = f"""WITH {POSTS_SQL}, untidy AS (
  SELECT * REPLACE (
    CASE WHEN id_jobpost % 23 = 0 THEN '9223372036854775807' WHEN id_jobpost % 29 = 0 THEN '9223372036854775808'
    ELSE CASE id_jobpost % 6 WHEN 0 THEN '  ' || minimumsalary || ' ' WHEN 1 THEN minimumsalary || '.5'
         WHEN 2 THEN '-' || minimumsalary WHEN 3 THEN '' WHEN 4 THEN minimumsalary || ' EUR'
         ELSE minimumsalary END END AS minimumsalary,
    CASE WHEN id_jobpost % 17 = 0 THEN 'n/a' ELSE experience END AS experience,
    CASE WHEN id_jobpost % 19 = 0 THEN NULL ELSE jobtitle END AS jobtitle)
  FROM posts), {_silver_sql("untidy")}"""

GOLD_SQL = """
rep AS (SELECT seniority, country, (salary_min + salary_max) / 2.0 AS salary FROM silver
        WHERE salary_min IS NOT NULL AND salary_max IS NOT NULL),
gold AS (
  SELECT 'seniority' AS dimension, seniority AS dimension_value,
         median(salary) AS median_salary, count(*) AS posting_count, '2024-02-01 00:00:00' AS as_of
  FROM rep GROUP BY seniority
  UNION ALL
  SELECT 'country', country, median(salary), count(*), '2024-02-01 00:00:00' FROM rep GROUP BY country)"""

ORDER_SQL = {
    "salary_max_desc": "-coalesce(salary_max, 0), job_id",
    "salary_min_asc": "coalesce(salary_min, 0), job_id",
    "experience_asc": "years_exp, job_id",
}

SEARCHES_SQL = """
searches AS (
  SELECT c_custkey AS request_id,
         CASE c_custkey % 4 WHEN 1 THEN 'junior' WHEN 2 THEN 'mid' WHEN 3 THEN 'senior' END AS w_seniority,
         CASE WHEN c_custkey % 3 = 0 THEN c_custkey % 7 END AS w_years,
         CASE WHEN c_acctbal >= 0 AND c_custkey % 5 < 3
              THEN CAST(floor(c_acctbal / 100) AS BIGINT) * 2500 END AS w_salary,
         CASE WHEN c_custkey % 2 = 0 THEN n_name END AS w_country,
         CASE c_custkey % 11 % 3 WHEN 0 THEN 'salary_max_desc' WHEN 1 THEN 'salary_min_asc'
              ELSE 'experience_asc' END AS w_sort,
         c_custkey % 100 + 1 AS w_limit
  FROM customer JOIN nation ON c_nationkey = n_nationkey),
matches AS (
  SELECT request_id, w_limit, job_id,
         CASE w_sort WHEN 'salary_max_desc' THEN -coalesce(salary_max, 0)
              WHEN 'salary_min_asc' THEN coalesce(salary_min, 0) ELSE years_exp END AS sort_key
  FROM searches JOIN silver
    ON seniority = coalesce(w_seniority, seniority) AND years_exp <= coalesce(w_years, years_exp)
   AND coalesce(salary_max, -1) >= coalesce(w_salary, -1) AND country = coalesce(w_country, country))"""

# Pages of five at most, so that the pairs stay few enough for one process.
PRICED_SQL = """
searches AS (
  SELECT o_orderkey AS request_id,
         CASE o_orderkey % 4 WHEN 1 THEN 'junior' WHEN 2 THEN 'mid' WHEN 3 THEN 'senior' END AS w_seniority,
         CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 7 END AS w_years,
         CAST(floor(o_totalprice / 3) AS BIGINT) AS w_salary,
         CASE WHEN o_orderkey % 2 = 0 THEN 'salary_max_desc' ELSE 'salary_min_asc' END AS w_sort,
         o_orderkey % 5 + 1 AS w_limit
  FROM orders),
matches AS (
  SELECT request_id, w_limit, job_id,
         CASE w_sort WHEN 'salary_max_desc' THEN -coalesce(salary_max, 0) ELSE coalesce(salary_min, 0) END AS sort_key
  FROM searches JOIN silver
    ON seniority = coalesce(w_seniority, seniority) AND years_exp <= coalesce(w_years, years_exp)
   AND salary_max >= w_salary)"""

LOG_SQL = """
log AS (SELECT event_id, ts, CASE WHEN event_id % 17 <> 0
               THEN concat('key-', CAST(user_id AS VARCHAR)) END AS raw_key FROM events),
registry AS (SELECT DISTINCT user_id AS client_id,
                    sha256(concat(CASE WHEN user_id % 5 = 0 THEN 'new-key-' ELSE 'key-' END,
                                  CAST(user_id AS VARCHAR))) AS key_sha256,
                    CASE WHEN user_id % 3 = 0 THEN TIMESTAMP '2024-01-15' END AS expires_at
             FROM events),
audited AS (
  SELECT event_id, ts, client_id,
         CASE WHEN raw_key IS NULL THEN 'missing' WHEN client_id IS NULL THEN 'unknown'
              WHEN ts > expires_at THEN 'expired' ELSE 'ok' END AS status
  FROM log LEFT JOIN registry ON sha256(raw_key) = key_sha256)"""


def _bucket_sql(source: str) -> str:
    """Sequential token bucket over ``source(client, event_id, us)`` in whole units."""
    unit, full = QUOTA.per_us, QUOTA.full
    level = f"least({full}, b.level + (n.us - b.us) * {QUOTA.tokens})"
    return f"""
numbered AS (SELECT client, event_id, us,
                    row_number() OVER (PARTITION BY client ORDER BY us, event_id) AS i FROM {source}),
bucket AS (
  SELECT client, event_id, us, i, CAST({full - unit} AS BIGINT) AS level, TRUE AS admitted
  FROM numbered WHERE i = 1
  UNION ALL
  SELECT n.client, n.event_id, n.us, n.i,
         CASE WHEN {level} >= {unit} THEN {level} - {unit} ELSE {level} END, {level} >= {unit}
  FROM bucket b JOIN numbered n ON n.client = b.client AND n.i = b.i + 1)"""


EVENTS_SQL = """requests AS (
  SELECT user_id AS client, event_id, epoch_us(ts) AS us FROM events WHERE event_id % 19 <> 0)"""
BUCKET_SQL = f"""WITH RECURSIVE {EVENTS_SQL}, {_bucket_sql("requests")}
SELECT client AS user_id, event_id, admitted, level / {QUOTA.per_us}.0 AS tokens_left FROM bucket
UNION ALL SELECT NULL, event_id, NULL, NULL FROM events WHERE event_id % 19 = 0"""

# ---------------------------------------------------------------- queries


def _silver(spark: SparkSession, folder: str) -> DataFrame:
    pin_session(spark)
    return build_silver(samples.posts(spark, folder), samples.companies(spark, folder))


def _midpoints(spark: SparkSession, folder: str) -> DataFrame:
    priced = _silver(spark, folder).dropna(subset=["salary_min", "salary_max"])
    return priced.select("job_id", representative_salary().alias("rep_salary"))


def _silver_rewrite(spark: SparkSession, folder: str) -> DataFrame:
    path = new_path(spark, "silver")
    for _ in range(2):
        write_postings(_silver(spark, folder), path, cluster_by=("country", "salary_max"))
    return read_postings(spark, path)


def _earlier(silver: DataFrame) -> DataFrame:
    """Silver as an earlier load may have left it: other salaries, rows since gone, rows yet to come."""
    n = F.col("job_id")
    known = silver.where(n % 11 != 4).withColumn("salary_max", F.when(n % 7 == 0, n % 1000).otherwise(F.col("salary_max")))
    return known.unionByName(silver.where(n % 9 == 1).withColumn("job_id", -n).withColumn("country", F.lit("NOWHERE")))


def _silver_by_difference(spark: SparkSession, folder: str) -> DataFrame:
    path = new_path(spark, "silver")
    silver = _silver(spark, folder)
    refresh_postings(_earlier(silver), path, buckets=32, cluster_by=("country",))
    refresh_postings(silver, path, cluster_by=("country",))
    return read_bucketed(spark, path)


def _silver_changes(spark: SparkSession, folder: str) -> DataFrame:
    path = new_path(spark, "silver")
    silver = _silver(spark, folder)
    first = refresh_postings(_earlier(silver), path, buckets=32)
    refresh_postings(silver, path)
    return changes_between(spark, path, first.version).select("job_id", "sign", "country", "salary_max")


def _gold_incremental(spark: SparkSession, folder: str) -> DataFrame:
    """Gold from counts that an earlier load left and a refresh by difference brought up to date."""
    path, counts = new_path(spark, "silver"), new_path(spark, "gold-counts")
    silver = _silver(spark, folder)
    first = refresh_postings(_earlier(silver), path, buckets=32)
    take_in_changes(changes_between(spark, path, None, first.version), counts)
    refresh_postings(silver, path)
    take_in_changes(changes_between(spark, path, first.version), counts)
    return _dated(gold_of_counts(spark, counts, RUN_AT))


def _silver_bucketed(spark: SparkSession, folder: str) -> DataFrame:
    """Silver by a merge of stored buckets; the catalog entries go, their files are the working folder's."""
    pin_session(spark)
    path = new_path(spark, "join-tables")
    posts, companies = (f"{name}_{path.rsplit('-', 1)[1]}" for name in ("posts", "companies"))
    store_for_join(samples.posts(spark, folder), samples.companies(spark, folder), posts, companies, path, buckets=16)
    silver = build_silver(*read_for_join(spark, posts, companies))
    for name in (posts, companies):
        spark.sql(f"DROP TABLE {name}")
    return silver


def _faulty(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    pin_session(spark)
    return build_silver_with_faults(samples.posts(spark, folder), samples.untidy_companies(spark, folder))


def _ranked_page(sort: str, number: int, **filters) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        path = new_path(spark, "rank-index")
        build_rank_index(_silver(spark, folder), path, sort, Filters(**filters), rows_per_file=5_000)
        return page_by_number(spark, path, number, sort)

    return run


def _ranked_page_sql(sort: str, number: int, where: str = "TRUE") -> str:
    return f"""{_export_sql(sort, where)}) WHERE page_no = {number}""".replace("SELECT *, (rank", "SELECT * FROM (SELECT *, (rank", 1)


def _page_behind(sort: str) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        path = new_path(spark, "rank-index")
        build_rank_index(_silver(spark, folder), path, sort, rows_per_file=5_000)
        last = page_by_number(spark, path, 9, sort).withColumn("key", ordering(sort).key()).orderBy(F.desc("rank")).first()
        return page_behind(spark, path, last["key"], last["job_id"], sort, limit=50)

    return run


def _stored_ci(spark: SparkSession, folder: str) -> DataFrame:
    path = new_path(spark, "silver")
    write_postings(_silver(spark, folder), path)
    page = page_rows(read_postings(spark, path, with_key=True), Filters(country="nAtIoN_1"), limit=100, ignore_case=True)
    return with_position(page, "salary_max_desc")


def _load_report(spark: SparkSession, folder: str) -> DataFrame:
    silver, gold = new_path(spark, "silver"), new_path(spark, "gold")
    rows = write_postings(_silver(spark, folder), silver)
    groups = write_metrics(build_gold(read_postings(spark, silver), RUN_AT), gold)
    return spark.createDataFrame(
        [("silver", rows), ("gold", groups)], "table_name string, row_count bigint"
    )


def _gold(spark: SparkSession, folder: str) -> DataFrame:
    return build_gold(_silver(spark, folder), RUN_AT)


def _dated(metrics: DataFrame) -> DataFrame:
    """The build time as text, so that both engines show it alike."""
    return metrics.withColumn("as_of", F.date_format("as_of", "yyyy-MM-dd HH:mm:ss"))


def _gold_rewrite(spark: SparkSession, folder: str) -> DataFrame:
    path = new_path(spark, "gold")
    for _ in range(2):
        write_metrics(_gold(spark, folder), path)
    return _dated(read_metrics(spark, path))


def _contract(spark: SparkSession, folder: str) -> DataFrame:
    pin_session(spark)
    silver = build_silver(samples.untidy_posts(spark, folder), samples.companies(spark, folder))
    accepted, rejected = split_rows(silver)
    named = rejected.select("job_id", F.array_join("violations", ",").alias("violations"))
    return accepted.select("job_id", F.lit("").alias("violations")).unionByName(named)


def _untidy_numbers(spark: SparkSession, folder: str) -> DataFrame:
    pin_session(spark)
    silver = build_silver(samples.untidy_posts(spark, folder), samples.companies(spark, folder))
    # As text: frames of other libraries would round numbers of 19 digits beside NULL.
    low, high = (F.col(name).cast("string").alias(name) for name in ("salary_min", "salary_max"))
    return silver.select("job_id", "years_exp", "seniority", low, high)


def _page(sort: str = "salary_max_desc", ignore_case: bool = False, **filters) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        page = page_rows(_silver(spark, folder), Filters(**filters), sort, 100, ignore_case=ignore_case)
        return with_position(page, sort)

    return run


def _page_sql(where: str = "TRUE", sort: str = "salary_max_desc", first: int = 1, last: int = 100) -> str:
    return f"""{SILVER_SQL} SELECT * FROM (
  SELECT *, row_number() OVER (ORDER BY {ORDER_SQL[sort]}) AS pos FROM silver WHERE {where})
WHERE pos BETWEEN {first} AND {last}"""


def _stored_silver(spark: SparkSession, folder: str) -> DataFrame:
    path = new_path(spark, "silver")
    write_postings(_silver(spark, folder), path, cluster_by=("country", "salary_max"))
    return read_postings(spark, path)


def _stored_page(spark: SparkSession, folder: str) -> DataFrame:
    """The first page of a search over the stored silver table."""
    filters = Filters(seniority="mid", experience_max=3, salary_min=40_000, country="NATION_7")
    return with_position(page_rows(_stored_silver(spark, folder), filters, "salary_max_desc", 100), "salary_max_desc")


def _stored_second_page(spark: SparkSession, folder: str) -> DataFrame:
    silver = _stored_silver(spark, folder)
    first = search(silver, sort="salary_min_asc", limit=20, with_total=False)
    page = page_rows(silver, sort="salary_min_asc", limit=20, cursor=first.next_cursor)
    return with_position(page, "salary_min_asc", start=21)


def _stored_metrics(dimension: str) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        path = new_path(spark, "gold")
        write_metrics(_gold(spark, folder), path)
        return _dated(market_metrics(read_metrics(spark, path), dimension))

    return run


def _second_page(sort: str) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        silver = _silver(spark, folder)
        first = search(silver, sort=sort, limit=20, with_total=False)
        page = page_rows(silver, sort=sort, limit=20, cursor=first.next_cursor)
        return with_position(page, sort, start=21)

    return run


def _zero_key_page(spark: SparkSession, folder: str) -> DataFrame:
    """A page from the middle of the postings without an upper salary."""
    cursor = Cursor(fingerprint(Filters(), "salary_max_desc"), 0, 700)
    page = page_rows(_silver(spark, folder), limit=20, cursor=cursor)
    return with_position(page, "salary_max_desc")


def _total(spark: SparkSession, folder: str) -> DataFrame:
    found = matching(_silver(spark, folder), Filters(country="NATION_1", salary_min=50_000))
    return found.agg(F.count(F.lit(1)).alias("total"))


def _export(sort: str, **filters) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return numbered_result(_silver(spark, folder), Filters(**filters), sort, page_size=20)

    return run


def _export_sql(sort: str, where: str = "TRUE") -> str:
    return f"""{SILVER_SQL} SELECT *, (rank - 1) // 20 + 1 AS page_no FROM (
  SELECT *, row_number() OVER (ORDER BY {ORDER_SQL[sort]}) AS rank FROM silver WHERE {where})"""


def _metrics(dimension: str) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return _dated(market_metrics(_gold(spark, folder), dimension))

    return run


def _metrics_sql(dimension: str) -> str:
    return f"""{SILVER_SQL}, {GOLD_SQL}
SELECT dimension_value, CASE WHEN posting_count >= 5 THEN median_salary END AS median_salary,
       posting_count, as_of FROM gold WHERE dimension = '{dimension}'"""


def _small_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Each company stands for a country of its own, so many groups are small."""
    pin_session(spark)
    companies = samples.companies(spark, folder).withColumn("country", F.col("companyname"))
    gold = build_gold(build_silver(samples.posts(spark, folder), companies), RUN_AT)
    return _dated(market_metrics(gold, "country"))


def _validate_searches(spark: SparkSession, folder: str) -> DataFrame:
    return validate(samples.doubtful_searches(spark, folder), search_request_fault())


def _validate_required(spark: SparkSession, folder: str) -> DataFrame:
    fault = search_request_fault(required=("country",))
    return validate(samples.doubtful_searches(spark, folder), fault)


def _validate_market(spark: SparkSession, folder: str) -> DataFrame:
    return validate(samples.market_requests(spark, folder), market_request_fault())


def _saved_hits(spark: SparkSession, folder: str) -> DataFrame:
    searches = typed_search_requests(samples.searches(spark, folder))
    return saved_search_hits(searches, _silver(spark, folder))


def _saved_totals(spark: SparkSession, folder: str) -> DataFrame:
    searches = typed_search_requests(samples.searches(spark, folder))
    return saved_search_totals(searches, _silver(spark, folder))


def _standing_hits(spark: SparkSession, folder: str) -> DataFrame:
    """The pages that an earlier load left, brought up to date by what came and went since."""
    path, table = new_path(spark, "standing-searches"), new_path(spark, "silver")
    # Both are read several times.
    searches = stage(typed_search_requests(samples.searches(spark, folder)), "searches")
    silver = stage(_silver(spark, folder), "source-silver")
    first = refresh_postings(_earlier(silver), table, buckets=32)
    start_standing_searches(searches, read_bucketed(spark, table), path)
    refresh_postings(silver, table)
    update_standing_searches(searches, read_bucketed(spark, table), changes_between(spark, table, first.version), path)
    return read_standing_hits(spark, path).select("request_id", "pos", "job_id")


def _priced_hits(spark: SparkSession, folder: str) -> DataFrame:
    return saved_search_hits(samples.priced_searches(spark, folder), _silver(spark, folder))


def _priced_totals(spark: SparkSession, folder: str) -> DataFrame:
    return saved_search_totals(samples.priced_searches(spark, folder), _silver(spark, folder))


def _audit(spark: SparkSession, folder: str) -> DataFrame:
    pin_session(spark)
    audited = audit_credentials(samples.request_log(spark, folder), samples.client_registry(spark, folder))
    return audited.select("event_id", "client_id", "status")


def _bucket_batch(spark: SparkSession, folder: str) -> DataFrame:
    pin_session(spark)
    log = samples.events_by_client(spark, folder)
    return admit_requests(log, QUOTA, client="user_id").select(
        "user_id", "event_id", "admitted", "tokens_left"
    )


def _bucket_stream(spark: SparkSession, folder: str) -> DataFrame:
    """The log arrives in four stretches of time, each of them one micro-batch.

    One scan deals the log to its stretches; the stream is started again for every stretch
    and takes whatever files that one has. Requests without a time come first, where they
    stop the stream.
    """
    pin_session(spark)
    source, path, checkpoint = (new_path(spark, name) for name in ("arrivals", "decisions", "admission-checkpoint"))
    events = samples.events_by_client(spark, folder)
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    bounds = events.select(F.expr("percentile_approx(unix_micros(cast(ts AS timestamp)), array(0.25, 0.5, 0.75))")).first()[0]
    number = sum(((us > bound).cast("int") for bound in bounds or []), F.lit(0))
    dealt = new_path(spark, "stretches")
    events.withColumn("stretch", F.coalesce(number, F.lit(0))).write.partitionBy("stretch").parquet(dealt)
    stretches = spark.read.schema(T.StructType([*events.schema, T.StructField("stretch", T.IntegerType())])).parquet(dealt)
    for stretch in range(len(bounds or []) + 1):
        stretches.where(F.col("stretch") == stretch).drop("stretch").write.mode("append").parquet(source)
        log = spark.readStream.schema(events.schema).parquet(source)
        start_admission(log, QUOTA, path, checkpoint, client="user_id").awaitTermination()
    return read_decisions(spark, path).select("user_id", "event_id", "admitted", "tokens_left")


def _access(spark: SparkSession, folder: str) -> DataFrame:
    pin_session(spark)
    return decide_access(
        samples.request_log(spark, folder), samples.client_registry(spark, folder), QUOTA
    )


REGISTERED: dict[str, tuple[Query, str]] = {
    "silver_build": (_silver, f"{SILVER_SQL} SELECT * FROM silver"),
    "silver_untidy_numbers": (
        _untidy_numbers,
        f"""{UNTIDY_SQL} SELECT job_id, years_exp, seniority, CAST(salary_min AS VARCHAR) AS salary_min,
  CAST(salary_max AS VARCHAR) AS salary_max FROM silver""",
    ),
    "representative_salary": (
        _midpoints,
        f"""{SILVER_SQL} SELECT job_id, (salary_min + salary_max) / 2.0 AS rep_salary FROM silver
WHERE salary_min IS NOT NULL AND salary_max IS NOT NULL""",
    ),
    "silver_rewrite": (_silver_rewrite, f"{SILVER_SQL} SELECT * FROM silver"),
    "silver_by_difference": (_silver_by_difference, f"{SILVER_SQL} SELECT * FROM silver"),
    "silver_changes": (
        _silver_changes,
        f"""{SILVER_SQL}, earlier AS (
  SELECT job_id, country, CASE WHEN job_id % 7 = 0 THEN job_id % 1000 ELSE salary_max END AS salary_max FROM silver WHERE job_id % 11 <> 4
  UNION ALL SELECT -job_id, 'NOWHERE', salary_max FROM silver WHERE job_id % 9 = 1),
now_ AS (SELECT job_id, country, salary_max FROM silver)
SELECT 1 AS sign, * FROM (SELECT * FROM now_ EXCEPT SELECT * FROM earlier)
UNION ALL SELECT -1, * FROM (SELECT * FROM earlier EXCEPT SELECT * FROM now_)""",
    ),
    "gold_incremental": (_gold_incremental, f"{SILVER_SQL}, {GOLD_SQL} SELECT * FROM gold"),
    "silver_bucketed_join": (_silver_bucketed, f"{SILVER_SQL} SELECT * FROM silver"),
    "silver_of_faulty_keys": (lambda spark, folder: _faulty(spark, folder)[0], f"{FAULTY_SQL}, {_silver_sql()} SELECT * FROM silver"),
    "silver_key_faults": (
        lambda spark, folder: _faulty(spark, folder)[1],
        f"""{FAULTY_SQL}, keys AS (SELECT id_company, count(*) AS companies FROM company GROUP BY id_company)
SELECT p.id_company, CASE WHEN companies IS NULL THEN 'orphan' ELSE 'repeated' END AS fault, count(*) AS postings,
       coalesce(companies, 0) AS companies
FROM posts p LEFT JOIN keys k ON k.id_company = p.id_company WHERE companies IS NULL OR companies > 1
GROUP BY p.id_company, companies""",
    ),
    "search_country_ci_stored": (_stored_ci, _page_sql("lower(coalesce(country, '')) = lower('nation_1')")),
    **{f"page_by_number_{sort}": (_ranked_page(sort, 50), _ranked_page_sql(sort, 50)) for sort in ORDER_SQL},
    "page_by_number_filtered": (
        _ranked_page("salary_min_asc", 20, seniority="senior"),
        _ranked_page_sql("salary_min_asc", 20, "seniority = 'senior'"),
    ),
    "page_behind_cursor": (
        _page_behind("salary_max_desc"),
        f"""{SILVER_SQL} SELECT * FROM (
  SELECT *, row_number() OVER (ORDER BY {ORDER_SQL["salary_max_desc"]}) AS rank FROM silver) WHERE rank BETWEEN 181 AND 230""",
    ),
    "contract_split": (
        _contract,
        f"""{UNTIDY_SQL} SELECT job_id, concat_ws(',', CASE WHEN title IS NULL THEN 'title' END,
  CASE WHEN years_exp IS NULL THEN 'years_exp' END,
  CASE WHEN seniority IS NULL THEN 'seniority' END) AS violations FROM silver""",
    ),
    "load_report": (
        _load_report,
        f"""{SILVER_SQL}, {GOLD_SQL} SELECT 'silver' AS table_name, count(*) AS row_count FROM silver
UNION ALL SELECT 'gold', count(*) FROM gold""",
    ),
    "search_seniority": (_page(seniority="senior"), _page_sql("seniority = 'senior'")),
    "search_experience_max": (_page(experience_max=2), _page_sql("years_exp <= 2")),
    "search_salary_min": (_page(salary_min=150_000), _page_sql("salary_max >= 150000")),
    "search_country": (_page(country="NATION_1"), _page_sql("country = 'NATION_1'")),
    "search_country_ci": (
        _page(ignore_case=True, country="nation_1"),
        _page_sql("lower(coalesce(country, '')) = lower('nation_1')"),
    ),
    "search_all": (
        _page(seniority="mid", experience_max=3, salary_min=40_000, country="NATION_7"),
        _page_sql(
            "seniority = 'mid' AND years_exp <= 3 AND salary_max >= 40000 AND country = 'NATION_7'"
        ),
    ),
    "search_hostile_value": (
        _page(country=HOSTILE),
        _page_sql("country = '" + HOSTILE.replace("'", "''") + "'"),
    ),
    "search_total": (
        _total,
        f"{SILVER_SQL} SELECT count(*) AS total FROM silver "
        "WHERE country = 'NATION_1' AND salary_max >= 50000",
    ),
    **{f"order_{sort}": (_page(sort), _page_sql(sort=sort)) for sort in ORDER_SQL},
    **{
        f"keyset_page2_{sort}": (_second_page(sort), _page_sql(sort=sort, first=21, last=40))
        for sort in ORDER_SQL
    },
    "stored_search": (
        _stored_page,
        _page_sql(
            "seniority = 'mid' AND years_exp <= 3 AND salary_max >= 40000 AND country = 'NATION_7'"
        ),
    ),
    "stored_keyset_page2": (_stored_second_page, _page_sql(sort="salary_min_asc", first=21, last=40)),
    "stored_metrics_seniority": (_stored_metrics("seniority"), _metrics_sql("seniority")),
    "stored_metrics_country": (_stored_metrics("country"), _metrics_sql("country")),
    "keyset_zero_key": (
        _zero_key_page,
        _page_sql("coalesce(salary_max, 0) = 0 AND job_id > 700", last=20),
    ),
    "page_export": (_export("salary_max_desc"), _export_sql("salary_max_desc")),
    "page_export_filtered": (
        _export("salary_min_asc", seniority="senior"),
        _export_sql("salary_min_asc", "seniority = 'senior'"),
    ),
    "gold_build": (
        lambda spark, folder: _dated(_gold(spark, folder)),
        f"{SILVER_SQL}, {GOLD_SQL} SELECT * FROM gold",
    ),
    "gold_rewrite": (_gold_rewrite, f"{SILVER_SQL}, {GOLD_SQL} SELECT * FROM gold"),
    "market_metrics_seniority": (_metrics("seniority"), _metrics_sql("seniority")),
    "market_metrics_country": (_metrics("country"), _metrics_sql("country")),
    "market_metrics_small_groups": (
        _small_groups,
        f"""WITH {POSTS_SQL.replace("n_name AS country", "c_name AS country")}, {_silver_sql()}, {GOLD_SQL}
SELECT dimension_value, CASE WHEN posting_count >= 5 THEN median_salary END AS median_salary,
       posting_count, as_of FROM gold WHERE dimension = 'country'""",
    ),
    **{
        name: (
            query,
            f"""{SILVER_SQL}, {SEARCHES_SQL} SELECT request_id, pos, job_id FROM (
  SELECT request_id, w_limit, job_id,
         row_number() OVER (PARTITION BY request_id ORDER BY sort_key, job_id) AS pos FROM matches)
WHERE pos <= w_limit""",
        )
        for name, query in (("saved_search_hits", _saved_hits), ("standing_search_hits", _standing_hits))
    },
    "saved_search_totals": (
        _saved_totals,
        f"""{SILVER_SQL}, {SEARCHES_SQL} SELECT s.request_id, count(job_id) AS total
FROM searches s LEFT JOIN matches m ON m.request_id = s.request_id GROUP BY s.request_id""",
    ),
    "priced_search_hits": (
        _priced_hits,
        f"""{SILVER_SQL}, {PRICED_SQL} SELECT request_id, pos, job_id FROM (
  SELECT request_id, w_limit, job_id,
         row_number() OVER (PARTITION BY request_id ORDER BY sort_key, job_id) AS pos FROM matches)
WHERE pos <= w_limit""",
    ),
    "priced_search_totals": (
        _priced_totals,
        f"""{SILVER_SQL}, {PRICED_SQL} SELECT s.request_id, count(job_id) AS total
FROM searches s LEFT JOIN matches m ON m.request_id = s.request_id GROUP BY s.request_id""",
    ),
    "credential_audit": (
        _audit,
        f"WITH {LOG_SQL} SELECT event_id, client_id, status FROM audited",
    ),
    "token_bucket_batch": (_bucket_batch, BUCKET_SQL),
    "token_bucket_stream": (_bucket_stream, BUCKET_SQL),
    "access_decisions": (
        _access,
        f"""WITH RECURSIVE {LOG_SQL},
requests AS (SELECT client_id AS client, event_id, epoch_us(ts) AS us FROM audited WHERE status = 'ok'),
{_bucket_sql("requests")}
SELECT event_id, client_id, status FROM audited WHERE status <> 'ok'
UNION ALL SELECT event_id, client, CASE WHEN admitted THEN 'ok' ELSE 'limited' END FROM bucket""",
    ),
}


def _request_sql(required: bool) -> str:
    missing = "WHEN country IS NULL THEN 'MISSING_REQUIRED_FILTER filters.country'" if required else ""
    return f"""WITH asked AS (
  SELECT c_custkey AS request_id, c_custkey % 120 AS w_limit,
         CASE WHEN c_custkey % 9 = 0 THEN 'lead+' WHEN c_custkey % 9 < 5 THEN 'mid' END AS seniority,
         CASE WHEN c_custkey % 4 <> 0 THEN c_custkey % 55 END AS years,
         CAST(floor(c_acctbal) AS BIGINT) AS salary,
         CASE WHEN c_custkey % 8 = 0 THEN repeat(c_name, 6) WHEN c_custkey % 8 < 4 THEN c_name END AS country,
         CASE WHEN c_custkey % 10 = 0 THEN c_mktsegment END AS city,
         CASE WHEN c_custkey % 6 = 0 THEN 'newest' ELSE 'experience_asc' END AS sort
  FROM customer),
given AS (SELECT * REPLACE (
    CASE WHEN request_id % 7 <> 0 THEN seniority END AS seniority, CASE WHEN request_id % 7 <> 0 THEN years END AS years,
    CASE WHEN request_id % 7 <> 0 THEN salary END AS salary, CASE WHEN request_id % 7 <> 0 THEN country END AS country,
    CASE WHEN request_id % 7 <> 0 THEN city END AS city) FROM asked),
judged AS (
  SELECT request_id, CASE
    WHEN w_limit > 100 THEN 'LIMIT_EXCEEDED limit'
    WHEN city IS NOT NULL THEN 'INVALID_FILTER filters.city'
    {missing}
    WHEN seniority NOT IN ('junior', 'mid', 'senior') THEN 'INVALID_FILTER filters.seniority'
    WHEN years NOT BETWEEN 0 AND 50 THEN 'INVALID_FILTER filters.experience_max'
    WHEN salary NOT BETWEEN 0 AND 1000000000 THEN 'INVALID_FILTER filters.salary_min'
    WHEN length(country) > 100 THEN 'INVALID_FILTER filters.country'
    WHEN sort NOT IN ('salary_max_desc', 'salary_min_asc', 'experience_asc') THEN 'INVALID_REQUEST sort'
    WHEN w_limit < 1 THEN 'INVALID_REQUEST limit' END AS fault FROM given)
SELECT request_id, fault IS NULL AS ok, CASE WHEN fault IS NOT NULL THEN split_part(fault, ' ', 1) END AS code,
       CASE WHEN fault IS NOT NULL THEN split_part(fault, ' ', 2) END AS field FROM judged"""


REGISTERED |= {
    "validate_requests": (_validate_searches, _request_sql(required=False)),
    "validate_required_filter": (_validate_required, _request_sql(required=True)),
    "validate_market_requests": (
        _validate_market,
        """WITH asked AS (
  SELECT c_custkey AS request_id,
         CASE c_custkey % 3 WHEN 0 THEN 'seniority' WHEN 1 THEN 'country'
              ELSE lower(c_mktsegment) END AS dimension,
         CASE WHEN c_custkey % 4 = 0 THEN 'median_salary' WHEN c_custkey % 4 < 3 THEN 'posting_count' END AS metric
  FROM customer),
judged AS (SELECT request_id, CASE WHEN dimension NOT IN ('seniority', 'country') THEN 'dimension'
                                   WHEN metric IS NULL THEN 'metric' END AS field FROM asked)
SELECT request_id, field IS NULL AS ok, CASE WHEN field IS NOT NULL THEN 'INVALID_REQUEST' END AS code, field
FROM judged""",
    ),
}

# ---------------------------------------------------------------- driver contract


def entry(spark: SparkSession) -> DataFrame:
    """Flagship: the best-paid postings of one country, straight from the source tables."""
    silver = _silver(spark, "/root/testdata/sf0.001")
    return page_rows(silver, Filters(country="NATION_1"))


def _corpus() -> tuple[dict[str, Query], dict[str, str]]:
    """Queries of the ``llm`` subpackage and of the corpus pipeline, where they are installed."""
    try:
        from vacantia.llm.queries import ORACLE_SQL, QUERIES
    except ModuleNotFoundError as gone:
        if not (gone.name or "").startswith("vacantia.llm"):
            raise
        return {}, {}
    found, sql = dict(QUERIES), dict(ORACLE_SQL)
    try:
        import corpus_pipeline
    except ModuleNotFoundError as gone:
        if gone.name != "corpus_pipeline":
            raise
        return found, sql
    found["pipeline"] = corpus_pipeline.run
    if corpus_pipeline.ORACLE_SQL:
        sql["pipeline"] = corpus_pipeline.ORACLE_SQL
    return found, sql


def queries() -> dict[str, Query]:
    return {name: query for name, (query, _) in REGISTERED.items()} | _corpus()[0]


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in REGISTERED.items()} | _corpus()[1]

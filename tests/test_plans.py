"""The plans the jobs must keep: pushdown, early cuts, reuse, no Python rows."""

from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from vacantia.operators.bucket_levels import Quota
from vacantia.operators.credentials import audit_credentials
from vacantia.operators.filters import Filters
from vacantia.operators.requests import typed_search_requests
from vacantia.operators.saved_searches import saved_search_hits, saved_search_totals
from vacantia.operators.token_bucket import admit_requests
from vacantia.plans.gold import build_gold
from vacantia.plans.metrics import market_metrics
from vacantia.plans.search import Cursor, fingerprint, matching, page_rows, search
from vacantia.plans.silver import build_silver
from vacantia.schema import COUNTRY_KEY, POSTING_COLUMNS
from vacantia.sources import samples
from vacantia.sources.sinks import write_metrics, write_postings
from vacantia.sources.tables import read_metrics, read_postings

FOLDER = "/root/testdata/sf0.001"


def plan(df, mode="formatted"):
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), mode)


@pytest.fixture(scope="module")
def raw_silver(spark):
    return build_silver(samples.posts(spark, FOLDER), samples.companies(spark, FOLDER))


@pytest.fixture(scope="module")
def tables(spark, raw_silver, tmp_path_factory):
    silver = str(tmp_path_factory.mktemp("tables") / "silver")
    gold = str(tmp_path_factory.mktemp("tables") / "gold")
    write_postings(raw_silver, silver)
    write_metrics(build_gold(read_postings(spark, silver), datetime(2024, 1, 1, tzinfo=timezone.utc)), gold)
    return silver, gold


def pushed(df):
    return next(line for line in plan(df).splitlines() if "PushedFilters" in line)


def test_filters_reach_the_scan(spark, tables):
    silver = read_postings(spark, tables[0])
    filters = Filters("mid", 3, 70_000, "NATION_1")
    line = pushed(matching(silver, filters))
    for part in (
        "EqualTo(seniority,mid)", "LessThanOrEqual(years_exp,3)",
        "GreaterThanOrEqual(salary_max,70000)", "EqualTo(country,NATION_1)",
    ):
        assert part in line


def test_a_country_without_regard_to_case_reaches_the_scan_and_skips_row_groups(spark, raw_silver, tmp_path):
    path = str(tmp_path / "silver")
    before = spark.conf.get("spark.sql.files.maxRecordsPerFile")
    spark.conf.set("spark.sql.files.maxRecordsPerFile", "40")  # small files, each with most countries between its least and greatest
    try:
        write_postings(raw_silver, path)
    finally:
        spark.conf.set("spark.sql.files.maxRecordsPerFile", before)
    stored = read_postings(spark, path, with_key=True)
    wanted = raw_silver.where("country = 'NATION_12'").count()
    for silver, skips in ((stored, True), (read_postings(spark, path), False)):
        found = matching(silver, Filters(country="NaTiOn_12"), ignore_case=True)
        assert ("EqualTo(country_key,nation_12)" in plan(found)) == skips
        assert len(found.collect()) == wanted > 0
        scan = found._jdf.queryExecution().executedPlan()
        rows = {}

        def walk(node):
            name = node.nodeName()
            if name.startswith("Scan"):
                rows["read"] = node.metrics().apply("numOutputRows").value()
            children = node.children()
            for i in range(children.size()):
                walk(children.apply(i))

        walk(scan)
        assert (rows["read"] < raw_silver.count()) == skips
    assert COUNTRY_KEY not in stored.select(*POSTING_COLUMNS).columns


@pytest.mark.parametrize(
    ("sort", "column"),
    [("salary_max_desc", "salary_max"), ("salary_min_asc", "salary_min"), ("experience_asc", "years_exp")],
)
def test_keyset_reaches_the_scan_and_the_page_is_a_top_k(spark, tables, sort, column):
    silver = read_postings(spark, tables[0])
    cursor = Cursor(fingerprint(Filters(), sort), -5 if sort == "salary_max_desc" else 5, 7)
    page = page_rows(silver, sort=sort, cursor=cursor)
    assert column in pushed(page) and "GreaterThan(job_id,7)" in pushed(page)
    assert "TakeOrderedAndProject" in plan(page)
    assert "Exchange" not in plan(page)


def test_pages_are_merged_on_an_executor(spark, tables, monkeypatch):
    silver = read_postings(spark, tables[0])
    seen = []
    frame_type = type(spark.range(1))
    collect = frame_type.collect
    monkeypatch.setattr(frame_type, "collect", lambda df: seen.append(plan(df, "simple")) or collect(df))
    search(silver, limit=5, with_total=False)
    assert len(seen) == 1 and "Coalesce" in seen[0]
    assert seen[0].index("Coalesce") < seen[0].index("TakeOrderedAndProject")


def test_total_reads_only_the_filter_columns(spark, tables):
    counted = matching(read_postings(spark, tables[0]), Filters(country="NATION_1")).agg(F.count("*"))
    schema = next(line for line in plan(counted).splitlines() if "ReadSchema" in line)
    assert schema.strip() == "ReadSchema: struct<country:string>"


def test_metrics_read_one_partition(spark, tables):
    text = plan(market_metrics(read_metrics(spark, tables[1]), "country"))
    filters = next(line for line in text.splitlines() if "PartitionFilters" in line)
    assert "country" in filters


def test_silver_reads_no_other_column_and_runs_no_python(raw_silver):
    text = plan(raw_silver)
    assert "acctbal" not in text and "orderdate" not in text
    assert "Python" not in text and "Pandas" not in text


def test_gold_scans_once(spark, tables):
    gold = build_gold(read_postings(spark, tables[0]))
    gold.collect()
    final = plan(gold, "simple").split("Initial Plan")[0]
    assert final.count("FileScan") == 1
    assert "ReusedExchange" in final and "Python" not in final


def test_saved_searches_cut_early_and_never_pair(spark, tables):
    searches = typed_search_requests(samples.searches(spark, FOLDER))
    text = plan(saved_search_hits(searches, read_postings(spark, tables[0])), "simple")
    assert text.count("WindowGroupLimit") == 4
    assert "NestedLoop" not in text and "Cartesian" not in text


def test_token_bucket_shuffles_its_chunks_once(spark):
    log = spark.read.parquet(f"{FOLDER}/events.parquet")
    decided = admit_requests(log, Quota(1, 1_000_000, 3), client="user_id")
    decided.collect()
    final = plan(decided, "simple").split("Initial Plan")[0]
    assert "ReusedExchange" in final
    # The sorted log once, and the requests without a client from the log itself.
    assert final.count("FileScan") == 2


@pytest.fixture
def crowded(spark):
    """No broadcasts, and partitions of 20 KB already count as large."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
    }
    before = {name: spark.conf.get(name, None) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    yield
    for name, value in before.items():
        spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def test_join_with_a_hot_company_is_split(spark, crowded):
    hot = F.when(F.col("id") % 2 == 0, F.lit(7)).otherwise(F.col("id") % 100)
    posts = spark.range(0, 60_000, numPartitions=16).select(
        F.col("id").alias("id_jobpost"), hot.alias("id_company"),
        F.sha2(F.col("id").cast("string"), 256).alias("jobtitle"),
        F.lit("1").alias("minimumsalary"), F.lit("2").alias("maximumsalary"),
        F.lit("3").alias("experience"), F.lit("q").alias("qualification"),
    )
    companies = spark.range(100).select(
        F.col("id").alias("id_company"), F.col("id").cast("string").alias("companyname"),
        F.lit("DK").alias("country"),
    )
    silver = build_silver(posts, companies)
    assert len(silver.collect()) == 60_000
    assert "skew=true" in plan(silver, "simple").split("Initial Plan")[0]


def test_audit_with_a_hot_client_is_split(spark, crowded):
    kind = F.col("id") % 3
    key = F.when(kind == 0, "k7").when(kind == 1, F.concat(F.lit("k"), F.col("id") % 500))
    log = spark.range(0, 60_000, numPartitions=16).select(
        F.col("id").alias("event_id"), F.timestamp_seconds("id").alias("ts"), key.alias("raw_key")
    )
    registry = spark.range(500).select(
        F.col("id").alias("client_id"),
        F.sha2(F.concat(F.lit("k"), F.col("id")), 256).alias("key_sha256"),
        F.lit(None).cast("timestamp").alias("expires_at"),
    )
    audited = audit_credentials(log, registry)
    counts = {r["status"]: r["count"] for r in audited.groupBy("status").count().collect()}
    assert counts == {"ok": 40_000, "missing": 20_000}
    audited.collect()
    assert "skew=true" in plan(audited, "simple").split("Initial Plan")[0]


def test_search_that_many_requests_share_is_split(spark, crowded, tables):
    shared = F.when(F.col("id") % 2 == 0, F.lit(3)).otherwise(F.col("id") % 40)
    searches = spark.range(0, 60_000, numPartitions=16).select(
        F.col("id").alias("request_id"), F.lit(None).cast("string").alias("seniority"),
        F.lit(None).cast("int").alias("experience_max"), (shared * 1000).cast("bigint").alias("salary_min"),
        F.lit(None).cast("string").alias("country"), F.lit("salary_max_desc").alias("sort"),
        F.lit(1).alias("limit"),
    )
    totals = saved_search_totals(searches, read_postings(spark, tables[0]))
    assert len(totals.collect()) == 60_000
    assert "skew=true" in plan(totals, "simple").split("Initial Plan")[0]

import pytest
from pyspark.sql import functions as F

from conftest import postings
from vacantia.errors import ContractError
from vacantia.functions.columns import posting_url, seniority_of, whole_number
from vacantia.operators.contract import check_columns, check_types, column_faults, split_rows
from vacantia.plans.gold import build_gold
from vacantia.plans.silver import build_silver
from vacantia.schema import POSTING_COLUMNS, POSTING_SCHEMA
from vacantia.sources.sinks import read_rejected, replace_table, write_metrics, write_postings
from vacantia.sources.tables import jdbc_options, read_metrics, read_postings
from vacantia.sources.workspace import shared_folder


@pytest.mark.parametrize(
    ("text", "number"),
    [
        ("0", 0), ("5", 5), (" 42 ", 42), ("39918", 39918), ("999999999999999999", 10**18 - 1), ("9223372036854775807", 2**63 - 1), ("9223372036854775808", None),
        ("1000000000000000000", 10**18), ("-1", None), ("4.5", None), ("", None), ("abc", None),
        ("12abc", None), (None, None), ("99999999999999999999999", None),
    ],
)
def test_whole_number(spark, text, number):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(whole_number("t").alias("n")).first()["n"] == number


@pytest.mark.parametrize(
    ("years", "level"),
    [(0, "junior"), (1, "junior"), (2, "mid"), (3, "mid"), (4, "senior"), (50, "senior"), (None, None)],
)
def test_seniority(spark, years, level):
    df = spark.createDataFrame([(years,)], "y int")
    assert df.select(seniority_of("y").alias("s")).first()["s"] == level


def test_url(spark):
    assert spark.range(7, 8).select(posting_url("id").alias("u")).first()["u"] == "/view-job-post.php?id=7"


POSTS = (
    "id_jobpost int, id_company int, jobtitle string, minimumsalary string,"
    " maximumsalary string, experience string, qualification string, description string"
)
COMPANIES = "id_company int, companyname string, country string, email string, contactno string"


def test_silver(spark):
    posts = spark.createDataFrame(
        [
            (1, 10, "A", "100", "200", "4", "q", "d"),
            (2, 20, "B", None, "n/a", "1", None, "d"),
            (3, 99, "no company", "1", "2", "3", "q", "d"),
            (4, None, "no company", "1", "2", "3", "q", "d"),
        ],
        POSTS,
    )
    companies = spark.createDataFrame(
        [(10, "C1", "DK", "x@y", "1"), (20, "C2", None, "x@y", "1"), (30, "C3", "SE", "x@y", "1")], COMPANIES
    )
    silver = build_silver(posts, companies)
    assert [(f.name, f.dataType) for f in silver.schema] == [(f.name, f.dataType) for f in POSTING_SCHEMA]
    assert [tuple(r) for r in silver.orderBy("job_id").collect()] == [
        (1, "A", "C1", "DK", "senior", 4, 100, 200, "q", "/view-job-post.php?id=1"),
        (2, "B", "C2", None, "junior", 1, None, None, None, "/view-job-post.php?id=2"),
    ]


def test_output_columns():
    check_columns(POSTING_COLUMNS)
    check_columns(["JOB_ID", "Title"])
    with pytest.raises(ContractError, match="email: sensitive; description: not in the contract"):
        check_columns(["job_id", "email", "description"])
    with pytest.raises(ContractError, match="Phone: sensitive"):
        check_columns(["job_id", "Phone"], ["job_id", "phone"])
    assert column_faults(["title", "url", "Title"]) == [("Title", "the same name as title")]


def bad_rows(spark):
    rows = [
        (1, "t", "c", "DK", "mid", 2, 1, 2),
        (2, None, "c", None, "mid", 2, None, None),
        (3, "t", None, "DK", "boss", None, 1, 2),
    ]
    full = [(*row, "q", f"u{row[0]}") for row in rows]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in POSTING_SCHEMA)
    return spark.createDataFrame(full, schema)


def test_row_contract(spark):
    accepted, rejected = split_rows(bad_rows(spark))
    assert [r["job_id"] for r in accepted.collect()] == [1]
    assert {r["job_id"]: r["violations"] for r in rejected.collect()} == {
        2: ["title"], 3: ["company_name", "years_exp", "seniority"]
    }


def test_types_are_part_of_the_contract(three):
    with pytest.raises(ContractError, match="salary_min"):
        check_types(three.withColumn("salary_min", F.col("salary_min").cast("string")))


def test_full_refresh_is_repeatable(spark, three, tmp_path):
    path = str(tmp_path / "silver")
    for _ in range(2):
        assert write_postings(three, path, cluster_by=("country",)) == 3
    assert sorted(read_postings(spark, path).collect()) == sorted(three.collect())
    fewer = three.where("job_id < 3")
    assert write_postings(fewer, path) == 2


def test_bad_rows_stop_the_load_and_keep_the_old_table(spark, three, tmp_path):
    path = str(tmp_path / "silver")
    write_postings(three, path)
    with pytest.raises(ContractError):
        write_postings(bad_rows(spark), path)
    assert read_postings(spark, path).count() == 3


def test_a_write_that_fails_half_way_leaves_the_old_table(spark, three, tmp_path):
    path = str(tmp_path / "silver")
    write_postings(three, path)
    fails = F.when(F.col("job_id") == 3, F.raise_error("disk lost").cast("string")).otherwise(F.col("title"))
    with pytest.raises(Exception, match="disk lost"):
        write_postings(three.repartition(3, "job_id").withColumn("title", fails), path)
    assert sorted(read_postings(spark, path).collect()) == sorted(three.collect())


def test_quarantine(spark, tmp_path):
    path = str(tmp_path / "silver")
    assert write_postings(bad_rows(spark), path, on_bad="quarantine") == 1
    assert [r["job_id"] for r in read_postings(spark, path).collect()] == [1]
    assert {r["job_id"]: r["violations"] for r in read_rejected(spark, path).collect()} == {
        2: ["title"], 3: ["company_name", "years_exp", "seniority"]
    }
    with pytest.raises(ValueError):
        write_postings(bad_rows(spark), path, on_bad="ignore")


def test_sinks_refuse_unknown_columns(spark, three, tmp_path):
    wide = three.withColumn("email", F.lit("x@y"))
    with pytest.raises(ContractError):
        write_postings(wide, str(tmp_path / "silver"))
    with pytest.raises(ContractError):
        replace_table(wide, str(tmp_path / "other"), POSTING_COLUMNS)


def test_gold_refresh(spark, tmp_path):
    path = str(tmp_path / "gold")
    rows = [(i, "t", "c", c, "mid", 2, i, i) for i, c in enumerate(["DK", "SE", None])]
    for _ in range(2):
        assert write_metrics(build_gold(postings(spark, rows)), path) == 4
    assert read_metrics(spark, path, "country").count() == 3
    assert read_metrics(spark, path, "seniority").first()["posting_count"] == 3


def test_jdbc_options():
    plain = jdbc_options("jdbc:x", "job_post", properties={"user": "reader"}, single_task=True)
    assert plain == {"url": "jdbc:x", "dbtable": "job_post", "fetchsize": "10000", "user": "reader"}
    split = jdbc_options("jdbc:x", "job_post", partition_column="id", bounds=(1, 9), partitions=4)
    assert (split["partitionColumn"], split["lowerBound"], split["upperBound"], split["numPartitions"]) == (
        "id", "1", "9", "4"
    )
    with pytest.raises(ValueError):
        jdbc_options("jdbc:x", "t", partition_column="id")
    with pytest.raises(ValueError):
        jdbc_options("jdbc:x", "t")


class Session:
    """The parts of a session that choosing a folder looks at."""

    def __init__(self, folder, master="local[2]", warehouse="file:/house"):
        self.conf = {"spark.checkpoint.dir": folder} if folder else {"spark.sql.warehouse.dir": warehouse}
        self.sparkContext = type("Context", (), {"applicationId": "app-1", "master": master})


def test_shared_folder():
    assert shared_folder(Session("s3://bucket/work/")) == "s3://bucket/work/app-1"
    assert shared_folder(Session(None)) == "file:/house/_working/app-1"
    assert shared_folder(Session("s3://bucket/work", "yarn")) == "s3://bucket/work/app-1"
    assert shared_folder(Session(None, "yarn", "s3://house")) == "s3://house/_working/app-1"
    for warehouse in ("file:/house", "/house"):
        with pytest.raises(ValueError, match="checkpoint"):
            shared_folder(Session(None, "yarn", warehouse))

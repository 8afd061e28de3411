"""Contract constants: schemas, enumerations and limits."""

from __future__ import annotations

from pyspark.sql import types as T

POSTING_SCHEMA = T.StructType(
    [
        T.StructField("job_id", T.LongType(), False),
        T.StructField("title", T.StringType(), False),
        T.StructField("company_name", T.StringType(), False),
        T.StructField("country", T.StringType(), True),
        T.StructField("seniority", T.StringType(), False),
        T.StructField("years_exp", T.IntegerType(), False),
        T.StructField("salary_min", T.LongType(), True),
        T.StructField("salary_max", T.LongType(), True),
        T.StructField("qualification", T.StringType(), True),
        T.StructField("url", T.StringType(), False),
    ]
)
POSTING_COLUMNS = POSTING_SCHEMA.names
#: Stored beside the contract columns: the country in lower case, '' for none.
COUNTRY_KEY = "country_key"
#: Different countries that a Bloom filter of one row group is sized for.
COUNTRIES = 1_000

METRIC_SCHEMA = T.StructType(
    [
        T.StructField("dimension", T.StringType(), False),
        T.StructField("dimension_value", T.StringType(), True),
        T.StructField("median_salary", T.DoubleType(), True),
        T.StructField("posting_count", T.LongType(), False),
        T.StructField("as_of", T.TimestampType(), False),
    ]
)
METRIC_COLUMNS = METRIC_SCHEMA.names

# Fixed values of the public contract.
SENIORITIES = ("junior", "mid", "senior")
SORTS = ("salary_max_desc", "salary_min_asc", "experience_asc")
DEFAULT_SORT = "salary_max_desc"
FILTER_NAMES = ("seniority", "experience_max", "salary_min", "country")
REQUIRED_FILTERS: tuple[str, ...] = ()
DIMENSIONS = ("seniority", "country")
METRICS = ("median_salary", "posting_count")
SENSITIVE_NAMES = (
    "email", "password", "dob", "address", "contactno",
    "phone", "hash", "resume", "candidate",
)
URL_PREFIX = "/view-job-post.php?id="
DEFAULT_LIMIT = 20
MAX_LIMIT = 100
MAX_EXPERIENCE_YEARS = 50
MAX_SALARY_FILTER = 1_000_000_000
MAX_COUNTRY_LENGTH = 100
MIN_GROUP_SIZE = 5
REQUESTS_PER_MINUTE = 120

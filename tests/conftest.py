import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from vacantia.schema import POSTING_SCHEMA  # noqa: E402
from vacantia.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session(8, "tests", working=str(tmp_path_factory.mktemp("working")))
    yield session
    session.stop()


@pytest.fixture(scope="session")
def three(spark):
    """Three postings whose answers are worked out by hand."""
    rows = [
        (1, "A", "C1", "Denmark", "senior", 4, 39918, 78808),
        (2, "B", "C2", "Bulgaria", "mid", 3, 43334, 76458),
        (3, "C", "C3", "Denmark", "junior", 1, 28080, 62841),
    ]
    return postings(spark, rows)


def postings(spark, rows):
    full = [(*row, "q", f"/view-job-post.php?id={row[0]}") for row in rows]
    return spark.createDataFrame(full, POSTING_SCHEMA)


def random_postings(spark, rng, count, countries=("DK", "SE", "NO", None), salaries=12, hot=0):
    """Many ties, NULL salaries and, if asked, one hot combination."""
    rows = []
    for job_id in range(1, count + 1):
        if job_id <= hot:
            rows.append((job_id, "t", "c", "DK", "senior", 5, None, None))
            continue
        years = rng.randint(0, 6)
        level = "junior" if years <= 1 else "mid" if years <= 3 else "senior"
        low = rng.choice([None, *range(salaries)])
        high = rng.choice([None, *range(salaries)])
        rows.append((job_id, "t", "c", rng.choice(countries), level, years, low, high))
    rng.shuffle(rows)
    return postings(spark, rows)

"""Every registered query against its SQL, on the given tables."""

import os
from pathlib import Path

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as registered

FOLDER = os.environ.get("PARITY_SF_DIR", "/root/testdata/sf0.01")


@pytest.fixture(scope="module")
def sql():
    connection = duckdb.connect()
    for path in Path(FOLDER).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    yield connection
    connection.close()


def rows(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    plain = [tuple(None if pd.isna(v) else v for v in row) for row in frame.itertuples(index=False)]
    return sorted(plain, key=lambda row: tuple((v is None, str(v)) for v in row))


@pytest.mark.parametrize("name", registered.oracle_sql())
def test_query_equals_sql(spark, sql, name):
    found = registered.queries()[name](spark, FOLDER).toPandas()
    wanted = sql.execute(registered.oracle_sql()[name]).df()
    assert sorted(found.columns) == sorted(wanted.columns)
    assert rows(found) == rows(wanted)


def test_flagship_query_has_rows(spark):
    assert registered.entry(spark).count() == 20

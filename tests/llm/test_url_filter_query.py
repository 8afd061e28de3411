"""The registered query against its SQL on hosts that labels alone block."""

import duckdb

import __spark_entry__ as registered


def test_bad_hosts_are_blocked_like_in_sql(spark, tmp_path):
    pages, labels, page_id = [], [], 0
    for host in range(12):
        for _ in range(60):
            page_id += 1
            name = ("10.0.0.8", "h9.d1.co.uk", "h10.d2.co.uk:81")[host - 8] if 8 <= host < 11 else f"h{host}.d{host % 5}.org"
            pages.append((page_id, f"https://{name}/xx/{page_id}.html"))
            bad = host in (3, 7) or page_id % 12 == 0
            labels.append((page_id, 0 if bad else 1, 0))
    spark.createDataFrame(pages, "page_id bigint, url string").write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    found = sorted(tuple(row) for row in registered.queries()["op6_url_filter"](spark, str(tmp_path)).select("page_id", "verdict").collect())
    connection = duckdb.connect()
    for name in ("pages", "labels"):
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    sql = registered.oracle_sql()["op6_url_filter"]
    assert found == sorted(connection.execute(f"SELECT page_id, verdict FROM ({sql})").fetchall())
    blocked = {(p - 1) // 60 for p, verdict in found if verdict == "block"}
    assert blocked == {3, 7}

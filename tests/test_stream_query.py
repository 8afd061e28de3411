"""The registered stream query: stretches of several files, one micro-batch each."""

import duckdb

import __spark_entry__ as registered

FOLDER = "/root/testdata/sf0.001"


def test_stretches_are_written_by_several_tasks(spark, tmp_path, monkeypatch):
    events = spark.read.parquet(f"{FOLDER}/events.parquet")
    events.repartition(4).write.parquet(f"{tmp_path}/events.parquet")
    paths, batches, new_path, decide = {}, [], registered.new_path, registered.start_admission

    def remembered(session, name):
        paths[name] = new_path(session, name)
        return paths[name]

    def counted(*args, **more):
        query = decide(*args, **more)
        batches.append(query)
        return query

    monkeypatch.setattr(registered, "new_path", remembered)
    monkeypatch.setattr(registered, "start_admission", counted)
    found = {tuple(row) for row in registered.queries()["token_bucket_stream"](spark, str(tmp_path)).select("event_id", "admitted").collect()}
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW events AS SELECT * FROM '{FOLDER}/events.parquet'")
    sql = registered.oracle_sql()["token_bucket_stream"]
    assert found == set(connection.execute(f"SELECT event_id, admitted FROM ({sql})").fetchall())
    files = spark.read.parquet(paths["arrivals"]).inputFiles()
    assert len(files) > 4
    assert spark.read.parquet(f"{paths['decisions']}/decisions").select("batch").distinct().count() == 4

import hashlib
from collections import defaultdict

from vacantia.llm.exact_dedup import DigestIndex, bucket_count
from vacantia.sources.workspace import new_path

SCHEMA = "doc_id bigint, text string, digest string, keep_id int"


def resolve(spark, rows, index=None):
    docs = spark.createDataFrame([(*row, "x", 1) for row in rows], SCHEMA)
    index = index or DigestIndex(spark, new_path(spark, "test-digests"), buckets=4)
    index.add(docs)
    return index.resolve(docs).collect()


def test_largest_id_stays_among_nulls_copies_and_ties(spark):
    rows = [(1, "a"), (5, "a"), (3, "a "), (2, None), (9, ""), (7, "x" * 300_000), (8, "x" * 300_000), (4, "é")]
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[text or ""].append(doc_id)
    found = resolve(spark, rows)
    assert len(found) == len(rows)
    for row in found:
        text = next(t or "" for i, t in rows if i == row.doc_id)
        assert row.keep_id == max(groups[text])
        assert row.group_size == len(groups[text])
        assert row.kept == (row.doc_id == max(groups[text]))
        assert bytes(row.digest).hex() == hashlib.sha256(text.encode()).hexdigest()


def test_rows_without_id_and_repeated_rows(spark):
    found = resolve(spark, [(None, "a"), (1, "a"), (1, "a"), (None, "b"), (None, "b")])
    kept = sorted((row.doc_id or 0, row.keep_id or 0, row.group_size, row.kept) for row in found)
    assert kept == [(0, 0, 2, True), (0, 0, 2, True), (0, 1, 3, False), (1, 1, 3, True), (1, 1, 3, True)]


def test_empty_table(spark):
    assert resolve(spark, []) == []


def test_index_outlives_its_handle_and_keeps_earlier_texts(spark):
    path = new_path(spark, "test-digests")
    resolve(spark, [(1, "a"), (2, "b")], DigestIndex(spark, path, buckets=4))
    found = resolve(spark, [(10, "a"), (11, "c"), (12, "c")], DigestIndex(spark, path, buckets=4))
    assert {(r.doc_id, r.keep_id, r.kept) for r in found} == {(10, 1, False), (11, 12, False), (12, 12, True)}
    assert DigestIndex(spark, path, buckets=4).rows().count() == 3


def test_hot_group_is_whole(spark):
    rows = [(i, "same") for i in range(700)] + [(1000 + i, f"text {i}") for i in range(300)]
    found = resolve(spark, rows)
    assert len(found) == 1000
    assert sum(row.kept for row in found) == 301


def test_anti_join_reads_the_index_without_a_shuffle(spark):
    index = DigestIndex(spark, new_path(spark, "test-digests"), buckets=4)
    index.add(spark.createDataFrame([(1, "a")], "doc_id bigint, text string"))
    batch = spark.range(10).selectExpr("unhex(sha2(cast(id as string), 256)) digest").repartition(4, "digest")
    plan = batch.hint("merge").join(index.rows().select("digest"), "digest", "left_anti")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in text and "Bucketed: true" in text


def test_buckets_follow_the_rows_and_the_catalog_entry_goes(spark):
    assert [bucket_count(n) for n in (0, 1, 128_000_000, 128_000_001, 10**9)] == [64, 64, 64, 128, 512]
    path = new_path(spark, "test-digests")
    index = DigestIndex(spark, path, buckets=4)
    docs = spark.createDataFrame([(1, "a"), (2, "a"), (3, None)], "doc_id bigint, text string")
    index.add(docs)
    found = index.resolve(docs)
    index.close()
    assert not spark.catalog.tableExists(index.table)
    assert sorted((r.doc_id, r.keep_id) for r in found.collect()) == [(1, 2), (2, 2), (3, 3)]
    assert DigestIndex(spark, path, buckets=4).rows().count() == 2


def test_every_bucket_is_one_file_whatever_the_partitions(spark, tmp_path, monkeypatch):
    docs = spark.range(2000).selectExpr("id doc_id", "cast(id as string) text")
    frame = type(docs)
    repartition = frame.repartition
    monkeypatch.setattr(frame, "repartition", lambda df, n, *by: repartition(df, max(n, 21), *by))
    path = tmp_path / "digests"
    index = DigestIndex(spark, str(path), buckets=8)
    index.add(docs)
    buckets = [f.name.split("_")[1].split(".")[0] for f in path.rglob("*.parquet")]
    assert len(buckets) == len(set(buckets)) == 8
    assert index.rows().count() == 2000

import itertools

import numpy as np
from pyspark.sql import functions as F

from vacantia.llm.line_crf import WIDTH, LineField, Lines, fit_line_field, line_features, quality_score, score_quality

LABELS = "doc_id bigint, quality int, toxic int"


def test_marginals_match_enumeration():
    rng = np.random.default_rng(2)
    texts = ["a\nB!!\n\nc d", "x", "", "a b\na b"]
    lines = Lines([line_features(t) for t in texts])
    field = LineField(np.zeros(WIDTH), np.ones(WIDTH), rng.normal(size=WIDTH + 1), rng.normal(size=(2, 2)))
    x = field.inputs(lines)
    p, expected = field.marginals(lines, x)
    links = np.zeros((2, 2))
    for doc in range(len(texts)):
        at = np.flatnonzero(lines.doc == doc)  # packed by position, so in order
        bad = x[at] @ field.weights
        total, marginal, counts = 0.0, np.zeros(len(at)), np.zeros((2, 2))
        for labels in itertools.product((0, 1), repeat=len(at)):
            score = sum(b for b, label in zip(bad, labels) if label) + sum(field.links[a, b] for a, b in zip(labels, labels[1:]))
            total += np.exp(score)
            marginal += np.exp(score) * np.array(labels)
            for a, b in zip(labels, labels[1:]):
                counts[a, b] += np.exp(score)
        assert np.allclose(p[at], marginal / total)
        links += counts / total
    assert np.allclose(expected, links)


def test_accuracy_on_the_given_labels(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    field = fit_line_field(docs, labels, sample_per_class=300)
    found = score_quality(docs, field).join(labels, "doc_id").where("held_out").collect()
    assert len(found) > 50 and sum(row.predicted == row.quality for row in found) / len(found) > 0.95


def test_nulls_empty_long_and_no_labels(spark):
    rows = [(1, None, 1), (2, "", 1), (None, "x", 1), (3, "line\n" * 30_000, 1), (3, "a", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, score int")
    field = fit_line_field(docs, spark.createDataFrame([], LABELS))
    found = score_quality(docs, field).collect()
    assert len(found) == 5 and {row.score for row in found} == {0.5}
    one_kind = spark.createDataFrame([(1, 1, 0), (3, 1, 0), (None, 0, 0), (2, None, 0)], LABELS)
    assert {row.score for row in score_quality(docs, fit_line_field(docs, one_kind)).collect()} == {1.0}
    assert score_quality(docs.limit(0), field).collect() == []


def test_documents_keep_their_columns(spark):
    docs = spark.createDataFrame([(1, "a", "en")], "doc_id bigint, text string, lang string")
    field = LineField(np.zeros(WIDTH), np.ones(WIDTH), np.zeros(WIDTH + 1), np.zeros((2, 2)))
    assert docs.withColumn("q", quality_score(field, F.col("text"))).first().lang == "en"

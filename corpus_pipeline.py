"""Training corpus from raw documents, in stages that each write a table.

Documents that the line field rejects go; of equal texts one stays, of near-duplicate
components one; passages that repeat anywhere are cut out; what is left is packed into
training sequences. Every stage reads all its predecessor kept.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vacantia.llm.exact_dedup import DigestIndex, text_digest
from vacantia.llm.line_crf import fit_line_field, quality_score
from vacantia.llm.ngram_join import near_duplicates
from vacantia.llm.packing import pack_documents
from vacantia.llm.session import Scratch, corpus_session
from vacantia.llm.substring_dedup import remove_repeats
from vacantia.sources.workspace import new_path, stage

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
LEAST_QUALITY = 0.3
#: Near copies of this stage; ``op10_ngram_join`` has a contract of its own.
SHINGLE, PERCENT = 5, 80


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    corpus_session(spark)
    field = fit_line_field(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = docs.select(*COLUMNS, quality_score(field, F.col("text")).alias("score of quality"))
    return scored.where(F.col("score of quality") >= LEAST_QUALITY).select(*COLUMNS)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that repeat id and text are one document, of which one row stays."""
    corpus_session(spark)
    index = DigestIndex(spark, new_path(spark, "digests"))
    index.add(docs)
    kept = index.resolve(docs).where("kept").groupBy("doc_id", "digest").agg(F.count(F.lit(1)).alias("copies"))
    kept = stage(kept.select(F.col("doc_id").alias("kept id"), F.col("digest").alias("kept digest"), "copies"), "kept")
    rows = docs.select(*COLUMNS, text_digest("text").alias("digest"))
    same = F.col("doc_id").eqNullSafe(F.col("kept id")) & (F.col("digest") == F.col("kept digest"))
    once, more = kept.where("copies = 1"), kept.where("copies > 1")
    result = rows.join(once, same, "left_semi")
    if not more.isEmpty():  # texts are only moved again where rows repeat
        repeated = rows.join(more, same, "left_semi")
        result = result.unionByName(repeated.dropDuplicates(["doc_id", "digest"]))
    return result.select(*COLUMNS)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each component stays; rows without an id too."""
    corpus_session(spark)
    scratch = Scratch(spark)
    parts = near_duplicates(docs.select("doc_id", "text"), shingle=SHINGLE, percent=PERCENT, scratch=scratch)
    gone = stage(parts.where(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct(), "near-copies")
    scratch.clear()
    return docs.select(*COLUMNS).join(gone, "doc_id", "left_anti").select(*COLUMNS)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    corpus_session(spark)
    cut = remove_repeats(docs, carry=("lang", "source"))
    return cut.select("doc_id", F.col("kept").alias("text"), "lang", "source", F.length("kept").cast("long").alias("n_chars"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences with their ids."""
    corpus_session(spark)
    return pack_documents(docs.select("doc_id", "text"), "byte_bpe_50k")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality_classifier),
    ("exact dedup", exact_dedup),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("substring dedup", substring_dedup),
    ("packing", packing),
]

#: SQL can express neither the classifier nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES:
        path = new_path(spark, name.replace(" ", "-"))
        step(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs

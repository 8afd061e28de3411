"""Saved searches kept up to date: stored first pages, changed by what came and went.

A table at ``path`` holds the first page of every distinct search (its *shape*, with the
largest limit that is asked) and the page of every search. A change of postings is met with
the searches by itself: rows that went are taken from the pages, rows that came and match
are merged into them. A page that was full and lost rows may lack postings that no page
holds; it is refilled from all postings, unless so many new rows stand before its old last
row that it is full again. All other pages are right without a look at the postings.

Ids of searches and of postings are unique; searches that share an id share a page of their
own, which holds the rows of each of them. A posting that changed went and came.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vacantia.operators.saved_searches import SHAPE, shape_pages, shapes_of
from vacantia.schema import MAX_LIMIT
from vacantia.sources.sinks import publish
from vacantia.sources.tables import current_version, version_path
from vacantia.sources.workspace import stage

_PAGES = "page_id string, pos bigint, job_id bigint, sort_key bigint"
_MEMBERS = "request_id bigint, page_id string, `limit` int"
#: What searches look at.
_LOOKED_AT = ["job_id", "seniority", "country", "years_exp", "salary_min", "salary_max"]


def _store(members: DataFrame, pages: DataFrame, path: str) -> None:
    spark, version = pages.sparkSession, uuid.uuid4().hex
    folder = version_path(path, version)
    members.select("request_id", "page_id", F.col("limit").cast("int").alias("limit")).write.parquet(f"{folder}/members")
    pages.select("page_id", "pos", "job_id", "sort_key").write.parquet(f"{folder}/pages")
    publish(spark, path, version, 0)


def _paged(searches: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The page of every search id, the shapes and limits that each page holds, and the shapes."""
    labelled, shapes = shapes_of(searches, SHAPE)
    request_id = F.col("request_id").cast("bigint").alias("request_id")
    copies = F.count(F.lit(1)).over(Window.partitionBy("request_id")).alias("copies")
    labelled = labelled.select(request_id, "shape_id", "limit", copies)
    page_id = F.when(F.col("copies") == 1, F.col("shape_id")).otherwise(F.concat(F.lit("="), "request_id"))
    labelled = stage(labelled.withColumn("page_id", page_id), "labelled")
    alone, repeated = labelled.where("copies = 1"), labelled.where("copies > 1")
    members = alone.select("request_id", "page_id", "limit").unionByName(
        repeated.select("request_id", "page_id", F.lit(MAX_LIMIT).alias("limit")).distinct()
    )
    asked = alone.groupBy("page_id", "shape_id").agg(F.max("limit").alias("limit"))
    asked = asked.unionByName(repeated.select("page_id", "shape_id", "limit"))
    return members, stage(asked, "pages-asked"), stage(shapes, "shapes")


def _pages(asked: DataFrame, shapes: DataFrame, silver: DataFrame) -> DataFrame:
    """``page_id, pos, job_id, sort_key``: pages of the searches on ``silver``."""
    found = shape_pages(shapes, silver).join(asked, "shape_id")
    return found.where(F.col("pos") <= F.col("limit")).select("page_id", "pos", "job_id", "sort_key")


def start_standing_searches(searches: DataFrame, silver: DataFrame, path: str) -> None:
    """Answer all searches on all postings, once."""
    members, asked, shapes = _paged(searches)
    _store(members, _pages(asked, shapes, silver), path)


def _read_pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_PAGES).parquet(f"{version_path(path, current_version(spark, path))}/pages")


def read_standing_hits(spark: SparkSession, path: str) -> DataFrame:
    """``request_id, pos, job_id, sort_key`` of every page."""
    folder = version_path(path, current_version(spark, path))
    members = spark.read.schema(_MEMBERS).parquet(f"{folder}/members")
    pages = spark.read.schema(_PAGES).parquet(f"{folder}/pages")
    return members.join(pages, "page_id").where(F.col("pos") <= F.col("limit")).select("request_id", "pos", "job_id", "sort_key")


def _pages_after(asked: DataFrame, shapes: DataFrame, stored: DataFrame, changes: DataFrame) -> DataFrame:
    """Pages without what went and with what came, in order, and whether each is ``sure``."""
    went = changes.where("sign = -1").select("job_id").distinct()
    came = changes.where("sign = 1").drop("sign")
    edge = stored.groupBy("page_id").agg(
        F.count(F.lit(1)).alias("size"), F.max(F.struct("sort_key", "job_id")).alias("edge")
    )
    kept = stored.select("page_id", "job_id", "sort_key").join(went, "job_id", "left_anti")
    new = _pages(asked, shapes, came).select("page_id", "job_id", "sort_key")
    order = Window.partitionBy("page_id").orderBy("sort_key", "job_id")
    limits = asked.select("page_id", "limit")
    pages = (
        kept.unionByName(new)
        .withColumn("pos", F.row_number().over(order).cast("bigint"))
        .join(limits, "page_id")
        .where(F.col("pos") <= F.col("limit"))
    )
    # A page of fewer rows than its limit held all matches; of a full one, only rows up to its edge are known.
    known = F.count_if(F.struct("sort_key", "job_id") <= F.col("edge")).alias("known")
    inside = pages.join(edge, "page_id").groupBy("page_id").agg(known)
    unsure = (
        edge.join(limits, "page_id")
        .where(F.col("size") == F.col("limit"))
        .join(inside, "page_id", "left")
        .where(F.coalesce("known", F.lit(0)) < F.col("limit"))
        .select("page_id", F.lit(True).alias("unsure"))
    )
    # A page that lost every row and got none has no row here, but is unsure too.
    return pages.join(unsure, "page_id", "full").select(
        "page_id", "pos", "job_id", "sort_key", F.col("unsure").isNull().alias("sure")
    )


def update_standing_searches(searches: DataFrame, silver: DataFrame, changes: DataFrame, path: str) -> int:
    """Bring the pages up to date and return how many were refilled from ``silver``.

    ``silver`` is the table after the change, ``changes`` its rows that came (``sign`` 1)
    or went (-1).
    """
    members, asked, shapes = _paged(searches)
    stored = _read_pages(searches.sparkSession, path)
    changes = stage(changes.select(*_LOOKED_AT, "sign"), "changes")
    pages = stage(_pages_after(asked, shapes, stored, changes), "pages")
    unsure = stage(pages.where(~F.col("sure")).select("page_id").distinct(), "unsure")
    number = members.join(unsure, "page_id", "left_semi").count()
    found = pages.where("sure").select("page_id", "pos", "job_id", "sort_key")
    if number:
        again = asked.join(unsure, "page_id", "left_semi")
        found = found.unionByName(_pages(again, shapes.join(again, "shape_id", "left_semi"), silver))
    _store(members, found, path)
    return number

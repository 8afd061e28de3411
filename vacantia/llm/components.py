"""Connected components by alternating large-star and small-star steps.

Kiveris et al., "Connected Components in MapReduce and Beyond", 2014. Every step is a
grouped minimum, combined in each task before it is shuffled, and a join with it; each
round is written to the shared folder, which cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacantia.llm.session import Scratch


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b") % 1_000_003)).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, component`` of every node of ``edges(a, b)``; the component is its least node."""
    # Two rounds are kept: the one that is read and the one that is written.
    before, current = Scratch(edges.sparkSession), Scratch(edges.sparkSession)
    edges = current.stage(
        edges.where(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct(),
        "edges",
    )
    state = _state(edges)
    while True:
        before.clear()
        before, current = current, Scratch(edges.sparkSession)
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        # Every larger neighbour is tied to the least node around.
        large = both.where(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = current.stage(large.where(F.col("a") != F.col("b")).distinct(), "edges")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        # Here every edge points from the larger to the smaller node already.
        small = large.join(least, "a").select("b", "m", "a")
        tied = small.where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        own = least.select("a", F.col("m").alias("b"))
        edges = current.stage(tied.unionByName(own).distinct(), "edges")
        now = _state(edges)
        if now == state:
            break
        state = now
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)

"""Exact top-k search by inner product with a vector-approximation file.

Every component is turned into the whole number ``floor(scale * x)``. Equal vectors are
one class, searched once, of which only the ``k + 1`` smallest ids can matter (ties go to
the smaller id, and a query may have to skip itself). An id with several vectors is
searched on its own, without the classes that hold no other id.

1. The approximation file holds one byte per component: the cell of the component among
   ``cells`` equal cells between the dimension's least and greatest value.
2. Blocks of queries meet blocks of cells; matrix products give an upper and a lower
   bound of every score. What a block keeps for a query is what can still be among its
   own ``k + 1`` best; the ``k + 1``-th best lower bound over all blocks then leaves the
   candidates.
3. Exact vectors are read in the order of the bounds, the most promising first: the first
   ``2 (k + 1)`` give an exact ``k + 1``-th score, and of the others only those are read
   whose bound reaches it, after which no other vector can be in the result.

Rules: vectors that are null, empty, or hold null or non-finite components take no part.
Vectors of different length have no score. Rows without an id take no part. Scores are
exact; an answer that a long cannot hold stops the job, and so does a sum of more than 38
digits on the way. With ``every_row`` all rows that repeat
an id are candidates, the answers of a repeated query id are ranked together, and a
component whose whole number a long cannot hold stops the job. Without it such vectors
take no part, and of rows that repeat an id only the one with the greatest whole vector
does.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vacantia.sources.workspace import stage

LONG = 2.0**63
#: Vectors of one block, fewer if they have more than 1024 components; a pair of blocks
#: needs one product of these sizes.
QUERY_BLOCK, VECTOR_BLOCK = 512, 4096


def whole_vectors(vectors: DataFrame, vec_id: str, vector: str, scale: int, every_row: bool = False) -> DataFrame:
    """``vec_id, v, copies`` with whole components, without the rows that take no part."""
    wide = F.transform(F.col(vector), lambda x: x.cast("double"))

    def fits(x: Column) -> Column:
        return F.abs(x * F.lit(float(scale))) < F.lit(LONG)

    def whole(x: Column) -> Column:
        number = F.floor(x * F.lit(float(scale)))
        wrong = F.raise_error(F.lit("a component's whole number does not fit a long")).cast("bigint")
        return F.when(fits(x), number).otherwise(wrong)

    def usable(x: Column) -> Column:
        finite = ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
        return F.coalesce(finite if every_row else finite & fits(x), F.lit(False))

    rows = vectors.where(F.col(vec_id).isNotNull() & (F.size(vector) >= 1) & F.forall(wide, usable))
    rows = rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.transform(wide, whole).alias("v"))
    if every_row:
        return rows.groupBy("vec_id", "v").agg(F.count(F.lit(1)).alias("copies"))
    return rows.groupBy("vec_id").agg(F.max("v").alias("v"), F.lit(1).cast("long").alias("copies"))


def _blocks(rows: DataFrame, size: int) -> DataFrame:
    """``dims, block, ids, owners, data``: up to ``size`` vectors of one length per row."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list[int], list[int | None], list[np.ndarray]]] = {}

        def row(dims: int) -> pa.RecordBatch:
            ids, owners, data = held.pop(dims)
            packed = np.asarray(data, np.int64).tobytes()
            return pa.RecordBatch.from_pydict({"dims": [dims], "ids": [ids], "owners": [owners], "data": [packed]}, _BLOCK)

        for batch in batches:
            lists = batch.column("v")
            offsets = lists.offsets.to_numpy()
            values = lists.values.to_numpy(zero_copy_only=False).astype(np.int64)
            named = zip(batch.column("number").to_pylist(), batch.column("owner").to_pylist(), strict=True)
            for i, (number, owner) in enumerate(named):
                v = values[offsets[i] : offsets[i + 1]]
                ids, owners, data = held.setdefault(len(v), ([], [], []))
                ids.append(number)
                owners.append(owner)
                data.append(v.copy())
                if len(ids) == max(1, min(size, 1024 * size // len(v))):
                    yield row(len(v))
        for dims in list(held):
            yield row(dims)

    packed = rows.select("number", "owner", "v").mapInArrow(pack, "dims int, ids array<bigint>, owners array<bigint>, data binary")
    return packed.withColumn("block", F.monotonically_increasing_id())


_BLOCK = pa.schema(
    [("dims", pa.int32()), ("ids", pa.list_(pa.int64())), ("owners", pa.list_(pa.int64())), ("data", pa.binary())]
)
_BOUNDS = pa.schema([("query", pa.int64()), ("class_id", pa.int64()), ("low", pa.float64()), ("high", pa.float64())])


def _bounded(pairs: DataFrame, keep: int) -> DataFrame:
    """Per pair of blocks: the candidates that can be among the ``keep`` best of the block."""

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pair in batch.to_pylist():
                dims = pair["dims"]
                queries = np.frombuffer(pair["query_data"], np.int64).reshape(-1, dims).astype(np.float64)
                cells = np.frombuffer(pair["cells"], np.uint8).reshape(-1, dims).astype(np.float64)
                least, width = np.asarray(pair["least"], np.float64), np.asarray(pair["width"], np.float64)
                middle = queries @ (least + (cells + 0.5) * width).T
                # Half a cell in every component, and room for rounding.
                slack = np.abs(queries) @ (width / 2)
                slack += 1e-9 * (np.abs(queries) @ np.maximum(np.abs(least), np.abs(least + 256 * width))) + 1e-6
                for i, owner in enumerate(pair["query_owners"]):
                    if owner is not None:
                        middle[i, [o == owner for o in pair["owners"]]] = -np.inf
                n = min(keep, middle.shape[1])
                best = np.partition(middle, middle.shape[1] - n, axis=1)[:, middle.shape[1] - n]
                at, of = np.nonzero((middle >= (best - 2 * slack)[:, None]) & (middle > -np.inf))
                found = middle[at, of]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.asarray(pair["query_ids"], np.int64)[at]),
                        pa.array(np.asarray(pair["ids"], np.int64)[of]),
                        pa.array(found - slack[at]),
                        pa.array(found + slack[at]),
                    ],
                    schema=_BOUNDS,
                )

    return pairs.mapInArrow(bound, "query bigint, class_id bigint, low double, high double")


def _cells(blocks: DataFrame, ranges: DataFrame, cells: int) -> DataFrame:
    """The approximation file: the blocks' components as one-byte cells."""
    schema = "dims int, block bigint, ids array<bigint>, owners array<bigint>, least array<double>, width array<double>, cells binary"

    def quantise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                least, width = np.asarray(row["least"]), np.asarray(row["width"])
                data = np.frombuffer(row.pop("data"), np.int64).reshape(-1, row["dims"])
                row["cells"] = np.clip((data - least) // width, 0, cells - 1).astype(np.uint8).tobytes()
                yield pa.RecordBatch.from_pylist([row], _CELLS)

    return blocks.join(ranges, "dims").select("dims", "block", "ids", "owners", "least", "width", "data").mapInArrow(quantise, schema)


_CELLS = pa.schema(
    [
        ("dims", pa.int32()),
        ("block", pa.int64()),
        ("ids", pa.list_(pa.int64())),
        ("owners", pa.list_(pa.int64())),
        ("least", pa.list_(pa.float64())),
        ("width", pa.list_(pa.float64())),
        ("cells", pa.binary()),
    ]
)


def _ranges(classes: DataFrame, cells: int) -> DataFrame:
    """``dims, least, width`` of the cells; one row per vector length."""
    parts = classes.select(F.size("v").alias("dims"), F.posexplode("v").alias("i", "x"))
    spread = parts.groupBy("dims", "i").agg(
        F.min("x").cast("double").alias("least"), F.max("x").cast("double").alias("most")
    )
    width = F.greatest((F.col("most") - F.col("least") + 1) / F.lit(float(cells)), F.lit(1e-3))
    rows = spread.groupBy("dims").agg(
        F.sort_array(F.collect_list(F.struct("i", "least", width.alias("width")))).alias("s")
    )
    return rows.select("dims", F.col("s.least").alias("least"), F.col("s.width").alias("width"))


def _dot(a: Column, b: Column, most: Column) -> Column:
    """The exact inner product; ``most`` is a bound of the sum of its terms' sizes."""
    products = F.zip_with(a, b, lambda x, y: x * y)
    short = F.aggregate(products, F.lit(0).cast("long"), lambda total, x: total + x)
    wide = F.zip_with(a, b, lambda x, y: (x.cast("decimal(19,0)") * y.cast("decimal(19,0)")).cast("decimal(38,0)"))
    total = F.aggregate(wide, F.lit(0).cast("decimal(38,0)"), lambda t, x: (t + x).cast("decimal(38,0)"))
    wrong = F.raise_error(F.lit("a score does not fit 38 digits")).cast("decimal(38,0)")
    return F.when(most < F.lit(2.0**62), short.cast("decimal(38,0)")).otherwise(F.coalesce(total, wrong))


def _as_long(score: Column) -> Column:
    held = score.between(F.lit(-(1 << 63)).cast("decimal(38,0)"), F.lit((1 << 63) - 1).cast("decimal(38,0)"))
    return F.when(held, score.cast("bigint")).otherwise(F.raise_error(F.lit("a score does not fit a long")).cast("bigint"))


def _scored(pairs: DataFrame, classes: DataFrame, units: DataFrame) -> DataFrame:
    queries = units.join(classes, "class_id").select(
        "query", F.col("v").alias("query_v"), F.col("largest").alias("query_largest")
    )
    most = F.size("v") * F.col("largest") * F.col("query_largest")
    return pairs.join(classes.select("class_id", "v", "largest"), "class_id").join(queries, "query").select(
        "query", "class_id", _dot(F.col("query_v"), F.col("v"), most).alias("score")
    )


def top_k(
    vectors: DataFrame,
    is_query: Column,
    k: int = 10,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    scale: int = 1024,
    cells: int = 256,
    every_row: bool = False,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` best other rows of every query row.

    ``is_query`` is a condition on the id column, named ``vec_id`` in it. ``cells`` is at
    most 256. ``every_row``: see the rules above. Intermediate tables are written to the session's shared folder.
    """
    keep = k + 1
    whole = whole_vectors(vectors, vec_id, vector, scale, every_row).withColumn("ticket", F.monotonically_increasing_id())
    whole = stage(whole, "whole-vectors")
    smallest = Window.partitionBy("v").orderBy("vec_id")
    # The limit on the row number cuts every class down in each task before the shuffle.
    members = whole.withColumn("place", F.row_number().over(smallest)).where(F.col("place") <= keep)
    same = Window.partitionBy("v")
    members = members.withColumn("class_id", F.min("ticket").over(same))
    members = members.withColumn("owner", F.when(F.count(F.lit(1)).over(same) == 1, F.col("vec_id")))
    members = stage(members, "vector-classes")
    largest = F.array_max(F.transform("v", lambda x: F.abs(x.cast("double")))).alias("largest")
    classes = members.where("place = 1").select("class_id", "owner", "v", largest)
    ids = members.select("class_id", "vec_id", F.least("copies", F.lit(k)).alias("copies"))
    asked = whole.where(is_query).withColumn("vectors", F.count(F.lit(1)).over(Window.partitionBy("vec_id")))
    own_id = F.when(F.col("vectors") > 1, F.col("vec_id"))
    asked = asked.join(classes.select("class_id", "v"), "v").select(
        F.when(own_id.isNotNull(), -F.col("ticket") - 1).otherwise(F.col("class_id")).alias("query"),
        F.col("vec_id").alias("query_id"),
        "class_id",
        own_id.alias("query_owner"),
        F.least("copies", F.lit(k)).alias("query_copies"),
    )
    asked = stage(asked, "asked")
    units = asked.select("query", "class_id", "query_owner").distinct()

    query_rows = classes.select("class_id", "v").join(units, "class_id")
    query_blocks = _blocks(query_rows.select(F.col("query").alias("number"), F.col("query_owner").alias("owner"), "v"), QUERY_BLOCK)
    query_blocks = query_blocks.select(
        "dims", F.col("ids").alias("query_ids"), F.col("owners").alias("query_owners"), F.col("data").alias("query_data")
    )
    class_rows = classes.select(F.col("class_id").alias("number"), "owner", "v")
    cell_blocks = _cells(_blocks(class_rows, VECTOR_BLOCK), _ranges(classes, cells), cells)
    # Every block of queries goes to every share of the cells, and only there.
    shares = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cell_blocks = cell_blocks.withColumn("share", F.pmod(F.xxhash64("block"), F.lit(shares)))
    query_blocks = query_blocks.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1)).cast("array<bigint>")))
    bounds = stage(_bounded(query_blocks.join(cell_blocks, ["dims", "share"]), keep), "bounds")

    by_low = Window.partitionBy("query").orderBy(F.col("low").desc(), "class_id")
    least = (
        bounds.select("query", "class_id", "low")
        .withColumn("place", F.row_number().over(by_low))
        .where(F.col("place") <= keep)
        .groupBy("query")
        .agg(F.when(F.count(F.lit(1)) == keep, F.min("low")).alias("sure"))
    )
    possible = bounds.join(least, "query").where(F.col("sure").isNull() | (F.col("high") >= F.col("sure")))
    by_bound = Window.partitionBy("query").orderBy(F.col("high").desc(), "class_id")
    possible = stage(possible.select("query", "class_id", "high"), "possible")
    first = possible.withColumn("place", F.row_number().over(by_bound)).where(F.col("place") <= 2 * keep)
    first = stage(_scored(first.select("query", "class_id"), classes, units), "first-scores")

    by_score = Window.partitionBy("query").orderBy(F.col("score").desc(), "class_id")
    certain = (
        first.withColumn("place", F.row_number().over(by_score))
        .where(F.col("place") <= keep)
        .groupBy("query")
        .agg(F.when(F.count(F.lit(1)) == keep, F.min("score")).alias("certain"))
    )
    rest = (
        possible.join(certain, "query")
        .where(F.col("certain").isNull() | (F.col("high") >= F.col("certain")))
        .join(first.select("query", "class_id"), ["query", "class_id"], "left_anti")
    )
    scores = first.unionByName(_scored(rest.select("query", "class_id"), classes, units))
    owned = units.select("query", "query_owner")
    best = scores.join(ids, "class_id").join(owned, "query").where(~F.col("vec_id").eqNullSafe(F.col("query_owner")))
    # One more than k, since a query skips itself.
    by_id = Window.partitionBy("query").orderBy(F.col("score").desc(), "vec_id")
    best = best.withColumn("place", F.row_number().over(by_id)).where(F.col("place") <= keep).drop("place")
    own = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    answers = asked.select("query", "query_id", "query_copies").join(best.select("query", "vec_id", "score", "copies"), "query")
    pairs = F.least(F.col("query_copies") * F.col("copies"), F.lit(k)).cast("int")
    return (
        answers.where(F.col("query_id") != F.col("vec_id"))
        .withColumn("copy", F.explode(F.sequence(F.lit(1), pairs)))
        .withColumn("rank", F.row_number().over(own))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", _as_long(F.col("score")).alias("score"))
    )

"""Answer a whole table of saved searches in one job, without pairing them with rows.

Every filter is turned into equality on *cells*. A posting lies in the cell of its
seniority, country, experience and salary; "any" of each is a cell of its own. A bound on
experience or salary is a prefix of an axis of fixed length (years upwards, salaries
downwards), and a prefix of any length is the union of at most one block per binary digit
of that length (block ``b`` of level ``l`` covers the positions ``b * 2**l`` up to
``(b + 1) * 2**l``). What a bound can never accept (no salary or a negative one, no
experience or more than any limit) lies in the cells of "any" only. The axes do not depend
on the searches, so any number of distinct bounds is answered in the same way.

First pages need fewer cells. Where results are ordered by the bounded column itself, the
rows that a bound accepts are the first ones of all rows that some bound could accept,
whatever the bound: such an axis has the cells "any" and "known" only, and the bound is
applied to the short list.

Postings between two neighbouring bounds on the salary that searches ask for are accepted by
the same searches, as far as salaries go: of each such stretch only the best ``MAX_LIMIT`` per
seniority, country, experience and order go on. Postings are widened only into cells that
some search asks for, one filter after the other. Row counts first rule out the postings that
can be on no first page; of the rest every cell keeps the best ``MAX_LIMIT``, cut within each
task before the shuffle, and searches meet these short lists by equi-join. The result is exact: the best rows of a
union are among the best rows of its parts.

Totals need no cells of salaries. Postings and searches are told apart by their *period*, the
cells of seniority, country and experience, and a bound on the salary accepts the postings
before a point of the axis: counts run along it, and a search looks up one point per period.

Searches must be valid requests. A limit, experience or salary outside the contract stops
the job: cells could not answer it rightly.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vacantia.functions.columns import own_shuffle
from vacantia.operators.ordering import ORDERINGS
from vacantia.schema import MAX_EXPERIENCE_YEARS, MAX_LIMIT, MAX_SALARY_FILTER, SORTS
from vacantia.sources.workspace import stage

BOUNDS = ["seniority", "experience_max", "salary_min", "country"]
SHAPE = [*BOUNDS, "sort"]
AREA = ["seniority", "country"]
PERIOD = [*AREA, "year_level", "year_block"]
CELL = [*PERIOD, "salary_level", "salary_block"]
KIND = [*AREA, "year_position"]
ANY, KNOWN = -1, -2
#: The axis that each order runs along, if any.
ALONG = {"year": "experience_asc", "salary": "salary_max_desc"}
YEAR_BITS = (MAX_EXPERIENCE_YEARS + 1).bit_length()
SALARY_BITS = (MAX_SALARY_FILTER + 1).bit_length()
#: Totals count along the salary axis, by blocks of this many bits.
POSITION_BITS, DIGIT_BITS = (MAX_SALARY_FILTER + 2).bit_length(), 10
BEYOND_YEARS, UNKNOWN_YEARS = MAX_EXPERIENCE_YEARS + 1, MAX_EXPERIENCE_YEARS + 2
STRETCHES = 2847  # of the salary axis, told apart when rows are ruled out; the last has no salary


def _in_contract(searches: DataFrame) -> DataFrame:
    """The searches; one that is no valid request stops the job."""

    def fine(name: str, low: int, high: int) -> Column:
        stop = F.raise_error(f"{name} of a saved search is not in {low}..{high}").cast("boolean")
        return F.when(F.col(name).between(low, high), True).otherwise(stop)

    bounds = F.when(F.col("experience_max").isNotNull(), fine("experience_max", 0, MAX_EXPERIENCE_YEARS)).otherwise(True)
    bounds &= F.when(F.col("salary_min").isNotNull(), fine("salary_min", 0, MAX_SALARY_FILTER)).otherwise(True)
    # Never NULL, or the planner might drop a NULL limit before it is refused.
    limited = searches.withColumn("limit", F.coalesce("limit", F.lit(0)))
    return limited.where(fine("limit", 1, MAX_LIMIT) & bounds)


def _blocks(level: Column, position: Column) -> Column:
    return F.struct(level.alias("level"), F.call_function("shiftright", position, level).cast("bigint").alias("block"))


def _prefix_cells(length: Column, bits: int) -> Column:
    """Blocks that make up a prefix of the axis, one per set bit; all of it is "any"."""
    levels = F.sequence(F.lit(0), F.lit(bits - 1))
    used = F.filter(levels, lambda level: F.call_function("shiftright", length, level) % 2 == 1)
    blocks = F.transform(used, lambda level: _blocks(level, length))
    starts = F.transform(blocks, lambda b: F.struct(b["level"].alias("level"), (b["block"] - 1).alias("block")))
    return F.when(length.isNull(), _any_cell()).otherwise(starts)


def _position_cells(position: Column, bits: int) -> Column:
    """Cells around a position; prefixes only ever use even blocks."""
    around = F.transform(F.sequence(F.lit(0), F.lit(bits - 1)), lambda level: _blocks(level, position))
    even = F.filter(around, lambda b: b["block"] % 2 == 0)
    return F.concat(_any_cell(), F.when(position.isNotNull(), even).otherwise(F.slice(_any_cell(), 2, 0)))


def _any_cell(level: int = ANY) -> Column:
    return F.array(F.struct(F.lit(level).alias("level"), F.lit(0).cast("bigint").alias("block")))


def _row_cells(df: DataFrame, axis: str, bits: int) -> Column:
    """Cells of rows; rows of an order along the axis need not be told apart on it."""
    position = F.col(f"{axis}_position")
    cells = _position_cells(position, bits)
    if "sort" not in df.columns:
        return cells
    known = F.when(position.isNotNull(), F.concat(_any_cell(), _any_cell(KNOWN))).otherwise(_any_cell())
    return F.when(F.col("sort") != ALONG[axis], cells).otherwise(known)


def _in_cells(df: DataFrame, cells: Column, name: str) -> DataFrame:
    """Every row once per cell of one axis."""
    wide = df.select("*", F.explode(cells).alias("cell"))
    return wide.withColumns({f"{name}_level": F.col("cell.level"), f"{name}_block": F.col("cell.block")}).drop("cell")


def _searches_in_cells(shapes: DataFrame) -> DataFrame:
    """One row per cell that a search shape accepts for its first page."""
    years = F.col("experience_max").cast("bigint") + 1
    salaries = F.lit(MAX_SALARY_FILTER + 1).cast("bigint") - F.col("salary_min")
    year_cells, salary_cells = _prefix_cells(years, YEAR_BITS), _prefix_cells(salaries, SALARY_BITS)
    year_cells = F.when(F.col("sort") != ALONG["year"], year_cells).when(years.isNull(), _any_cell()).otherwise(_any_cell(KNOWN))
    salary_cells = (
        F.when(F.col("sort") != ALONG["salary"], salary_cells).when(salaries.isNull(), _any_cell()).otherwise(_any_cell(KNOWN))
    )
    in_both = _in_cells(_in_cells(shapes, year_cells, "year"), salary_cells, "salary")
    return in_both.select("shape_id", *CELL, "sort", "limit", "experience_max", "salary_min")


def _also_any(df: DataFrame, column: str) -> DataFrame:
    """Every row also with NULL for "any"; a row without value only as "any"."""
    value = F.when(F.col("is_any"), F.lit(None).cast("string")).otherwise(F.col(column))
    return (
        df.select("*", F.explode(F.array(F.lit(False), F.lit(True))).alias("is_any"))
        .where(F.col("is_any") | F.col(column).isNotNull())
        .withColumn(column, value)
        .drop("is_any")
    )


def _placed(postings: DataFrame) -> DataFrame:
    """``years`` as searches tell them apart, and the positions on both axes, if any."""
    years, salary = F.col("years_exp"), F.col("salary_max")
    told = F.when(years.isNull(), UNKNOWN_YEARS).otherwise(F.greatest(F.lit(0), F.least(years, F.lit(BEYOND_YEARS))))
    placed = postings.withColumn("years", told.cast("int"))
    return placed.withColumns(
        {
            "year_position": F.when(F.col("years") <= MAX_EXPERIENCE_YEARS, F.col("years").cast("bigint")),
            "salary_position": F.when(
                salary >= 0, F.lit(MAX_SALARY_FILTER).cast("bigint") - F.least(salary, F.lit(MAX_SALARY_FILTER))
            ),
        }
    )


def _meet(wanted: DataFrame, cells: DataFrame, names: list[str], how: str = "inner") -> DataFrame:
    """Equi-join on cell columns; NULL meets NULL as "any"."""
    wanted = wanted.select(*[F.col(name).alias(f"of_{name}") for name in wanted.columns])
    match = F.lit(True)
    for name in names:
        a, b = F.col(name), F.col(f"of_{name}")
        match = match & (a.eqNullSafe(b) if name in AREA else a == b)
    return cells.join(wanted, match, how)


def _asked(cells: DataFrame, wanted: DataFrame, names: list[str]) -> DataFrame:
    """The rows whose cell, as far as ``names`` go, some search asks for, in their order if they have one."""
    names = [*names, "sort"] if "sort" in cells.columns else names
    return _meet(wanted.select(*names).distinct(), cells, names, "left_semi")


def _in_periods(placed: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows in each asked seniority, country and stretch of years that holds them."""
    areas = _asked(_also_any(_also_any(placed, "seniority"), "country"), wanted, AREA)
    return _asked(_in_cells(areas, _row_cells(areas, "year", YEAR_BITS), "year"), wanted, PERIOD)


def _in_salaries(periods: DataFrame, wanted: DataFrame) -> DataFrame:
    return _asked(_in_cells(periods, _row_cells(periods, "salary", SALARY_BITS), "salary"), wanted, CELL)


def _within_bounds() -> Column:
    """Whether a search's bound along its own order accepts a row; the key tells."""
    by_years = (F.col("sort") == ALONG["year"]) & (F.col("sort_key") > F.col("of_experience_max"))
    by_salary = (F.col("sort") == ALONG["salary"]) & (-F.col("sort_key") < F.col("of_salary_min"))
    return ~F.coalesce(by_years | by_salary, F.lit(False))


def _best(rows: DataFrame, group: list[str], limit: int = MAX_LIMIT) -> DataFrame:
    """The first ``limit`` rows per group, cut within each task before the shuffle."""
    place = F.row_number().over(Window.partitionBy(*group).orderBy("sort_key", "job_id"))
    return rows.withColumn("place", place).where(F.col("place") <= limit)


def _coarse(number: Column) -> Column:
    """A coarse size of a whole number that never changes its order; only 0 gives 0.

    Square roots are correctly rounded, hence monotonic.
    """
    size = F.floor(F.sqrt(F.sqrt(F.abs(number).cast("double"))) * 16)
    return F.when(number < 0, -size).otherwise(size)


def _hint() -> Column:
    """A number such that a smaller hint always means an earlier row of the same sort.

    It holds the coarse sort key and, where all rows of that hint share one key
    (experience, or no salary), the coarse job id as well.
    """
    by_years = F.col("sort") == "experience_asc"
    key = F.when(by_years, F.col("sort_key")).otherwise(_coarse(F.col("sort_key")))
    tied = by_years | (F.col("sort_key") == 0)
    return key * F.lit(1 << 21) + F.when(tied, _coarse(F.col("job_id"))).otherwise(F.lit(0))


def _in_level(df: DataFrame, bits: int, block: Callable[[Column], Column], parity: int) -> DataFrame:
    """Every row once per level, with the level's block where that has the parity."""
    wide = df.select("*", F.explode(F.sequence(F.lit(0), F.lit(bits - 1))).alias("level"))
    return wide.withColumn("block", block(F.col("level"))).where(F.pmod("block", F.lit(2)) == parity)


def _stretch(position: Column) -> Column:
    """The stretch of the salary axis around a position; rows that no bound accepts come last."""
    last = F.lit(STRETCHES - 1).cast("bigint")
    return F.coalesce(last - 1 - _coarse(F.lit(MAX_SALARY_FILTER).cast("bigint") - position), last)


def _reached(placed: DataFrame, shapes: DataFrame) -> DataFrame:
    """Rows with ``reach``, the first asked bound on the axis that accepts them, if any.

    Bounds and salaries, once each, are ordered within the stretches of the axis; what lies
    behind the last bound of its stretch is reached by the first one of a later stretch.
    """
    asked = shapes.where(F.col("salary_min").isNotNull())
    bound = (F.lit(MAX_SALARY_FILTER).cast("bigint") - F.col("salary_min")).alias("salary_position")
    bounds = asked.select(bound).distinct().select("salary_position", F.col("salary_position").alias("bound"))
    salaries = placed.where(F.col("salary_position").isNotNull()).select("salary_position").distinct()
    points = (
        bounds.unionByName(salaries.withColumn("bound", F.lit(None).cast("bigint")))
        .groupBy("salary_position")
        .agg(F.min("bound").alias("bound"))
        .withColumn("stretch", _stretch(F.col("salary_position")))
    )
    # Backwards, so that a running minimum does.
    from_here = Window.partitionBy("stretch").orderBy(F.desc("salary_position")).rowsBetween(Window.unboundedPreceding, 0)
    later = Window.orderBy(F.desc("stretch")).rowsBetween(Window.unboundedPreceding, -1)
    all_stretches = shapes.sparkSession.range(STRETCHES).select(F.col("id").alias("stretch"))
    first = bounds.groupBy(_stretch(F.col("salary_position")).alias("stretch")).agg(F.min("bound").alias("first"))
    # One row per stretch, whatever the tables hold.
    behind = all_stretches.join(first, "stretch", "left").select("stretch", F.min("first").over(later).alias("behind"))
    reach = points.select("salary_position", "stretch", F.min("bound").over(from_here).alias("here")).join(
        F.broadcast(behind), "stretch"
    )
    reach = reach.select("salary_position", F.coalesce("here", "behind").alias("reach"))
    # A plain shuffle, which can be split where very many postings have one salary.
    reach = reach.select(own_shuffle(F.col("salary_position").cast("string")).alias("key"), "reach")
    return placed.join(reach, F.col("salary_position").cast("string") == F.col("key"), "left").drop("key")


def _promising(placed: DataFrame) -> DataFrame:
    """Leave out rows that ``MAX_LIMIT`` other rows beat in every search.

    A search that accepts a row accepts all rows before it on the salary axis in
    the same seniority, country and experience. Row counts per hint give, for
    every stretch of the axis, a hint below which ``MAX_LIMIT`` rows lie; a row
    with a larger hint than a stretch before it cannot reach any first page.
    """
    bits = STRETCHES.bit_length()
    cell = F.struct("seniority", "country", "years", "sort")
    # What accepts rows of the last stretch accepts all.
    hinted = placed.withColumns({"cell": cell, "stretch": _stretch(F.col("salary_position")), "hint": _hint()})
    counts = hinted.groupBy("cell", "stretch", "hint").agg(F.count(F.lit(1)).alias("n"))
    upward = Window.partitionBy("cell", "level", "block").orderBy("hint")
    cutoffs = (
        _in_level(counts, bits, lambda level: F.call_function("shiftright", F.col("stretch"), level), 0)
        .groupBy("cell", "level", "block", "hint")
        .agg(F.sum("n").alias("n"))
        .withColumn("running", F.sum("n").over(upward))
        .where(F.col("running") >= MAX_LIMIT)
        .groupBy("cell", "level", "block")
        .agg(F.min("hint").alias("cutoff"))
    )
    # Only whole stretches before a row's own are sure to be accepted with it.
    stretches = counts.select("cell", "stretch").distinct()
    limits = (
        _in_level(stretches, bits, lambda level: F.call_function("shiftright", F.col("stretch"), level) - 1, 0)
        .join(cutoffs, ["cell", "level", "block"])
        .groupBy("cell", "stretch")
        .agg(F.min("cutoff").alias("cutoff"))
    )
    limits = limits.select("cell", own_shuffle(F.col("stretch").cast("string")).alias("stretch_key"), "cutoff")
    hinted = hinted.withColumn("stretch_key", F.col("stretch").cast("string"))
    kept = F.col("cutoff").isNull() | (F.col("hint") <= F.col("cutoff"))
    return hinted.join(limits, ["cell", "stretch_key"], "left").where(kept).select(*placed.columns)


def shapes_of(searches: DataFrame, shape: list[str]) -> tuple[DataFrame, DataFrame]:
    """Searches with their shape, and each distinct shape with its largest limit."""
    shape_id = F.sha2(F.to_json(F.struct(*shape)), 256)
    labelled = _in_contract(searches).withColumn("shape_id", shape_id)
    shapes = labelled.groupBy("shape_id", *shape).agg(F.max("limit").alias("limit"))
    return labelled, shapes


def _named(df: DataFrame) -> DataFrame:
    """Seniority and country without NULL, so that they join and group as plain keys."""
    return df.withColumns({name: F.coalesce(F.concat(F.lit("="), name), F.lit("")) for name in AREA})


def _counts_before(points: DataFrame, bits: int) -> DataFrame:
    """The asked points with ``before``: the ``n`` of all points before them in their period.

    Counts run within blocks of ``1 << DIGIT_BITS`` positions, and what lies before a block
    is found alike from the sums of blocks; no task needs a whole period.
    """
    blocks = points.withColumn("block", F.call_function("shiftright", F.col("position"), F.lit(DIGIT_BITS)))
    earlier_here = Window.partitionBy(*PERIOD, "block").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    here = blocks.withColumn("before", F.coalesce(F.sum("n").over(earlier_here), F.lit(0))).where("asked")
    if bits <= DIGIT_BITS:
        return here.select(*PERIOD, "position", "before")
    sums = blocks.groupBy(*PERIOD, F.col("block").alias("position")).agg(F.sum("n").alias("n"), F.max("asked").alias("asked"))
    of_blocks = _counts_before(sums, bits - DIGIT_BITS)
    # Merged, since blocks grow with the searches and a broadcast passes through the driver.
    of_blocks = of_blocks.select(*PERIOD, F.col("position").alias("block"), F.col("before").alias("before_block"))
    met = here.join(of_blocks.hint("merge"), [*PERIOD, "block"])
    return met.select(*PERIOD, "position", (F.col("before") + F.col("before_block")).alias("before"))


def saved_search_totals(searches: DataFrame, silver: DataFrame) -> DataFrame:
    """``request_id, total`` for every search, zero included.

    A bound on the salary accepts what lies before a point of the axis; what no bound
    accepts lies behind them all, and before the point of a search without a bound.
    """
    labelled, shapes = shapes_of(searches, BOUNDS)
    beyond = F.lit(MAX_SALARY_FILTER + 1).cast("bigint")
    years = F.col("experience_max").cast("bigint") + 1
    bounded = stage(shapes, "shapes").withColumn("position", F.coalesce(beyond - F.col("salary_min"), beyond + 1))
    wanted = _in_cells(bounded, _prefix_cells(years, YEAR_BITS), "year").select("shape_id", *PERIOD, "position")
    placed = _placed(silver.select("seniority", "country", "years_exp", "salary_max"))
    placed = placed.withColumn("position", F.coalesce("salary_position", beyond)).withColumn("kind", F.to_json(F.struct(*KIND)))
    # Kinds are few: they are widened into asked periods, and counts then meet them.
    kinds = placed.select("kind", *KIND).distinct()
    periods = _named(_in_periods(kinds, wanted)).select("kind", *PERIOD)
    counts = placed.groupBy("kind", "position").agg(F.count(F.lit(1)).alias("n")).join(periods, "kind")
    wanted = _named(wanted)
    asked = wanted.select(*PERIOD, "position", F.lit(0).cast("bigint").alias("n"), F.lit(True).alias("asked"))
    points = (
        counts.select(*PERIOD, "position", "n", F.lit(False).alias("asked"))
        .unionByName(asked)
        .groupBy(*PERIOD, "position")
        .agg(F.sum("n").alias("n"), F.max("asked").alias("asked"))
    )
    points = stage(points, "points")
    totals = (
        wanted.join(_counts_before(points, POSITION_BITS).hint("merge"), [*PERIOD, "position"])
        .groupBy("shape_id")
        .agg(F.sum("before").alias("total"))
        .select(own_shuffle("shape_id").alias("shape_id"), "total")
    )
    return labelled.join(totals.hint("merge"), "shape_id", "left").select(
        "request_id", F.coalesce("total", F.lit(0)).cast("bigint").alias("total")
    )


def shape_pages(shapes: DataFrame, silver: DataFrame) -> DataFrame:
    """``shape_id, pos, job_id, sort_key``: the first page of every distinct search."""
    shapes = stage(shapes, "shapes")
    wanted = _searches_in_cells(shapes)
    keys = F.inline(
        F.array(
            *[F.struct(F.lit(name).alias("sort"), ORDERINGS[name].key().alias("sort_key")) for name in SORTS]
        )
    )
    columns = silver.select("job_id", "seniority", "country", "years_exp", "salary_min", "salary_max")
    placed = _reached(_placed(columns), shapes)
    placed = placed.select("job_id", *AREA, "years", "year_position", "salary_position", "reach", keys)
    # Written once, since what follows reads them several times.
    short = stage(_best(placed, [*AREA, "years", "reach", "sort"]).drop("place"), "short-lists")
    periods = _in_periods(_promising(short), wanted)
    # What is short per year is cut once more per stretch of years, "any" country and "any" seniority.
    periods = stage(_best(periods, [*PERIOD, "reach", "sort"]).drop("place"), "periods")
    widened = _in_salaries(periods, wanted).select(*CELL, "job_id", "sort", "sort_key")
    lists = _best(widened, [*CELL, "sort"])
    met = (
        _meet(wanted, lists, [*CELL, "sort"])
        .where((F.col("place") <= F.col("of_limit")) & _within_bounds())
        .select(F.col("of_shape_id").alias("shape_id"), F.col("of_limit").alias("limit"), "job_id", "sort_key")
    )
    pages = _best(met, ["shape_id"]).where(F.col("place") <= F.col("limit"))
    return pages.select("shape_id", F.col("place").cast("bigint").alias("pos"), "job_id", "sort_key")


def saved_search_hits(searches: DataFrame, silver: DataFrame) -> DataFrame:
    """``request_id, pos, job_id``: the first page of every search.

    ``searches`` holds valid requests: ``request_id``, one typed column per
    filter, ``sort`` and ``limit``.
    """
    labelled, shapes = shapes_of(searches, SHAPE)
    hits = shape_pages(shapes, silver).withColumn("shape_id", own_shuffle("shape_id"))
    return labelled.join(hits, "shape_id").where(F.col("pos") <= F.col("limit")).select("request_id", "pos", "job_id")

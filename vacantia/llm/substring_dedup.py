"""Removal of long passages that repeat anywhere, by minimizer partitioning of word windows.

A window is ``window`` consecutive words of one text; every word covered by a window
whose words also start anywhere else goes, the first occurrence included.

It replaces a de Bruijn graph of k-mer edges contracted by joins; no edges or degrees are
built, because every word begins a k-mer and all of them would have to be shuffled. Here
each window is assigned to its least k-mer by hash (its anchor, the leftmost of equal
ones); equal windows have equal anchors. The windows of one anchor are consecutive and make
one *path*, the words that they cover together, so a text has an anchor for every dozen of
its words or so.

1. Paths are counted by anchor, in each task first. An anchor that occurs once has no
   repeated window. An anchor whose occurrences all have one path is a nonbranching
   stretch: all its windows are repeated.
2. Where paths of one anchor differ (the text branches there), the single windows of such
   paths are hashed to 128 bits and counted, in each task first; those that occur once are
   dropped.
3. The texts are read once more. Bit arrays of bounded size, known to all tasks, say which
   of a text's paths and windows may be repeated. Texts without any are finished at once; of
   the others the source coordinates of all such places are joined with the exact tables,
   and the marks that remain are joined with these texts, which are packed for that.

Tables of counts are written before they are joined, so these joins are plain sort-merge
joins whose large partitions Spark can split, however many documents share a passage.

Rules:

* Words are runs of bytes without ``\\x20`` and ``\\x09-\\x0D``, unchanged. A null text has
  none. A text of fewer words than a window keeps all of them.
* Windows are judged on the input. Overlapping occurrences in one text count.
* Rows that repeat id and text are copies of one another. Null ids are allowed.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacantia.llm.bitset import fitting, has
from vacantia.llm.hashing import U, Words, mix, slices, text_bytes
from vacantia.llm.session import Scratch, released

WINDOW, KMER = 35, 8
#: Texts that are unpacked at once.
ROWS = 64
def _least_of(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of ``width`` consecutive values at each position that has as many."""
    size = 1
    while size * 2 <= width:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    rest = width - size
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def anchored_paths(words: Words, window: int, kmer: int) -> tuple[np.ndarray, ...]:
    """``anchor, path, text, begin, count`` of every run of windows with one anchor.

    ``begin`` is the first window's first word, counted over all texts.
    """
    begin, text = words.windows(window)
    if not len(begin):
        return (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64),) * 3
    n = len(words)
    starts = np.arange(n - kmer + 1)
    hashes = words.spans(starts, starts + kmer)
    # The position in the low bits makes the leftmost of equal k-mers the least.
    low = U((1 << max(20, n.bit_length())) - 1)
    least = _least_of((hashes & ~low) | starts.astype(np.uint64), window - kmer + 1)[begin]
    first = np.flatnonzero(np.concatenate(([True], (least[1:] != least[:-1]) | (text[1:] != text[:-1]))))
    count = np.diff(np.append(first, len(begin)))
    at = (least[first] & low).astype(np.int64)
    run = begin[first]
    path = mix(words.spans(run, run + count + window - 1) + (at - run).astype(np.uint64))
    return hashes[at], path, text[first], run, count


def _paths(docs: DataFrame, window: int, kmer: int) -> DataFrame:
    """``anchor, path`` of every run of windows."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                anchor, path, _, _, _ = anchored_paths(Words(text_bytes(part.column("text"))), window, kmer)
                columns = [pa.array(anchor.view(np.int64)), pa.array(path.view(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, names=["anchor", "path"])

    return docs.select("text").mapInArrow(released(find), "anchor bigint, path bigint")


def _windows_of(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """First words of all windows of some runs."""
    ends = np.cumsum(count)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(begin - (ends - count), count)


def _branching_windows(docs: DataFrame, branches: np.ndarray, window: int, kmer: int) -> DataFrame:
    """128 bits of each window whose anchor may branch."""
    shared = docs.sparkSession.sparkContext.broadcast(branches)  # of bounded size

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                texts = text_bytes(part.column("text"))
                words = Words(texts)
                anchor, _, _, begin, count = anchored_paths(words, window, kmer)
                open_ = has(shared.value, anchor)
                if open_.any():
                    at = _windows_of(begin[open_], count[open_])
                    sides = [w.spans(at, at + window).view(np.int64) for w in (words, Words(texts, seed=1))]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in sides], names=["one", "two"])

    return docs.select("text").mapInArrow(released(find), "one bigint, two bigint")


_JUDGED = (
    "n_words bigint, n_removed bigint, kept string, kept_sha256 string, packed binary, "
    "paths array<struct<anchor:bigint,begin:int,count:int>>, windows array<struct<one:bigint,two:bigint,begin:int>>"
)
_JUDGED_ARROW = pa.schema(
    [
        ("n_words", pa.int64()),
        ("n_removed", pa.int64()),
        ("kept", pa.string()),
        ("kept_sha256", pa.string()),
        ("packed", pa.binary()),
        ("paths", pa.list_(pa.struct([("anchor", pa.int64()), ("begin", pa.int32()), ("count", pa.int32())]))),
        ("windows", pa.list_(pa.struct([("one", pa.int64()), ("two", pa.int64()), ("begin", pa.int32())]))),
    ]
)


def _cut(text: str, runs: list[tuple[int, int]], window: int, keep_text: bool) -> dict:
    """``text`` without the words of ``runs`` of windows, given as (first, number)."""
    words = text.encode().split()
    n = len(words)
    if runs:
        keep = np.ones(n, bool)
        for begin, count in runs:
            keep[begin : begin + count + window - 1] = False
        words = list(compress(words, keep))
    kept = b" ".join(words)
    return {
        "n_words": n,
        "n_removed": n - len(words),
        "kept": kept.decode() if keep_text else None,
        "kept_sha256": hashlib.sha256(kept).hexdigest(),
    }


def _with_rest(rows: list[dict], part: pa.RecordBatch) -> pa.RecordBatch:
    """One row per row of ``part``, which keeps its column ``rest``."""
    batch = pa.RecordBatch.from_pylist(rows, _JUDGED_ARROW)
    return pa.RecordBatch.from_arrays([*batch.columns, part.column("rest")], names=[*batch.schema.names, "rest"])


def _judged_schema(docs: DataFrame) -> str:
    return f"{_JUDGED}, rest {docs.schema['rest'].dataType.simpleString()}"


def _per_text(values: list[tuple[str, np.ndarray]], text: np.ndarray, texts: int) -> list[list[dict]]:
    """The rows of some columns, dealt to their texts; ``text`` ascends."""
    names, columns = [name for name, _ in values], [v.tolist() for _, v in values]
    rows = [dict(zip(names, row)) for row in zip(*columns)]
    cuts = np.searchsorted(text, np.arange(texts + 1)).tolist()
    return [rows[a:b] for a, b in zip(cuts[:-1], cuts[1:])]


def _judge(docs: DataFrame, sets: tuple, window: int, kmer: int, keep_text: bool) -> DataFrame:
    """Finish the texts without a place that may be repeated; hand on the others with these places."""
    shared = docs.sparkSession.sparkContext.broadcast(sets)  # bit arrays of bounded size

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sure, branches, twice = shared.value
        for batch in batches:
            for part in slices(batch, "text"):
                texts = text_bytes(part.column("text"))
                words = Words(texts)
                anchor, _, text, begin, count = anchored_paths(words, window, kmer)
                whole, open_ = has(sure, anchor), has(branches, anchor)
                first = words.first[text]
                paths = _per_text(
                    [("anchor", anchor[whole].view(np.int64)), ("begin", (begin - first)[whole]), ("count", count[whole])], text[whole], len(part)
                )
                at = _windows_of(begin[open_], count[open_])
                of = np.repeat(text[open_], count[open_])
                one = words.spans(at, at + window)
                likely = has(twice, one)
                at, of, one = at[likely], of[likely], one[likely]
                two = Words(texts, seed=1).spans(at, at + window) if len(at) else one
                windows = _per_text(
                    [("one", one.view(np.int64)), ("two", two.view(np.int64)), ("begin", at - words.first[of])], of, len(part)
                )
                rows = [
                    {"packed": zlib.compress(own.encode(), 1), "paths": p, "windows": w} if p or w else _cut(own, [], window, keep_text)
                    for own, p, w in zip(part.column("text").to_pylist(), paths, windows)
                ]
                yield _with_rest(rows, part)

    return docs.select("text", "rest").mapInArrow(released(judge), _judged_schema(docs))


def _finish(open_docs: DataFrame, window: int, keep_text: bool) -> DataFrame:
    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, ROWS) for i in range(0, len(batch), ROWS)):
                rows = []
                for row in part.select(["packed", "runs"]).to_pylist():
                    runs = [(r["begin"], r["count"]) for r in row["runs"] or []]
                    rows.append(_cut(zlib.decompress(row["packed"]).decode(), runs, window, keep_text))
                yield _with_rest(rows, part)

    return open_docs.select("packed", "runs", "rest").mapInArrow(released(finish), _judged_schema(open_docs))


def remove_repeats(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    window: int = WINDOW,
    kmer: int = KMER,
    keep_text: bool = True,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """Per row: the id, ``n_words, n_removed, kept, kept_sha256`` and the columns ``carry``.

    ``kept`` is the text that stays, its words joined by one space; without ``keep_text``
    it is null. Intermediate tables go to the session's shared folder and are dropped, but
    for those that the result reads.
    """
    rest = F.struct(F.col(doc_id).cast("long").alias("id"), *[F.col(name).alias(f"carried_{i}") for i, name in enumerate(carry)])
    rows = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text"), rest.alias("rest"))
    needed, own = Scratch(docs.sparkSession), Scratch(docs.sparkSession)

    counts = _paths(rows, window, kmer).groupBy("anchor").agg(
        F.count(F.lit(1)).alias("uses"), F.min("path").alias("low"), F.max("path").alias("high")
    )
    repeated = counts.where(F.col("uses") > 1).select("anchor", (F.col("low") == F.col("high")).alias("sure"))
    repeated = own.stage(repeated, "repeated-anchors")
    sure, branches = (fitting(repeated.where(kind), "anchor") for kind in ("sure", "NOT sure"))
    single = _branching_windows(rows, branches, window, kmer)
    twice = own.stage(single.groupBy("one", "two").count().where(F.col("count") > 1).select("one", "two"), "repeated-windows")
    judged = _judge(rows, (sure, branches, fitting(twice, "one")), window, kmer, keep_text)
    judged = needed.stage(judged.withColumn("row", F.monotonically_increasing_id()), "judged")
    done, left = judged.where(F.col("n_words").isNotNull()), judged.where(F.col("n_words").isNull())

    paths = left.select("row", F.explode("paths").alias("p")).select("row", "p.anchor", "p.begin", "p.count")
    windows = left.select("row", F.explode("windows").alias("w")).select("row", "w.one", "w.two", "w.begin")
    marks = (
        paths.join(repeated.where("sure").select("anchor"), "anchor")
        .select("row", "begin", "count")
        .unionByName(windows.join(twice, ["one", "two"]).select("row", "begin", F.lit(1).alias("count")))
        .groupBy("row")
        .agg(F.collect_list(F.struct("begin", "count")).alias("runs"))
    )
    marks = needed.stage(marks, "marks")
    own.clear()
    finished = _finish(left.select("row", "packed", "rest").join(marks, "row", "left"), window, keep_text)
    carried = [F.col(f"rest.carried_{i}").alias(name) for i, name in enumerate(carry)]
    result = done.drop("row").unionByName(finished)
    return result.select(F.col("rest.id").alias(doc_id), "n_words", "n_removed", "kept", "kept_sha256", *carried)

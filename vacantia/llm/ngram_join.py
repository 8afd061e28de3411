"""Near-duplicate components by a grouped prefix join over word shingles.

A document is the set of its distinct ``shingle``-word shingles. Documents with equal
sets are one class. Two sets of Jaccard similarity ``percent / 100`` or more share a
shingle among the first ``n - ceil(n * percent / 100) + 1`` of each (its prefix), in any
order of all shingles; the order here puts shingles of frequent hash buckets last.

1. Classes with the same size and prefix are collapsed into one group. Groups meet by
   the shingles of their prefixes; shingles that one class alone has are dropped. Pairs of
   groups are filtered by size and by the places of the shingle.
2. Groups that have a partner, or several members, are expanded to their members and cut
   into blocks. Pairs of members are filtered by size, place and parity sketches, whose
   Hamming distance never exceeds the symmetric difference of the sets. Of what remains,
   each pair of blocks hands on a spanning forest, the most similar pairs first, since more
   links inside a component would not change it.
3. Members are verified on their exact sets of shingles. Where a handed-on pair is no
   link, the pairs of these blocks that still join two components are all verified.

No cap is set anywhere: the order, the sketches and the forests only save work.

Rules: A-Z are lower-cased; words are runs of bytes without ``\\x20`` and ``\\x09-\\x0D``. A
text of fewer words than a shingle has one shingle, all its words. Null texts and texts
without words have no shingle and no link. Rows of one id are one document: their links
are united. Rows without an id have no links and no component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantia.llm.bitset import BITS, bit_array, is_set
from vacantia.llm.components import connected_components
from vacantia.llm.hashing import U, Words, mix, slices, text_bytes
from vacantia.llm.session import Scratch, released

SHINGLE, PERCENT = 4, 85
#: Frequencies only order the shingles, so they are counted in a fixed number of hash
#: buckets, and only buckets that stand out in some task are known to the others.
BUCKETS, STANDS_OUT, KNOWN_BUCKETS = 1 << 22, 8, 200_000
BLOCK = 256


def _shingles(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text of every shingle; short texts have one."""
    begin, text = words.windows(size)
    counts = np.diff(words.first)
    short = np.flatnonzero((counts > 0) & (counts < size))
    first = words.first[short]
    begins = np.concatenate((begin, first))
    ends = np.concatenate((begin + size, first + counts[short]))
    return words.spans(begins, ends), np.concatenate((text, short))


def _frequent_buckets(docs: DataFrame, size: int) -> np.ndarray:
    """Class of frequency of each hash bucket; 0 for all that do not stand out."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, total = np.zeros(BUCKETS, np.uint32), 0
        for batch in batches:
            for part in slices(batch, "text"):
                hashes, _ = _shingles(Words(text_bytes(part.column("text")), lower=True), size)
                at, n = np.unique((hashes & U(BUCKETS - 1)).astype(np.int64), return_counts=True)
                table[at] += n.astype(np.uint32)
                total += len(hashes)
        found = np.flatnonzero(table >= STANDS_OUT + 4 * total // BUCKETS)
        yield pa.RecordBatch.from_arrays(
            [pa.array(found), pa.array(table[found].astype(np.int64))], names=["bucket", "uses"]
        )

    counts = docs.select("text").mapInArrow(released(count), "bucket bigint, uses bigint").groupBy("bucket").agg(F.sum("uses").alias("uses"))
    rows = counts.orderBy(F.col("uses").desc(), "bucket").limit(KNOWN_BUCKETS).toArrow()
    classes = np.zeros(BUCKETS, np.uint8)
    classes[rows.column("bucket").to_numpy()] = np.log2(rows.column("uses").to_numpy() + 1).astype(np.uint8)
    return classes


def sketch_bits(n: np.ndarray) -> np.ndarray:
    """Bits of a set's parity sketch: a power of two of about the set's size."""
    return 1 << np.clip(np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64), 10, 16)


def _sketches(hashes: np.ndarray, text: np.ndarray, n: np.ndarray) -> list[bytes]:
    """Parity of the number of shingles that fall on each bit, per text."""
    bits = np.where(n > 0, sketch_bits(n), 0)
    start = np.concatenate(([0], np.cumsum(bits)))
    at = start[text] + ((hashes >> U(24)).astype(np.int64) & (bits[text] - 1))
    parity = (np.bincount(at, minlength=start[-1]) & 1).astype(np.uint8)
    packed = np.packbits(parity, bitorder="little").tobytes()
    return [packed[a // 8 : b // 8] for a, b in zip(start[:-1], start[1:], strict=True)]


_PROFILE = "id bigint, n bigint, one bigint, two bigint, prefix array<bigint>, sketch binary"
_PROFILE_ARROW = pa.schema(
    [
        ("id", pa.int64()),
        ("n", pa.int64()),
        ("one", pa.int64()),
        ("two", pa.int64()),
        ("prefix", pa.list_(pa.int64())),
        ("sketch", pa.binary()),
    ]
)


def _ordered_sets(texts: pa.LargeBinaryArray, size: int, classes: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text, the rare ones first, with their text, and set sizes."""
    hashes, text = _shingles(Words(texts, lower=True), size)
    if classes is None:
        order = np.lexsort((hashes, text))
    else:
        order = np.lexsort((hashes, classes[(hashes & U(BUCKETS - 1)).astype(np.int64)], text))
    hashes, text = hashes[order], text[order]
    if len(hashes):
        new = np.concatenate(([True], (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])))
        hashes, text = hashes[new], text[new]
    return hashes, text, np.bincount(text, minlength=len(texts))


def _profiles(docs: DataFrame, size: int, percent: int, classes: np.ndarray) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(classes)  # BUCKETS bytes, whatever the data

    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                hashes, text, n = _ordered_sets(text_bytes(part.column("text")), size, shared.value)
                start = np.concatenate(([0], np.cumsum(n)))
                place = np.arange(len(hashes)) - start[text]
                prefix = n - (n * percent + 99) // 100 + (n > 0)
                taken = place < prefix[text]
                sums = []
                for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F):
                    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(hashes ^ U(salt)), dtype=np.uint64)))
                    sums.append((total[start[1:]] - total[start[:-1]]).view(np.int64))
                offsets = pa.array(np.concatenate(([0], np.cumsum(prefix))).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("id"),
                        pa.array(n),
                        pa.array(sums[0]),
                        pa.array(sums[1]),
                        pa.ListArray.from_arrays(offsets, pa.array(hashes[taken].view(np.int64))),
                        pa.array(_sketches(hashes, text, n), pa.binary()),
                    ],
                    schema=_PROFILE_ARROW,
                )

    # The number of a row is fixed by the write that follows.
    return docs.select("id", "text").mapInArrow(released(profile), _PROFILE).withColumn("row", F.monotonically_increasing_id())


def _bit(value: str | Column) -> Column:
    return F.pmod(F.xxhash64(value), F.lit(BITS))


def _could_link(a: Column, b: Column, percent: int) -> Column:
    """Size and position filter: the common shingle taken as the first one of both."""
    larger, smaller = F.greatest(a["n"], b["n"]), F.least(a["n"], b["n"])
    rest = F.least(a["n"] - a["pos"], b["n"] - b["pos"])
    return (smaller * 100 >= larger * percent) & (rest * (100 + percent) >= (a["n"] + b["n"]) * percent)


def _block_of(column: str) -> Column:
    return F.pmod(F.xxhash64(column, F.lit(7)), F.col("blocks")).cast("int").alias("block")


def _partnered(block_pairs: DataFrame, percent: int) -> DataFrame:
    """``shingle, key, pos, size`` of the groups of long lists that some other group may link with.

    A group of several members is its own partner, in the list of its first shingle.
    """
    schema = pa.schema([("shingle", pa.int64()), ("key", pa.int64()), ("pos", pa.int32()), ("size", pa.int64())])

    def table(groups: list[dict]) -> list[np.ndarray]:
        return [np.array([g[name] for g in groups], np.int64) for name in ("n", "pos", "key", "size")]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                row = batch.slice(i, 1).to_pylist()[0]
                left, right = row["left"], row["right"] or row["left"]
                (n, pos, key, size), (m, at, other, _) = table(left), table(right)
                near = 100 * np.minimum.outer(n, m) >= percent * np.maximum.outer(n, m)
                near &= (100 + percent) * np.minimum.outer(n - pos, m - at) >= percent * np.add.outer(n, m)
                near &= np.not_equal.outer(key, other)
                kept = [left[k] for k in np.flatnonzero(near.any(1) | ((size > 1) & (pos == 0)))]
                if row["right"]:
                    kept += [right[k] for k in np.flatnonzero(near.any(0))]
                if kept:
                    yield pa.RecordBatch.from_pylist([{**g, "shingle": row["shingle"]} for g in kept], schema)

    return block_pairs.mapInArrow(released(judge), "shingle bigint, key bigint, pos int, size bigint").distinct()


def _group_entries(groups: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """``shingle, key, pos, total``: the groups of each list that have a partner in it.

    ``groups`` has a row for each size and prefix, with the number of its members; ``total``
    counts the members of all groups of a list. Pairs of groups are judged by size and by
    the places of the shingle, before any group is expanded.
    """
    uses = (
        groups.select("size", F.explode("prefix").alias("shingle"))
        .groupBy("shingle")
        .agg(F.sum("size").alias("uses"), F.count(F.lit(1)).alias("kinds"))
        .where(F.col("uses") > 1)
    )
    uses = scratch.stage(uses, "uses")
    shared = groups.sparkSession.sparkContext.broadcast(bit_array(uses, _bit("shingle")))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prefix, bits = batch.column("prefix"), batch.column("bits")
            counts = np.diff(prefix.offsets.to_numpy())
            at = np.arange(int(counts.sum()))
            pos = at - np.repeat(np.cumsum(counts) - counts, counts)
            row = np.repeat(np.arange(len(batch)), counts)
            kept = is_set(shared.value, bits.flatten().to_numpy())
            own = pa.array(row[kept])
            yield pa.RecordBatch.from_arrays(
                [prefix.flatten().filter(pa.array(kept)), *(batch.column(c).take(own) for c in ("key", "n", "size")), pa.array(pos[kept].astype(np.int32))],
                names=["shingle", "key", "n", "size", "pos"],
            )

    bits = F.transform("prefix", _bit).alias("bits")
    rows = groups.select("key", "n", "size", "prefix", bits).mapInArrow(
        released(spread), "shingle bigint, key bigint, n bigint, size bigint, pos int"
    )
    lists = (
        rows.join(uses.select("shingle", F.ceil(F.col("kinds") / BLOCK).cast("int").alias("blocks")), "shingle")
        .groupBy("shingle", "blocks", _block_of("key"))
        .agg(F.collect_list(F.struct("key", "n", "pos", "size")).alias("members"))
    )
    lists = scratch.stage(lists, "group-lists")

    def partnered(m: Column) -> Column:
        other = F.exists("members", lambda o: (o["key"] != m["key"]) & _could_link(m, o, percent))
        return other | ((m["size"] > 1) & (m["pos"] == 0))

    small = (F.col("blocks") == 1) & (F.size("members") <= 16)
    chosen = F.array_sort(F.transform(F.filter("members", partnered), lambda m: F.struct(m["key"], m["size"])))
    # Near copies share many shingles; one list stands for all short ones of the same groups.
    short = (
        lists.where(small)
        .select("shingle", chosen.alias("members"))
        .where(F.size("members") > 0)
        .groupBy("members")
        .agg(F.min("shingle").alias("shingle"))
        .select("shingle", F.explode("members").alias("m"), F.aggregate("members", F.lit(0).cast("long"), lambda t, m: t + m["size"]).alias("total"))
        .select("shingle", "m.key", F.lit(0).alias("pos"), "total")
    )
    long = scratch.stage(_partnered(_block_pairs(lists.where(~small)), percent), "partnered-groups")
    totals = scratch.stage(long.groupBy("shingle").agg(F.sum("size").alias("total")), "list-sizes")
    long = long.join(totals, "shingle").select("shingle", "key", "pos", "total")
    return short.unionByName(long).where(F.col("total") > 1)


def _lists(leaders: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """``shingle, blocks, block, members``: who shares a prefix shingle, in blocks.

    ``leaders`` has a row per class. Groups of leaders of one size and prefix are paired
    first; those that have a partner are expanded to their members. The number of blocks
    follows the number of members, so that blocks stay near ``BLOCK`` members however long
    a list is.
    """
    # Grouped by the prefix itself; the hash only names the group when it is expanded.
    key = F.xxhash64("n", "prefix").alias("key")
    groups = leaders.groupBy("n", "prefix").agg(F.count(F.lit(1)).alias("size")).select("n", "prefix", "size", key)
    entries = scratch.stage(_group_entries(scratch.stage(groups, "groups"), percent, scratch), "entries")
    return (
        entries.join(leaders.select(key, "id", "n", "sketch"), "key")
        .withColumn("blocks", F.ceil(F.col("total") / BLOCK).cast("int"))
        .groupBy("shingle", "blocks", _block_of("id"))
        .agg(F.collect_list(F.struct("id", "n", "pos", "sketch")).alias("members"))
    )


def _block_pairs(lists: DataFrame) -> DataFrame:
    """``shingle, x, y, left, right``: every two blocks of a list, and each with itself."""
    alone = lists.select(
        "shingle", F.col("block").alias("x"), F.col("block").alias("y"), F.col("members").alias("left"), F.lit(None).alias("right")
    )
    several = lists.where(F.col("blocks") > 1)
    a = several.select("shingle", F.col("block").alias("x"), F.col("members").alias("left"))
    b = several.select("shingle", F.col("block").alias("y"), F.col("members").alias("right"))
    return alone.unionByName(a.join(b, "shingle").where(F.col("x") < F.col("y")).select("shingle", "x", "y", "left", "right"))


def _folded(sketch: np.ndarray, bits: int) -> np.ndarray:
    while len(sketch) * 64 > bits:
        half = len(sketch) // 2
        sketch = sketch[:half] ^ sketch[half:]
    return sketch


def possible_pairs(left: list[dict], right: list[dict] | None, percent: int) -> list[tuple[float, int, int]]:
    """``(distance, a, b)`` of the pairs that the filters allow, the closest first.

    ``pos`` is the place of the list's shingle in a member's order; a pair is judged in
    the list of its first common shingle, so no more than what follows can be common.

    The distance is the Hamming distance as a share of what is allowed.
    """
    members = left + (right or [])
    ids = np.array([m["id"] for m in members], np.int64)
    n = np.array([m["n"] for m in members], np.int64)
    rest = n - np.array([m["pos"] for m in members], np.int64)
    side = np.array([0] * len(left) + [1] * len(right or []))
    bits = sketch_bits(n)
    sketches = [np.frombuffer(m["sketch"], np.uint64) for m in members]
    found = []
    for size in np.unique(bits):
        # Sizes of linked sets are within a factor of two, and so are their sketches.
        near = np.flatnonzero((bits == size) | (bits == 2 * size))
        table = np.stack([_folded(sketches[i], int(size)) for i in near])
        for k, i in enumerate(near):
            if bits[i] != size:
                continue
            others = near if right is None else near[side[near] != side[i]]
            rows = np.arange(len(near)) if right is None else np.flatnonzero(side[near] != side[i])
            # Pairs of one sketch size are met from both ends; keep one.
            keep = (bits[others] > size) | (ids[others] > ids[i])
            keep &= 100 * np.minimum(n[others], n[i]) >= percent * np.maximum(n[others], n[i])
            keep &= (100 + percent) * np.minimum(rest[others], rest[i]) >= percent * (n[others] + n[i])
            others, rows = others[keep], rows[keep]
            if not len(others):
                continue
            distance = np.bitwise_count(table[rows] ^ table[k]).sum(1, dtype=np.int64)
            allowed = (100 - percent) * (n[others] + n[i]) // (100 + percent)
            fits = (distance <= allowed) & (ids[others] != ids[i])
            share = distance[fits] / np.maximum(allowed[fits], 1)
            found += [(float(s), int(min(ids[i], o)), int(max(ids[i], o))) for s, o in zip(share, ids[others[fits]])]
    found.sort()
    return found


def _forest(pairs: list[tuple[float, int, int]]) -> list[tuple[float, int, int]]:
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = parent[up]
            x = up
        return x

    chosen = []
    for pair in pairs:
        a, b = root(pair[1]), root(pair[2])
        if a != b:
            parent[a] = b
            chosen.append(pair)
    return chosen


_PAIR = "shingle bigint, x int, y int, a bigint, b bigint, complete boolean"
_PAIR_ARROW = pa.schema(
    [("shingle", pa.int64()), ("x", pa.int32()), ("y", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("complete", pa.bool_())]
)


def _forests(block_pairs: DataFrame, percent: int) -> DataFrame:
    """A spanning forest of the possible pairs of each two blocks.

    ``complete`` says that there was no possible pair beyond the forest.
    """

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                row = batch.slice(i, 1).to_pylist()[0]
                pairs = possible_pairs(row["left"], row["right"], percent)
                forest = _forest(pairs)
                if forest:
                    head = {k: row[k] for k in ("shingle", "x", "y")} | {"complete": len(forest) == len(pairs)}
                    yield pa.RecordBatch.from_pylist([head | {"a": a, "b": b} for _, a, b in forest], _PAIR_ARROW)

    return block_pairs.mapInArrow(released(choose), _PAIR)


def _all_pairs_between_components(block_pairs: DataFrame, percent: int) -> DataFrame:
    """All possible pairs whose members (with ``component``) are in two components."""

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                row = batch.slice(i, 1).to_pylist()[0]
                component = {c["id"]: c["component"] for c in row["components"] or []}
                pairs = possible_pairs(row["left"], row["right"], percent)
                left = [(a, b) for _, a, b in pairs if component.get(a, a) != component.get(b, b)]
                head = {k: row[k] for k in ("shingle", "x", "y")} | {"complete": True}
                if left:
                    yield pa.RecordBatch.from_pylist([head | {"a": a, "b": b} for a, b in left], _PAIR_ARROW)

    return block_pairs.mapInArrow(released(choose), _PAIR)


def _sets(docs: DataFrame, pairs: DataFrame, size: int, repeats: bool) -> DataFrame:
    """``id, shingles`` of at least the documents in ``pairs``; of ``repeats`` each once.

    A bit array of fixed size says which ids may be wanted, so that no text is shuffled.
    """
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    shared = docs.sparkSession.sparkContext.broadcast(bit_array(wanted, _bit("id")))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(is_set(shared.value, batch.column("bit").to_numpy())))
            for part in slices(batch, "text"):
                hashes, _, n = _ordered_sets(text_bytes(part.column("text")), size, None)
                cuts = np.concatenate(([0], np.cumsum(n)))
                data = [hashes[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(data, pa.binary())], names=["id", "shingles"])

    known = docs.where(F.col("id").isNotNull())
    found = known.select("id", "text", _bit("id").alias("bit")).mapInArrow(released(read), "id bigint, shingles binary")
    return found.distinct() if repeats else found


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``a, b, linked`` of distinct pairs, on their exact sets."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for one, two in zip(batch.column("left"), batch.column("right"), strict=True):
                x, y = np.frombuffer(one.as_buffer(), np.uint64), np.frombuffer(two.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                linked.append(bool(len(x)) and 100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(linked, pa.bool_())], names=["a", "b", "linked"])

    joined = (
        pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("left")), "a")
        .join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("right")), "b")
        .select("a", "b", "left", "right")
    )
    checked = joined.mapInArrow(released(verify), "a bigint, b bigint, linked boolean")
    # An id with several rows is linked if one of them is.
    return checked.groupBy("a", "b").agg(F.max("linked").alias("linked"))


def near_duplicates(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    shingle: int = SHINGLE,
    percent: int = PERCENT,
    scratch: Scratch | None = None,
) -> DataFrame:
    """Per row: the id, ``n_shingles`` and ``component_id``, the least id reachable by links.

    ``percent`` is at least 60, so that linked sets have sketches of neighbouring sizes.
    Intermediate tables are written to the session's shared folder and dropped, but for
    those that the result reads; they go to ``scratch``, if the caller has one.
    """
    if not 60 <= percent <= 100:
        raise ValueError("percent must be between 60 and 100")
    needed, own, early = scratch or Scratch(docs.sparkSession), Scratch(docs.sparkSession), Scratch(docs.sparkSession)
    stage = own.stage
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    profiles = early.stage(_profiles(rows, shingle, percent, _frequent_buckets(rows, shingle)), "profiles")
    counts = needed.stage(profiles.select("id", "n"), "set-sizes")
    digest = ["n", "one", "two"]
    some = profiles.where(F.col("id").isNotNull() & (F.col("n") > 0))
    first = F.min(F.struct("id", "row")).alias("first")
    classes = stage(some.groupBy(*digest).agg(first).select(*digest, F.col("first.id").alias("leader"), F.col("first.row").alias("own")), "classes")
    same = some.select("id", "row", *digest).join(classes, digest)
    same = stage(same.select("id", "leader", "row", (F.col("row") == F.col("own")).alias("leads")), "same-sets")
    leaders = stage(some.join(same.where("leads").select("row"), "row", "left_semi").select("id", "n", "prefix", "sketch"), "leaders")
    early.clear()
    lists = stage(_lists(leaders, percent, early), "shared-shingles")
    early.clear()
    # Rows of one id and set beside the leader: their sets must not be taken once for each row.
    repeats = not same.where((F.col("id") == F.col("leader")) & ~F.col("leads")).isEmpty()

    forests = stage(_forests(_block_pairs(lists), percent), "forests")
    tested = forests.select("a", "b").distinct()
    verified = stage(_verified(tested, stage(_sets(rows, tested, shingle, repeats), "sets"), percent), "verified")
    links = verified.where("linked").select("a", "b")

    failed = forests.where(~F.col("complete")).join(verified.where(~F.col("linked")), ["a", "b"], "left_semi")
    again = stage(failed.select("shingle", "x", "y").distinct(), "open-blocks")
    if not again.isEmpty():
        found = stage(connected_components(links), "components")
        open_pairs = stage(_block_pairs(lists).join(again, ["shingle", "x", "y"], "left_semi"), "open-block-pairs")
        named = (
            open_pairs.select(
                "shingle", "x", "y",
                F.explode(F.concat("left.id", F.coalesce("right.id", F.array().cast("array<bigint>")))).alias("node"),
            )
            .join(found, "node")
            .groupBy("shingle", "x", "y")
            .agg(F.collect_set(F.struct(F.col("node").alias("id"), "component")).alias("components"))
        )
        rest = _all_pairs_between_components(open_pairs.join(named, ["shingle", "x", "y"], "left"), percent)
        rest = stage(rest.select("a", "b").distinct().join(tested, ["a", "b"], "left_anti"), "rest-pairs")
        second = _verified(rest, stage(_sets(rows, rest, shingle, repeats), "sets"), percent)
        links = links.unionByName(second.where("linked").select("a", "b"))

    # Sets of one id, and ids of one set, belong together.
    same = same.select("id", "leader").distinct()
    firsts = needed.stage(same.groupBy("id").agg(F.min("leader").alias("first")), "first-leaders")
    bridges = same.join(firsts, "id").where(F.col("leader") != F.col("first")).select(
        F.col("leader").alias("a"), F.col("first").alias("b")
    )
    parts = needed.stage(connected_components(links.unionByName(bridges)), "components")
    own.clear()
    labelled = firsts.join(parts.withColumnRenamed("node", "first"), "first", "left").select(
        "id", F.coalesce("component", "first").alias("component_id")
    )
    return counts.join(labelled, "id", "left").select(
        F.col("id").alias(doc_id), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id")
    )

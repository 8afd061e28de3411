"""Ranked lexical search of many items at once over a query-sharing graph.

A document's score for an item sums a contribution of every term that both have. Items
share terms, and sets of terms, so the sums have common parts.

1. Items are taken in batches of bounded size. Terms that the same items hold with the
   same repeats make one shared set; after that, the pair of sets or terms that most items
   still hold both of becomes a new set, round after round. The result is a directed graph
   from terms over shared sets to items.
2. One pass over the documents notes each one's terms of the batch and their uses in a
   table. Numbers of documents per term and the corpus statistics come from that table.
3. The table is read in blocks of documents. In each block every node's accumulator, the
   partial sums of all documents of the block, is made once from its terms and from the
   accumulators below it, and is dropped when all nodes above it have used it. A task keeps
   the best documents of each item; those meet in one window per item.

Rules:

* Terms are runs of ASCII letters and digits and of all characters from U+0080 on, with
  A-Z lower-cased. A null text has none.
* Rows that repeat an item's id and text are one item; rows of an id with other texts are
  items of their own. An item without terms finds nothing.
* Every row of the documents is ranked. Of equal scores the smaller id comes first, rows
  without an id last.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vacantia.llm.hashing import Words, slices, text_bytes
from vacantia.llm.session import Scratch

#: Expected bytes of item texts that one pass over the documents serves.
BATCH_BYTES = 4_000_000
#: Documents whose accumulators are held at once.
BLOCK = 4096
#: Symbols of one item that pairs are mined from; more only share less.
MINED_SYMBOLS = 300
MINING_ROUNDS = 40
_INT = 1 << 62

_OUTSIDE = np.zeros(256, bool)
for _first, _last in ((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)):
    _OUTSIDE[_first : _last + 1] = True


def terms_of(texts: pa.LargeBinaryArray) -> Words:
    return Words(texts, lower=True, outside=_OUTSIDE)


def term_list(text: str | None) -> list[bytes]:
    words = terms_of(text_bytes(pa.array([text], pa.string())))
    data = words.data.tobytes()
    return [data[a:b] for a, b in zip(words.begin.tolist(), words.end.tolist(), strict=True)]


class Vocabulary:
    """Terms of a batch of items, found in documents by hash and compared byte by byte."""

    def __init__(self, terms: list[bytes]):
        words = terms_of(text_bytes(pa.array([t.decode() for t in terms], pa.string())))
        order = np.argsort(words.hash, kind="stable")
        self.hashes, self.number = words.hash[order], order
        self.data, self.begin, self.size = words.data, words.begin, words.end - words.begin

    def find(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Word positions that hold a term, and the term's number."""
        if not len(words) or not len(self.hashes):
            return (np.zeros(0, np.int64),) * 2
        at = np.minimum(np.searchsorted(self.hashes, words.hash), len(self.hashes) - 1)
        hit = np.flatnonzero(self.hashes[at] == words.hash)
        term = self.number[at[hit]]
        same = (words.end - words.begin)[hit] == self.size[term]
        hit, term = hit[same], term[same]
        size = self.size[term]
        row = np.repeat(np.arange(len(hit)), size)
        step = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
        differs = words.data[words.begin[hit][row] + step] != self.data[self.begin[term][row] + step]
        same = np.bincount(row, weights=differs, minlength=len(hit)) == 0
        return hit[same], term[same]


@dataclass
class Node:
    """A sum: ``terms`` as (number, times), and the sums of the nodes in ``parts``."""

    terms: list[tuple[int, int]] = field(default_factory=list)
    parts: list[int] = field(default_factory=list)


def sharing_graph(items: list[Counter]) -> tuple[list[Node], list[int]]:
    """Nodes, each after those it uses, and the node of each item.

    ``items`` count the term numbers of each item.
    """
    nodes: list[Node] = []
    # A symbol is (term, times) or the number of a node; an item is the sum of its symbols.
    held: list[set] = [set(item.items()) for item in items]
    users: dict = defaultdict(set)
    for i, symbols in enumerate(held):
        for symbol in symbols:
            users[symbol].add(i)

    def share(symbols: tuple, who: set[int]) -> None:
        nodes.append(Node([s for s in symbols if isinstance(s, tuple)], [s for s in symbols if isinstance(s, int)]))
        for i in who:
            held[i].difference_update(symbols)
            held[i].add(len(nodes) - 1)
        for symbol in symbols:
            users[symbol] -= who
        users[len(nodes) - 1] = set(who)

    alike: dict = defaultdict(list)
    for symbol, who in users.items():
        if len(who) > 1:
            alike[frozenset(who)].append(symbol)
    for who, symbols in sorted(alike.items(), key=lambda x: (-len(x[0]), sorted(x[1]))):
        if len(symbols) > 1:
            share(tuple(sorted(symbols)), set(who))
    for _ in range(MINING_ROUNDS):
        pairs: Counter = Counter()
        for symbols in held:
            common = sorted((s for s in symbols if len(users[s]) > 2), key=lambda s: (-len(users[s]), str(s)))
            pairs.update(combinations(common[:MINED_SYMBOLS], 2))
        found = False
        for pair, count in sorted(pairs.items(), key=lambda x: (-x[1], str(x[0]))):
            if count < 3:
                break
            # Earlier pairs of the round may have taken a symbol away.
            who = {i for i in users[pair[0]] & users[pair[1]] if pair[0] in held[i] and pair[1] in held[i]}
            if len(who) > 2:
                share(pair, who)
                found = True
        if not found:
            break
    tops = []
    for symbols in held:
        if len(symbols) == 1 and isinstance(only := next(iter(symbols)), int):
            tops.append(only)
            continue
        nodes.append(Node(sorted(s for s in symbols if isinstance(s, tuple)), sorted(s for s in symbols if isinstance(s, int))))
        tops.append(len(nodes) - 1)
    return nodes, tops


def _uses(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """``doc_id, n, terms, tf`` of every document: its length and its terms of the batch."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    schema = pa.schema(
        [("doc_id", pa.int64()), ("n", pa.int64()), ("terms", pa.list_(pa.int32())), ("tf", pa.list_(pa.int32()))]
    )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                words = terms_of(text_bytes(part.column("text")))
                hit, term = shared.value.find(words)
                text = np.searchsorted(words.first, hit, side="right") - 1
                width = max(1, len(shared.value.hashes))
                keys, tf = np.unique(text * width + term, return_counts=True)
                cuts = pa.array(np.searchsorted(keys, np.arange(len(part) + 1) * width).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array(np.diff(words.first)),
                        pa.ListArray.from_arrays(cuts, pa.array((keys % width).astype(np.int32))),
                        pa.ListArray.from_arrays(cuts, pa.array(tf.astype(np.int32))),
                    ],
                    schema=schema,
                )

    return docs.mapInArrow(read, "doc_id bigint, n bigint, terms array<int>, tf array<int>")


def length_factor(n: np.ndarray, documents: int, length: int) -> np.ndarray:
    """``m`` of documents of ``n`` terms."""
    if 25 * int(n.max(initial=0)) * documents < _INT:
        return 75 + 25 * n * documents // length
    return np.array([75 + 25 * x * documents // length for x in n.tolist()], np.int64)


class _Best:
    """The best documents of one item that a task has met."""

    def __init__(self, k: int):
        self.k, self.floor = k, 1
        self.score, self.doc, self.no_id = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def add(self, score: np.ndarray, doc: np.ndarray, no_id: np.ndarray) -> None:
        least = self.floor
        if len(score) > self.k:
            least = max(least, int(np.partition(score, -self.k)[-self.k]))
        found = np.flatnonzero(score >= least)
        if not len(found):
            return
        score = np.concatenate((self.score, score[found]))
        doc, no_id = np.concatenate((self.doc, doc[found])), np.concatenate((self.no_id, no_id[found]))
        order = np.lexsort((doc, no_id, -score))[: self.k]
        self.score, self.doc, self.no_id = score[order], doc[order], no_id[order]
        if len(order) == self.k:
            self.floor = int(self.score[-1])


def _search_block(block: pa.RecordBatch, nodes: list[Node], tops: dict[int, list[_Best]], weight: np.ndarray, corpus: tuple) -> None:
    """Accumulate every node for the documents of a block and keep the items' best."""
    documents, length = corpus
    n = block.column("n").to_numpy()
    ids = block.column("doc_id")
    no_id = np.asarray(ids.is_null().to_numpy(zero_copy_only=False))
    doc = ids.fill_null(0).to_numpy()
    counts = np.diff(block.column("terms").offsets.to_numpy())
    row = np.repeat(np.arange(len(block)), counts)
    term = block.column("terms").flatten().to_numpy().astype(np.int64)
    tf = block.column("tf").flatten().to_numpy().astype(np.int64)
    m = length_factor(n, documents, length)
    gain = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m[row]))
    order = np.argsort(term, kind="stable")
    row, gain = row[order], gain[order]
    cut = np.searchsorted(term[order], np.arange(len(weight) + 1)).tolist()
    waiting = Counter(part for node in nodes for part in node.parts)
    sums: dict[int, np.ndarray] = {}
    for i, node in enumerate(nodes):
        total = np.zeros(len(block), np.int64)
        for number, times in node.terms:
            own = slice(cut[number], cut[number + 1])
            total[row[own]] += times * gain[own]  # a document has a term once
        for part in node.parts:
            total += sums[part]
            waiting[part] -= 1
            if not waiting[part]:
                del sums[part]
        for best in tops.get(i, ()):
            best.add(total, doc, no_id)
        if waiting[i]:
            sums[i] = total


_HIT = "item int, doc_id bigint, score bigint"


def _search(uses: DataFrame, nodes: list[Node], tops: list[int], weight: np.ndarray, corpus: tuple, k: int) -> DataFrame:
    shared = uses.sparkSession.sparkContext.broadcast((nodes, tops, weight))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes, tops, weight = shared.value
        best = [_Best(k) for _ in tops]
        by_node: dict[int, list[_Best]] = defaultdict(list)
        for own, top in zip(best, tops, strict=True):
            by_node[top].append(own)
        for batch in batches:
            for at in range(0, len(batch), BLOCK):
                _search_block(batch.slice(at, BLOCK), nodes, by_node, weight, corpus)
        for item, own in enumerate(best):
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(own.doc), item, np.int32)), pa.array(own.doc, mask=own.no_id), pa.array(own.score)],
                names=["item", "doc_id", "score"],
            )

    return uses.mapInArrow(search, _HIT)


def term_weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def rank_documents(
    docs: DataFrame,
    items: DataFrame,
    k: int = 20,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    batch_bytes: int = BATCH_BYTES,
) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` best documents of each item.

    The driver holds one batch of items at a time. Every batch reads the documents once;
    its tables go to the session's shared folder, and only what the result reads stays.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    asked = items.select(F.col(item_id).cast("long").alias("item_id"), F.coalesce(item_text, F.lit("")).alias("text")).distinct()
    needed, own = Scratch(spark), Scratch(spark)
    asked = needed.stage(asked, "items")
    size = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_batches = max(1, -(-size // batch_bytes))
    batch = F.pmod(F.xxhash64("item_id", "text"), F.lit(n_batches))
    found: DataFrame | None = None
    for number in range(n_batches):
        part = asked.where(batch == number).orderBy("item_id", "text").collect()  # about batch_bytes
        counts = [Counter(term_list(row.text)) for row in part]
        terms = sorted(set().union(*counts))
        place = {term: i for i, term in enumerate(terms)}
        nodes, tops = sharing_graph([Counter({place[t]: c for t, c in item.items()}) for item in counts])
        uses = own.stage(_uses(rows, Vocabulary(terms)), "uses")
        documents, length = uses.agg(F.count(F.when(F.col("n") > 0, 1)), F.sum("n")).first()
        holding = dict(uses.select(F.explode("terms").alias("term")).groupBy("term").count().collect())  # a row per term of the batch
        weight = np.array([term_weight(documents, holding.get(i, 0)) for i in range(len(terms))], np.int64)
        hits = _search(uses, nodes, tops, weight, (documents, max(1, length or 0)), k)
        names = spark.createDataFrame([(i, row.item_id) for i, row in enumerate(part)], "item int, item_id long")
        order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.asc_nulls_last("doc_id"))
        ranked = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        ranked = needed.stage(ranked.join(names, "item").select("item_id", "rank", "doc_id", "score"), "ranked")
        own.clear()
        found = ranked if found is None else found.unionByName(ranked)
    return found

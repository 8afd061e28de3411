"""Alignment of two tokenizers' tokens over the same text, by lockstep merging.

Byte-level BPE (A) and SentencePiece (B) both cut ``space + text`` into tokens that cover
its bytes. Two tokens are linked where their byte ranges overlap; offsets at which tokens
of both end cut the tokens into groups.

1. A batch of documents is encoded by both. Neither lets a token cross from a character
   that is no white space to a space behind it, so the stretches between such places are
   encoded once per worker, for a bounded number of them.
2. A document's stretches are dealt in lanes of some dozens, so that a long document is
   many lanes. One state vector holds a pointer into A's and one into B's tokens for every
   lane of the batch. In each step all lanes emit the link at their pointers, those whose
   two tokens end alike emit a cut, and the pointer at the lesser end moves on (both, at a
   cut). Lanes that have arrived are taken out of the vector.
3. The aligned documents are written with the id pairs that each one links. From that
   table links are counted by pair in each task and summed by Spark. What a document needs
   of these counts comes from two tables of bounded size, the greatest count of each B id
   and the counts of the most frequent pairs; counts of all other pairs are joined.

Rules: a text is encoded without special tokens, whose strings in it are plain text. A
text that is null or empty, or whose tokens do not spell ``space + text`` in both, has no
tokens: all its numbers are 0 and its groups are ''. Repeated rows count each.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
from array import array
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacantia.llm.hashing import slices
from vacantia.llm.session import Scratch

A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Stretches in a lane: the steps of a batch follow from it, however long a document is.
LANE = 64
#: Stretches and their ids that a worker remembers.
_REMEMBERED, _IDS = 600_000, 8_000_000
#: Pairs whose counts all tasks know; 16 bytes each.
KNOWN_PAIRS = 1_500_000
#: Distinct pairs that a task counts before it hands them on.
_COUNTED = 2_000_000
_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_STRETCH = re.compile(f" *[^ ]+(?:(?<=[{_SPACE}]) +[^ ]*)*| +")
# Up to here, and for short stretches, both libraries of byte-level BPE class letters alike.
_PLAIN_LIMIT, _LONGEST = "ɐ", 200
META = "▁"


def _byte_alphabet() -> dict[str, int]:
    """The characters that byte-level vocabularies write for bytes."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class TokenPair(dict):
    """Both tokenizers. As a mapping: the number of each stretch that is remembered.

    Stretch ``n`` has A ids ``a_ids[a_at[n] : a_at[n + 1]]`` and B ids likewise.
    """

    def __init__(self, a_file: str, b_file: str):
        super().__init__()
        import public_tokenizers
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        a = Tokenizer.from_file(public_tokenizers.path(a_file))
        a.encode_special_tokens = True
        self.a_slow = lambda text: a.encode(text, add_special_tokens=False).ids
        self.a_fast = self._ranked(public_tokenizers, a_file) or self.a_slow
        b = SentencePieceProcessor(model_file=public_tokenizers.path(b_file))
        self.b_encode = lambda text: b.encode(text, num_threads=1)
        letters = _byte_alphabet()
        self.a_bytes = [b""] * a.get_vocab_size()
        for token, i in a.get_vocab().items():
            known = all(c in letters for c in token)
            self.a_bytes[i] = bytes(letters[c] for c in token) if known else token.encode()
        self.b_bytes = [
            bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace(META, " ").encode()
            for i, piece in ((i, b.id_to_piece(i)) for i in range(b.get_piece_size()))
        ]
        if any(META in b.id_to_piece(i).lstrip(META) for i in range(b.get_piece_size())):
            raise ValueError(f"{b_file} has pieces that go on behind a word")
        self.a_size = np.array([len(x) for x in self.a_bytes])
        self.b_size = np.array([len(x) for x in self.b_bytes])
        self.digits = [_decimal(len(self.a_bytes)), _decimal(len(self.b_bytes))]
        self._forget()

    @staticmethod
    def _ranked(files, a_file: str):
        """The faster library, where the vocabulary is there in its format too."""
        import tiktoken

        path = files.path(a_file.removesuffix(".json") + ".tiktoken")
        if not os.path.exists(path):
            return None
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        return tiktoken.Encoding("own", pat_str=files.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    @staticmethod
    @cache
    def shared(a_file: str, b_file: str) -> TokenPair:
        return TokenPair(a_file, b_file)

    def _forget(self) -> None:
        self.clear()
        self.a_ids, self.b_ids = array("i"), array("i")
        self.a_at, self.b_at, self.odd = array("q", [0]), array("q", [0]), array("b")

    def __missing__(self, stretch: str) -> int:
        plain = len(stretch) <= _LONGEST and max(stretch) < _PLAIN_LIMIT
        a = (self.a_fast if plain else self.a_slow)(stretch)
        b = self.b_encode("a" + stretch)[1:]  # no piece crosses from "a" to the space
        spelled = stretch.encode()
        odd = b"".join(map(self.a_bytes.__getitem__, a)) != spelled or b"".join(map(self.b_bytes.__getitem__, b)) != spelled
        number = self[stretch] = len(self.odd)
        self.a_ids.extend(a)
        self.b_ids.extend(b)
        self.a_at.append(len(self.a_ids))
        self.b_at.append(len(self.b_ids))
        self.odd.append(odd)
        return number

    def _learn(self, stretches: list[str]) -> None:
        """Encode plain stretches together: A one behind the other, where they stay apart as in a text."""
        plain = [s for s in stretches if len(s) <= _LONGEST and (s.isascii() or max(s) < _PLAIN_LIMIT) and not s[-1].isspace()]
        spelled = "".join(plain).encode()
        size = np.fromiter((len(s) if s.isascii() else len(s.encode()) for s in plain), np.int64, len(plain))
        ends, found = np.cumsum(size), []
        b_ids = self.b_encode(["a" + s for s in plain])
        for ids, of, sizes in (
            (self.a_fast(spelled.decode()), self.a_bytes, self.a_size),
            (list(chain.from_iterable(ids[1:] for ids in b_ids)), self.b_bytes, self.b_size),
        ):
            own_ends = np.cumsum(sizes[np.array(ids, np.int64)])
            if b"".join(map(of.__getitem__, ids)) != spelled:
                return
            cuts = np.searchsorted(own_ends, ends)
            if not np.array_equal(own_ends[cuts], ends):
                return
            found.append((ids, cuts + 1))
        first = len(self.odd)
        for (ids, cuts), held, at in zip(found, (self.a_ids, self.b_ids), (self.a_at, self.b_at), strict=True):
            at.frombytes((cuts + len(held)).astype(np.int64).tobytes())
            held.frombytes(np.array(ids, np.int32).tobytes())
        self.odd.frombytes(bytes(len(plain)))
        self.update(zip(plain, range(first, first + len(plain))))

    def encode(self, texts: list[str | None]) -> Encoded:
        if len(self) > _REMEMBERED or len(self.a_ids) + len(self.b_ids) > _IDS:
            self._forget()
        found = [_STRETCH.findall(" " + text) if text else [] for text in texts]
        flat = list(chain.from_iterable(found))
        self._learn([s for s in dict.fromkeys(flat) if s not in self])
        numbers = np.fromiter(map(self.__getitem__, flat), np.int64, len(flat))
        counts = np.fromiter(map(len, found), np.int64, len(found))
        odd = np.frombuffer(self.odd, np.int8)
        if len(odd) and odd[numbers].any():
            ends = np.cumsum(counts)
            for i in np.unique(np.searchsorted(ends, np.flatnonzero(odd[numbers]), side="right")):
                if not self._spells(numbers[ends[i] - counts[i] : ends[i]].tolist(), texts[i]):
                    numbers[ends[i] - counts[i] : ends[i]] = -1
                    counts[i] = 0
            numbers = numbers[numbers >= 0]
        return Encoded(self, numbers, counts)

    def _spells(self, stretches: list[int], text: str) -> bool:
        """Whether ``stretches`` joined are the text in both, which ends of odd ones must bear out too."""
        wanted = (" " + text).encode()
        for ids, at, of in ((self.a_ids, self.a_at, self.a_bytes), (self.b_ids, self.b_at, self.b_bytes)):
            if b"".join(of[i] for n in stretches for i in ids[at[n] : at[n + 1]]) != wanted:
                return False
        return True


def _decimal(n: int) -> np.ndarray:
    """Digits of the numbers below ``n`` in rows of bytes, to the right, with a column for what follows."""
    width = len(str(max(1, n - 1)))
    text = b"".join(str(i).rjust(width, "\0").encode() + b"\0" for i in range(n))
    return np.frombuffer(text, np.uint8).reshape(n, width + 1)


def _gather(values: np.ndarray, begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """``values[b : b + c]`` of each pair, one after the other."""
    ends = np.cumsum(count)
    return values[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(begin - (ends - count), count)]


class Encoded:
    """Tokens of a batch: ids and byte ends of both sides, and the lanes they are walked in."""

    def __init__(self, pair: TokenPair, stretches: np.ndarray, counts: np.ndarray):
        sides = []
        for ids, at, size in ((pair.a_ids, pair.a_at, pair.a_size), (pair.b_ids, pair.b_at, pair.b_size)):
            at = np.frombuffer(at, np.int64)
            n = at[stretches + 1] - at[stretches]
            flat = _gather(np.frombuffer(ids, np.int32).astype(np.int64), at[stretches], n)
            first = np.concatenate(([0], np.cumsum(n)))
            sides.append((flat, np.cumsum(size[flat]), first))
        (self.a, self.a_end, a_first), (self.b, self.b_end, b_first) = sides
        ends = np.concatenate(([0], np.cumsum(counts)))
        #: Of each document: its first token on either side, and one behind the last.
        self.a_doc, self.b_doc = a_first[ends], b_first[ends]
        place = np.arange(len(stretches)) - np.repeat(ends[:-1], counts)
        starts = np.flatnonzero(place % LANE == 0)
        odd = np.frombuffer(pair.odd, np.int8)[stretches] if len(stretches) else np.zeros(0, np.int8)
        if odd.any():  # these documents' stretches need not end alike
            doc = np.repeat(np.arange(len(counts)), counts)
            whole = np.bincount(doc, weights=odd, minlength=len(counts)) > 0
            starts = starts[~whole[doc[starts]] | (place[starts] == 0)]
        stops = np.append(starts[1:], len(stretches)) if len(starts) else starts
        self.lanes = a_first[starts], a_first[stops], b_first[starts], b_first[stops]

    def align(self) -> None:
        """``link_a, link_b``: token positions of every link; ``a_cut, b_cut``: where groups end."""
        i, a_stop, j, _ = (x.copy() for x in self.lanes)
        self.a_cut, self.b_cut = np.zeros(len(self.a), bool), np.zeros(len(self.b), bool)
        links_a, links_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        while len(i):
            links_a.append(i)
            links_b.append(j)
            a_end, b_end = self.a_end[i], self.b_end[j]
            cut = a_end == b_end
            self.a_cut[i[cut]] = True
            self.b_cut[j[cut]] = True
            i, j = i + (a_end <= b_end), j + (b_end <= a_end)
            going = i < a_stop
            if not going.all():
                i, j, a_stop = i[going], j[going], a_stop[going]
        self.link_a, self.link_b = np.concatenate(links_a), np.concatenate(links_b)

    def pairs(self, b_vocabulary: int) -> np.ndarray:
        """One number for the two ids of each link."""
        return self.a[self.link_a] * b_vocabulary + self.b[self.link_b]

    def doc_of_link(self) -> np.ndarray:
        n = np.diff(self.a_doc)
        return np.repeat(np.arange(len(n)), n)[self.link_a]

    def groups(self, digits: list[np.ndarray]) -> list[bytes]:
        """``a1,a2|b1;a3|b2,b3`` of each document."""
        a_group = np.cumsum(self.a_cut) - self.a_cut
        b_group = np.cumsum(self.b_cut) - self.b_cut
        a_until = np.flatnonzero(self.a_cut) + 1
        b_from = np.concatenate(([0], np.flatnonzero(self.b_cut) + 1))
        a_at = np.arange(len(self.a)) + b_from[a_group]
        b_at = np.arange(len(self.b)) + a_until[b_group]
        width = max(d.shape[1] for d in digits)
        out = np.zeros((len(self.a) + len(self.b), width), np.uint8)
        out[a_at, width - digits[0].shape[1] :] = digits[0][self.a]
        out[b_at, width - digits[1].shape[1] :] = digits[1][self.b]
        out[a_at, -1] = np.where(self.a_cut, ord("|"), ord(","))
        out[b_at, -1] = np.where(self.b_cut, ord(";"), ord(","))
        size = np.concatenate(([0], np.cumsum((out != 0).sum(1))))
        data = out[out != 0].tobytes()
        ends = size[self.a_doc + self.b_doc].tolist()
        return [data[x : max(x, y - 1)] for x, y in zip(ends[:-1], ends[1:], strict=True)]


def _reduced(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    key, n = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    first = np.flatnonzero(np.concatenate((np.ones(min(1, len(key)), bool), key[1:] != key[:-1])))
    return key[first], np.add.reduceat(n, first) if len(first) else n


def _planes(values: np.ndarray) -> bytes:
    """Whole numbers byte by byte, all low bytes first, so that they can be compressed."""
    table = values.astype("<u8").view(np.uint8).reshape(-1, 8)
    width = 8
    while width > 1 and not table[:, width - 1].any():
        width -= 1
    return bytes([width]) + table[:, :width].T.tobytes()


def _from_planes(data: bytes) -> np.ndarray:
    width = data[0]
    table = np.zeros(((len(data) - 1) // width, 8), np.uint8)
    table[:, :width] = np.frombuffer(data, np.uint8, offset=1).reshape(width, -1).T
    return table.reshape(-1).view("<i8")


_NUMBERS = ["n_a", "n_b", "n_groups", "n_links"]
_COUNTED_NUMBERS = ["n_best", "count_sum"]
_ALIGNED_ARROW = pa.schema(
    [("doc_id", pa.int64())]
    + [(name, pa.int64()) for name in _NUMBERS]
    + [("groups_sha256", pa.string()), ("groups", pa.string()), ("pairs", pa.binary()), ("times", pa.binary())]
)
_ALIGNED = "doc_id bigint, " + "".join(f"{name} bigint, " for name in _NUMBERS) + (
    "groups_sha256 string, groups string, pairs binary, times binary"
)


def _aligned(docs: DataFrame, files: tuple[str, str], keep_groups: bool) -> DataFrame:
    """One row per document: all that needs no counts, and its id pairs with how often they are linked."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = TokenPair.shared(*files)
        wide = len(both.a_bytes) * len(both.b_bytes)
        for batch in batches:
            for part in slices(batch, "text"):
                found = both.encode(part.column("text").to_pylist())
                found.align()
                doc, rows = found.doc_of_link(), len(part)
                # Texts are about a million bytes in all, so the product stays far below 2**63.
                own, times = np.unique(doc * wide + found.pairs(len(both.b_bytes)), return_counts=True)
                cuts = np.searchsorted(own, np.arange(rows + 1) * wide).tolist()
                pairs = own % wide
                step = np.diff(pairs, prepend=0)
                first = np.array(cuts[:-1])[np.diff(cuts) > 0]
                step[first] = pairs[first]
                groups = found.groups(both.digits)
                numbers = [
                    np.diff(found.a_doc),
                    np.diff(found.b_doc),
                    np.diff(np.concatenate(([0], np.cumsum(found.a_cut)))[found.a_doc]),
                    np.bincount(doc, minlength=rows),
                ]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        *[pa.array(x.astype(np.int64)) for x in numbers],
                        pa.array([hashlib.sha256(g).hexdigest() if g else "" for g in groups], pa.string()),
                        pa.array([g.decode() for g in groups] if keep_groups else [None] * rows, pa.string()),
                        pa.array([_planes(step[x:y]) for x, y in zip(cuts[:-1], cuts[1:])], pa.binary()),
                        pa.array([_planes(times[x:y]) for x, y in zip(cuts[:-1], cuts[1:])], pa.binary()),
                    ],
                    schema=_ALIGNED_ARROW,
                )

    return docs.mapInArrow(read, _ALIGNED)


def _links(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, pair and times of all pairs of a batch of aligned rows."""
    pairs = [np.cumsum(_from_planes(x)) for x in batch.column("pairs").to_pylist()]
    times = [_from_planes(x) for x in batch.column("times").to_pylist()]
    doc = np.repeat(np.arange(len(batch)), [len(x) for x in pairs])
    return doc, np.concatenate(pairs), np.concatenate(times)


def _pair_counts(aligned: DataFrame) -> DataFrame:
    """``pair, n``: links of each id pair, summed in each task."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, held, last = [], [], 0, 0

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(keys[0]), pa.array(counts[0])], names=["pair", "n"])

        for batch in batches:
            if not len(batch):
                continue
            _, pair, times = _links(batch)
            key, n = _reduced([pair], [times])
            keys.append(key)
            counts.append(n)
            held += len(key)
            if held > 2 * last + _COUNTED // 2:
                key, n = _reduced(keys, counts)
                keys, counts, held, last = [key], [n], len(key), len(key)
                if last > _COUNTED:
                    yield rows()
                    keys, counts, held, last = [], [], 0, 0
        if keys:
            key, n = _reduced(keys, counts)
            keys, counts = [key], [n]
            yield rows()

    counted = aligned.select("pairs", "times").mapInArrow(count, "pair bigint, n bigint")
    return counted.groupBy("pair").agg(F.sum("n").alias("n"))


def _frequent(pairs: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray, bool]:
    """Pairs and counts of those that occur most, and whether these are all pairs."""
    level = F.floor(F.log2("n")).cast("int").alias("level")
    sizes = sorted(((r.level, r["count"]) for r in pairs.groupBy(level).count().collect()), reverse=True)  # 64 rows at most
    held, least, every = 0, None, True
    for step, size in sizes:
        if held + size > most:
            every = False
            break
        held, least = held + size, step
    if least is None:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), not sizes
    rows = pairs.where(level >= least).toArrow()
    key, n = rows.column("pair").to_numpy(), rows.column("n").to_numpy()
    order = np.argsort(key)
    return key[order], n[order], every


def _per_doc(doc: np.ndarray, value: np.ndarray, docs: int) -> np.ndarray:
    total = np.zeros(docs, np.int64)
    np.add.at(total, doc, value)
    return total


def _counted(aligned: DataFrame, columns: list[str], b_vocabulary: int, frequent: tuple[np.ndarray, np.ndarray], best: np.ndarray) -> DataFrame:
    """``n_best`` and ``count_sum`` as far as frequent pairs go; the others are listed in ``rare``."""
    shared = aligned.sparkSession.sparkContext.broadcast((*frequent, best))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, count, most = shared.value
        for batch in batches:
            if not len(batch):
                continue
            doc, pair, times = _links(batch)
            at = np.minimum(np.searchsorted(known, pair), max(0, len(known) - 1))
            is_known = known[at] == pair if len(known) else np.zeros(len(pair), bool)
            uses = np.where(is_known, count[at] if len(known) else 0, 0)
            is_best = (uses == most[pair % b_vocabulary]) & is_known
            rare = np.flatnonzero(~is_known)
            cuts = pa.array(np.searchsorted(doc[rare], np.arange(len(batch) + 1)).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(name) for name in columns),
                    pa.array(_per_doc(doc, times * is_best, len(batch))),
                    pa.array(_per_doc(doc, times * uses, len(batch))),
                    pa.ListArray.from_arrays(cuts, pa.array(pair[rare])),
                    pa.ListArray.from_arrays(cuts, pa.array(times[rare])),
                ],
                names=[*columns, *_COUNTED_NUMBERS, "rare", "rare_times"],
            )

    kept = ", ".join(f"{name} {aligned.schema[name].dataType.simpleString()}" for name in columns)
    schema = f"{kept}, n_best bigint, count_sum bigint, rare array<bigint>, rare_times array<bigint>"
    return aligned.select(*columns, "pairs", "times").mapInArrow(read, schema)


def align_tokens(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    a_file: str = A_FILE,
    b_file: str = B_FILE,
    keep_groups: bool = True,
    known_pairs: int = KNOWN_PAIRS,
) -> DataFrame:
    """Per row: the id, ``n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, groups``.

    ``groups`` lists the ids of each group, ``a1,a2|b1;a3|b2,b3``; without ``keep_groups``
    it is null. Files are named as ``public_tokenizers`` knows them. The driver receives
    the counts of ``known_pairs`` pairs at most and one number per B id. The aligned
    documents, with their pairs but without texts, are a table in the session's shared
    folder that the result reads.
    """
    spark, files = docs.sparkSession, (a_file, b_file)
    b_vocabulary = len(TokenPair.shared(*files).b_bytes)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    needed, own = Scratch(spark), Scratch(spark)
    aligned = _aligned(rows, files, keep_groups).withColumn("row", F.monotonically_increasing_id())
    aligned = needed.stage(aligned, "aligned", compression="zstd")
    pairs = own.stage(_pair_counts(aligned), "pair-counts")
    b_id = (F.col("pair") % b_vocabulary).cast("int").alias("b")
    most = pairs.groupBy(b_id).agg(F.max("n").alias("most")).toArrow()  # a row per B id
    best = np.zeros(b_vocabulary, np.int64)
    best[most.column("b").to_numpy()] = most.column("most").to_numpy()
    known, count, every = _frequent(pairs, known_pairs)
    columns = ["doc_id", *_NUMBERS, "groups_sha256", "groups"]
    counted = _counted(aligned, [*columns, "row"], b_vocabulary, (known, count), best)
    shown = [*columns[:-2], *_COUNTED_NUMBERS, *columns[-2:]]
    if every:
        own.clear()
        return counted.select(*shown).withColumnRenamed("doc_id", doc_id)
    counted = needed.stage(counted, "counted")
    links = counted.select("row", F.explode(F.arrays_zip("rare", "rare_times")).alias("x")).select(
        "row", F.col("x.rare").alias("pair"), F.col("x.rare_times").alias("times")
    )
    tops = pairs.groupBy(b_id).agg(F.max("n").alias("most"))
    rest = links.join(pairs, "pair").join(F.broadcast(tops), b_id == F.col("b"))  # a row per B id
    rest = rest.groupBy("row").agg(
        F.sum(F.when(F.col("n") == F.col("most"), F.col("times")).otherwise(0)).alias("best"),
        F.sum(F.col("n") * F.col("times")).alias("sum"),
    )
    rest = needed.stage(rest, "rare-links")
    own.clear()
    joined = counted.join(rest, "row", "left")
    joined = joined.withColumn("n_best", F.col("n_best") + F.coalesce("best", F.lit(0)))
    joined = joined.withColumn("count_sum", F.col("count_sum") + F.coalesce("sum", F.lit(0)))
    return joined.select(*shown).withColumnRenamed("doc_id", doc_id)

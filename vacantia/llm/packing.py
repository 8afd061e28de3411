"""Bounded-space online packing of tokenised documents into sequences of fixed length.

Each partition packs its documents in one pass with a fixed number of open windows. A
piece goes to the open window it fits best. When none fits, the fullest window is closed
and the piece opens a new one; if the closed window would leave a gap wider than
``max_gap``, it is first filled with the beginning of the arriving piece. What a document
has of whole sequences is cut off as sequences of their own. The windows that stay open
are merged by the same pass, those of some partitions in one task, round by round until
one task's windows are left. These last pieces are laid end to end; the remainder is cut
into lengths that need no padding (powers of two).

Rules:

* A null text is the empty text: its only id is the end id. Empty tables give no pieces.
* Every row is a document of its own, also when ids repeat or are null.
* Pieces cover each document once, in order; each sequence is filled from 0 without gaps.
* Only the id and text columns are read, whatever else a table has.
"""

from __future__ import annotations

import itertools
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacantia.llm.byte_bpe import ByteBpe
from vacantia.sources.workspace import stage

LENGTH, END_ID = 2048, 1
OPEN_WINDOWS, MAX_GAP = 32, 32
#: Characters tokenised at once; a longer text is tokenised alone.
TEXT_AT_ONCE = 1_000_000
#: Partitions whose open windows are merged in one task: at most 64 * 32 windows.
MERGED_TOGETHER = 64
_ROUND, _PART = 1 << 57, 1 << 32
_FIELDS = {
    "doc_id": "bigint",
    "start": "bigint",
    "length": "bigint",
    "ids": "binary",
    "ids_crc32": "bigint",
    "doc_tokens": "bigint",
    "sequence_id": "bigint",
    "offset": "bigint",
    "open": "boolean",
    "part": "bigint",
}
_SCHEMA = ", ".join(f"{name} {kind}" for name, kind in _FIELDS.items())
_ARROW = pa.schema(
    [(name, {"bigint": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}[kind]) for name, kind in _FIELDS.items()]
)


class Packer:
    """Open windows of one task. A piece is ``(doc_id, start, ids, doc_tokens)``."""

    def __init__(self, first_sequence: int, part: int, length: int, windows: int, max_gap: int, keep_ids: bool):
        self.sequence, self.part, self.length = first_sequence, part, length
        self.windows, self.max_gap, self.keep_ids = windows, max_gap, keep_ids
        self.free: list[tuple[int, int]] = []  # (free ids, sequence), ascending
        self.held: dict[int, list[tuple]] = {}
        self.rows: list[tuple] = []

    def emit(self, sequence: int, pieces: list[tuple], still_open: bool) -> None:
        offset = 0
        for doc_id, start, ids, doc_tokens in pieces:
            data = ids.tobytes()
            kept = data if still_open or self.keep_ids else None
            self.rows.append(
                (doc_id, start, len(ids), kept, zlib.crc32(data), doc_tokens, sequence, offset, still_open, self.part)
            )
            offset += len(ids)

    def new_sequence(self) -> int:
        self.sequence += 1
        return self.sequence - 1

    def add(self, doc_id: int | None, start: int, ids: np.ndarray, doc_tokens: int) -> None:
        whole = len(ids) // self.length * self.length
        for at in range(0, whole, self.length):
            piece = (doc_id, start + at, ids[at : at + self.length], doc_tokens)
            self.emit(self.new_sequence(), [piece], still_open=False)
        if whole < len(ids):
            self.place(doc_id, start + whole, ids[whole:].copy(), doc_tokens)

    def place(self, doc_id: int | None, start: int, ids: np.ndarray, doc_tokens: int) -> None:
        at = bisect_left(self.free, (len(ids), -1))
        if at == len(self.free) and len(self.free) >= self.windows:
            gap, fullest = self.free.pop(0)
            if gap > self.max_gap:
                self.held[fullest].append((doc_id, start, ids[:gap], doc_tokens))
                start, ids = start + gap, ids[gap:]
                # What is left is shorter and may fit an open window now.
                at = bisect_left(self.free, (len(ids), -1))
            self.emit(fullest, self.held.pop(fullest), still_open=False)
            at = min(at, len(self.free))
        if at < len(self.free):
            room, sequence = self.free.pop(at)
        else:
            room, sequence = self.length, self.new_sequence()
        self.held.setdefault(sequence, []).append((doc_id, start, ids, doc_tokens))
        if room == len(ids):
            self.emit(sequence, self.held.pop(sequence), still_open=False)
        else:
            insort(self.free, (room - len(ids), sequence))

    def leave_open(self) -> None:
        for sequence, pieces in self.held.items():
            self.emit(sequence, pieces, still_open=True)

    def close_all(self) -> None:
        """Lay the last pieces end to end, in whole sequences and then powers of two."""
        pieces = [piece for held in self.held.values() for piece in held]
        left = sum(len(piece[2]) for piece in pieces)
        while pieces:
            room = min(self.length, 1 << (left.bit_length() - 1)) if left < self.length else self.length
            left -= room
            taken = []
            while room:
                doc_id, start, ids, doc_tokens = pieces.pop(0)
                if len(ids) > room:
                    pieces.insert(0, (doc_id, start + room, ids[room:], doc_tokens))
                    ids = ids[:room]
                taken.append((doc_id, start, ids, doc_tokens))
                room -= len(ids)
            self.emit(self.new_sequence(), taken, still_open=False)

    def take_rows(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows, strict=True)) or [[] for _ in _FIELDS]
        self.rows = []
        return pa.RecordBatch.from_arrays(
            [pa.array(c, field.type) for c, field in zip(columns, _ARROW, strict=True)], schema=_ARROW
        )


def open_pack(
    docs: DataFrame, tokenizer: str, doc_id: str, text: str, length: int, windows: int, max_gap: int, keep_ids: bool
) -> DataFrame:
    """The first pass, over the partitions of ``docs`` as they are."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        packer = Packer(part * _PART, part, length, windows, max_gap, keep_ids)
        bpe = ByteBpe.shared(tokenizer)
        for batch in batches:
            ids, texts = batch.column("id").to_pylist(), batch.column("text").to_pylist()
            at = 0
            while at < len(ids):
                end, held = at + 1, len(texts[at])
                while end < len(ids) and end - at < 1000 and held + len(texts[end]) <= TEXT_AT_ONCE:
                    held += len(texts[end])
                    end += 1
                for key, tokens in zip(ids[at:end], bpe.encode(texts[at:end], END_ID), strict=True):
                    packer.add(key, 0, tokens, len(tokens))
                yield packer.take_rows()
                at = end
        packer.leave_open()
        yield packer.take_rows()

    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.mapInArrow(pack, _SCHEMA)


def merge_windows(open_pieces: DataFrame, turn: int, last: bool, length: int, windows: int, max_gap: int, keep_ids: bool) -> DataFrame:
    """Pack the open pieces of ``MERGED_TOGETHER`` parts in each task anew."""

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        group = key[0].as_py()
        packer = Packer(turn * _ROUND + group * _PART, group, length, windows, max_gap, keep_ids)
        table = table.sort_by([("part", "ascending"), ("sequence_id", "ascending"), ("offset", "ascending")])
        for row in table.select(["doc_id", "start", "ids", "doc_tokens"]).to_pylist():
            packer.add(row["doc_id"], row["start"], np.frombuffer(row["ids"], np.uint32), row["doc_tokens"])
        if last:
            packer.close_all()
        else:
            packer.leave_open()
        return pa.Table.from_batches([packer.take_rows()])

    groups = open_pieces.withColumn("merge_group", F.floor(F.col("part") / MERGED_TOGETHER))
    return groups.groupBy("merge_group").applyInArrow(merge, _SCHEMA)


def pack_documents(
    docs: DataFrame,
    tokenizer: str,
    doc_id: str = "doc_id",
    text: str = "text",
    length: int = LENGTH,
    windows: int = OPEN_WINDOWS,
    max_gap: int = MAX_GAP,
    keep_ids: bool = True,
) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids, ids_crc32, doc_tokens, sequence_id, offset``.

    ``ids`` are little-endian unsigned 32-bit numbers; without ``keep_ids`` they are null
    and only their checksum is returned. Tables of each round are written to the
    session's shared folder, since which piece shares a window must not change when an
    executor is lost.
    """
    shape = (length, windows, max_gap, keep_ids)
    packed = stage(open_pack(docs, tokenizer, doc_id, text, *shape), "packed")
    done = packed.where(~F.col("open"))
    parts = packed.agg(F.max("part")).first()[0] or 0
    for turn in itertools.count(1):
        last = parts < MERGED_TOGETHER
        packed = stage(merge_windows(packed.where("open"), turn, last, *shape), "merged-windows")
        done = done.unionByName(packed.where(~F.col("open")))
        if last:
            break
        parts //= MERGED_TOGETHER
    names = [name for name in _FIELDS if name not in ("open", "part")]
    return done.select(*[F.col(name) if name != "doc_id" else F.col(name).alias(doc_id) for name in names])

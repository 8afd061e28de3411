"""SentencePiece ids by streaming Viterbi, and texts from ids.

Of all ways to cut a text into pieces of the vocabulary, the one with the greatest sum of
piece scores is taken; of equal sums the one whose last differing piece is longer. The
scan keeps only the boundaries that a later piece can still begin at, as many as the
longest piece has characters, and commits ids whenever all their backpointer paths meet
in one boundary. Where no piece of the vocabulary crosses from a word to the white space
after it, paths always meet there; stretches between such places are remembered for a
bounded number of them.

Rules: as in SentencePiece, a space stands for the meta symbol and one is put before the
text. A character without a piece, and a meta symbol that the text itself holds, is
spelled in bytes; so decoding gives back every text exactly. A null text is the empty
text, which has no ids. Ids are little-endian unsigned 32-bit numbers; decoding refuses
ids that the vocabulary does not have. The pieces' scores of a BPE vocabulary are merge
ranks; the best sum under them need not be the segmentation that merging gives.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
_REMEMBERED, _LONGEST = 800_000, 100
_TEXT_AT_ONCE = 1_000_000


class Vocabulary:
    """Pieces, scores and byte ids of a model file that ``public_tokenizers`` names."""

    def __init__(self, model: str):
        import public_tokenizers
        from sentencepiece import SentencePieceProcessor

        processor = SentencePieceProcessor(model_file=public_tokenizers.path(model))
        self.pieces = [processor.id_to_piece(i) for i in range(processor.get_piece_size())]
        self.bytes: dict[int, int] = {}
        self.known: dict[str, tuple[int, float]] = {}
        lowest = 0.0
        for i, piece in enumerate(self.pieces):
            if processor.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
            elif not (processor.is_control(i) or processor.is_unknown(i) or processor.is_unused(i)):
                self.known[piece] = (i, processor.get_score(i))
                lowest = min(lowest, processor.get_score(i))
        self.of_byte = {i: b for b, i in self.bytes.items()}
        #: What an id stands for by itself; bytes from 128 on only do so with others.
        self.text_of = [chr(self.of_byte[i]) if i in self.of_byte else p.replace(SPACE, " ") for i, p in enumerate(self.pieces)]
        self.part_of_char = np.array([self.of_byte.get(i, 0) >= 128 for i in range(len(self.pieces))])
        self.spelled = lowest - 10.0
        self.longest = max(map(len, self.known), default=1)
        #: Every beginning of a piece: the piece itself, or True for a beginning only.
        self.beginnings: dict[str, tuple[int, float] | bool] = {p[:n]: True for p in self.known for n in range(1, len(p))}
        self.beginnings |= self.known
        #: Whether no piece has a meta symbol behind another character.
        self.words_end_paths = all(SPACE not in piece.lstrip(SPACE) for piece in self.known)

    @staticmethod
    @cache
    def shared(model: str) -> Vocabulary:
        return Vocabulary(model)

    def spell(self, char: str) -> list[int]:
        return [self.bytes[b] for b in char.encode()]


def committed_ids(vocabulary: Vocabulary, text: str) -> Iterator[list[int]]:
    """Ids of ``text`` (with meta symbols), in parts, each as soon as it is certain."""
    get, longest, spelled = vocabulary.beginnings.get, vocabulary.longest, vocabulary.spelled
    size, base = len(text), 0
    # Of each boundary from the last commit on: best score, and the last piece's begin and id.
    score: list[float | None] = [0.0, None]
    began, piece = [0, 0], [-1, -1]
    for begin in range(size):
        here = score[begin - base]
        end, known = begin + 1, get(text[begin])
        if known is None or known is True:
            # No piece for this character alone.
            if score[end - base] is None or here + spelled > score[end - base]:
                score[end - base], began[end - base], piece[end - base] = here + spelled, begin, -1
        while known is not None:
            if known is not True and (score[end - base] is None or here + known[1] > score[end - base]):
                score[end - base], began[end - base], piece[end - base] = here + known[1], begin, known[0]
            end += 1
            if end > size:
                break
            if end - base == len(score):
                score.append(None)
                began.append(0)
                piece.append(-1)
            known = get(text[begin:end])
        done = begin + 1
        if done == size:
            ends = {size}
        elif (done - base) % longest == 0:
            # Paths go on from this boundary and from those that a piece has reached beyond it.
            ends = {at for at in range(done, base + len(score)) if score[at - base] is not None}
        else:
            if done + 1 - base == len(score):
                score.append(None)
                began.append(0)
                piece.append(-1)
            continue
        while len(ends) > 1:
            last = max(ends)
            ends.remove(last)
            ends.add(began[last - base])
        meeting = ends.pop()
        if meeting > base:
            path, at = [], meeting
            while at > base:
                start, number = began[at - base], piece[at - base]
                path.append([number] if number >= 0 else vocabulary.spell(text[start]))
                at = start
            yield list(chain.from_iterable(reversed(path)))
            del score[: meeting - base], began[: meeting - base], piece[: meeting - base]
            base = meeting
        while len(score) <= done + 1 - base:
            score.append(None)
            began.append(0)
            piece.append(-1)


class Encoder(dict):
    """Ids of stretches whose ends all paths share, as bytes; remembered per worker."""

    @staticmethod
    @cache
    def shared(model: str) -> Encoder:
        return Encoder(Vocabulary.shared(model))

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary = vocabulary
        self.stretch = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")

    def __missing__(self, stretch: str) -> bytes:
        ids = array("I", chain.from_iterable(committed_ids(self.vocabulary, stretch))).tobytes()
        if len(stretch) <= _LONGEST:
            if len(self) >= _REMEMBERED:
                self.clear()
            self[stretch] = ids
        return ids

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        # A meta symbol of the text itself has no piece, so every path is cut around it.
        plain = text.split(SPACE)
        marked = [(SPACE if i == 0 else "") + part.replace(" ", SPACE) for i, part in enumerate(plain)]
        parts: list[bytes] = []
        for i, part in enumerate(marked):
            if i:
                parts.append(array("I", self.vocabulary.spell(SPACE)).tobytes())
            if self.vocabulary.words_end_paths:
                parts.extend(map(self.__getitem__, self.stretch.findall(part)))
            else:
                parts.extend(array("I", ids).tobytes() for ids in committed_ids(self.vocabulary, part))
        return b"".join(parts)


def decode(vocabulary: Vocabulary, ids: np.ndarray) -> str:
    """The text of whole ids; byte pieces are taken as they are, not as white space."""
    if not len(ids):
        return ""
    if not vocabulary.part_of_char[ids].any():
        return "".join(map(vocabulary.text_of.__getitem__, ids.tolist()))[1:]
    parts, spelled = [], bytearray()
    for i in ids.tolist():
        byte = vocabulary.of_byte.get(i)
        if byte is not None:
            spelled.append(byte)
            continue
        if spelled:
            parts.append(spelled.decode(errors="replace"))
            spelled.clear()
        parts.append(vocabulary.text_of[i])
    parts.append(spelled.decode(errors="replace"))
    return "".join(parts)[1:]


def encode_texts(docs: DataFrame, model: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``id, ids`` of every row; ``ids`` is a binary of 32-bit numbers."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.shared(model)
        for batch in batches:
            keys, texts = batch.column("id"), batch.column("text").to_pylist()
            at = 0
            while at < len(texts):
                end, held = at, 0
                rows = []
                while end < len(texts) and (end == at or held + len(texts[end]) <= _TEXT_AT_ONCE):
                    held += len(texts[end])
                    rows.append(encoder.encode(texts[end]))
                    end += 1
                yield pa.RecordBatch.from_arrays([keys.slice(at, end - at), pa.array(rows, pa.binary())], names=["id", "ids"])
                at = end

    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.mapInArrow(encode, "id bigint, ids binary").withColumnRenamed("id", doc_id)


def decode_ids(encoded: DataFrame, model: str, doc_id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``id, ids, text`` of every row; null ids are no ids."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary.shared(model)
        for batch in batches:
            texts = [decode(vocabulary, np.frombuffer(x or b"", np.uint32)) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=["id", "ids", "text"])

    rows = encoded.select(F.col(doc_id).alias("id"), F.col(ids).alias("ids"))
    return rows.mapInArrow(read, "id bigint, ids binary, text string").withColumnRenamed("id", doc_id)

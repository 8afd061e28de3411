import random

import numpy as np
import pytest

from vacantia.llm.sentencepiece_viterbi import Encoder, Vocabulary, committed_ids, decode, decode_ids, encode_texts

MODEL = "piece_bpe_32k.model"


@pytest.fixture(scope="module")
def vocabulary():
    return Vocabulary.shared(MODEL)


def brute(vocabulary, text):
    best, back = [0.0] + [None] * len(text), [None] * (len(text) + 1)
    for end in range(1, len(text) + 1):
        for begin in range(end):
            piece = vocabulary.known.get(text[begin:end])
            if piece and (best[end] is None or best[begin] + piece[1] > best[end]):
                best[end], back[end] = best[begin] + piece[1], (begin, [piece[0]])
        if text[end - 1] not in vocabulary.known:
            total = best[end - 1] + vocabulary.spelled
            if best[end] is None or total > best[end]:
                best[end], back[end] = total, (end - 1, vocabulary.spell(text[end - 1]))
    out, at = [], len(text)
    while at:
        out = back[at][1] + out
        at = back[at][0]
    return out


def test_best_segmentation_and_round_trip(vocabulary):
    rng = random.Random(1)
    encoder = Encoder(vocabulary)
    for _ in range(800):
        marked = "▁" + "".join(rng.choice("theanding▁éx🙂\n") for _ in range(rng.randint(1, 50)))
        assert sum(committed_ids(vocabulary, marked), []) == brute(vocabulary, marked)
        text = marked[1:].replace("▁", " ")
        ids = np.frombuffer(encoder.encode(text), np.uint32)
        assert ids.tolist() == brute(vocabulary, marked) and decode(vocabulary, ids) == text


def test_long_texts_are_committed_in_parts(vocabulary):
    text = "internationalisation" * 500
    parts = list(committed_ids(vocabulary, text))
    assert len(parts) > 100 and sum(parts, []) == brute_by_words(vocabulary, text)


def brute_by_words(vocabulary, text):
    """The same recurrence with the begin bounded by the longest piece, kept whole."""
    best, back = [0.0], [None]
    for end in range(1, len(text) + 1):
        options = [
            (-(best[begin] + piece[1]), begin, piece[0])
            for begin in range(max(0, end - vocabulary.longest), end)
            if (piece := vocabulary.known.get(text[begin:end]))
        ]
        score, begin, number = min(options)
        best.append(-score)
        back.append((begin, number))
    out, at = [], len(text)
    while at:
        at, number = back[at]
        out.append(number)
    return out[::-1]


def test_rows(spark, vocabulary):
    texts = [None, "", " ", "▁", "a▁ b▁▁", "  x  \n é\x00中🙂 ", "<s> </s> <unk> <0x41>", "word " * 60_000, "x" * 20_000]
    docs = spark.createDataFrame([(i, t, "y") for i, t in enumerate(texts)] + [(1, "twice", "y"), (None, "z", "y")], "doc_id bigint, text string, ids string")
    rows = decode_ids(encode_texts(docs, MODEL), MODEL).collect()
    assert len(rows) == len(texts) + 2
    found = {(r.doc_id, r.text) for r in rows}
    assert found == {(i, t or "") for i, t in enumerate(texts)} | {(1, "twice"), (None, "z")}
    assert all((np.frombuffer(r.ids, "<u4") < 32_000).all() for r in rows)
    assert encode_texts(docs.limit(0), MODEL).collect() == []

import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from vacantia.llm.byte_bpe import ByteBpe
from vacantia.llm.packing import pack_documents

NAME = "byte_bpe_50k"
SLOW = Tokenizer.from_file(public_tokenizers.path(f"{NAME}.json"))


def ids_of(text):
    return SLOW.encode(text or "", add_special_tokens=False).ids


def test_ids_are_those_of_the_defining_library():
    rng = random.Random(5)
    letters = "ab Z9 .,!'\n\t\r\x85\xa0\u2003 \u200b\x1c\u3000éß中文ि٣①Ⅷʼ’'sn't🙂 \ufeff\u0378\U0001e900"
    texts = ["", "  ", "it's <|endoftext|> a  <|endoftext|>", "x" * 5000, " " * 3000]
    texts += ["".join(rng.choice(letters) for _ in range(rng.randint(1, 30))) for _ in range(3000)]
    got = ByteBpe(NAME).encode(texts, 1)
    assert all(g.tolist() == [*ids_of(t), 1] for g, t in zip(got, texts, strict=True))


def check(rows, texts, length, max_gap=32):
    by_row, by_sequence = {}, {}
    for row in rows:
        ids = np.frombuffer(row.ids, "<u4")
        assert len(ids) == row.length > 0 and zlib.crc32(row.ids) == row.ids_crc32
        by_row.setdefault(row.doc_id, []).append((row.start, ids.tolist(), row.doc_tokens))
        by_sequence.setdefault(row.sequence_id, []).append((row.offset, row.length))
    assert set(by_row) == set(texts)
    for doc_id, pieces in by_row.items():
        whole = [*ids_of(texts[doc_id]), 1]
        joined = []
        for start, ids, tokens in sorted(pieces):
            assert start == len(joined) and tokens == len(whole)
            joined += ids
        assert joined == whole
    for pieces in by_sequence.values():
        at = 0
        for offset, size in sorted(pieces):
            assert offset == at
            at += size
        assert length - max_gap <= at <= length or at.bit_count() == 1


def test_pieces_cover_every_document_once(spark):
    rng = random.Random(3)
    texts = {i: " ".join(rng.choice(("the", "of", "xylo", "é")) for _ in range(rng.choice((1, 30, 200, 900)))) for i in range(400)}
    texts |= {1000: None, 1001: "", 1002: "word " * 9000}
    docs = spark.createDataFrame([(i, t, 0) for i, t in texts.items()], "doc_id bigint, text string, part int")
    rows = pack_documents(docs.repartition(7, "doc_id"), NAME, length=256, windows=4).collect()
    check(rows, texts, 256)


def test_many_partitions_are_merged_in_rounds(spark, monkeypatch):
    monkeypatch.setattr("vacantia.llm.packing.MERGED_TOGETHER", 3)
    texts = {i: f"text {i} " * (i % 40 + 1) for i in range(300)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    check(pack_documents(docs.repartition(20, "doc_id"), NAME, length=128, windows=3).collect(), texts, 128)


def test_repeated_and_null_ids_and_empty_table(spark):
    schema = "doc_id bigint, text string"
    rows = pack_documents(spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c")], schema), NAME).collect()
    assert sorted((r.doc_id or 0, r.length) for r in rows) == [(0, 2), (1, 3), (1, 3)]
    assert pack_documents(spark.createDataFrame([], schema), NAME).collect() == []

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers as files
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from vacantia.llm.queries import QUERIES
from vacantia.llm.token_alignment import A_FILE, B_FILE, TokenPair, align_tokens

SCHEMA = "doc_id bigint, text string"
A = Tokenizer.from_file(files.path(A_FILE))
A.encode_special_tokens = True
B = SentencePieceProcessor(model_file=files.path(B_FILE))
BOTH = TokenPair(A_FILE, B_FILE)


def tokens(text):
    """Ids and byte ranges of both sides, each library asked for the whole text."""
    if not text:
        return [], []
    sides = []
    for ids, size in ((A.encode(" " + text, add_special_tokens=False).ids, BOTH.a_bytes), (B.encode(text), BOTH.b_bytes)):
        if b"".join(size[i] for i in ids) != (" " + text).encode():
            return [], []
        ends = np.cumsum([len(size[i]) for i in ids]).tolist()
        sides.append(list(zip(ids, [0, *ends[:-1]], ends)))
    return sides


def brute(texts):
    found = []
    for text in texts:
        a, b = tokens(text)
        links = [(x, y) for x, s, e in a for y, t, f in b if max(s, t) < min(e, f)]
        cuts = sorted({e for _, _, e in a} & {e for _, _, e in b})
        groups = []
        for low, high in zip([0, *cuts[:-1]], cuts):
            inside = [",".join(str(x) for x, s, e in side if s >= low and e <= high) for side in (a, b)]
            groups.append("|".join(inside))
        found.append((len(a), len(b), len(groups), links, ";".join(groups)))
    counts = Counter(link for *_, links, _ in found for link in links)
    best = Counter()
    for (_, y), n in counts.items():
        best[y] = max(best[y], n)
    for n_a, n_b, n_groups, links, groups in found:
        n_best = sum(counts[x, y] == best[y] for x, y in links)
        sha = hashlib.sha256(groups.encode()).hexdigest() if groups else ""
        yield n_a, n_b, n_groups, len(links), n_best, sum(counts[link] for link in links), sha, groups


def some_texts():
    rng = random.Random(11)
    letters = "ab Z9 .,!'\n\t\r\x85\xa0  ​\x1c　éß中文ि٣Ⅷʼ’🙂 ﻿͸▁\x00"
    texts = [None, "", " ", "   ", "a", " a ", "a  b", "x\n  y", "<s> <|endoftext|> </s><0x0A>", "▁", "a▁b", "the of and " * 40, "x" * 400]
    texts += ["".join(rng.choice(letters) for _ in range(rng.randint(1, 30))) for _ in range(400)]
    words = ["the", "Straße", "don't", "xylograph", "日本語", "é", "１２", "ﬁn", "naïve"]
    return texts + [" ".join(rng.choice(words) for _ in range(rng.randint(1, 300))) for _ in range(25)]


def rows(frame):
    names = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "groups"]
    return {r.doc_id: tuple(r[n] for n in names) for r in frame.collect()}


def test_equals_all_overlapping_ranges(spark):
    texts = some_texts()
    docs = spark.createDataFrame(list(enumerate(texts)), SCHEMA).repartition(5)
    wanted = dict(enumerate(brute(texts)))
    assert sum(1 for x in wanted.values() if x[0]) > 200
    assert rows(align_tokens(docs)) == wanted
    # Most pairs are joined instead of known to all tasks.
    assert rows(align_tokens(docs, known_pairs=20)) == wanted
    assert rows(align_tokens(docs, known_pairs=0)) == wanted


def test_lanes_and_forgetting_do_not_show(spark, monkeypatch):
    texts = some_texts()[:200]
    for name, value in (("LANE", 1), ("_REMEMBERED", 3), ("_COUNTED", 10)):
        monkeypatch.setattr(f"vacantia.llm.token_alignment.{name}", value)
    pair = TokenPair(A_FILE, B_FILE)
    monkeypatch.setattr(TokenPair, "shared", staticmethod(lambda *files: pair))
    wanted = list(brute(texts))
    for k in range(0, len(texts), 50):
        found = pair.encode(texts[k : k + 50])
        found.align()
        assert [g.decode() for g in found.groups(pair.digits)] == [w[-1] for w in wanted[k : k + 50]]
        assert np.bincount(found.doc_of_link(), minlength=50).tolist() == [w[3] for w in wanted[k : k + 50]]


def test_repeated_rows_null_ids_empty_table_and_clashing_columns(spark):
    wide = f"{SCHEMA}, pair int, n_a string, row int"
    docs = spark.createDataFrame([(1, "one two", 1, "x", 2), (1, "one two", 1, "x", 2), (None, "two", 1, None, 3)], wide)
    wanted = list(brute(["one two", "one two", "two"]))
    for known in (1000, 0):
        got = [tuple(r) for r in align_tokens(docs, known_pairs=known).collect()]
        assert sorted(got, key=str) == sorted([(1, *wanted[0]), (1, *wanted[1]), (None, *wanted[2])], key=str)
        assert align_tokens(spark.createDataFrame([], SCHEMA), known_pairs=known).collect() == []


def test_query_equals_brute_force(spark, tmp_path):
    texts = some_texts()[:120]
    spark.createDataFrame(list(enumerate(texts)), SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    found = QUERIES["op11_token_alignment"](spark, str(tmp_path))
    assert "groups" not in found.columns
    names = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    got = {r.doc_id: tuple(r[n] for n in names) for r in found.collect()}
    assert got == {i: w[:-1] for i, w in enumerate(brute(texts))}

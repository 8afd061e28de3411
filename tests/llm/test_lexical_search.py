import math
import random
import re
from collections import Counter

import pyarrow as pa
import pytest

from vacantia.llm.hashing import text_bytes
from vacantia.llm.lexical_search import Vocabulary, rank_documents, sharing_graph, term_list, terms_of

DOCS, ITEMS = "doc_id bigint, text string", "item_id bigint, text string"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {a: a + 32 for a in range(65, 91)}


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def ranked(docs, items, k):
    """Every document against every item, in whole numbers."""
    counts = [(doc_id, Counter(terms(text))) for doc_id, text in docs]
    n_docs, length = sum(1 for _, c in counts if c), sum(c.total() for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item_id, text in dict.fromkeys((i, t or "") for i, t in items):
        found = []
        for doc_id, c in counts:
            m = 75 + (25 * c.total() * n_docs) // max(1, length)
            score = 0
            for term in terms(text):
                if term in c:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[term] + 1)))
                    score += w * (1_000_000_000 * c[term] // (1000 * c[term] + 12 * m))
            if score > 0:
                found.append((-score, doc_id is None, doc_id or 0, doc_id))
        for rank, (score, _, _, doc_id) in enumerate(sorted(found)[:k], 1):
            out.append((item_id, rank, doc_id, -score))
    return out


def check(spark, docs, items, k=20, **options):
    found = rank_documents(
        spark.createDataFrame(docs, DOCS).repartition(4), spark.createDataFrame(items, ITEMS), k=k, **options
    )
    key = lambda row: tuple((x is None, x) for x in row)
    got = sorted((tuple(r) for r in found.select("item_id", "rank", "doc_id", "score").collect()), key=key)
    assert got == sorted(ranked(docs, items, k), key=key)
    return got


@pytest.mark.parametrize("seed", range(3))
def test_equals_every_document_against_every_item(spark, seed):
    rng = random.Random(seed)
    words = ["the", "of", "Straße", "STRASSE", "x1", "日本", "a b", "İ", *(f"w{i}" for i in range(30))]
    pick = lambda n: " ".join(rng.choice(words[: rng.choice((5, len(words)))]) for _ in range(n))
    docs = [(i, pick(rng.randint(0, 60))) for i in range(150)]
    docs += [(7, docs[3][1]), (None, "the of w1"), (None, "the of w1"), (200, None), (201, ""), (202, "--- ,."), (203, "the " * 3000)]
    docs += [(300 + i, "w1 w2 w3 the") for i in range(40)]
    items = [(i, pick(rng.randint(1, 25))) for i in range(25)]
    items += [(3, "the other text"), (4, None), (5, ""), (6, items[6][1]), (7, "nowhere"), (8, "the the THE of")]
    check(spark, docs, items, k=5)


def test_batches_of_items_give_the_same(spark):
    rng = random.Random(9)
    docs = [(i, " ".join(rng.choice("abcdefgh") for _ in range(20))) for i in range(60)]
    items = [(i, " ".join(rng.choice("abcdefghij") for _ in range(12))) for i in range(12)]
    assert check(spark, docs, items, k=4) == check(spark, docs, items, k=4, batch_bytes=40)


def test_empty_tables_and_clashing_columns(spark):
    assert check(spark, [], [(1, "a")]) == [] == check(spark, [(1, "a")], [])
    docs = spark.createDataFrame([(1, "a b", 5, "x"), (2, "b", 6, "y")], "doc_id bigint, text string, rank int, item_id string")
    items = spark.createDataFrame([(1, "a", 3)], "item_id bigint, text string, score int")
    assert [tuple(r)[:3] for r in rank_documents(docs, items).collect()] == [(1, 1, 1)]


def test_graph_sums_are_the_items(spark):
    rng = random.Random(4)
    common = [Counter(rng.choices(range(20), k=8)) for _ in range(4)]
    items = [sum(rng.sample(common, 2), Counter()) + Counter(rng.choices(range(60), k=5)) for _ in range(30)]
    nodes, tops = sharing_graph([*items, Counter(), items[0]])

    def total(i):
        out = Counter()
        for term, times in nodes[i].terms:
            out[term] += times
        for part in nodes[i].parts:
            assert part < i
            out.update(total(part))
        return out

    assert [total(top) for top in tops] == [*items, Counter(), items[0]]
    steps = sum(len(node.terms) + len(node.parts) for node in nodes)
    assert steps < sum(len(item) for item in [*items, items[0]])


def test_terms_of_equal_hash_are_told_apart(monkeypatch):
    """Positions are compared byte by byte, whatever the hashes say."""
    vocabulary = Vocabulary([b"ab", b"cd"])
    words = terms_of(text_bytes(pa.array(["cd ab xy ab"])))
    words._hash = words.hash.copy()
    words._hash[2] = words._hash[1]  # "xy" looks like "ab"
    hit, term = vocabulary.find(words)
    assert hit.tolist() == [0, 1, 3] and term.tolist() == [1, 0, 0]
    assert term_list("Ab,ÄB 1_2") == [b"ab", "Äb".encode(), b"1", b"2"]

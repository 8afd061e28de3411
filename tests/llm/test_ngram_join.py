import random

import pytest

from vacantia.llm.components import connected_components
from vacantia.llm.ngram_join import near_duplicates, possible_pairs
import vacantia.llm.ngram_join as module


def shingles(text, size=4):
    table = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    words = (text or "").encode().translate(table).split()
    if len(words) < size:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}


def components(pairs, nodes):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def brute(rows, percent=85):
    sets = [(i, shingles(t)) for i, t in rows if i is not None]
    pairs = [
        (a, b)
        for k, (a, x) in enumerate(sets)
        for b, y in sets[:k]
        if x and y and 100 * len(x & y) >= percent * len(x | y)
    ]
    label = components(pairs, {i for i, _ in sets})
    return sorted((i or 0, len(shingles(t)), label.get(i, 0)) for i, t in rows)


def found(spark, rows, **more):
    docs = spark.createDataFrame([(*row, 1, "x") for row in rows], "doc_id bigint, text string, n int, component_id string")
    return sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in near_duplicates(docs, **more).collect())


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"new{rng.randint(0, 10**6)}"
    return " ".join(words)


def test_near_copies_at_and_around_the_limit(spark):
    rng = random.Random(1)
    rows = []
    for _ in range(40):
        base = [f"v{rng.randint(0, 3000)}" for _ in range(rng.randint(3, 150))]
        rows += [(0, edited(rng, base, rng.randint(0, 5))) for _ in range(rng.randint(1, 8))]
    rows = [(i, text) for i, (_, text) in enumerate(rows)]
    assert found(spark, rows) == brute(rows)
    assert found(spark, rows, percent=70) == brute(rows, 70)


def test_a_group_of_near_copies_larger_than_a_block(spark, monkeypatch):
    monkeypatch.setattr(module, "BLOCK", 16)
    rng = random.Random(2)
    base = [f"v{i}" for i in range(60)]
    rows = [(i, edited(rng, base, rng.randint(0, 3))) for i in range(150)]
    rows += [(1000 + i, " ".join(f"z{rng.randint(0, 500)}" for _ in range(50))) for i in range(100)]
    assert found(spark, rows) == brute(rows)


def test_short_null_repeated_and_odd_rows(spark):
    rows = [(5, "One two"), (3, "one  TWO"), (4, "one two three"), (7, None), (8, ""), (9, " \t"), (None, "one two")]
    rows += [(20, "same id first text of it"), (20, "another text of the same id"), (21, "another text of the same id")]
    rows += [(22, "same id first text of it"), (30, "a b c d e " * 5000), (31, "A B C D E " * 4000), (32, "É b c d"), (33, "é b c d")]
    wanted = brute(rows)
    assert found(spark, rows) == wanted


def test_many_rows_of_one_id_and_text(spark, monkeypatch):
    """Rows that repeat an id are one member; near copies of it have rows of their own."""
    rng = random.Random(7)
    base = [f"v{i}" for i in range(120)]
    text = " ".join(base)
    rows = [(5, text)] * 3000 + [(6, edited(rng, base, 1)), (7, edited(rng, base, 2))] * 40
    rows += [(8, text), (9, "other words of another length altogether"), (5, "other words of another length altogether"), (None, text)]
    wanted = brute(sorted(set(rows), key=str))
    copies = {row: rows.count(row) for row in set(rows)}
    full = [w for row, w in zip(sorted(set(rows), key=str), [brute([r])[0] for r in sorted(set(rows), key=str)]) for _ in range(copies[row])]
    label = {i: c for i, _, c in wanted}
    assert found(spark, rows) == sorted((i, n, label[i]) for i, n, _ in full)


def test_pairs_of_groups_are_judged_before_they_are_expanded(spark):
    """Only groups with a partner, and groups of several members, are expanded."""
    from vacantia.llm.ngram_join import _group_entries
    from vacantia.llm.session import Scratch

    rows = [
        (100, [1, 2, 3], 1, 1),  # shares 1 with a group of about its size, at the same place
        (104, [1, 7, 8], 1, 2),
        (400, [1, 9, 10], 1, 3),  # too large for both
        (50, [20, 21], 3, 4),  # several members, no partner
        (51, [30, 31, 32, 33, 20], 1, 5),  # shares 20, but at the end
        (60, [40], 1, 6),  # shares nothing
    ]
    groups = spark.createDataFrame(rows, "n bigint, prefix array<bigint>, size bigint, key bigint")
    for limit in (256, 1):
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(module, "BLOCK", limit)
            entries = _group_entries(groups, 97, Scratch(spark)).collect()
        assert {(r.shingle, r.key, r.total) for r in entries} == {(20, 4, 3)}
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(module, "BLOCK", limit)
            entries = _group_entries(groups, 85, Scratch(spark)).collect()
        assert {(r.shingle, r.key, r.total) for r in entries} >= {(1, 1, 2), (1, 2, 2)}
        assert not {r.key for r in entries} & {3, 6}


def test_empty_table_and_bad_parameter(spark):
    assert found(spark, []) == []
    with pytest.raises(ValueError):
        found(spark, [], percent=50)


def test_random_sets_of_few_words(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice("abc") for _ in range(rng.randint(1, 12)))) for i in range(150)]
    assert found(spark, rows) == brute(rows)


def test_sketches_never_rule_out_a_link():
    rng = random.Random(5)
    import numpy as np

    from vacantia.llm.hashing import text_bytes
    from vacantia.llm.ngram_join import _ordered_sets, _sketches
    import pyarrow as pa

    base = [f"v{i}" for i in range(1300)]
    texts = [edited(rng, base[: rng.randint(900, 1300)], rng.randint(0, 60)) for _ in range(60)]
    hashes, text, n = _ordered_sets(text_bytes(pa.array(texts)), 4, np.zeros(module.BUCKETS, np.uint8))
    sketches = _sketches(hashes, text, n)
    members = [{"id": i, "n": int(n[i]), "pos": 0, "sketch": sketches[i]} for i in range(len(texts))]
    possible = {(a, b) for _, a, b in possible_pairs(members, None, 85)}
    across = {(a, b) for _, a, b in possible_pairs(members[:30], members[30:], 85)}
    sets = [shingles(t) for t in texts]
    linked = {(a, b) for b in range(60) for a in range(b) if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])}
    assert linked and linked <= possible
    assert {p for p in linked if p[0] < 30 <= p[1]} <= across


def test_connected_components(spark):
    rng = random.Random(6)
    edges = [(rng.randint(0, 80), rng.randint(0, 80)) for _ in range(60)] + [(100 + i, 101 + i) for i in range(40)]
    edges += [(500, 500), *((600, 601 + i) for i in range(30))]
    frame = spark.createDataFrame(edges, "a bigint, b bigint")
    nodes = {n for a, b in edges if a != b for n in (a, b)}
    wanted = components([e for e in edges if e[0] != e[1]], nodes)
    assert {r.node: r.component for r in connected_components(frame).collect()} == wanted
    assert connected_components(frame.limit(0)).collect() == []

import hashlib
import random
from collections import Counter

from vacantia.llm.substring_dedup import remove_repeats

SCHEMA = "doc_id bigint, text string, n_words string, lang string"


def brute(rows, window):
    texts = [(text or "").encode().split() for _, text in rows]
    count = Counter(tuple(w[i : i + window]) for w in texts for i in range(len(w) - window + 1))
    out = []
    for (doc_id, _), words in zip(rows, texts, strict=True):
        keep = [True] * len(words)
        for i in range(len(words) - window + 1):
            if count[tuple(words[i : i + window])] > 1:
                keep[i : i + window] = [False] * window
        kept = b" ".join(w for w, k in zip(words, keep, strict=True) if k)
        out.append((doc_id or 0, len(words), len(words) - sum(keep), kept.decode(), hashlib.sha256(kept).hexdigest(), "en"))
    return sorted(out)


def found(spark, rows, window=35, kmer=8):
    docs = spark.createDataFrame([(*row, "x", "en") for row in rows], SCHEMA)
    cut = remove_repeats(docs, window=window, kmer=kmer, carry=("lang",)).collect()
    return sorted((r.doc_id or 0, r.n_words, r.n_removed, r.kept, r.kept_sha256, r.lang) for r in cut)


def test_random_texts_of_few_words(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice("ab") for _ in range(rng.randint(0, 40)))) for i in range(60)]
    assert found(spark, rows, window=8, kmer=3) == brute(rows, 8)


def test_shared_passages_at_any_place(spark):
    rng = random.Random(2)

    def words(n):
        return [f"w{rng.randint(0, 5000)}" for _ in range(n)]

    passages = [words(rng.randint(30, 90)) for _ in range(6)]
    rows = []
    for i in range(120):
        body = words(rng.randint(0, 200))
        for _ in range(rng.randint(0, 3)):
            at, passage = rng.randint(0, len(body)), rng.choice(passages)
            body[at:at] = passage[rng.randint(0, 5) :]
        rows.append((i, rng.choice((" ", "\n", "\t ")).join(body)))
    assert found(spark, rows) == brute(rows, 35)


def test_nulls_copies_long_texts_and_repeated_rows(spark):
    long = " ".join(f"x{i}" for i in range(40_000))
    rows = [(1, None), (2, ""), (3, "a b"), (4, long), (5, f"start {long} end"), (6, "t " * 5000)]
    rows += [(7, "one " * 35), (8, "b " * 34), (9, "b " * 34)]
    copy = " ".join(f"c{i}" for i in range(50))
    rows += [(10, copy), (10, copy), (None, copy + " more"), (11, "a b " * 40), (12, "é\x1fz")]
    assert found(spark, rows) == brute(rows, 35)


def test_one_passage_in_a_third_of_all_documents(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(i, f"{passage} own{i} words{i}" if i % 3 == 0 else f"quite other{i} text {i}") for i in range(600)]
    assert found(spark, rows) == brute(rows, 35)


def test_empty_table(spark):
    assert found(spark, []) == []

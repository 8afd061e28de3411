import math
import random

from vacantia.llm.toxicity import ToxicityModel, Lookup, fit_toxicity, maximal_segments, score_toxicity

LABELS = "doc_id bigint, quality int, toxic int"


def brute_segments(scores):
    """Ruzzo and Tompa's definition: take the best segment, then both sides of it."""
    best = None
    for i in range(len(scores)):
        for j in range(i + 1, len(scores) + 1):
            total = sum(scores[i:j])
            if total > 0 and (best is None or total > best[2] or (total == best[2] and j - i < best[1] - best[0])):
                best = (i, j, total)
    if best is None:
        return []
    i, j, _ = best
    left = brute_segments(scores[:i])
    right = [(a + j, b + j, s) for a, b, s in brute_segments(scores[j:])]
    return [*left, best, *right]


def test_maximal_segments_match_their_definition():
    rng = random.Random(6)
    for _ in range(400):
        scores = [rng.choice((-1, 1)) * rng.randint(1, 1 << 20) / 64 for _ in range(rng.randint(0, 14))]
        assert maximal_segments(scores) == brute_segments(scores)


def corpus(rng, n):
    rows, labels = [], []
    for i in range(n):
        words = [rng.choice(("alpha", "beta", "gamma", "delta", "omega")) + str(rng.randint(0, 30)) for _ in range(rng.randint(5, 120))]
        toxic = i % 4 == 0
        if toxic:
            at = rng.randrange(len(words))
            words[at:at] = rng.sample(["idiot", "clown", "scum"], rng.randint(1, 3))
        rows.append((i, " ".join(words), "en"))
        labels.append((i, None, int(toxic)))
    return rows, labels


def test_toxic_documents_are_found_outside_the_training_rows(spark):
    rows, labels = corpus(random.Random(1), 900)
    docs, marks = spark.createDataFrame(rows, "doc_id bigint, text string, score string"), spark.createDataFrame(labels, LABELS)
    found = score_toxicity(docs, fit_toxicity(docs, marks, sample_per_class=300)).collect()
    test = [(row.predicted, labels[row.doc_id][2]) for row in found if row.held_out]
    assert len(test) > 100 and sum(a == b for a, b in test) / len(test) > 0.98
    for row in found:
        words = rows[row.doc_id][1].split()
        insults = [i for i, w in enumerate(words) if w in ("idiot", "clown", "scum")]
        if insults:
            assert any(p.begin <= insults[0] < p.end for p in row.passages)


def test_nulls_empty_and_no_labels(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "idiot"), (3, "a " * 100_000), (3, "a")], "doc_id bigint, text string")
    empty = spark.createDataFrame([], LABELS)
    found = score_toxicity(docs, fit_toxicity(docs, empty)).collect()
    assert len(found) == 5 and {row.score for row in found} == {0.0}
    only_clean = spark.createDataFrame([(1, 1, 0), (2, 1, None), (None, 0, 1)], LABELS)
    assert {row.predicted for row in score_toxicity(docs, fit_toxicity(docs, only_clean)).collect()} == {0}
    assert score_toxicity(docs.limit(0), ToxicityModel()).collect() == []


def test_gaps_are_one_step():
    model = ToxicityModel(weights={"bad": 3.0})
    text = "bad x bad " + "x " * 20 + "bad"
    words, passages = model.passages(text, Lookup(model.weight))
    assert words == 24 and [(b, e) for b, e, _ in passages] == [(0, 3), (23, 24)]


def test_accuracy_on_the_given_labels(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    found = score_toxicity(docs, fit_toxicity(docs, labels)).join(labels, "doc_id").where("held_out").collect()
    assert sum(row.predicted == row.toxic for row in found) / len(found) > 0.9


def test_tokens_are_counted_over_all_labelled_rows_and_texts_once(spark, monkeypatch):
    """Against counts by hand: copies and repeats of a word count once, held-out rows and unlabelled ones not."""
    from collections import Counter

    from vacantia.llm import toxicity
    from vacantia.llm.labelled import training_labels
    from vacantia.llm.session import Scratch

    rows, labels = corpus(random.Random(3), 400)
    rows += [(1000 + i, "clown clown " + rows[0][1], "en") for i in range(30)] + [(2000 + i, rows[4][1], "en") for i in range(50)]
    labels += [(1000 + i, None, 1) for i in range(30)] + [(2000 + i, None, 1) for i in range(50)]
    docs, marks = spark.createDataFrame(rows, "doc_id bigint, text string, kind string"), spark.createDataFrame(labels, LABELS)
    training = training_labels(marks, "toxic")
    known = {r.doc_id: r.label for r in training.collect()}
    texts = {}
    for i, text, _ in rows:
        if i in known:
            texts[text] = max(texts.get(text, 0), known[i])
    counts, totals = Counter(), Counter()
    for text, kind in texts.items():
        for word in set(toxicity.words_of(text)):
            totals[kind] += 1
            for token in toxicity.tokens_of(word):
                counts[token, kind] += 1
    everywhere = Counter(t for _, text, _ in rows for w in set(toxicity.words_of(text)) for t in toxicity.tokens_of(w))
    words = sum(len(set(toxicity.words_of(text))) for _, text, _ in rows)
    wanted = {}
    for token in {t for t, _ in counts}:
        prior = (toxicity.PRIOR_SHARE * totals[1] + 1) * (everywhere[token] + 0.5) / (words + 1)
        y1, y0 = counts[token, 1] + prior, counts[token, 0] + prior
        size = toxicity.PRIOR_SHARE * totals[1] + 1
        delta = math.log(y1 / (totals[1] + size - y1)) - math.log(y0 / (totals[0] + size - y0))
        if delta / math.sqrt(1 / y1 + 1 / y0) >= toxicity.LEAST_Z and delta > toxicity.DRIFT:
            wanted[token] = (delta, counts[token, 0])
    assert {"clown", "idiot", "scum"} <= set(wanted)
    for known_tokens, counted in ((200_000, 1_000_000), (0, 50)):  # told to tasks, or all words counted
        monkeypatch.setattr(toxicity, "KNOWN_TOKENS", known_tokens)
        monkeypatch.setattr(toxicity, "_COUNTED", counted)
        found, clean = toxicity._significant(docs.repartition(5), training, Scratch(spark))
        assert clean == totals[0] and set(found) == set(wanted)
        assert all(abs(found[t][0] - wanted[t][0]) < 1e-9 and found[t][1] == wanted[t][1] for t in wanted)

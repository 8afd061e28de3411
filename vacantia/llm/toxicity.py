"""Toxic passages by maximum-scoring segments of token log-odds.

1. Tokens are counted in all labelled rows to learn from, in each task first. A token is a
   word or the beginning of a word (4, 5 or 6 letters). Of rows with one text one counts,
   and a word counts once in a text: neither copies nor a text that repeats itself make a
   habit. What cannot be significant whatever all documents say is left out by arithmetic.
2. The uses of the rest are counted in all documents. Log-odds of toxic against clean use
   have a Dirichlet prior proportional to the use in all documents; all tokens whose
   log-odds are significant make the model, however many they are.
3. A document's words score their log-odds less a constant. One linear scan finds all
   maximal scoring segments (Ruzzo and Tompa 1999).
4. By extreme-value statistics (Karlin and Altschul 1990) a segment of score ``s`` in
   ``n`` words is expected ``K n exp(-lambda s)`` times in clean text. The significance of
   the best segment and of all significant ones is turned into a probability by a
   logistic model of the sampled documents.

Rules: a null text is the empty text; it has no passage and scores as such. Words are
runs of letters, digits and underscores of the lower-cased text. Without labels of both
kinds no token is significant and every score is the prior rate (0 without any label).
Repeated rows are scored one by one.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantia.llm.bitset import fitting, has
from vacantia.llm.labelled import fit_logistic, held_out, logistic, sampled_docs, training_labels
from vacantia.llm.session import Scratch

#: Labelled documents of each kind that the calibration reads.
SAMPLE_PER_CLASS = 3000
#: Candidate tokens that tasks are told; with more, tasks count all words.
KNOWN_TOKENS = 200_000
#: Words that a task counts before it hands them on.
_COUNTED = 1_000_000
PREFIXES = (4, 5, 6)
#: Words of the Dirichlet prior, as a share of the words of toxic documents.
PRIOR_SHARE = 0.1
LEAST_Z = 3.0
DRIFT = 0.4
SIGNIFICANT = 0.05
_WORDS = re.compile(r"\w+")
_REMEMBERED = 300_000


def words_of(text: str) -> list[str]:
    return _WORDS.findall(text.lower())


def tokens_of(word: str) -> list[str]:
    return [word, *(f"{word[:n]}*" for n in PREFIXES if len(word) > n)]


class Lookup(dict):
    """What a function says of each word, remembered for a bounded number of words."""

    def __init__(self, function):
        super().__init__()
        self.function = function

    def __missing__(self, word: str):
        if len(self) >= _REMEMBERED:
            self.clear()
        found = self[word] = self.function(word)
        return found


def maximal_segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments as ``(begin, end, score)``, end exclusive."""
    # Each entry: begin, end, sum before the segment, sum with the segment.
    found: list[tuple[int, int, float, float]] = []
    total = 0.0
    for i, score in enumerate(scores):
        before = total
        total += score
        if score <= 0:
            continue
        begin, left, right = i, before, total
        while found:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= left:
                j -= 1
            if j < 0 or found[j][3] >= right:
                break
            begin, left = found[j][0], found[j][2]
            del found[j:]
        found.append((begin, i + 1, left, right))
    return [(begin, end, right - left) for begin, end, left, right in found]


@dataclass
class ToxicityModel:
    weights: dict[str, float] = field(default_factory=dict)
    rate: float = 1.0  # lambda
    scale: float = 1.0  # K
    calibration: np.ndarray | None = None
    prior: float = 0.0

    def weight(self, word: str) -> float:
        known = [self.weights[t] for t in tokens_of(word) if t in self.weights]
        return max(known, default=0.0)

    def passages(self, text: str, lookup: Lookup) -> tuple[int, list[tuple[int, int, float]]]:
        """Number of words, and all maximal segments in word positions.

        Between scoring words the score only falls, so each such gap is one step.
        """
        words = words_of(text)
        weights = list(map(lookup.__getitem__, words))
        at = [i for i, w in enumerate(weights) if w > DRIFT]
        steps: list[float] = []
        for k, i in enumerate(at):
            steps.append(-DRIFT * (i - (at[k - 1] + 1 if k else 0)))
            steps.append(weights[i] - DRIFT)
        segments = maximal_segments(steps)
        return len(words), [(at[b // 2], at[(e - 1) // 2] + 1, s) for b, e, s in segments]

    def expected(self, words: int, score: float) -> float:
        return self.scale * max(1, words) * math.exp(-self.rate * score)

    def evidence(self, words: int, segments: list[tuple[int, int, float]]) -> tuple[float, float, float]:
        """Significance of the best segment, of all significant ones, and how many those are."""
        surprises = [-math.log(max(1e-300, -math.expm1(-self.expected(words, s)))) for _, _, s in segments]
        significant = [x for x in surprises if x >= -math.log(SIGNIFICANT)]
        return min(40.0, max(surprises, default=0.0)), math.log1p(sum(significant)), math.log1p(len(significant))

    def scores(self, evidence: np.ndarray) -> np.ndarray:
        if self.calibration is None:
            return np.full(len(evidence), self.prior)
        return logistic(evidence, self.calibration)


def _word_counts(texts: DataFrame, kinds: int, wanted: set[str] | None = None) -> DataFrame:
    """``word, kind, n``: how many texts of each kind have a word, summed in each task.

    With ``wanted`` only words that have such a token are told. The word '' stands for all
    words of all texts.
    """
    shared = texts.sparkSession.sparkContext.broadcast(wanted)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        told = Lookup(lambda word: known is None or any(t in known for t in tokens_of(word)))
        found, totals = [Counter() for _ in range(kinds)], [0] * kinds

        def rows() -> Iterator[pa.RecordBatch]:
            for kind, own in enumerate(found):
                words = [w for w in own if told[w]]
                columns = {"word": words, "kind": [kind] * len(words), "n": [own[w] for w in words]}
                yield pa.RecordBatch.from_pydict(columns, _COUNTS)
                own.clear()

        for batch in batches:
            for text, kind in zip(batch.column("text").to_pylist(), batch.column("kind").to_pylist(), strict=True):
                own = set(words_of(text or ""))
                totals[kind] += len(own)
                found[kind].update(own)
            if sum(map(len, found)) > _COUNTED:
                yield from rows()
        yield from rows()
        yield pa.RecordBatch.from_pydict({"word": [""] * kinds, "kind": list(range(kinds)), "n": totals}, _COUNTS)

    counts = texts.select("text", "kind").mapInArrow(count, "word string, kind int, n bigint")
    return counts.groupBy("word", "kind").agg(F.sum("n").alias("n"))


_COUNTS = pa.schema([("word", pa.string()), ("kind", pa.int32()), ("n", pa.int64())])


def _token_column() -> Column:
    """``tokens_of`` as an expression."""
    beginnings = [F.when(F.length("word") > n, F.concat(F.substring("word", 1, n), F.lit("*"))) for n in PREFIXES]
    return F.explode(F.array_compact(F.array(F.col("word"), *beginnings))).alias("token")


def _labelled_texts(docs: DataFrame, training: DataFrame, scratch: Scratch) -> DataFrame:
    """``text, kind`` of the rows to learn from, one row of each text.

    Only texts that a bit array of bounded size does not rule out are shuffled.
    """
    digest = F.xxhash64(F.coalesce("text", F.lit(""))).alias("digest")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest).join(training, "doc_id")
    # Of rows of one text the least id stands for all; toxic if one of them is.
    firsts = rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.max("label").alias("kind"))
    firsts = scratch.stage(firsts, "labelled-texts")
    hashes = firsts.select(F.xxhash64("doc_id").alias("hash"))
    shared = docs.sparkSession.sparkContext.broadcast(fitting(hashes, "hash"))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            likely = has(shared.value, batch.column("hash").to_numpy().view(np.uint64))
            yield batch.filter(pa.array(likely)).select(["doc_id", "digest", "text"])

    texts = docs.where(F.col("doc_id").isNotNull()).select(
        F.col("doc_id").cast("long").alias("doc_id"), digest, "text", F.xxhash64(F.col("doc_id").cast("long")).alias("hash")
    )
    likely = texts.mapInArrow(choose, "doc_id bigint, digest bigint, text string")
    return likely.join(firsts, ["doc_id", "digest"]).dropDuplicates(["doc_id", "digest"]).select("text", "kind")


def least_uses(clean: float, toxic: float) -> int:
    """Fewest toxic uses of a token with which its log-odds can be significant at all.

    Whatever its uses and prior elsewhere, ``y`` in all: ``z`` of ``k`` toxic uses and a
    prior ``p <= y`` is at most the greatest over ``y`` of the value here.
    """
    ratio = (clean + 1) / (toxic + 1)
    y = np.exp(np.linspace(np.log(1e-3), np.log(1e6), 4000))
    k = 1
    while k < 1000:
        # Half a use more than counted bounds what the prior may add.
        z = np.log(np.maximum(1e-300, (k + 0.5) * 1.1 * ratio / y)) / np.sqrt(1 / (k + 0.5) + 1 / y)
        if z.max() >= LEAST_Z:
            return k
        k += 1
    return k


def _significant(docs: DataFrame, training: DataFrame, scratch: Scratch) -> tuple[dict[str, tuple[float, float]], float]:
    """Log-odds and clean uses of all significant tokens, and the clean words counted."""
    labelled = scratch.stage(_word_counts(_labelled_texts(docs, training, scratch), 2), "labelled-words")
    totals = {row.kind: row.n for row in labelled.where("word = ''").collect()}  # two rows
    clean, toxic = totals.get(0, 0), totals.get(1, 0)
    if not toxic or not clean:
        return {}, 0.0
    tokens = labelled.where("word <> ''").select(_token_column(), "kind", "n").groupBy("token").agg(
        F.sum(F.when(F.col("kind") == 1, F.col("n")).otherwise(0)).alias("toxic"),
        F.sum(F.when(F.col("kind") == 0, F.col("n")).otherwise(0)).alias("clean"),
    )
    # A prior draws both rates together, so log-odds of no more than these cannot pass.
    likelier = F.col("toxic") * F.lit(float(clean)) > F.col("clean") * F.lit(float(toxic))
    candidates = scratch.stage(tokens.where((F.col("toxic") >= least_uses(clean, toxic)) & likelier), "candidate-tokens")
    wanted = None
    if candidates.count() <= KNOWN_TOKENS:
        wanted = {row.token for row in candidates.select("token").collect()}  # KNOWN_TOKENS at most
    everywhere = scratch.stage(_word_counts(docs.select("text", F.lit(0).alias("kind")), 1, wanted), "all-words")
    total = everywhere.where("word = ''").agg(F.sum("n")).first()[0] or 0
    uses = everywhere.where("word <> ''").select(_token_column(), "n")
    uses = uses.join(candidates.select("token"), "token", "left_semi").groupBy("token").agg(F.sum("n").alias("uses"))
    strength = PRIOR_SHARE * toxic + 1
    prior = F.lit(strength) * (F.col("uses") + 0.5) / F.lit(total + 1.0)
    y1, y0 = F.col("toxic") + prior, F.col("clean") + prior
    # The rest of the words, with the rest of the prior.
    delta = F.log(y1 / (F.lit(toxic + strength) - y1)) - F.log(y0 / (F.lit(clean + strength) - y0))
    judged = candidates.join(uses, "token").select("token", "clean", delta.alias("delta"), (delta / F.sqrt(1 / y1 + 1 / y0)).alias("z"))
    found = judged.where((F.col("z") >= LEAST_Z) & (F.col("delta") > DRIFT)).collect()  # the model
    return {row.token: (row.delta, float(row.clean)) for row in found}, float(clean)


def _karlin_rate(found: dict[str, tuple[float, float]], clean: float) -> float:
    """The positive root of the mean of ``exp(lambda * score)`` over clean words being 1."""
    weights = {t: delta for t, (delta, _) in found.items()}
    share = {t: (uses + 0.5) / (clean + 1) for t, (_, uses) in found.items()}
    rest = max(0.0, 1 - sum(share.values()))

    def excess(rate: float) -> float:
        gain = sum(p * math.exp(min(600.0, rate * (weights[t] - DRIFT))) for t, p in share.items())
        return gain + rest * math.exp(-rate * DRIFT) - 1

    low, high = 1e-3, 1e-2
    while excess(high) < 0 and high < 50:
        high *= 2
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if excess(middle) < 0 else (low, middle)
    return high


def fit_toxicity(docs: DataFrame, labels: DataFrame, sample_per_class: int = SAMPLE_PER_CLASS) -> ToxicityModel:
    """Learn from ``docs(doc_id, text)`` and ``labels(doc_id, toxic)``.

    The driver receives the significant tokens, which are the model, at most
    ``KNOWN_TOKENS`` candidates for them, and three numbers for each of at most
    ``2 * sample_per_class`` documents.
    """
    training = training_labels(labels, "toxic")
    sizes = {row.label: row["count"] for row in training.groupBy("label").count().collect()}
    prior = sizes.get(1, 0) / max(1, sum(sizes.values()))
    if len(sizes) < 2:
        return ToxicityModel(prior=prior)
    scratch = Scratch(docs.sparkSession)
    tokens, clean_words = _significant(docs, training, scratch)
    scratch.clear()
    if not tokens:
        return ToxicityModel(prior=prior)
    model = ToxicityModel(weights={t: delta for t, (delta, _) in tokens.items()}, prior=prior)
    model.rate = _karlin_rate(tokens, clean_words)
    sample = sampled_docs(docs, labels, "toxic", sample_per_class)

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = Lookup(model.weight)
        for batch in batches:
            found = [model.passages(text or "", lookup) for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("label"),
                    batch.column("weight"),
                    pa.array([n for n, _ in found], pa.int64()),
                    pa.array([[s for _, _, s in own] for _, own in found], pa.list_(pa.float64())),
                ],
                ["label", "weight", "words", "scores"],
            )

    schema = "label int, weight double, words bigint, scores array<double>"
    rows = sample.mapInArrow(segments, schema).collect()
    clean = [row for row in rows if row.label == 0]
    # K from the segments that clean documents have above the smallest weight.
    floor = min(model.weights.values()) - DRIFT
    chance = sum(1 for row in clean for s in row.scores if s >= floor)
    model.scale = (chance + 0.5) / (max(1, sum(row.words for row in clean)) * math.exp(-model.rate * floor))
    x = np.array([model.evidence(row.words, [(0, 0, s) for s in row.scores]) for row in rows])
    y, weight = np.array([row.label for row in rows], float), np.array([row.weight for row in rows])
    model.calibration = fit_logistic(x, y, weight)
    return model


_SCORED = "doc_id bigint, score double, passages array<struct<begin:bigint,end:bigint,score:double>>"
_SCORED_ARROW = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("score", pa.float64()),
        ("passages", pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))),
    ]
)


def score_toxicity(docs: DataFrame, model: ToxicityModel, threshold: float = 0.5) -> DataFrame:
    """``doc_id, held_out, score, predicted, passages`` of every row.

    ``passages`` are the maximal segments in word positions, end exclusive.
    """

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = Lookup(model.weight)
        for batch in batches:
            found = [model.passages(text or "", lookup) for text in batch.column("text").to_pylist()]
            scores = model.scores(np.array([model.evidence(n, own) for n, own in found]).reshape(-1, 3))
            passages = [[{"begin": b, "end": e, "score": s} for b, e, s in own] for _, own in found]
            columns = {"doc_id": batch.column("doc_id").to_pylist(), "score": scores.tolist(), "passages": passages}
            yield pa.RecordBatch.from_pydict(columns, _SCORED_ARROW)

    scored = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(score, _SCORED)
    return scored.select(
        "doc_id",
        F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
        "passages",
    )

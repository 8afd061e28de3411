"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad. The field sees features of a line and of its neighbours and
how labels follow one another. It learns from documents labelled as a whole: lines of
good documents are good; lines of bad documents start as bad, and after each fit those
that the field finds good are relabelled, while the worst line of a bad document stays
bad. Forward-backward marginals, weighted by the lines' length, give the share of bad
text in a document; a logistic model of the labelled sample turns it into a score.

Rules: a null text is the empty text, which is one empty line. Lines end with ``\\n``.
Without labels of both kinds every score is the prior rate (0.5 without any label).
Repeated rows are scored one by one; id, language and source are no inputs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantia.llm.labelled import fit_logistic, held_out, logistic, sampled_docs, training_labels

#: Labelled documents of each kind the field learns from.
SAMPLE_PER_CLASS = 1500
#: Texts whose lines are in memory at once, by characters; a longer text stands alone.
TEXT_AT_ONCE = 2_000_000
RELABELLINGS = 3

_UPPER = bytes(range(65, 91))
_DIGITS = b"0123456789"
_MARKS = b"$%&*#!|@^~<>{}[]\\/=+_`"
_POINTS = b".,;:?'\"()-"
#: Features of a neighbouring line that a line sees, by position in its own list.
_SEEN = (1, 2, 6, 7, 8, 10)


def line_features(text: str) -> tuple[list[list[float]], list[int]]:
    """Features and length of each line of a text."""
    lines = text.split("\n")
    count: dict[str, int] = {}
    for line in lines:
        count[line] = count.get(line, 0) + 1
    rows = []
    for line in lines:
        raw = line.encode()
        size = len(raw)
        per = 1 / max(1, size)
        words = line.split()
        n = len(words)
        per_word = 1 / max(1, n)
        rows.append(
            [
                np.log1p(size),
                (size - len(raw.translate(None, _UPPER))) * per,
                (size - len(raw.translate(None, _MARKS))) * per,
                (size - len(raw.translate(None, _DIGITS))) * per,
                (size - len(raw.translate(None, _POINTS))) * per,
                min(30.0, size * per_word),
                len(set(words)) * per_word if n else 1.0,
                len(set(zip(words, words[1:]))) / (n - 1) if n > 1 else 1.0,
                sum(map(str.__eq__, words, words[1:])) * per_word,
                line.count("|") * per_word,
                float(count[line] > 1 and size > 0),
                float(n <= 3),
                float(line[-1:] in ".!?"),
                float(n == 0),
            ]
        )
    return rows, [len(line) + 1 for line in lines]


_OWN = len(line_features("")[0][0])
WIDTH = _OWN + 2 * len(_SEEN) + 2


class Lines:
    """Lines of many documents, packed by position so that chains run side by side.

    Documents are ordered by falling number of lines; the lines at position ``t`` of all
    documents that have one stand at ``start[t] : start[t] + active[t]``.
    """

    def __init__(self, documents: list[tuple[list[list[float]], list[int]]]):
        sizes = np.array([len(lengths) for _, lengths in documents], np.int64)
        self.order = np.argsort(-sizes, kind="stable")
        self.sizes = sizes[self.order]
        steps = int(sizes.max()) if len(sizes) else 0
        self.active = np.array([np.searchsorted(-self.sizes, -t, side="left") for t in range(steps)], np.int64)
        self.start = np.concatenate(([0], np.cumsum(self.active)))
        own = np.zeros((int(sizes.sum()), _OWN))
        self.length = np.zeros(len(own))
        self.doc = np.zeros(len(own), np.int64)
        before, after = np.zeros((len(own), len(_SEEN) + 1)), np.zeros((len(own), len(_SEEN) + 1))
        for place, i in enumerate(self.order):
            rows, lengths = documents[i]
            at = self.start[: len(lengths)] + place
            features = np.asarray(rows)
            own[at], self.length[at], self.doc[at] = features, lengths, i
            seen = np.column_stack([features[:, _SEEN], np.ones(len(features))])
            before[at[1:]], after[at[:-1]] = seen[:-1], seen[1:]
        self.features = np.column_stack([own, before, after])
        self.documents = len(documents)

    def __len__(self) -> int:
        return len(self.doc)

    def at(self, t: int, count: int | None = None) -> slice:
        return slice(self.start[t], self.start[t] + (self.active[t] if count is None else count))


def _log_add(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.logaddexp(a, b)


@dataclass
class LineField:
    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray  # of the bad label; the last one is the bias
    links: np.ndarray  # links[a, b]: label a is followed by b; 1 is bad
    calibration: np.ndarray | None = None
    prior: float = 0.5

    def inputs(self, lines: Lines) -> np.ndarray:
        x = np.clip((lines.features - self.mean) / self.spread, -8, 8)
        return np.column_stack([x, np.ones(len(x))])

    def marginals(self, lines: Lines, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Probability that each line is bad, and expected counts of each link."""
        bad = x @ self.weights
        steps = len(lines.active)
        forward, backward = np.zeros((len(lines), 2)), np.zeros((len(lines), 2))
        score = np.column_stack([np.zeros(len(lines)), bad])
        for t in range(steps):
            now = lines.at(t)
            if t == 0:
                forward[now] = score[now]
                continue
            past = forward[lines.at(t - 1, lines.active[t])]
            for b in (0, 1):
                forward[now, b] = score[now, b] + _log_add(past[:, 0] + self.links[0, b], past[:, 1] + self.links[1, b])
        expected = np.zeros((2, 2))
        for t in range(steps - 1, 0, -1):
            now, past = lines.at(t), lines.at(t - 1, lines.active[t])
            ahead = score[now] + backward[now]
            for a in (0, 1):
                backward[past, a] = _log_add(ahead[:, 0] + self.links[a, 0], ahead[:, 1] + self.links[a, 1])
            whole = _log_add(forward[now, 0] + backward[now, 0], forward[now, 1] + backward[now, 1])
            for a in (0, 1):
                for b in (0, 1):
                    expected[a, b] += np.exp(forward[past, a] + self.links[a, b] + ahead[:, b] - whole).sum()
        both = forward + backward
        return np.exp(both[:, 1] - _log_add(both[:, 0], both[:, 1])), expected

    def fit(self, lines: Lines, labels: np.ndarray, weight: np.ndarray, rounds: int = 100) -> None:
        """Maximum likelihood of the labels, with a small penalty, by Adam steps.

        ``weight`` is per line and the same for all lines of a document; links count by
        documents of either kind alike.
        """
        x = self.inputs(lines)
        seen = np.zeros((2, 2))
        for t in range(1, len(lines.active)):
            a, b = labels[lines.at(t - 1, lines.active[t])], labels[lines.at(t)]
            np.add.at(seen, (a, b), 1)
        theta = np.concatenate([self.weights, self.links.ravel()])
        first, second = np.zeros_like(theta), np.zeros_like(theta)
        for step in range(1, rounds + 1):
            self.weights, self.links = theta[:-4], theta[-4:].reshape(2, 2)
            p, expected = self.marginals(lines, x)
            gradient = np.concatenate([x.T @ (weight * (labels - p)), (seen - expected).ravel()]) / max(1, len(lines))
            gradient -= 1e-4 * theta
            first = 0.9 * first + 0.1 * gradient
            second = 0.99 * second + 0.01 * gradient**2
            theta = theta + 0.08 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
        self.weights, self.links = theta[:-4], theta[-4:].reshape(2, 2)

    def bad_share(self, lines: Lines) -> np.ndarray:
        """Per document: bad share of the text, of its worst line, and the log length."""
        p, _ = self.marginals(lines, self.inputs(lines))
        total = np.bincount(lines.doc, lines.length, lines.documents)
        share = np.bincount(lines.doc, lines.length * p, lines.documents) / np.maximum(total, 1)
        worst = np.zeros(lines.documents)
        np.maximum.at(worst, lines.doc, p)
        return np.column_stack([share, worst, np.log1p(total) / 10])

    def scores(self, lines: Lines) -> np.ndarray:
        if self.calibration is None:
            return np.full(lines.documents, self.prior)
        return logistic(self.bad_share(lines), self.calibration)


def fit_line_field(docs: DataFrame, labels: DataFrame, sample_per_class: int = SAMPLE_PER_CLASS) -> LineField:
    """Learn from ``docs(doc_id, text)`` and ``labels(doc_id, quality)``.

    The driver receives line features of at most ``2 * sample_per_class`` documents, no
    texts.
    """
    sizes = {row.label: row["count"] for row in training_labels(labels, "quality").groupBy("label").count().collect()}
    prior = sizes.get(1, 0) / sum(sizes.values()) if sizes else 0.5

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                rows, lengths = line_features(row["text"] or "")
                columns = {"label": [row["label"]], "weight": [row["weight"]]}
                columns |= {"features": [np.asarray(rows, np.float32).tobytes()], "lengths": [lengths]}
                yield pa.RecordBatch.from_pydict(columns)

    sample = sampled_docs(docs, labels, "quality", sample_per_class)
    # Sorted, so that the same rows always give the same model.
    found = sample.mapInArrow(features, "label bigint, weight double, features binary, lengths array<bigint>").collect()
    found.sort(key=lambda row: (row.label, bytes(row.features)))
    documents = [(np.frombuffer(row.features, np.float32).reshape(-1, _OWN), row.lengths) for row in found]
    field = LineField(np.zeros(WIDTH), np.ones(WIDTH), np.zeros(WIDTH + 1), np.zeros((2, 2)), prior=prior)
    good = np.array([row.label for row in found], np.int64)
    if len(set(good.tolist())) < 2:
        return field
    lines = Lines(documents)
    field.mean, field.spread = lines.features.mean(0), lines.features.std(0) + 1e-3
    of_bad = good[lines.doc] == 0
    labels_now = of_bad.astype(np.int64)
    # Every document counts alike, and both kinds together alike.
    kind = np.where(good == 0, 0.5 / max(1, (good == 0).sum()), 0.5 / max(1, (good == 1).sum()))
    size = np.bincount(lines.doc, minlength=len(good))
    weight = (kind / size)[lines.doc] * len(lines)
    for turn in range(RELABELLINGS):
        field.fit(lines, labels_now, weight)
        if turn == RELABELLINGS - 1:
            break
        p, _ = field.marginals(lines, field.inputs(lines))
        worst = np.zeros(len(good))
        np.maximum.at(worst, lines.doc, p)
        labels_now = (of_bad & ((p >= 0.5) | (p >= worst[lines.doc]))).astype(np.int64)
    stands_for = np.array([row.weight for row in found])
    field.calibration = fit_logistic(field.bad_share(lines), good.astype(float), stands_for)
    return field


def quality_score(field: LineField, text: Column) -> Column:
    """The score of a text, between 0 and 1; documents keep their other columns."""

    @F.arrow_udf("double")
    def score(column: pa.Array) -> pa.Array:
        texts = column.to_pylist()
        parts, at = [], 0
        while at < len(texts):
            end, held = at + 1, len(texts[at])
            while end < len(texts) and held + len(texts[end]) <= TEXT_AT_ONCE:
                held += len(texts[end])
                end += 1
            parts.append(field.scores(Lines([line_features(text) for text in texts[at:end]])))
            at = end
        return pa.array(np.concatenate(parts) if parts else np.zeros(0))

    return score(F.coalesce(text, F.lit("")))


def score_quality(docs: DataFrame, field: LineField, threshold: float = 0.3) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row."""
    scored = docs.select("doc_id", quality_score(field, F.col("text")).alias("score"))
    return scored.select(
        "doc_id",
        F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )

"""Quality classifier: naive Bayes support vectors over byte n-gram indicators.

A text's features say which byte n-grams of 1 to 3 bytes it has, and which n-grams of
"same word as before" marks: stretches of repeated words, and the share of 3-word windows
met before in the text. Longer texts have more features, so a vector is scaled to length 1. Each feature is multiplied by the log of
the ratio of its class counts, and a linear hinge-loss model is fitted by dual
coordinate descent. Margins become scores by a logistic curve fitted to rows that the
model didn't see.

Fitted on at most TRAIN_ROWS labelled rows (those with the smallest hash of doc_id):
their features are extracted where the rows lie and gathered in one task, at most DIM
numbers of four bytes for each; the model has DIM weights whatever the input, so it may
be broadcast. Every row is scored, whole.

Cases: null text counts as empty and gets a score as any other; rows of labels that are
null or whose document is absent aren't learned from; a doc_id with several labels
counts as 1 if at least half are 1; with labels of one class or none every score is that
class' share, or 0.5; repeated rows score alike; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinderlog.llm._text import docs_of, map_arrow, text_bytes, windows, word_hashes, workers_find_package

TRAIN_ROWS = 12_000
TRIGRAMS = 1 << 17
REPEATS = 16
DIM = 256 + 65536 + TRIGRAMS + REPEATS
EPOCHS = 15
COST = 1.0
HELD_OUT, FOLDS = 2, 4
_LONG = 1 << 22


class Grams:
    """Finds the indices of the n-grams that a text has."""

    def __init__(self) -> None:
        self.flags = np.zeros(DIM, bool)

    def __call__(self, text: bytes, words: np.ndarray) -> np.ndarray:
        base = DIM - REPEATS
        same = words[1:] == words[:-1]
        for n in range(4):  # marks in a row: 1, 2, 3, 4
            self.flags[base + n] = same.any()
            same = same[1:] & same[:-1]
        three = windows(words, 3)
        again = 1 - len(np.unique(three)) / max(1, len(three)) if len(three) else 0.0
        for n, share in enumerate((0.0, 0.02, 0.05, 0.1, 0.2, 0.3, 0.5, 0.7)):
            self.flags[base + 4 + n] = again > share
        for at in range(0, max(1, len(text)), _LONG):
            b = np.frombuffer(text[at : at + _LONG + 2], np.uint8).astype(np.uint32)
            self.flags[b] = True
            two = b[:-1] << 8 | b[1:]
            self.flags[two + 256] = True
            three = (two[:-1] << 8 | b[2:]) * np.uint32(2654435761)
            self.flags[(three >> np.uint32(15)) + 65792] = True
        found = np.flatnonzero(self.flags)
        self.flags[found] = False
        return found.astype("<u4")


def _with_words(batch: pa.RecordBatch) -> Iterator[tuple[bytes, np.ndarray]]:
    texts = text_bytes(batch.column("text"))
    return zip(texts, word_hashes(texts, False), strict=True)


def fold_of(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % FOLDS


def fit(features: list[np.ndarray], labels: np.ndarray) -> tuple[np.ndarray, float, float]:
    """Weights and the logistic curve (a, b): score = 1 / (1 + exp(-(a * margin + b)))."""
    share = float(labels.mean()) if len(labels) else 0.5
    if len(labels) < 10 or share in (0.0, 1.0):
        share = min(0.99, max(0.01, share))
        return np.zeros(DIM, np.float32), 0.0, float(np.log(share / (1 - share)))
    rng = np.random.Generator(np.random.PCG64(7))
    order = rng.permutation(len(labels))
    held, used = order[: len(order) // 5], order[len(order) // 5 :]
    sums = np.ones((2, DIM))
    for i in used:
        sums[int(labels[i]), features[i]] += 1
    ratio = np.log(sums[1] / sums[1].sum()) - np.log(sums[0] / sums[0].sum())
    sign = np.where(labels > 0, 1.0, -1.0)
    cost = COST * np.where(labels > 0, 0.5 / share, 0.5 / (1 - share))
    w, bias, alpha = np.zeros(DIM), 0.0, np.zeros(len(labels))
    norm = {i: max(1e-9, float(np.sqrt((ratio[features[i]] ** 2).sum()))) for i in used}
    for _ in range(EPOCHS):
        for i in rng.permutation(used):
            at, x = features[i], ratio[features[i]] / norm[i]
            gradient = sign[i] * (w[at] @ x + bias) - 1
            new = min(max(alpha[i] - gradient / 2, 0.0), 10 * cost[i])  # x @ x + 1 is 2
            if new != alpha[i]:
                step = (new - alpha[i]) * sign[i]
                alpha[i] = new
                w[at] += step * x
                bias += step
    weights = (w * ratio).astype(np.float32)
    squares = (ratio**2).astype(np.float32)
    margin = np.array([weights[features[i]].sum() / max(1e-9, float(np.sqrt(squares[features[i]].sum()))) + bias for i in held])
    a, b = _logistic(margin, labels[held])
    return np.concatenate([weights, squares, [np.float32(bias)]]), a, b


def _logistic(margin: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Fits score = 1 / (1 + exp(-(a * margin + b))) by Newton steps, with softened targets."""
    ones = labels.sum()
    target = np.where(labels > 0, (ones + 1) / (ones + 2), 1 / (len(labels) - ones + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        g = np.array([((p - target) * margin).sum() + 1e-3 * a, (p - target).sum()])
        v = p * (1 - p)
        h = np.array([[(v * margin**2).sum() + 1e-3, (v * margin).sum()], [(v * margin).sum(), v.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        size = min(1.0, 5 / max(1e-9, float(np.abs(step).max())))
        a, b = a - size * step[0], b - size * step[1]
    return float(a), float(b)


def train(documents: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> bytes:
    """Fits the model in one task, from features of `rows` rows at most; its bytes come to the driver."""
    docs = docs_of(documents)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("quality")).where(
        F.col("quality").isNotNull() & (fold_of(F.col("doc_id")) != HELD_OUT)
    )
    known = known.groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    chosen = docs.join(F.broadcast(known), "doc_id")  # at most `rows` ids and labels

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        own = Grams()
        for batch in batches:
            yield {"doc_id": batch.column("doc_id"), "label": batch.column("label"), "at": [own(x, w).tobytes() for x, w in _with_words(batch)]}

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        got: list[tuple[int, int, bytes]] = []
        for batch in batches:
            got += zip(*(batch.column(x).to_pylist() for x in ("doc_id", "label", "at")), strict=True)
        got.sort()
        weights, a, b = fit([np.frombuffer(x, "<u4") for _, _, x in got], np.array([x for _, x, _ in got], float))
        yield {"model": [struct.pack("<dd", a, b) + weights.astype("<f4").tobytes()]}

    found = map_arrow(map_arrow(chosen, grams, "doc_id long, label int, at binary").repartition(1), one, "model binary").collect()
    return bytes(found[0].model)


class Model:
    def __init__(self, data: bytes) -> None:
        self.a, self.b = struct.unpack_from("<dd", data)
        rest = np.frombuffer(data, "<f4", offset=16)
        self.weights, self.squares, self.bias = (rest[:DIM], rest[DIM : 2 * DIM], float(rest[-1])) if len(rest) > DIM else (rest, rest, 0.0)
        self.grams = Grams()

    def score(self, text: bytes, words: np.ndarray) -> float:
        at = self.grams(text, words)
        length = float(np.sqrt(self.squares[at].sum()))
        margin = self.weights[at].sum() / max(1e-9, length) + self.bias
        return float(1 / (1 + np.exp(-np.clip(self.a * margin + self.b, -30, 30))))


def score(documents: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    docs = docs_of(documents)
    model = docs.sparkSession.sparkContext.broadcast(train(documents, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        own = Model(model.value)
        for batch in batches:
            yield {"doc_id": batch.column("doc_id"), "score": [own.score(x, w) for x, w in _with_words(batch)]}

    scored = map_arrow(docs, run, "doc_id long, score double")
    held = F.coalesce(fold_of(F.col("doc_id")) == HELD_OUT, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep(documents: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The documents predicted as good, with all their columns; each row goes by its own text."""
    model = documents.sparkSession.sparkContext.broadcast(train(documents, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(model.value)
        for batch in batches:
            yield batch.filter(pa.array([own.score(x, w) >= threshold for x, w in _with_words(batch)], pa.bool_()))

    workers_find_package(documents.sparkSession)
    return documents.mapInArrow(run, documents.schema)

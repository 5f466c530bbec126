"""Toxicity: a convolutional text classifier over hashed word embeddings.

A word is a run of ASCII letters, digits and bytes of other characters, A-Z counting as
a-z. Its embedding is the sum of three rows of a table: those of the hashes of the word, of its
first four and of its first six bytes. Filters of one, two and three words slide over the
whole text, each filter's largest value is kept (max pooling), and a linear layer makes a
logit of what is positive. Table, filters and layer are trained together by gradient
steps in numpy.

Thresholds are calibrated by language: rows that the model didn't see give, for each
language, the logit that parts the classes best, and a text's score is 0.5 there. The
language is guessed from the text's own common words; the column `lang` is never read.
A language with few such rows uses the threshold of all.

Trained in one task on at most TRAIN_ROWS labelled rows (those with the smallest hash of
doc_id) of at most TRAIN_BYTES bytes; their words are hashed where the rows lie. The model's
size is fixed, so it may be broadcast. Every row is scored, whole, BLOCK words at a time.

Cases: null text counts as empty and gets a score as any other; rows of labels that are
null or whose document is absent aren't learned from; a doc_id with several labels
counts as 1 if at least half are 1; of labelled rows that repeat a doc_id one is learned from;
with labels of one class or none every score is that class' share, or 0.5; repeated rows
score alike; a null doc_id is never held out; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinderlog.llm._text import PIECE, docs_of, map_arrow, span_hashes, text_bytes

TRAIN_ROWS = 12_000
TRAIN_BYTES = 1 << 16
#: Table rows of words, of first four and of first six bytes; the row after them is the empty place's.
SIZES = (1 << 16, 1 << 14, 1 << 15)
ROWS = sum(SIZES)
EMPTY = ROWS
DIM, FILTERS, WIDTHS = 12, 8, (1, 2, 3)
EPOCHS, BATCH, RATE = 8, 32, 0.08
#: Words convolved at once.
BLOCK = 1 << 16
HELD_OUT, FOLDS = 0, 5
#: Calibration rows of each class that a language's own threshold takes.
LEAST = 8

# Common words that tell a language.
LANGUAGES = {
    "en": "the and of to in is that for was with it are this not have",
    "fr": "le les des et une est dans pour que qui sur pas avec du au",
    "de": "der die und das nicht ein ist mit auf den von zu sich dem eine",
    "es": "el los las que del una por con para como en y se al lo",
}

_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _ids_of_buffer(buffer: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Table rows (n, 3) of a buffer's words, and where they start."""
    b = _LOWER[np.frombuffer(buffer, np.uint8)]
    edge = np.zeros(len(b) + 2, bool)
    edge[1:-1] = _WORD[b]
    starts, ends = np.flatnonzero(~edge[:-1] & edge[1:]), np.flatnonzero(edge[:-1] & ~edge[1:])
    out, base, lowered = np.empty((len(starts), 3), np.int32), 0, b.tobytes()
    for i, (rows, upto) in enumerate(zip(SIZES, (ends, np.minimum(ends, starts + 4), np.minimum(ends, starts + 6)), strict=True)):
        out[:, i] = (span_hashes(lowered, starts, upto) % np.uint64(rows)).astype(np.int32) + base
        base += rows
    return out, starts


def word_ids(texts: list[bytes]) -> list[np.ndarray]:
    """For each text, the table rows (n, 3) of its words; small texts are hashed together, long ones in pieces."""
    out: list[np.ndarray] = []
    group: list[bytes] = []

    def together() -> None:
        if group:
            ids, starts = _ids_of_buffer(b"\n".join(group))
            edges = np.searchsorted(starts, np.cumsum([0, *(len(x) + 1 for x in group)]))
            out.extend(ids[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True))
            group.clear()

    total = 0
    for text in texts:
        if total + len(text) > PIECE:
            together()
            total = 0
        if len(text) > PIECE:
            out.append(np.concatenate([_ids_of_buffer(x)[0] for x in _pieces(text)]))
        else:
            group.append(text)
            total += len(text) + 1
    together()
    return out


def _pieces(text: bytes) -> Iterator[bytes]:
    """text cut between words into pieces of about PIECE bytes."""
    at = 0
    while at < len(text):
        end = min(len(text), at + PIECE)
        while end < len(text) and _WORD[text[end]]:
            end += 1
        yield text[at:end]
        at = end


def _language_table() -> np.ndarray:
    """For each row of whole words, the number of the language it is a common word of, or the number of languages."""
    out = np.full(SIZES[0], len(LANGUAGES), np.uint8)
    for i, words in enumerate(LANGUAGES.values()):
        for ids in word_ids([x.encode() for x in words.split()]):
            out[ids[0, 0]] = i
    return out


class Network:
    """The table (ROWS + 1, DIM), filters by width (width, DIM, FILTERS), their biases and the last layer."""

    def __init__(self, seed: int = 7) -> None:
        rng = np.random.Generator(np.random.PCG64(seed))
        self.table = rng.normal(0, 0.1, (ROWS + 1, DIM)).astype(np.float32)
        self.table[EMPTY] = 0
        self.filters = [rng.normal(0, 0.4, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
        self.last = rng.normal(0, 0.3, len(WIDTHS) * FILTERS).astype(np.float32)
        self.offset = np.zeros(1, np.float32)

    def parameters(self) -> list[np.ndarray]:
        return [*self.filters, *self.bias, self.last, self.offset]

    def logits(self, pooled: np.ndarray) -> np.ndarray:
        return np.maximum(pooled, 0) @ self.last + self.offset[0]


def _laid_out(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of all words, each text followed by empty places so that no filter spans two; starts and word counts (1 at least)."""
    gap = max(WIDTHS) - 1
    count = np.array([max(1, len(x)) for x in docs])
    starts = np.concatenate([[0], np.cumsum(count + gap)])
    ids = np.full((starts[-1], 3), EMPTY, np.int32)
    for x, at in zip(docs, starts, strict=False):
        ids[at : at + len(x)] = x
    return ids, starts[:-1], count


def train_network(docs: list[np.ndarray], labels: np.ndarray) -> Network:
    """Gradient steps with a step size for each weight (Adagrad) on the class-weighted logistic loss."""
    net, rng = Network(), np.random.Generator(np.random.PCG64(11))
    share = labels.mean()
    weight = np.where(labels > 0, 0.5 / share, 0.5 / (1 - share)).astype(np.float32)
    seen_table, seen = np.full(ROWS + 1, 1e-3, np.float32), [np.full_like(x, 1e-3) for x in net.parameters()]
    for _ in range(EPOCHS):
        order = rng.permutation(len(docs))
        for begin in range(0, len(order), BATCH):
            chosen = order[begin : begin + BATCH]
            ids, starts, count = _laid_out([docs[i] for i in chosen])
            x = net.table[ids].sum(1)
            pooled, places = [], []
            for w, filters, bias in zip(WIDTHS, net.filters, net.bias, strict=True):
                n = len(x) - w + 1
                z = sum(x[o : o + n] @ filters[o] for o in range(w)) + bias
                at = np.stack([s + z[s : s + c].argmax(0) for s, c in zip(starts, count, strict=True)])
                places.append(at)
                pooled.append(np.take_along_axis(z, at, 0))
            h = np.concatenate(pooled, 1)
            p = 1 / (1 + np.exp(-np.clip(net.logits(h), -30, 30)))
            g = ((p - labels[chosen]) * weight[chosen] / len(chosen)).astype(np.float32)
            back = g[:, None] * net.last * (h > 0)
            grads, touched, pushes = [], [], []
            for i, (w, at) in enumerate(zip(WIDTHS, places, strict=True)):
                own = back[:, i * FILTERS : (i + 1) * FILTERS]
                grads.append(np.stack([np.einsum("bf,bfd->df", own, x[at + o]) for o in range(w)]))
                for o in range(w):
                    push = own[:, :, None] * net.filters[i][o].T
                    touched.append(ids[at + o].reshape(-1, 3))
                    pushes.append(push.reshape(-1, DIM))
            grads += [back[:, i * FILTERS : (i + 1) * FILTERS].sum(0) for i in range(len(WIDTHS))]
            grads += [np.maximum(h, 0).T @ g, g.sum(keepdims=True)]
            for value, grad, total in zip(net.parameters(), grads, seen, strict=True):
                total += grad**2
                value -= RATE / 2 * grad / np.sqrt(total)
            at, push = np.concatenate(touched), np.concatenate(pushes)
            rows, inverse = np.unique(at, return_inverse=True)
            inverse = inverse.reshape(at.shape)
            sums = np.zeros((len(rows), DIM), np.float32)
            for column in range(3):
                np.add.at(sums, inverse[:, column], push)
            seen_table[rows] += (sums**2).mean(1)
            net.table[rows] -= RATE * sums / np.sqrt(seen_table[rows])[:, None]
            net.table[EMPTY] = 0
    return net


class Scorer:
    """Scores texts: filters are applied to the table once, so that a place's value is a sum of looked-up rows."""

    def __init__(self, data: bytes) -> None:
        got = np.load(io.BytesIO(data))
        self.prior = float(got["prior"][0])
        self.thresholds, self.slope = got["thresholds"], float(got["slope"][0])
        self.language = _language_table()
        if "table" in got:
            self.last, self.offset = got["last"], float(got["offset"][0])
            self.bias = np.concatenate([got[f"bias{i}"] for i in range(len(WIDTHS))])
            self.place = np.concatenate([got["table"] @ f for i in range(len(WIDTHS)) for f in got[f"filters{i}"]], 1)

    def pooled(self, docs: list[np.ndarray]) -> np.ndarray:
        """Each text's largest value of each filter."""
        ids, starts, count = _laid_out(docs)
        gap = max(WIDTHS) - 1
        out = np.full((len(docs), len(self.bias)), -np.inf, np.float32)
        ends = starts + count
        for at in range(0, len(ids) - gap, BLOCK):
            upto = min(len(ids) - gap, at + BLOCK)
            places = self.place[ids[at : upto + gap, 0]]
            for i in (1, 2):
                places += self.place[ids[at : upto + gap, i]]
            value, column = [], 0
            for w in WIDTHS:
                z = places[: upto - at, column : column + FILTERS]
                for o in range(1, w):
                    z = z + places[o : o + upto - at, column + o * FILTERS : column + (o + 1) * FILTERS]
                value.append(z)
                column += w * FILTERS
            first, last = np.searchsorted(ends, at, "right"), np.searchsorted(starts, upto, "left")
            if last > first:
                value = np.concatenate(value, 1)
                # spans of texts and of the empty places after them by turns; only the former are kept
                edges = np.stack([np.maximum(starts[first:last], at), np.minimum(ends[first:last], upto)], 1).ravel() - at
                edges = edges[:-1] if edges[-1] == upto - at else edges
                out[first:last] = np.maximum(out[first:last], np.maximum.reduceat(value, edges)[::2])
        return out + self.bias

    def logits(self, docs: list[np.ndarray]) -> np.ndarray:
        return np.maximum(self.pooled(docs), 0) @ self.last + self.offset

    def languages(self, docs: list[np.ndarray]) -> np.ndarray:
        """The language most of whose common words a text has; the number of languages for none."""
        out = np.empty(len(docs), np.int64)
        for i, x in enumerate(docs):
            n = np.bincount(self.language[x[:, 0]], minlength=len(LANGUAGES) + 1)[: len(LANGUAGES)] if len(x) else np.zeros(1)
            out[i] = int(n.argmax()) if n.any() else len(LANGUAGES)
        return out

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if not hasattr(self, "last"):
            return np.full(len(texts), self.prior)
        out = []
        docs, words = [], 0
        for x in word_ids(texts):
            docs.append(x)
            words += len(x)
            if words > BLOCK:
                out.append(self._scores(docs))
                docs, words = [], 0
        return np.concatenate([*out, self._scores(docs)]) if docs else np.concatenate(out) if out else np.empty(0)

    def _scores(self, docs: list[np.ndarray]) -> np.ndarray:
        margin = self.slope * (self.logits(docs).astype(float) - self.thresholds[self.languages(docs)])
        return 1 / (1 + np.exp(-np.clip(margin, -30, 30)))


def best_threshold(logits: np.ndarray, labels: np.ndarray) -> float:
    """The logit above which rows are called toxic with fewest weighted errors; the middle of the widest of equally good gaps."""
    order = np.argsort(logits, kind="stable")
    x, y = logits[order], labels[order]
    share = y.mean()
    cost = np.where(y > 0, np.sqrt((1 - share) / share), 1.0)
    # errors with the first i rows called clean
    errors = np.concatenate([[0], np.cumsum(cost * (y > 0))]) + np.concatenate([np.cumsum((cost * (y == 0))[::-1])[::-1], [0]])
    low, high = np.concatenate([[x[0] - 1], x]), np.concatenate([x, [x[-1] + 1]])
    good = (errors <= errors[high > low].min() + 1e-9) & (high > low)
    at = max(np.flatnonzero(good), key=lambda i: high[i] - low[i])
    return float((low[at] + high[at]) / 2)


def fit(docs: list[np.ndarray], labels: np.ndarray) -> bytes:
    """The model's bytes: trained on four fifths of the rows, calibrated on the rest."""
    share = float(labels.mean()) if len(labels) else 0.5
    out: dict[str, np.ndarray] = {"prior": np.array([share]), "thresholds": np.zeros(len(LANGUAGES) + 1), "slope": np.ones(1)}
    order = np.random.Generator(np.random.PCG64(5)).permutation(len(labels))
    held, used = order[: len(order) // 5], order[len(order) // 5 :]
    if len(labels) >= 10 and 0 < labels[used].sum() < len(used):
        net = train_network([docs[i] for i in used], labels[used].astype(np.float32))
        out |= {"table": net.table, "last": net.last, "offset": net.offset}
        out |= {f"filters{i}": x for i, x in enumerate(net.filters)} | {f"bias{i}": x for i, x in enumerate(net.bias)}
        scorer = Scorer(_packed(out))
        rows = held if 0 < labels[held].sum() < len(held) else order
        logits, languages, y = scorer.logits([docs[i] for i in rows]).astype(float), scorer.languages([docs[i] for i in rows]), labels[rows]
        out["thresholds"][:] = best_threshold(logits, y)
        for i in range(len(LANGUAGES) + 1):
            own = languages == i
            if min(y[own].sum(), (1 - y[own]).sum()) >= LEAST:
                out["thresholds"][i] = best_threshold(logits[own], y[own])
        spread = np.abs(logits - out["thresholds"][languages])
        out["slope"][:] = 3 / max(1e-6, float(np.median(spread)))
    return _packed(out)


def _packed(arrays: dict[str, np.ndarray]) -> bytes:
    buffer = io.BytesIO()
    np.savez(buffer, **arrays)
    return buffer.getvalue()


def fold_of(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % FOLDS


def train(documents: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> bytes:
    """Fits the model in one task, from the words of `rows` texts at most; its bytes come to the driver."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("double").alias("toxic")).where(
        F.col("toxic").isNotNull() & (fold_of(F.col("doc_id")) != HELD_OUT)
    )
    known = known.groupBy("doc_id").agg((F.avg("toxic") >= 0.5).cast("int").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    short = docs_of(documents).where(F.octet_length("text") <= TRAIN_BYTES)
    chosen = short.join(F.broadcast(known), "doc_id")  # at most `rows` ids and labels
    # of rows that repeat an id one is learned from, so that the gathering task gets `rows` texts at most
    chosen = chosen.groupBy("doc_id").agg(F.min(F.struct("text", "label")).alias("x")).select("doc_id", "x.text", "x.label")

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            yield {"doc_id": batch.column("doc_id"), "label": batch.column("label"), "at": [x.astype("<i4").tobytes() for x in word_ids(text_bytes(batch.column("text")))]}

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        got: list[tuple[int, int, bytes]] = []
        for batch in batches:
            got += zip(*(batch.column(x).to_pylist() for x in ("doc_id", "label", "at")), strict=True)
        got.sort()
        yield {"model": [fit([np.frombuffer(x, "<i4").reshape(-1, 3) for _, _, x in got], np.array([x for _, x, _ in got], float))]}

    found = map_arrow(map_arrow(chosen, words, "doc_id long, label int, at binary").repartition(1), one, "model binary").collect()
    return bytes(found[0].model)


def score(documents: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    docs = docs_of(documents)
    model = docs.sparkSession.sparkContext.broadcast(train(documents, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        own = Scorer(model.value)
        for batch in batches:
            yield {"doc_id": batch.column("doc_id"), "score": own.scores(text_bytes(batch.column("text")))}

    scored = map_arrow(docs, run, "doc_id long, score double")
    held = F.coalesce(fold_of(F.col("doc_id")) == HELD_OUT, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))

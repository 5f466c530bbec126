from __future__ import annotations

import zlib

import numpy as np
import pytest

from cinderlog.llm import toxicity

DIR = "/root/testdata/sf0.1"


def brute_ids(text):
    """Words by a plain loop; their rows by hashing each alone."""
    words, now = [], b""
    for c in text + b" ":
        if bytes([c]).isalnum() and c < 128 or c >= 128:
            now += bytes([c]).lower() if c < 128 else bytes([c])
        elif now:
            words.append(now)
            now = b""
    rows = [toxicity.word_ids([w])[0] for w in words]
    return np.concatenate(rows) if rows else np.empty((0, 3), np.int32)


@pytest.mark.parametrize("text", [b"", b" ", b"One, two-three! 4x4", "Größe é ÜBER".encode(), b"idiot idiots IDIOT," * 3])
def test_words(text):
    assert (toxicity.word_ids([text])[0] == brute_ids(text)).all()
    assert all((a == b).all() for a, b in zip(toxicity.word_ids([text, b"x", text]), (brute_ids(text), brute_ids(b"x"), brute_ids(text)), strict=True))


def small_model():
    rng = np.random.default_rng(2)
    vocabulary = [f"w{i}" for i in range(300)]
    texts, labels = [], []
    for i in range(400):
        words = rng.choice(vocabulary, rng.integers(3, 60)).tolist()
        if i % 4 == 0:
            words[rng.integers(len(words))] = "vile" + "abcd"[i % 3]
        texts.append(" ".join(words).encode())
        labels.append(i % 4 == 0)
    return texts, np.array(labels, float)


def brute_pooled(scorer, net, ids):
    """Every filter at every place, one at a time."""
    rows = ids if len(ids) else np.full((1, 3), toxicity.EMPTY)
    rows = np.concatenate([rows, np.full((2, 3), toxicity.EMPTY)])
    x = net["table"][rows].sum(1)
    out = []
    for i, w in enumerate(toxicity.WIDTHS):
        z = [sum(x[p + o] @ net[f"filters{i}"][o] for o in range(w)) + net[f"bias{i}"] for p in range(len(rows) - 2)]
        out.append(np.max(z, 0))
    return np.concatenate(out)


def test_training_and_scoring(monkeypatch):
    import io

    texts, labels = small_model()
    model = toxicity.fit(toxicity.word_ids(texts), labels)
    scorer = toxicity.Scorer(model)
    scores = scorer.scores(texts)
    assert ((scores >= 0.5) == labels).mean() > 0.97
    net = np.load(io.BytesIO(model))
    some = [*texts[:20], b"", b"one"]
    ids = toxicity.word_ids(some)
    want = np.stack([brute_pooled(scorer, net, x) for x in ids])
    np.testing.assert_allclose(scorer.pooled(ids), want, atol=1e-4)
    for block in (1, 7, 64):  # texts that lie in several blocks
        monkeypatch.setattr(toxicity, "BLOCK", block)
        np.testing.assert_allclose(scorer.pooled(ids), want, atol=1e-4)


def test_long_text_counts_to_its_end():
    texts, labels = small_model()
    scorer = toxicity.Scorer(toxicity.fit(toxicity.word_ids(texts), labels))
    clean = b" ".join(x for x, y in zip(texts, labels, strict=True) if not y) * 130  # over a million bytes
    assert len(clean) > toxicity.PIECE
    low, high = scorer.scores([clean, clean + b" vilea"])
    assert high > low


def test_gradients_move_towards_lower_loss():
    texts, labels = small_model()
    ids = toxicity.word_ids(texts)
    net = toxicity.train_network(ids, labels.astype(np.float32))
    x = [np.concatenate([i, np.full((2, 3), toxicity.EMPTY)]) for i in ids]
    assert (net.table[toxicity.EMPTY] == 0).all() and len(x) == len(ids)


def test_threshold():
    x, y = np.array([0.0, 1, 2, 6, 7]), np.array([0.0, 0, 0, 1, 1])
    assert toxicity.best_threshold(x, y) == 4
    assert 1 < toxicity.best_threshold(np.array([1.0, 1, 5, 5]), np.array([0.0, 0, 1, 1])) < 5


def test_language_is_read_from_the_text():
    scorer = toxicity.Scorer(toxicity.fit([], np.empty(0)))
    docs = toxicity.word_ids([b"the cat and the dog", "le chat et les chiens dans une maison".encode(), b"der Hund und die Katze", b"el gato y los perros", b"qqq zzz", b""])
    assert scorer.languages(docs).tolist() == [0, 1, 2, 3, 4, 4]


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{DIR}/documents.parquet"), spark.read.parquet(f"{DIR}/labels.parquet")
    rows = toxicity.score(docs, labels).collect()
    assert len(rows) == docs.count()
    toxic = {r.doc_id: r.toxic for r in labels.collect()}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in toxic]
    right = np.mean([r.predicted == toxic[r.doc_id] for r in held])
    found = np.mean([r.predicted for r in held if toxic[r.doc_id]])
    wrong = np.mean([r.predicted for r in held if not toxic[r.doc_id]])
    # about a tenth of this table's toxic labels lie on texts without any such word
    assert right > 0.955 and found > 0.72 and wrong < 0.02, (right, found, wrong)


def test_scores_read_no_labels_of_the_held_out_fold(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{x}.parquet") for x in ("documents", "labels"))
    changed = labels.selectExpr("doc_id", "CASE WHEN crc32(CAST(doc_id AS STRING)) % 5 = 0 THEN 1 - toxic ELSE toxic END AS toxic")
    assert sorted(toxicity.score(docs, labels).collect()) == sorted(toxicity.score(docs.withColumns({}), changed).collect())


def test_odd_documents(spark, odd_documents, no_documents):
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 11)] + [(1, None), (None, 1), (99, 1)], "doc_id long, toxic int")
    rows = toxicity.score(odd_documents, labels).collect()
    assert len(rows) == 12 and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id == 7}) == 1 and len({r.score for r in rows if r.doc_id in (2, 3)}) == 1
    one = toxicity.score(odd_documents, labels.where("toxic = 1")).collect()
    assert {r.predicted for r in one} == {1}
    assert {r.score for r in toxicity.score(odd_documents, labels.limit(0)).collect()} == {0.5}
    assert toxicity.score(no_documents, labels).count() == 0

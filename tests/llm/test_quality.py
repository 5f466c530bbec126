from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from cinderlog.llm import nbsvm, quality_rules
from cinderlog.llm._text import word_hashes

DIR = "/root/testdata/sf0.01"


def brute_counts(text):
    import re

    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0d]+", text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    covered = set()
    for i, w in enumerate(windows):
        if windows.count(w) > 1:
            covered |= set(range(i, i + 8))
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0d]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


@pytest.mark.parametrize("text", ["", "a", "a b\na b\n\n \na b", "é# ü*\x0bx\x0cy $", "x y z " * 9, "a b c d e f g h a b c d e f g h", "| <b> | &", "one two three"])
def test_counts(text):
    found = quality_rules.counts(text, next(word_hashes([text.encode()], False)))
    assert found[:5] == brute_counts(text)


def test_verdicts(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    rows = quality_rules.judge(docs).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert len(rows) == len(texts)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DIR}/labels.parquet").collect()}
    good = bad = good_kept = bad_kept = 0
    for r in rows:
        if r.n_words < 400:
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_counts(texts[r.doc_id])
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert not (r.base_failed and r.kept)
        if r.doc_id in labels and not r.base_failed:
            if labels[r.doc_id]:
                good, good_kept = good + 1, good_kept + r.kept
            else:
                bad, bad_kept = bad + 1, bad_kept + r.kept
    assert good_kept >= 0.99 * good
    assert bad_kept < 0.5 * bad


def test_estimate_withstands_outliers(spark):
    """A third of odd rows doesn't move the estimate, where mean and covariance of all rows are moved."""
    rng = np.random.default_rng(1)
    clean = np.rint(rng.normal(1000, 60, (400, quality_rules.DIM))).astype(int)
    odd = np.rint(rng.normal(4000, 20, (120, quality_rules.DIM))).astype(int)
    rows = [("en", "a", x.tolist()) for x in np.concatenate([clean, odd])]
    found = quality_rules.estimates(spark.createDataFrame(rows, "lang string, source string, v array<long>")).where("level = 0").first()
    assert np.abs(np.array(found.mean) - 1000).max() < 15
    assert np.abs(np.mean([r[2] for r in rows], 0) - 1000).min() > 300


def brute_estimate(v):
    """The estimate of one group by numpy: (mean, covariance, factor)."""
    q, d = quality_rules, np.array(quality_rules.FLOOR) * quality_rules.UNIT

    def bins(mean, cov):
        x = v - mean
        distance = np.clip((x @ np.linalg.inv(cov) * x).sum(1), 1e-4, 1e12)
        return np.floor(np.log(distance) * 32)

    def quantile(b, share):
        return np.sort(b)[int(np.ceil(len(b) * share)) - 1]

    ends = []
    middle = np.median(v, 0)
    mad = np.median(np.abs(v - middle), 0)
    for mean, cov in ((middle, np.diag((1.4826 * mad) ** 2 + d**2)), (v.mean(0), np.cov(v.T, bias=True) + np.diag(d**2))):
        best = np.inf
        for _ in range(q.STEPS):
            b = bins(mean, cov)
            near = v[b <= quantile(b, q.H)]
            next_mean, next_cov = near.mean(0), np.cov(near.T, bias=True) + np.diag(d**2)
            if np.linalg.slogdet(next_cov)[1] >= best - 1e-9:
                break
            mean, cov, best = next_mean, next_cov, np.linalg.slogdet(next_cov)[1]
        ends.append((best, mean, cov))
    _, mean, cov = min(ends, key=lambda x: x[0])
    return mean, cov, min(1.0, q.MEDIAN / np.exp((quantile(bins(mean, cov), 0.5) + 1) / 32))


@pytest.mark.parametrize("few", [True, False])
def test_estimates_equal_brute_force(spark, monkeypatch, few):
    """Every level, by broadcast and by the salted join."""
    monkeypatch.setattr(quality_rules, "STEPS", 3)
    if not few:
        monkeypatch.setattr(quality_rules, "BROADCAST_ROWS", 0)
        monkeypatch.setattr(quality_rules, "SALTS", 3)
    rng = np.random.default_rng(3)
    rows = []
    for lang, source, n, at in (("en", "a", 300, 900), ("en", "b", 150, 1200), ("de", "a", 120, 1000)):
        mixed = rng.normal(size=(n, quality_rules.DIM)) @ rng.normal(size=(quality_rules.DIM, quality_rules.DIM)) * 90 + at
        mixed[: n // 6] += 2500
        rows += [(lang, source, x) for x in np.rint(mixed).astype(int).tolist()]
    found = quality_rules.estimates(spark.createDataFrame(rows, "lang string, source string, v array<long>").repartition(3)).collect()
    assert len(found) == 3 + 2 + 1
    for r in found:
        v = np.array([x[2] for x in rows if r.level == 2 or r.lang == x[0] and (r.level == 1 or r.source == x[1])], float)
        mean, cov, factor = brute_estimate(v)
        assert r.n == len(v)
        np.testing.assert_allclose(r.mean, mean, rtol=1e-9)
        inverse = np.linalg.inv(cov)
        np.testing.assert_allclose(r.inverse, [inverse[i, j] * (1 if i == j else 2) for i, j in quality_rules._PAIRS], rtol=1e-6, atol=1e-12)
        assert abs(r.factor - factor) < 1e-9


def test_keep_goes_by_rows(spark):
    """A rejected text doesn't stay because another row of its id does."""
    good = " ".join(f"word{i} of" if i % 3 else f"w{i}, and" for i in range(60))
    rows = [(1, good, "en", "a", 1), (1, "too short", "en", "a", 1), (None, good, "en", "a", 1), (None, None, None, None, None)]
    kept = quality_rules.keep(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")).collect()
    assert sorted(str(r.doc_id) for r in kept) == ["1", "None"]
    assert all(r.text == good for r in kept)


def test_rules_on_odd_documents(odd_documents, no_documents):
    found = {r.doc_id: r for r in quality_rules.judge(odd_documents).collect()}
    assert len(found) == 11
    assert found[2].n_words == 0
    assert found[2].base_failed
    assert quality_rules.judge(odd_documents).count() == odd_documents.count()
    assert quality_rules.judge(no_documents).count() == 0
    assert quality_rules.keep(odd_documents).columns == odd_documents.columns


def test_classifier_on_held_out_rows(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    got = nbsvm.score(docs, labels)
    rows = got.join(labels, "doc_id").where("held_out").collect()
    import zlib

    assert all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in rows)
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)


def test_labels_of_the_fold_are_never_read(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    labels = spark.read.parquet(f"{DIR}/labels.parquet")
    turned = labels.withColumn("quality", F.when(nbsvm.fold_of(F.col("doc_id")) == nbsvm.HELD_OUT, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert nbsvm.train(docs, labels) == nbsvm.train(docs.repartition(3), turned)


def test_classifier_on_odd_documents(spark, odd_documents, no_documents):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (5, None, 0), (None, 1, 0), (77, 0, 0)], "doc_id long, quality int, toxic int")
    for some in (labels, labels.limit(0)):
        rows = nbsvm.score(odd_documents, some).collect()
        assert len(rows) == odd_documents.count()
        assert all(0 <= r.score <= 1 for r in rows)
    assert nbsvm.score(no_documents, labels).count() == 0


def test_fit_equals_a_plain_one():
    """Dual coordinate descent on 300 rows reaches what projected gradient ascent on the dual reaches."""
    rng = np.random.default_rng(2)
    labels = (rng.random(300) < 0.5).astype(float)
    features = [np.unique(np.concatenate([rng.integers(0, 40, 12) + 40 * int(y), rng.integers(80, 200, 12)])).astype("<u4") for y in labels]
    weights, a, _ = nbsvm.fit(features, labels)
    order = np.random.Generator(np.random.PCG64(7)).permutation(300)
    used = order[60:]
    x = np.zeros((300, 200))
    for i, at in enumerate(features):
        x[i, at] = 1
    ratio = np.log((1 + x[used][labels[used] > 0].sum(0)) / (nbsvm.DIM + x[used][labels[used] > 0].sum())) - np.log((1 + x[used][labels[used] == 0].sum(0)) / (nbsvm.DIM + x[used][labels[used] == 0].sum()))
    z = x * ratio
    z /= np.sqrt((z**2).sum(1, keepdims=True))
    z = np.concatenate([z, np.ones((300, 1))], 1)
    sign = np.where(labels > 0, 1.0, -1.0)
    share = labels.mean()
    top = 10 * nbsvm.COST * np.where(labels > 0, 0.5 / share, 0.5 / (1 - share))
    g = (z[used] * sign[used, None]) @ (z[used] * sign[used, None]).T
    alpha = np.zeros(len(used))
    for _ in range(60_000):
        alpha = np.clip(alpha + (1 - g @ alpha) / np.linalg.norm(g, 2), 0, top[used])
    w = (z[used] * sign[used, None]).T @ alpha
    margin = z @ w
    got = np.array([weights[:200] @ x[i] / np.sqrt((weights[nbsvm.DIM : nbsvm.DIM + 200] * x[i]).sum()) + weights[-1] for i in range(300)])
    assert a > 0
    assert np.abs(got - margin).mean() < 0.05 * np.abs(margin).mean()
    assert ((got > 0) == (labels > 0)).mean() > 0.99


def test_classifier_keeps_rows_by_their_own_text(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    labels = spark.read.parquet(f"{DIR}/labels.parquet")
    kept = nbsvm.keep(docs, labels)
    assert kept.schema == docs.schema
    good = {r.doc_id for r in nbsvm.score(docs, labels).where("predicted = 1").collect()}
    assert {r.doc_id for r in kept.collect()} == good

from __future__ import annotations

import hashlib
import random
import re

from cinderlog.llm import exact_dedup
from cinderlog.llm.exact_dedup import DigestIndex


def test_index_inserts_deletes_and_grows():
    rng = random.Random(1)
    index, truth = DigestIndex(4), {}
    for i in range(5000):
        d = hashlib.sha256(str(rng.randrange(1500)).encode()).digest()
        if rng.random() < 0.3:
            assert index.delete(d) == (truth.pop(d, None) is not None)
        else:
            index.set(d, i)
            truth[d] = i
        assert index.size == len(truth)
    assert index.resizes > 0
    assert dict(index.items()) == truth
    for i in range(1500):
        d = hashlib.sha256(str(i).encode()).digest()
        assert index.get(d) == truth.get(d)


def test_index_verifies_filter_hits():
    index = DigestIndex(1)
    a = bytes(32)
    b = bytes(31) + b"\1"  # the same fingerprint and buckets, another digest
    index.set(a, 1)
    assert index.maybe(b)
    assert index.get(b) is None
    assert index.false_hits == 1


def test_groups_of_odd_documents(odd_documents):
    rows = exact_dedup.exact_groups(odd_documents).collect()
    assert len(rows) == odd_documents.count()
    texts = {}
    for r in odd_documents.select("doc_id", "text").collect():
        t = re.sub(r"[\x20\x09-\x0d]+", " ", r.text or "")
        texts.setdefault(hashlib.sha256(t.encode()).hexdigest(), []).append(r.doc_id)
    for r in rows:
        ids = texts[r.text_sha256]
        known = [x for x in ids if x is not None]
        assert r.doc_id in ids
        assert r.group_size == len(ids)
        assert r.keep_id == (min(known) if known else None)
        assert r.kept == (r.doc_id == r.keep_id)


def test_empty_table(no_documents):
    assert exact_dedup.exact_groups(no_documents).count() == 0
    assert exact_dedup.drop_copies(no_documents).columns == no_documents.columns


def test_drop_copies_keeps_columns(odd_documents):
    kept = exact_dedup.drop_copies(odd_documents)
    assert kept.columns == odd_documents.columns
    assert {r.doc_id for r in kept.collect()} == {1, 2, 4, 5, 6, None, 8, 9, 10}


def test_drop_copies_goes_by_rows(spark):
    """Repeated rows leave one; rows of one id with other texts are judged apart; null ids too."""
    rows = [(1, "a b"), (1, "a b"), (1, "a  b"), (2, "a\tb"), (2, "c"), (3, "c"), (None, "n"), (None, "n"), (None, "c"), (4, None), (5, "")]
    kept = exact_dedup.drop_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), " ".join((r.text or "").split())) for r in kept) == [("1", "a b"), ("2", "c"), ("4", ""), ("None", "n")]


def test_bounded_indexes_give_whole_groups(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "FLUSH", 3)
    rows = [(i, f"text {i % 37}") for i in range(400)]
    found = exact_dedup.exact_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).collect()
    assert len(found) == 400
    for r in found:
        assert r.keep_id == r.doc_id % 37
        assert r.group_size == len(range(r.doc_id % 37, 400, 37))

from __future__ import annotations

import random

import numpy as np
import pytest

from pyspark.sql import functions as F

from cinderlog.llm import exact_dedup, ngram_join, quality_rules
from cinderlog.llm.components import components
from cinderlog.llm.ngram_join import RTree, Threshold, keys_of, links_in, points


def brute(rows, size, num, den):
    """doc_id -> (n, component) by comparing all pairs."""
    sets = {}
    for doc_id, text in rows:
        w = (text or "").encode().lower().split()
        sets[doc_id] = frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(i for i in sets if sets[i])
    for a in ids:
        for b in ids:
            if a < b:
                common = len(sets[a] & sets[b])
                if den * common >= num * (len(sets[a]) + len(sets[b]) - common):
                    x, y = sorted((find(a), find(b)))
                    parent[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


def made(rng, n):
    """Near copies with 0 to 30 % of words changed, chains of copies, tiny texts and shared passages."""
    vocabulary = [f"w{i}" for i in range(400)]
    passage = [rng.choice(vocabulary) for _ in range(40)]
    out = []
    while len(out) < n:
        base = [rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 3, 4, 6, 10, 19, 20, 40, 90, 150]))]
        if rng.random() < 0.4:
            base = base + passage
        text = base
        for _ in range(rng.choice([1, 1, 3, 12])):
            if rng.random() < 0.5:
                text = base
            text = [rng.choice(vocabulary) if rng.random() < rng.choice([0, 0.003, 0.01, 0.03]) else w for w in text]
            if rng.random() < 0.3:
                text = text + [rng.choice(vocabulary)]
            out.append(" ".join(w.upper() if rng.random() < 0.1 else w for w in text))
    return list(enumerate(out[:n]))


@pytest.mark.parametrize(("size", "num", "den"), [(3, 90, 100), (5, 80, 100), (1, 60, 100)])
def test_components_equal_brute_force(spark, size, num, den, monkeypatch):
    monkeypatch.setattr(ngram_join, "TILE_LOAD", 8192)
    monkeypatch.setattr(ngram_join, "GROUP_GRAMS", 2000)
    rows = made(random.Random(size), 500)
    found = ngram_join.link_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), size, num, den).collect()
    want = brute(rows, size, num, den)
    assert len(found) == len(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == want


@pytest.mark.parametrize(("num", "den"), [(90, 100), (80, 100), (50, 100), (1, 1)])
def test_linked_sets_share_a_key(num, den):
    t, rng = Threshold(num, den), np.random.default_rng(4)
    for _ in range(1500):
        n = int(rng.integers(1, rng.choice([6, 30, 200, 900])))
        a = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        most = t.differ(len(a), len(a))
        drop = int(rng.integers(0, most + 2))
        b = np.delete(a, rng.choice(len(a), min(len(a) - 1, drop), replace=False))
        b = np.unique(np.concatenate([b, rng.integers(0, 2**64, int(rng.integers(0, most + 2)), dtype=np.uint64)]))
        common = len(np.intersect1d(a, b))
        if den * common >= num * (len(a) + len(b) - common):
            both = np.intersect1d(keys_of(a, t), keys_of(b, t))
            assert len(both) > max(t.dropped(len(a)), t.dropped(len(b))), (len(a), len(b), common)


def test_shared_keys_count_alike(spark, monkeypatch):
    """All rows of a key get the same count, whatever its task and batches; keys of one row go."""
    monkeypatch.setattr(ngram_join, "FREQUENT", 20)
    rng = random.Random(6)
    rows = [(rng.choice([1, 1, 1, 2, 3, *range(10, 900)]), i) for i in range(3000)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    found = ngram_join.shared(spark.createDataFrame(rows, "key long, id long")).collect()
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    sizes = {k: sum(1 for x, _ in rows if x == k) for k, _ in rows}
    by_key = {}
    for r in found:
        by_key.setdefault(r.key, []).append(r)
    assert {k for k, n in sizes.items() if n > 1} <= set(by_key)
    for k, some in by_key.items():
        assert {r.id for r in some} == {i for x, i in rows if x == k}
        assert len({r.n for r in some}) == 1
        assert some[0].n in ((sizes[k], 21) if sizes[k] <= 20 else (21,))
        assert all(r.leader <= r.id for r in some)


def test_tree_finds_all_within_the_bound():
    rng, t = np.random.default_rng(5), Threshold(90, 100)
    sets = []
    for _ in range(60):
        base = rng.integers(0, 2**64, int(rng.integers(5, 200)), dtype=np.uint64)
        for _ in range(5):
            keep = rng.random(len(base)) > 0.02
            sets.append(np.unique(np.concatenate([base[keep], rng.integers(0, 2**64, 2, dtype=np.uint64)])))
    counts, sizes = points(sets), np.array([len(x) for x in sets])
    assert (counts.sum(1) == sizes).all()
    label = np.arange(len(sets))
    tree = RTree(counts, sizes)
    boxes = ngram_join._box_labels(tree, label)
    for i in range(len(sets)):
        found = set(tree.search(counts[i], sizes[i], t, label, i, boxes).tolist())
        for j in range(len(sets)):
            common = len(np.intersect1d(sets[i], sets[j]))
            if j != i and 100 * common >= 90 * (sizes[i] + sizes[j] - common):
                assert j in found
    links = links_in(sets, t)
    assert len(links) < len(sets)
    for i, j in links:
        common = len(np.intersect1d(sets[i], sets[j]))
        assert 100 * common >= 90 * (sizes[i] + sizes[j] - common)
    fine = [ngram_join.pack_point(points([x], ngram_join.fine_groups(len(x)))[0]) for x in sets]
    counts = ngram_join.unpack_points(fine, sizes)
    assert (counts.sum(1) == sizes).all()
    first = ngram_join.clusters(counts, sizes, label, t)
    assert all(first[i] == first[j] for i, j in links)


def test_points_of_many_equal_hashes_keep_their_counts():
    """A group with more than 255 n-grams needs four bytes a count."""
    sets = [np.arange(1000, dtype=np.uint64), np.arange(300, 1600, dtype=np.uint64)]
    sizes = np.array([1000, 1300])
    fine = [ngram_join.pack_point(points([x], ngram_join.fine_groups(len(x)))[0]) for x in sets]
    assert (ngram_join.unpack_points(fine, sizes).sum(1) == sizes).all()


def test_equal_sets_and_bad_thresholds(spark):
    rows = made(random.Random(9), 120)
    found = ngram_join.link_components(spark.createDataFrame(rows, "doc_id long, text string"), 2, 1, 1).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == brute(rows, 2, 1, 1)
    with pytest.raises(ValueError):
        Threshold(101, 100)


def test_tiles_give_links_not_pairs():
    """A component of near copies that meets others in one tile: a tree of links, whatever the pairs."""
    rng, t = np.random.default_rng(8), Threshold(80, 100)
    base = np.unique(rng.integers(0, 2**64, 300, dtype=np.uint64))
    sets = [np.unique(np.concatenate([base[rng.random(len(base)) > 0.02], rng.integers(0, 2**64, 5, dtype=np.uint64)])) for _ in range(150)]
    assert len(links_in(sets, t)) == 149
    assert len(links_in(sets, t, np.arange(150) // 50)) == 2


def test_odd_documents(odd_documents, no_documents):
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.link_components(odd_documents, 3, 90, 100).collect()}
    assert found[1] == (16, 1)
    assert found[7] == (16, 1)
    assert found[2] == found[3][:1] + (2,) == (0, 2)
    assert found[4] == (0, 4)
    assert found[6][1] == found[5][1] == 5
    assert found[8] == (1, 8)
    assert found[9] == (1, 8)
    assert found[None][1] is None
    assert ngram_join.link_components(no_documents).count() == 0


def test_keep_one(odd_documents):
    kept = ngram_join.keep_one(odd_documents, 3, 90, 100)
    assert kept.columns == odd_documents.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([1, 2, 3, 4, 5, None, 8, 10], key=str)
    twice = odd_documents.unionByName(odd_documents)
    assert sorted((r.doc_id for r in ngram_join.keep_one(twice, 3, 90, 100).collect()), key=str) == sorted([1, 2, 3, 4, 5, None, None, 8, 10], key=str)


def test_rows_that_share_a_doc_id_are_linked_by_their_own_texts(spark):
    one, two, three = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(5, one), (5, two), (7, two + " end"), (9, two), (8, one + " x"), (4, three), (4, three)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = sorted((r.doc_id, r.component_id) for r in ngram_join.link_components(docs, 3, 90, 100).collect())
    assert found == [(4, 4), (4, 4), (5, 5), (5, 5), (7, 5), (8, 5), (9, 5)]
    # both components have 5 for their smallest doc_id; a row of each stays
    assert sorted(map(tuple, ngram_join.keep_one(docs, 3, 90, 100).collect())) == sorted([(5, one), (5, two), (4, three)])
    # two texts of a doc_id in one component: one of them stays
    near = spark.createDataFrame([(5, one), (5, one + " x"), (6, one)], "doc_id long, text string")
    assert ngram_join.keep_one(near, 3, 90, 100).count() == 1


CLASHES = ["__id", "__own", "__mark", "__n", "key", "rep", "row", "mark", "id", "own", "times", "first", "kept_id", "digest", "component"]


@pytest.mark.parametrize("keep", [ngram_join.keep_one, exact_dedup.drop_copies, quality_rules.keep])
def test_stages_keep_columns_of_any_name(spark, odd_documents, keep):
    clashing = odd_documents.select("doc_id", "text", "lang", "source", "n_chars", *(F.lit("mine").alias(x) for x in CLASHES))
    found = keep(clashing)
    assert found.columns == clashing.columns
    rows = found.collect()
    assert len(rows) == keep(odd_documents).count() and all(r[x] == "mine" for r in rows for x in CLASHES)


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 102), (101, 102), (200, 200)]
    found = {r.id: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert found == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100}

from __future__ import annotations

import hashlib
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from cinderlog.llm import merkle

DIR = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, more=0):
    values = [row.doc_id, row.source, row.lang, None if row.n_chars is None else row.n_chars + more, row.text]
    return h(*("-" if x is None else f"{len(str(x).encode())}:{x}" for x in values))


def tree(leaves, fan):
    """The levels of a tree, from its leaves to its root."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + fan]) for i in range(0, len(levels[-1]), fan)])
    return levels


def path(levels, i, fan):
    """For each level: the run a node is in, and its place there."""
    out = []
    for level in levels[:-1]:
        at = i // fan * fan
        out.append((level[at : at + fan], i - at))
        i //= fan
    return out


def brute(rows, fan=2):
    langs = sorted({r.lang for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    own = {x: sorted((r for r in rows if r.lang == x), key=lambda r: (r.doc_id is not None, r.doc_id or 0, leaf(r))) for x in langs}
    trees = {x: tree([leaf(r) for r in own[x]], fan) for x in langs}
    over = tree([trees[x][-1][0] for x in langs], fan)
    out = []
    for n, x in enumerate(langs):
        for i, r in enumerate(own[x]):
            steps = path(trees[x], i, fan) + path(over, n, fan)
            odd = r.doc_id is not None and r.n_chars is not None and zlib.crc32(str(r.doc_id).encode()) % 7 == 0
            folded = leaf(r, 1) if odd else leaf(r)
            for run, at in steps:
                folded = h(*run[:at], folded, *run[at + 1 :])
            proof = h(*(s for run, at in steps for j, s in enumerate(run) if j != at))
            out.append((r.doc_id, leaf(r), trees[x][-1][0], over[-1][0], proof, folded, folded == over[-1][0]))
    return out


def key(row):
    return tuple(x is not None and str(x) or "" for x in row)


@pytest.mark.parametrize(("fan", "depth"), [(2, 12), (2, 2), (2, 3), (3, 2), (5, 1)])
def test_test_table_equals_brute_force(spark, fan, depth):
    """Small depths make several rounds of subtrees."""
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    found = merkle.manifest(docs.repartition(5), fan, depth).collect()
    want = brute(docs.collect(), fan)
    assert sorted(map(tuple, found), key=key) == sorted(want, key=key)
    assert 0 < sum(not r.verified for r in found) < len(found) / 3


def test_odd_documents(spark, odd_documents):
    found = merkle.manifest(odd_documents).collect()
    assert sorted(map(tuple, found), key=key) == sorted(brute(odd_documents.select("doc_id", "text", "lang", "source", "n_chars").collect()), key=key)


def test_small_tables(spark, no_documents):
    assert merkle.manifest(no_documents).collect() == []
    for n in (1, 2, 3, 5, 8, 9):
        docs = spark.createDataFrame([(i, "t", "en", "s", i) for i in range(n)], DOCS)
        assert sorted(map(tuple, merkle.manifest(docs).collect()), key=key) == sorted(brute(docs.collect()), key=key)


def test_many_languages_and_the_largest_number(spark):
    rows = [(i, f"text {i}", None if i % 11 == 0 else f"l{i % 37}é", None, 2**63 - 1 if i % 2 else None) for i in range(150)]
    docs = spark.createDataFrame(rows, DOCS)
    assert sorted(map(tuple, merkle.manifest(docs, 2, 2).collect()), key=key) == sorted(brute(docs.collect()), key=key)


def test_partial_parents_meet_in_any_order():
    """Nodes that arrive in any order, dealt to several partial trees, close the same parents."""
    leaves = [hashlib.sha256(bytes([i])).digest() for i in range(23)]
    one = merkle.Partial(2, 12)
    for i, x in enumerate(leaves):
        one.arrive(0, 0, i, 23, x)
    many = [merkle.Partial(2, 12) for _ in range(4)]
    for i in sorted(range(23), key=lambda i: zlib.crc32(bytes([i]))):
        many[i * 7 % 4].arrive(0, 0, i, 23, leaves[i])
    for other in many[1:]:
        many[0].merge(other)
    assert sorted(many[0].closed) == sorted(one.closed) and many[0].tops == one.tops and not many[0].open and not one.open
    assert one.tops[0][4].hex() == tree([x.hex() for x in leaves], 2)[-1][0]


def test_few_nodes_wait_in_tasks(spark):
    """Rows in order leave a task at most two open nodes a level."""
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.sha2(F.col("id").cast("string"), 256).alias("d"), F.lit("en").alias("lang"))
    leaves = merkle.numbered(docs.select("doc_id", "lang", F.unhex("d").alias("digest")), ["lang"], ["doc_id"])
    assert sorted(r.place for r in leaves.select("place").collect()) == list(range(4000)) and leaves.where("n != 4000 OR place != doc_id").isEmpty()
    parents, roots, _ = merkle.build(leaves)
    assert roots.count() == 1 and parents.count() == sum(-(-4000 // 2**i) for i in range(1, 13))


def test_clashing_names_and_sql(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    clash = docs.select("*", *(F.lit("x").alias(x) for x in ("tree", "place", "n", "digest", "changed", "part", "stretch", "kind", "path")))
    found = merkle.manifest(clash)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{DIR}/documents.parquet'")
    want = con.sql(merkle.duck_sql()).df()
    assert sorted(map(tuple, found.collect())) == sorted(tuple(x) for x in want[found.columns].itertuples(index=False))

from __future__ import annotations

import corpus_pipeline
from cinderlog.llm import exact_dedup, nbsvm, ngram_join, packing, quality_rules
from cinderlog.llm.queries import word_vocabulary

DIR = "/root/testdata/sf0.001"


def test_stages_take_effect(spark, vocabulary_path, tmp_path):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    names, sizes = docs.columns, [docs.count()]
    labels = spark.read.parquet(f"{DIR}/labels.parquet")
    expected = {
        "quality rules": lambda d: {r.doc_id for r in quality_rules.judge(d).collect() if r.kept},
        "quality classifier": lambda d: {r.doc_id for r in nbsvm.score(d, labels).collect() if r.predicted},
        "exact dedup": lambda d: {r.doc_id for r in exact_dedup.exact_groups(d).collect() if r.kept},
        "near dedup": lambda d: {r.doc_id for r in ngram_join.link_components(d, 5, 80, 100).collect() if r.doc_id == r.component_id},
    }
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, docs, DIR)
        assert out.columns == names
        out.write.parquet(f"{tmp_path}/{i}")
        want = expected[name](docs)
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        assert {r.doc_id for r in docs.collect()} == want
        sizes.append(docs.count())
    assert sizes == sorted(sizes, reverse=True)
    assert sizes[0] > sizes[1] >= sizes[2] >= sizes[3] >= sizes[4] > 0
    packed = {(r.doc_id, r.start, r.length) for r in corpus_pipeline.STAGES[-1][1](spark, docs, DIR).collect()}
    assert packed == {(r.doc_id, r.start, r.length) for r in packing.pieces(docs, word_vocabulary()).collect()}
    assert packed == {(r.doc_id, r.start, r.length) for r in corpus_pipeline.run(spark, DIR).collect()}


def test_an_empty_table_passes(spark, no_documents):
    docs = no_documents
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, DIR)
    assert docs.count() == 0

from __future__ import annotations

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls, empty and long texts, ties, repeated rows and columns whose names operators use themselves."""
    long_text = " ".join(f"word{i % 977}" for i in range(60_000))
    rows = [
        (1, "the cat sat on the mat and looked at the dog for a very long while today again", "en", "a", 1), (2, None, None, None, None), (3, "", "en", "a", 0), (4, " \t\n ", "en", None, 3),
        (5, long_text, "en", "a", 9), (6, long_text + " end", "en", "b", 9), (7, "the cat sat on the mat and looked at the dog for a very long while today again", None, "a", 1),
        (7, "the cat sat on the mat and looked at the dog for a very long while today again", None, "a", 1), (None, "no id here", "en", "a", 1), (8, "one", "fr", "a", 1), (9, "ONE", "fr", "a", 1), (10, "x" * 100_000, "en", "a", 1),
    ]
    df = spark.createDataFrame(rows, DOCS)
    clash = ["keep_id", "kept", "n", "digest", "rep", "key", "leader", "n_tokens", "start", "sequence_id", "offset", "score", "v", "one", "mark", "chunk", "length", "component_id"]
    from pyspark.sql import functions as F

    return df.select("*", *(F.lit("clash").alias(x) for x in clash))


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def vocabulary_path():
    public = pytest.importorskip("public_tokenizers")
    return str(public.path("word_bpe_49k.json"))

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from cinderlog.llm import bpe

TEXTS = [
    "", " ", "Hello world's 123 DON'T  stop!!", "naïve café ÀÉÎ İstanbul Ⱥ", "a<|endoftext|>b <|startoftext|>", "日本語 テスト", "tab\x1cbound\x1fs", "é combining", "ΑΣ ΣΑΣ", "x" * 500, "\x85next\xa0line", "ſƁ",
    "thing," * 50, "<| not special |>",
]


@pytest.fixture(scope="module")
def library(vocabulary_path):
    return pytest.importorskip("tokenizers").Tokenizer.from_file(vocabulary_path)


def test_encodes_as_the_library(vocabulary_path, library):
    own = bpe.encoder(vocabulary_path)
    rng = random.Random(3)
    letters = [chr(c) for c in [*range(0x180), 0x1E9B, 0x2028, 0x3000, 0xAC00, 0x1100, 0x1161, 0x660]]
    texts = TEXTS + ["".join(rng.choice([*letters, *[" ", "'s", "the", "<|endoftext|>"] * 20]) for _ in range(40)) for _ in range(500)]
    for text, ids in zip(texts, own.encode(texts), strict=True):
        wanted = library.encode(text, add_special_tokens=False).ids
        assert ids.tolist() == wanted, text
        assert own.vocabulary.decode(ids).decode() == library.decode(wanted, skip_special_tokens=False)


def test_long_words_merge_alike(vocabulary_path):
    vocab = bpe.vocabulary(vocabulary_path)
    word = b"internationalisation" * 3
    short = vocab.merge([word])[0]
    assert np.frombuffer(short, "<u4").tolist() == vocab._merge_long(word)


def test_transducer_is_minimal_and_exact(vocabulary_path):
    vocab = bpe.vocabulary(vocabulary_path)
    words = sorted({f"{a}{b}{c}".encode() for a in ("re", "un", "") for b in ("do", "make", "think") for c in ("", "ing", "ings", "er")})
    ids = vocab.merge(words)
    t = bpe.Transducer(bpe.compile_transducer(zip(words, ids, strict=True)))
    assert t.lookup(words) == ids
    assert t.lookup([b"redo", b"redoin", b"", b"zzz", b"redoingsx"]) == [ids[words.index(b"redo")], None, None, None, None]
    rights = set()  # a minimal automaton has a state for each set of endings
    for w in words:
        for i in range(len(w) + 1):
            rights.add(frozenset(x[i:] for x in words if x.startswith(w[:i])))
    assert t.states == len(rights)
    assert bpe.mapped(bpe.compile_transducer([])).lookup([b"a"]) == [None]


def test_odd_documents(odd_documents, no_documents, vocabulary_path, library):
    rows = bpe.encode_decode(odd_documents, vocabulary_path, limit=50, with_ids=True).collect()
    texts = {r.doc_id: r.text or "" for r in odd_documents.select("doc_id", "text").collect()}
    assert len(rows) == odd_documents.count()
    for r in rows:
        wanted = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.ids == wanted
        assert r.n_tokens == len(wanted)
        assert r.ids_sha256 == hashlib.sha256(np.array(wanted, "<u4").tobytes()).hexdigest()
        assert r.decoded == library.decode(wanted, skip_special_tokens=False)
        assert r.decoded_sha256 == hashlib.sha256(r.decoded.encode()).hexdigest()
    assert bpe.encode_decode(no_documents, vocabulary_path).count() == 0


def test_lexicon_has_the_most_frequent_words(spark, vocabulary_path):
    docs = spark.createDataFrame([(1, "b b b b b b b b a a a a c"), (2, "B")], "doc_id long, text string")
    found = {r.word: r.n for r in bpe.frequent_words(docs, vocabulary_path, 2).collect()}
    assert found == {"b": 9, "a": 4}


def test_random_strings_over_all_code_points(vocabulary_path, library):
    """Whatever the characters, newer ones than the library's tables and combining ones too, ids are the library's."""
    rng = random.Random(3)

    def character():
        while True:
            c = rng.choice([rng.randrange(0x110000), rng.randrange(0x3000), rng.randrange(0x300, 0x370), rng.randrange(0x900, 0x1000), rng.randrange(128)])
            if not 0xD800 <= c < 0xE000:
                return chr(c)

    texts = ["຺҆", "̰৾", "೜", "Ᲊx", "Ɤ"] + ["".join(character() for _ in range(rng.randrange(1, 30))) for _ in range(50_000)]
    for text, ids in zip(texts, bpe.Encoder(vocabulary_path).encode(texts), strict=True):
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_words_that_share_a_hash(vocabulary_path, monkeypatch):
    """Bytes decide, not hashes: words of one length are given one hash here."""
    texts = ["the cat sat on the mat", "a dog dug a pit, the pig hid", "the cat"] * 3
    want = [x.tolist() for x in bpe.Encoder(vocabulary_path).encode(texts)]
    monkeypatch.setattr(bpe.Pieces, "hashes", lambda self: (self.ends - self.starts).astype("u8"))
    own = bpe.Encoder(vocabulary_path)
    assert [x.tolist() for text in texts for x in own.encode([text])] == want
    assert [x.tolist() for x in own.encode(texts)] == want

from __future__ import annotations

import io
import zlib

import numpy as np
import pytest

from cinderlog.llm import packing, sst


@pytest.fixture(scope="module")
def library(vocabulary_path):
    return pytest.importorskip("tokenizers").Tokenizer.from_file(vocabulary_path)


def test_shard_round_trip(tmp_path):
    rng = np.random.default_rng(1)
    ids = sorted({int(x) for x in rng.integers(-(2**62), 2**62, 3000)})
    docs = [(None, np.array([7], "<u4"))] + [(i, rng.integers(0, 60000, int(rng.integers(0, 90))).astype("<u4")) for i in ids]
    docs.insert(5, (docs[4][0], np.array([1, 2], "<u4")))  # a repeated id
    stream = io.BytesIO()
    writer = sst.ShardWriter(stream, 2)
    for i, x in docs:
        writer.add(i, x)
    with pytest.raises(ValueError, match="ascend"):
        writer.add(-(2**63), docs[0][1])
    writer.close()
    path = tmp_path / "a.sst"
    path.write_bytes(stream.getvalue())
    reader = sst.ShardReader(f"file://{path}")
    assert [(i, x.tolist()) for i, x in reader.scan()] == [(i, x.tolist()) for i, x in docs]
    reader.blocks_read = 0
    assert [x.tolist() for x in reader.get(docs[700][0])] == [docs[700][1].tolist()]
    assert reader.blocks_read <= 2
    assert len(reader.get(docs[4][0])) == 2
    assert [x.tolist() for x in reader.get(None)] == [[7]]
    misses = [i + 1 for i in ids[:500] if i + 1 not in set(ids)]
    reader.blocks_read = 0
    assert not any(reader.get(i) for i in misses)
    assert reader.blocks_read < 40  # the Bloom filter answers nearly all


def test_a_damaged_block_is_noticed(tmp_path):
    stream = io.BytesIO()
    writer = sst.ShardWriter(stream, 4)
    writer.add(1, np.arange(1000, dtype="<u4"))
    writer.close()
    data = bytearray(stream.getvalue())
    data[10] ^= 255
    (tmp_path / "b.sst").write_bytes(data)
    with pytest.raises(ValueError, match="damaged"):
        list(sst.ShardReader(f"file://{tmp_path}/b.sst").scan())


def test_token_output(odd_documents, no_documents, vocabulary_path, library, tmp_path):
    manifest = sst.write_shards(odd_documents, vocabulary_path, f"file://{tmp_path}/out")
    rows = sst.read_shards(manifest, with_ids=True).collect()
    texts = odd_documents.select("doc_id", "text").collect()
    assert len(rows) == len(texts)
    want = {r.doc_id: library.encode(r.text or "", add_special_tokens=False).ids + [1] for r in texts}
    at = 0
    for r in sorted(rows, key=lambda r: (r.start, r.n_tokens)):
        assert r.ids == want[r.doc_id]
        assert r.start == at
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        at += r.n_tokens
    order = [r.doc_id for r in sorted(rows, key=lambda r: r.start)]
    assert order == [None, 1, 2, 3, 4, 5, 6, 7, 7, 8, 9, 10]
    assert len(sst.find([r.path for r in manifest.collect()], 7)) == 2
    assert sst.token_output(no_documents, vocabulary_path).count() == 0


def test_fill_holds_all_limits():
    rng = np.random.default_rng(2)
    sizes = np.stack([rng.integers(1, 2048, 3000), np.ones(3000, int), rng.integers(0, 900, 3000)], 1)
    sequence, offset = packing.fill(sizes, (2048, 7, 1500))
    totals = np.zeros((sequence.max() + 1, 3), int)
    np.add.at(totals, sequence, sizes)
    assert (totals <= (2048, 7, 1500)).all()
    for s in range(sequence.max() + 1):
        own = np.flatnonzero(sequence == s)
        own = own[np.argsort(offset[own])]
        assert offset[own].tolist() == (np.cumsum(sizes[own, 0]) - sizes[own, 0]).tolist()
    with pytest.raises(ValueError, match="larger"):
        packing.fill(np.array([[9, 1, 1]]), (8, 1, 1))
    assert len(packing.fill(np.empty((0, 3), int), (8, 1, 1))[0]) == 0


def test_packed_documents(odd_documents, no_documents, vocabulary_path, library):
    rows = packing.pack_documents(odd_documents, vocabulary_path).collect()
    texts = {r.doc_id: r.text or "" for r in odd_documents.select("doc_id", "text").collect()}
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(texts)
    for doc_id, own in by_doc.items():
        ids = np.array(library.encode(texts[doc_id], add_special_tokens=False).ids + [1], "<u4")
        times = 2 if doc_id == 7 else 1
        assert sum(r.length for r in own) == len(ids) * times
        for r in own:
            assert r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    assert packing.pack_documents(no_documents, vocabulary_path).count() == 0


def test_padding_is_small(spark, vocabulary_path):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = packing.pack_documents(docs, vocabulary_path).select("sequence_id", "length").collect()
    assert sum(r.length for r in rows) >= 0.99 * 2048 * len({r.sequence_id for r in rows})

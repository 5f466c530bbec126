from __future__ import annotations

import hashlib
import random

from cinderlog.llm import line_dedup


def brute(rows):
    """Cleaned texts: every chunk is held against its first place, and grows over whole texts, as far as lines are equal."""
    places, gone, texts = {}, {}, {}
    for at, (_, text) in enumerate(sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))):
        lines = texts[at] = (text or "").encode().split(b"\n")
        gone[at] = set()
        for c in line_dedup.chunks(lines):
            first, start = places.setdefault(b"\n".join(lines[c.start : c.stop]), (at, c.start))
            if (first, start) == (at, c.start):
                continue
            other, a, b = texts[first], c.start, c.stop
            shift = start - c.start
            while a > 0 and a + shift > 0 and lines[a - 1] == other[a - 1 + shift]:
                a -= 1
            while b < len(lines) and b + shift < len(other) and lines[b] == other[b + shift]:
                b += 1
            gone[at] |= set(range(a, b))
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    return {i: b"\n".join(x for n, x in enumerate(texts[at]) if n not in gone[at]) for at, (i, _) in enumerate(order)}


def parts(lines):
    return {b"\n".join(lines[c.start : c.stop]) for c in line_dedup.chunks(lines)}


def test_boundaries_resist_shifts():
    rng = random.Random(1)
    lines = [f"line {rng.random()}".encode() for _ in range(400)]
    moved = [b"new one", b"new two", *lines[:200], b"inserted", *lines[200:]]
    assert len(parts(lines) & parts(moved)) > 0.9 * len(parts(lines))
    assert all(c.stop - c.start == 2 and c.low <= c.start < c.stop <= c.high for c in line_dedup.chunks(lines))
    assert len(line_dedup.chunks(lines)) < 0.9 * len(lines)


def test_a_run_without_choices_has_chunks():
    """The same line again and again, whose hash chooses no pair: a chunk every MOST_LINES lines, each bounded."""
    for i in range(1000):
        lines = [f"same {i}".encode()] * 300
        if len(line_dedup.chunks(lines)) < 200:
            break
    found = line_dedup.chunks(lines)
    assert 5 < len(found) < 20 and all(c.high - c.low <= 2 * line_dedup.MOST_LINES + 2 for c in found)


def test_equals_brute_force(spark):
    rng = random.Random(2)
    blocks = [[f"b{i} line {j} {rng.random()}" for j in range(rng.randrange(2, 12))] for i in range(15)]
    rows = []
    for i in range(120):
        parts = [[f"own {i} {rng.random()}" for _ in range(rng.randrange(0, 6))] if rng.random() < 0.5 else rng.choice(blocks) for _ in range(rng.randrange(1, 5))]
        rows.append((i, "\n".join(sum(parts, []))))
    rows += [(200, None), (201, ""), (202, "\n\n\n\n"), (203, "\n\n\n\n"), (204, "one line"), (205, "one line")]
    found = {r.doc_id: r for r in line_dedup.clean(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    want = brute(rows)
    assert {i: r.text.encode() for i, r in found.items()} == want
    texts = dict(rows)
    for i, r in found.items():
        assert r.text_sha256 == hashlib.sha256(want[i]).hexdigest()
        assert r.n_removed_bytes == len((texts[i] or "").encode()) - len(want[i])
    assert any(r.n_removed_lines for r in found.values())


def made(rng):
    """Passages of 2 to 40 lines, a blank line in one, and a long line, each first by itself and then within 80 texts."""
    passages = [[f"p{i} line {j} {rng.random()}" for j in range(n)] for i, n in enumerate([2, 2, 3, 3, 4, 5, 6, 8, 12, 40])]
    passages[4].insert(2, "")
    passages.append([" ".join(f"w{j}" for j in range(60))])
    own = lambda k: [f"own {rng.random()}" for _ in range(k)]
    rows, want = [], {}
    for i, p in enumerate(passages):
        rows.append((i, "\n".join([*own(i % 3 + 1), *p, *own(2)])))
        want[i] = rows[-1][1]
    for i in range(80):
        head, tail, p = own(rng.randrange(1, 5)), own(rng.randrange(1, 5)), rng.choice(passages)
        rows.append((100 + i, "\n".join([*head, *p, *tail])))
        found = bool(line_dedup.chunks([x.encode() for x in p]))
        want[100 + i] = "\n".join([*head, *tail] if found else [*head, *p, *tail])
    rows += [(300, "short line"), (301, "short line"), (302, None), (None, "\n\n")]
    return rows, want | {300: "short line", 301: "short line", 302: "", None: "\n\n"}


def test_passages_go_whole_whatever_surrounds_them(spark):
    rows, want = made(random.Random(5))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert {r.doc_id: r.text for r in line_dedup.clean(df).collect()} == want
    assert sum(want[i] != t for i, t in rows if i and i >= 100 and i < 200) > 60


def test_without_chunks_nothing_goes(spark, monkeypatch):
    """What decides are chunks, and their bytes."""
    rows, _ = made(random.Random(5))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, mark long, start int, stop int")
    monkeypatch.setattr(line_dedup, "removed_lines", lambda documents: none)
    assert line_dedup.clean(df).where("n_removed_lines > 0").isEmpty()


def test_the_test_table_equals_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = docs.collect()
    found = line_dedup.clean(docs.repartition(6)).collect()
    assert {r.doc_id: r.text.encode() for r in found} == brute([(r.doc_id, r.text) for r in rows])
    assert sum(r.n_removed_lines for r in found) > 500


def test_odd_documents(odd_documents, no_documents):
    assert line_dedup.clean(odd_documents).count() == odd_documents.count()
    assert line_dedup.clean(no_documents).count() == 0


def test_repeated_rows_are_one_document(spark):
    """Rows that repeat doc_id and text, and rows without an id, each get what the first of them keeps."""
    text = "\n".join(f"line {i} of a passage" for i in range(6))
    rows = [(1, text), (1, text), (2, text), (None, text), (None, text)]
    found = line_dedup.clean(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), r.n_removed_lines) for r in found) == [("1", 0), ("1", 0), ("2", 6), ("None", 6), ("None", 6)]

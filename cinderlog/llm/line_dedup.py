"""Line dedup over content-defined chunks of lines.

Each line of a text has a hash, and a rolling hash over the hashes of two neighbouring lines that have a
word chooses where a chunk begins; so inserted or deleted lines move few chunks. A chunk is those two lines and
the blank ones between them; a line of LONG_WORDS words is a chunk by itself. Chunks that occur
again anywhere in the corpus are repetitions of their first occurrence (smallest doc_id, then place) once their bytes
have been compared with it, and then they grow: line by line, both ways, as long as the lines' bytes are those next to
the first occurrence. What was verified is removed, so a passage goes to its ends whatever surrounds it.

A chunk hands on the lines up to the chunks before and after it, which is as far as it has to grow: if both places are equal
beyond the next chunk's start, that chunk lies in both and grows itself. So no chunk's bytes grow with
the text. The first place of a line is never removed, as nothing precedes it; no line is lost from
the corpus. Places within a document count as well.

Digests are counted first; only texts that have a repeated chunk hand on those chunks'
bytes. Counting adds up before the shuffle and a frequent chunk's rows may be split by
the joins, so no task gathers all occurrences.

A passage in which the rolling hash chooses no two lines isn't found: of passages of n lines that have words, one in
SKIP to the power of n - 1, on average. One line alone is removed only with LONG_WORDS words.

Cases: null text is empty and keeps nothing to remove; a null doc_id comes after all
others; rows that repeat a doc_id are told apart by their text's hash; rows that repeat
both are one document, and each gets what the first of them keeps; blank lines alone
are never removed; an empty table gives an empty result; texts are read whole; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinderlog.llm._text import cut, map_arrow, text_bytes

#: One pair of lines in this many, on average, begins no chunk; but one does after MOST_LINES lines with words.
SKIP, MOST_LINES = 4, 32
#: A single line of this many words is a chunk.
LONG_WORDS = 50
_BLANK = b" \t\n\r\x0b\x0c"


class Chunk(NamedTuple):
    """Lines start to stop, and how far it may have to grow: from line low to line high."""

    start: int
    stop: int
    low: int
    high: int


def chunks(lines: list[bytes]) -> list[Chunk]:
    """The chunks of a text's lines, in order; they may overlap by a line."""
    worded = [i for i, x in enumerate(lines) if x.strip(_BLANK)]
    marks = [xxhash.xxh3_64_intdigest(lines[i]) for i in worded]
    chosen, last = [], -1
    for j in range(len(worded) - 1):
        rolling = (marks[j + 1] * 0x9E3779B97F4A7C15 + marks[j] * 0xC2B2AE3D27D4EB4F) & (2**64 - 1)
        if (rolling >> 32) % SKIP or j - last >= MOST_LINES:
            chosen.append(j)
            last = j
    out = []
    for k, j in enumerate(chosen):
        low = worded[chosen[k - 1]] + 1 if k else 0
        high = worded[chosen[k + 1]] + 1 if k + 1 < len(chosen) else len(lines)
        out.append(Chunk(worded[j], worded[j + 1] + 1, min(low, worded[j]), max(high, worded[j + 1] + 1)))
    for i in worded:
        if len(lines[i]) >= 2 * LONG_WORDS - 1 and len(lines[i].split()) >= LONG_WORDS:
            out.append(Chunk(i, i + 1, max(0, i - 1), min(len(lines), i + 2)))
    return out


def _digest(lines: list[bytes], chunk: Chunk) -> bytes:
    return hashlib.blake2b(b"\n".join(lines[chunk.start : chunk.stop]), digest_size=16).digest()


def grown(before: list[bytes], after: list[bytes], first_before: list[bytes], first_after: list[bytes]) -> tuple[int, int]:
    """How many lines before and after two equal chunks are equal, too."""
    up = down = 0
    while up < min(len(before), len(first_before)) and before[-1 - up] == first_before[-1 - up]:
        up += 1
    while down < min(len(after), len(first_after)) and after[down] == first_after[down]:
        down += 1
    return up, down


def _rows(documents: DataFrame) -> DataFrame:
    """doc_id, text and a row key that tells rows of a doc_id apart by text and number."""
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("mark", F.xxhash64("text"))


def _packed(rows: DataFrame) -> DataFrame:
    """rows with their text compressed as it is read, for the joins that deal texts out anew."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        packer = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            yield {"doc_id": batch.column("doc_id"), "mark": batch.column("mark"), "packed": [packer.compress(x) for x in text_bytes(batch.column("text"))]}

    return map_arrow(rows, run, "doc_id long, mark long, packed binary")


def _unpacked(column: pa.Array) -> Iterator[bytes]:
    unpacker = zstandard.ZstdDecompressor()
    return (unpacker.decompress(x) for x in column.to_pylist())


def removed_lines(documents: DataFrame) -> DataFrame:
    """(doc_id, mark, start, stop) of verified repetitions, as grown."""
    rows = _rows(documents)

    def meta(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            out: dict[str, list] = {"doc_id": [], "mark": [], "chunk": [], "digest": []}
            for doc_id, mark, text in zip(*(batch.column(x).to_pylist() for x in ("doc_id", "mark", "text")), strict=True):
                lines = text.encode().split(b"\n")
                for i, chunk in enumerate(chunks(lines)):
                    for name, value in zip(out, (doc_id, mark, i, _digest(lines, chunk)), strict=True):
                        out[name].append(value)
            yield out

    found = cut(map_arrow(rows, meta, "doc_id long, mark long, chunk int, digest binary"))
    place = F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "mark", "chunk")
    repeated = found.groupBy("digest").agg(F.count("*").alias("n"), F.min(place).alias("first")).where("n > 1")
    flagged = cut(found.join(repeated, "digest").select("doc_id", "mark", "chunk", "digest", (place == F.col("first")).alias("is_first")))
    wanted = flagged.groupBy("doc_id", "mark").agg(F.collect_set(F.struct("chunk", "is_first")).alias("wanted"))
    own = wanted.withColumnsRenamed({"doc_id": "__id", "mark": "__mark"})
    texts = _packed(rows).join(own, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("mark") == F.col("__mark"))).select("doc_id", "mark", "packed", "wanted")

    def bytes_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            out: dict[str, list] = {x: [] for x in ("doc_id", "mark", "start", "stop", "digest", "is_first", "part", "before", "after")}
            rows = zip(batch.column("doc_id").to_pylist(), batch.column("mark").to_pylist(), _unpacked(batch.column("packed")), batch.column("wanted").to_pylist(), strict=True)
            for doc_id, mark, text, some in rows:
                lines = text.split(b"\n")
                by_number = {x["chunk"]: x["is_first"] for x in some}
                for i, c in enumerate(chunks(lines)):
                    if i in by_number:
                        values = (doc_id, mark, c.start, c.stop, _digest(lines, c), by_number[i], b"\n".join(lines[c.start : c.stop]), lines[c.low : c.start], lines[c.stop : c.high])
                        for name, value in zip(out, values, strict=True):
                            out[name].append(value)
            yield out

    parts = cut(map_arrow(texts, bytes_of, "doc_id long, mark long, start int, stop int, digest binary, is_first boolean, part binary, before array<binary>, after array<binary>"))
    firsts = parts.where("is_first").dropDuplicates(["digest"]).select("digest", F.col("part").alias("first_part"), F.col("before").alias("first_before"), F.col("after").alias("first_after"))
    pairs = parts.where("NOT is_first").drop("is_first").join(firsts, "digest").where("part = first_part")

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            by = [grown(*x) for x in zip(*(batch.column(x).to_pylist() for x in ("before", "after", "first_before", "first_after")), strict=True)]
            start, stop = batch.column("start").to_pylist(), batch.column("stop").to_pylist()
            yield {"doc_id": batch.column("doc_id"), "mark": batch.column("mark"), "start": [a - up for a, (up, _) in zip(start, by, strict=True)], "stop": [b + down for b, (_, down) in zip(stop, by, strict=True)]}

    pairs = pairs.select("doc_id", "mark", "start", "stop", "before", "after", "first_before", "first_after")
    return map_arrow(pairs, grow, "doc_id long, mark long, start int, stop int").distinct()


def clean(documents: DataFrame, with_text: bool = True) -> DataFrame:
    """doc_id, n_lines, n_removed_lines, n_removed_bytes, text_sha256 (and text) of every row."""
    rows = _rows(documents)
    gone = removed_lines(documents).groupBy("doc_id", "mark").agg(F.collect_set(F.struct("start", "stop")).alias("gone"))
    gone = gone.withColumnsRenamed({"doc_id": "__id", "mark": "__mark"})
    joined = _packed(rows).join(gone, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("mark") == F.col("__mark")), "left").select("doc_id", "packed", "gone")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            out: dict[str, list] = {"doc_id": [], "n_lines": [], "n_removed_lines": [], "n_removed_bytes": [], "text_sha256": [], "text": []}
            for doc_id, data, some in zip(batch.column("doc_id").to_pylist(), _unpacked(batch.column("packed")), batch.column("gone").to_pylist(), strict=True):
                n = data.count(b"\n") + 1 if data else 0
                kept, left = n, data
                if some:
                    dropped = {i for x in some for i in range(x["start"], x["stop"])}
                    out_lines = [x for i, x in enumerate(data.split(b"\n")) if i not in dropped]
                    kept, left = len(out_lines), b"\n".join(out_lines)
                for name, value in zip(out, (doc_id, n, n - kept, len(data) - len(left), hashlib.sha256(left).hexdigest(), left.decode() if with_text else None), strict=True):
                    out[name].append(value)
            yield out

    return map_arrow(joined, run, "doc_id long, n_lines long, n_removed_lines long, n_removed_bytes long, text_sha256 string" + ", text string" * with_text)

"""Vector bin packing of examples into training sequences.

Each example has three sizes: tokens, segments and loss-bearing tokens, and a sequence
limits all three. A sequence is filled with the example that fits and whose sizes have
the largest dot product with what the sequence has left (each divided by its limit),
again and again, until none fits. Examples of equal sizes are one type, so a choice
looks at the types, not at all examples.

Documents longer than a sequence are cut; each cut piece is an example. Pieces are dealt
to tasks by a hash of document and place, so neither a long document nor a hot source
gathers in one task. A task packs GROUP_ROWS pieces at a time, and each such group leaves
about one sequence unfilled. Examples with equal dot products go by size, smaller tokens
first, and equal sizes by `by`.

Cases: null text is empty and has its end id alone; null doc_ids and repeated rows are
packed like any other; an empty table gives an empty result; texts are encoded whole; an
example beyond a limit by itself is an error of the general interface and can't come
from documents; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinderlog.llm._text import cut, docs_of, map_arrow, workers_find_package
from cinderlog.llm.bpe import encoder

SEQUENCE_TOKENS = 2048
#: Segments of a sequence at most: each has a token, so by default this adds nothing to the limit on tokens.
MAX_SEGMENTS = SEQUENCE_TOKENS
END_ID = 1
#: Examples that are packed together: about 100 MB.
GROUP_ROWS = 200_000


def fill(sizes: np.ndarray, limits: tuple[int, int, int]) -> tuple[np.ndarray, np.ndarray]:
    """For examples with (tokens, segments, loss tokens): each one's sequence and offset."""
    if not len(sizes):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    if (sizes > np.array(limits)).any():
        raise ValueError("an example is larger than a sequence")
    types, kind = np.unique(sizes, axis=0, return_inverse=True)
    order = np.argsort(kind.ravel(), kind="stable")
    left = np.bincount(kind.ravel(), minlength=len(types))
    taken = np.cumsum(left) - left  # next example of each type in order
    scale = np.array([1 / max(1, x) for x in limits])
    weights = types * scale
    sequence, offset = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    room, number = np.array(limits), 0
    live = np.arange(len(types))
    for _ in range(len(sizes)):
        good = live[(types[live] <= room).all(1)]
        if not len(good):
            room, number = np.array(limits), number + 1
            good = live
        best = good[np.argmax(weights[good] @ (room * scale))]
        at = order[taken[best]]
        sequence[at], offset[at] = number, limits[0] - room[0]
        room = room - types[best]
        taken[best] += 1
        left[best] -= 1
        if not left[best]:
            live = live[live != best]
    return sequence, offset


def pieces(documents: DataFrame, vocabulary_path: str, tokens: int = SEQUENCE_TOKENS) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens of the pieces of at most `tokens` ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        own, end = encoder(vocabulary_path), np.array([END_ID], "<u4")
        for batch in batches:
            out: dict[str, list] = {x: [] for x in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")}
            for doc_id, found in zip(batch.column("doc_id").to_pylist(), own.encode(batch.column("text").to_pylist()), strict=True):
                ids = np.concatenate([found, end])
                for start in range(0, len(ids), tokens):
                    part = ids[start : start + tokens]
                    for name, value in zip(out, (doc_id, start, len(part), zlib.crc32(part.tobytes()), len(ids)), strict=True):
                        out[name].append(value)
            yield out

    return map_arrow(docs_of(documents), run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def pack(examples: DataFrame, tokens: str, segments: str, loss: str, limits: tuple[int, int, int], by: list[str]) -> DataFrame:
    """examples with sequence_id and offset; `by` names columns that tell examples apart.

    A sequence_id is unique, not dense: the task's number and the task's own count.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    columns = [x for x in examples.columns if x not in ("sequence_id", "offset")]
    dealt = examples.select(*columns).repartition(F.xxhash64(*by)).sortWithinPartitions(*by)
    schema = to_arrow_schema(dealt.schema)
    schema = schema.append(pa.field("sequence_id", pa.int64())).append(pa.field("offset", pa.int64()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 36
        for group in _groups(batches):
            sizes = np.stack([group.column(x).to_numpy().astype(np.int64) for x in (tokens, segments, loss)], 1)
            sequence, offset = fill(sizes, limits)
            table = group.append_column("sequence_id", pa.array(sequence + base)).append_column("offset", pa.array(offset))
            yield from table.cast(schema).combine_chunks().to_batches()
            base += int(sequence.max()) + 1

    workers_find_package(examples.sparkSession)
    return dealt.mapInArrow(run, dealt.withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")}).schema)


def _groups(batches: Iterator[pa.RecordBatch], rows: int = GROUP_ROWS) -> Iterator[pa.Table]:
    """Batches in tables of about `rows` rows, packed one after another in bounded memory."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(x.num_rows for x in held) >= rows:
            yield pa.Table.from_batches(held)
            held = []
    if held:
        yield pa.Table.from_batches(held)


def pack_documents(documents: DataFrame, vocabulary_path: str, tokens: int = SEQUENCE_TOKENS, segments: int = MAX_SEGMENTS) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece.

    All ids of a document bear loss, so that limit is the one on tokens.
    """
    rows = cut(pieces(documents, vocabulary_path, tokens)).withColumns({"n_segments": F.lit(1).cast("long"), "loss_tokens": F.col("length")})
    return pack(rows, "length", "n_segments", "loss_tokens", (tokens, segments, tokens), ["doc_id", "start", "ids_crc32"]).drop("n_segments", "loss_tokens")

"""Shared helpers: shared-folder tables, Arrow mapping, vectorised word hashing."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text hashed at once; bounds the working arrays whatever a text's length.
PIECE = 1 << 20
ASCII_SPACE = b" \t\n\r\x0b\x0c"


def work_dir(spark: SparkSession) -> str:
    """A new folder name under the shared folder in spark.checkpoint.dir.

    Where the setting is absent, a folder of this machine is used in local mode (tests in
    one JVM); on a cluster that is an error, as executors don't share such a folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.gettempdir() + "/cinderlog-work"
    return f"{base.rstrip('/')}/cinderlog-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and reread it, which cuts its lineage."""
    spark = df.sparkSession
    path = work_dir(spark)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def workers_find_package(spark: SparkSession) -> None:
    """Python workers on this machine import the package from where the driver did.

    On a cluster, install it on the executors or hand it over with --py-files.
    """
    root = str(Path(__file__).resolve().parents[2])
    environment = spark.sparkContext.environment
    if root not in environment.get("PYTHONPATH", "").split(os.pathsep):
        environment["PYTHONPATH"] = os.pathsep.join(x for x in (root, environment.get("PYTHONPATH", "")) if x)


def docs_of(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) alone, so other columns of any name can't clash; null text is empty."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def map_arrow(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterable[dict]], schema: str) -> DataFrame:
    """mapInArrow for a function that yields dicts of columns (lists or arrays)."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    target = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in f(batches):
            arrays = [
                x if isinstance(x := columns[field.name], (pa.Array, pa.ChunkedArray)) else pa.array(x, type=field.type)
                for field in target
            ]
            arrays = [x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in arrays]
            yield pa.RecordBatch.from_arrays(arrays, schema=target)

    workers_find_package(df.sparkSession)
    return df.mapInArrow(run, schema)


_RNG = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _RNG.integers(1, 2**64, 256, dtype=np.uint64, endpoint=False)
_BYTE_LOWER = _BYTE.copy()
_BYTE_LOWER[65:91] = _BYTE[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[list(ASCII_SPACE)] = True
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_POWERS: list[np.ndarray] = [np.empty(0, np.uint64), np.empty(0, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        for i, base in enumerate((_BASE, _INVERSE)):
            x = np.full(max(n, PIECE + 4096), base, np.uint64)
            x[0] = 1
            _POWERS[i] = np.multiply.accumulate(x)
    return _POWERS[0][:n], _POWERS[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _hash_buffer(buffer: bytes, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of one buffer, and where they start."""
    b = np.frombuffer(buffer, np.uint8)
    n = len(b)
    if not n:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    space = np.ones(n + 2, bool)
    space[1:-1] = _SPACE[b]
    starts = np.flatnonzero(space[:-1] & ~space[1:])
    ends = np.flatnonzero(~space[:-1] & space[1:])
    return span_hashes(buffer, starts, ends, _BYTE_LOWER if lower else _BYTE), starts


def span_hashes(buffer: bytes, starts: np.ndarray, ends: np.ndarray, table: np.ndarray = _BYTE) -> np.ndarray:
    """64-bit hashes of spans of a buffer, from sums of byte values times powers."""
    b = np.frombuffer(buffer, np.uint8)
    power, inverse = _powers(len(b))
    sums = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(table[b] * power, out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64)) if len(starts) else np.empty(0, np.uint64)


def _pieces(text: bytes) -> Iterator[bytes]:
    """text cut at white space into pieces of about PIECE bytes."""
    at = 0
    while at < len(text):
        end = min(len(text), at + PIECE)
        while end < len(text) and text[end] not in ASCII_SPACE:
            end += 1
        yield text[at:end]
        at = end


def word_hashes(texts: list[bytes], lower: bool) -> Iterator[np.ndarray]:
    """For each text, the 64-bit hashes of its words [^\\x20\\x09-\\x0D]+ in order.

    lower: A-Z count as a-z. Small texts are hashed together, long ones in pieces.
    """
    group: list[bytes] = []
    total = 0

    def together() -> Iterator[np.ndarray]:
        if group:
            hashes, starts = _hash_buffer(b"\n".join(group), lower)
            edges = np.cumsum([0, *(len(x) + 1 for x in group)])
            cuts = np.searchsorted(starts, edges)
            for i in range(len(group)):
                yield hashes[cuts[i] : cuts[i + 1]]

    for text in texts:
        if group and total + len(text) > PIECE:
            yield from together()
            group, total = [], 0
        if len(text) > PIECE:
            yield np.concatenate([_hash_buffer(x, lower)[0] for x in _pieces(text)])
        else:
            group.append(text)
            total += len(text) + 1
    yield from together()


def windows(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the windows of `size` consecutive words, in order; empty with fewer words."""
    n = len(words) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(size):
        out = mix(out * np.uint64(_BASE) + words[i : i + n])
    return out


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null is empty."""
    return [x or b"" for x in column.cast(pa.binary() if pa.types.is_string(column.type) else pa.large_binary()).to_pylist()]

"""Exact dedup over a cuckoo-filter index of live digests.

A text's digest is the SHA-256 of its UTF-8 bytes, with each run of ASCII white space
made one space. Every task keeps an index of the digests it has met: a cuckoo filter
answers most misses, a hit is verified against the full digests kept in the filter's
buckets, and an overflow rebuilds a filter of twice the size from those stored keys.
Tasks first collapse their own rows, so a digest that holds a third of all rows reaches
the shuffle once an index; then the digests of each shuffle partition are indexed in order,
a bounded slice at a time.

Cases: null text counts as empty, and empty texts are equal to each other; a null doc_id
never stays if the group has another and is null as keep_id if it hasn't; rows that
repeat a doc_id and a text all carry that group's values, and drop_copies lets one of
them stay; rows that share a doc_id but no text are judged apart; an empty table gives an empty
result; texts are read whole; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinderlog.llm._text import cut, docs_of, map_arrow, text_bytes

SLOTS = 4
KICKS = 200
#: Digests in an index at most, before a task hands them on: about 60 MB.
FLUSH = 200_000
_RUNS = re.compile(b"[\x20\x09-\x0d]+")


def normalised(text: bytes) -> bytes:
    return _RUNS.sub(b" ", text)


class DigestIndex:
    """Live digests with a value each; insertion, deletion and verified lookup.

    The filter has buckets of four 16-bit fingerprints; a digest may lie in either of
    two buckets that differ by a hash of its fingerprint (partial-key cuckoo hashing).
    """

    def __init__(self, buckets: int = 1 << 10) -> None:
        self.stored: dict[int, dict[bytes, object]] = {}  # first bucket of 2**16 -> digest -> value
        self.size = 0
        self.false_hits = 0
        self.resizes = 0
        self._start(buckets)

    def _start(self, buckets: int) -> None:
        self.mask = buckets - 1
        self.table = [0] * (buckets * SLOTS)
        self.turn = 0

    def _places(self, digest: bytes) -> tuple[int, int, int]:
        mark = int.from_bytes(digest[:2], "little") or 1
        one = int.from_bytes(digest[2:10], "little") & self.mask
        return mark, one, self._other(one, mark)

    def _other(self, bucket: int, mark: int) -> int:
        return (bucket ^ (mark * 0x5BD1E995)) & self.mask

    def maybe(self, digest: bytes) -> bool:
        """The filter's answer: false is certain."""
        mark, one, two = self._places(digest)
        return mark in self.table[one * SLOTS : one * SLOTS + SLOTS] or mark in self.table[two * SLOTS : two * SLOTS + SLOTS]

    def _put(self, digest: bytes) -> bool:
        mark, one, two = self._places(digest)
        for bucket in (one, two):
            for slot in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                if not self.table[slot]:
                    self.table[slot] = mark
                    return True
        bucket = two
        for _ in range(KICKS):
            self.turn = (self.turn + 1) % SLOTS
            slot = bucket * SLOTS + self.turn
            mark, self.table[slot] = self.table[slot], mark
            bucket = self._other(bucket, mark)
            for slot in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                if not self.table[slot]:
                    self.table[slot] = mark
                    return True
        return False

    def _grow(self) -> None:
        buckets = self.mask + 1
        while True:
            buckets *= 2
            self.resizes += 1
            self._start(buckets)
            if all(self._put(x) for bucket in self.stored.values() for x in bucket):
                return

    @staticmethod
    def _bucket(digest: bytes) -> int:
        return int.from_bytes(digest[10:12], "little")

    def get(self, digest: bytes) -> object | None:
        if not self.maybe(digest):
            return None
        found = self.stored.get(self._bucket(digest), {}).get(digest)
        self.false_hits += found is None
        return found

    def set(self, digest: bytes, value: object) -> None:
        """Inserts a digest, or replaces its value."""
        bucket = self.stored.setdefault(self._bucket(digest), {})
        fresh = digest not in bucket
        bucket[digest] = value
        if fresh:
            self.size += 1
            if self.size > 0.9 * len(self.table) or not self._put(digest):
                self._grow()

    def delete(self, digest: bytes) -> bool:
        """Removes a live digest; false if it isn't live."""
        bucket = self.stored.get(self._bucket(digest), {})
        if digest not in bucket:
            return False
        del bucket[digest]
        self.size -= 1
        mark, one, two = self._places(digest)
        for slot in [*range(one * SLOTS, one * SLOTS + SLOTS), *range(two * SLOTS, two * SLOTS + SLOTS)]:
            if self.table[slot] == mark:
                self.table[slot] = 0
                break
        return True

    def items(self) -> Iterator[tuple[bytes, object]]:
        for bucket in self.stored.values():
            yield from bucket.items()


def digests(documents: DataFrame) -> DataFrame:
    """(doc_id, digest) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            yield {"doc_id": batch.column("doc_id"), "digest": [hashlib.sha256(normalised(x)).digest() for x in text_bytes(batch.column("text"))]}

    return map_arrow(docs_of(documents), run, "doc_id long, digest binary")


def _smallest(a: int | None, b: int | None) -> int | None:
    return b if a is None else a if b is None else min(a, b)


def _collapse(rows: DataFrame, in_order: bool = False) -> DataFrame:
    """(digest, keep_id, n): rows of a task with equal digests made one, through an index of at most FLUSH digests.

    in_order: rows come sorted by digest, so no digest is in two indexes, however many a task has.
    """

    def out(index: DigestIndex) -> dict:
        items = list(index.items())
        return {"digest": [x[0] for x in items], "keep_id": [x[1][0] for x in items], "n": [x[1][1] for x in items]}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        index = DigestIndex()
        last = None
        for batch in batches:
            for digest, i, n in zip(*(batch.column(x).to_pylist() for x in ("digest", "keep_id", "n")), strict=True):
                if index.size >= FLUSH and not (in_order and digest == last):
                    yield out(index)
                    index = DigestIndex()
                found = index.get(digest)
                index.set(digest, (i, n) if found is None else (_smallest(found[0], i), found[1] + n))
                last = digest
        yield out(index)

    return map_arrow(rows, run, "digest binary, keep_id long, n long")


def exact_groups(documents: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row."""
    rows = cut(digests(documents))
    local = _collapse(rows.select("digest", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("n")))
    groups = _collapse(local.repartition("digest").sortWithinPartitions("digest"), True)
    return rows.join(groups, "digest").select(
        "doc_id", "keep_id", F.col("n").alias("group_size"), F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("keep_id").isNull()).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )


def drop_copies(documents: DataFrame) -> DataFrame:
    """One document of each group of equal texts, with all its columns: of rows with the smallest doc_id, one."""
    digest = F.sha2(F.regexp_replace(F.coalesce(F.col("text"), F.lit("")), r"[\x20\x09-\x0D]+", " "), 256)
    kept = exact_groups(documents).where("kept").groupBy(F.col("text_sha256").alias("digest"), F.col("doc_id").alias("kept_id"))
    kept = cut(kept.agg(F.count("*").alias("times")))
    rows = documents.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"), digest.alias("own"))
    stay = (rows["own"] == kept["digest"]) & rows["id"].eqNullSafe(kept["kept_id"])
    once = rows.join(kept.where("times = 1"), stay, "left_semi")
    repeated = rows.join(kept.where("times > 1"), stay, "left_semi")
    return once.unionByName(repeated.dropDuplicates(["own"])).select("row.*")

from __future__ import annotations

import glob
import os
import threading

import pytest

from cinderlog.operators.ledger import upsert_embeddings
from cinderlog.sources.versioned import Conflict, Folder, VersionedTable

SCHEMA = "failure_id long, model string, team_id long, embedding string, source_text string"
KEYS = ["failure_id", "model"]


def rows(spark, ids, text, team=1):
    return spark.createDataFrame([(i, "m", team, f"e{text}", f"t{text}") for i in ids], SCHEMA)


def content(df):
    return {r.failure_id: (r.team_id, r.embedding) for r in df.collect()}


@pytest.fixture
def table(spark, tmp_path):
    return VersionedTable.create(rows(spark, range(100), "old"), f"file://{tmp_path}/t", KEYS, buckets=8)


def test_upsert_rewrites_touched_buckets_only(spark, table):
    before = table.version()
    new = table.upsert(rows(spark, [3, 500], "new", team=9), upsert_embeddings)
    touched = [b for b in range(8) if new.files[b] != before.files[b]]
    assert 1 <= len(touched) <= 2
    want = {i: (1, "eold") for i in range(100)} | {3: (1, "enew"), 500: (9, "enew")}  # an old row keeps its team
    assert content(table.read()) == want
    assert content(table.read(0)) == {i: (1, "eold") for i in range(100)}  # the version before is as it was
    assert table.read(buckets=touched).count() < 60


def test_a_batch_that_comes_again_changes_nothing(spark, table):
    first = table.upsert(rows(spark, [1], "a"), upsert_embeddings, ("s", 5))
    files = sorted(glob.glob(f"{table.path[7:]}/data/**/*.parquet", recursive=True))
    for number in (5, 4):
        assert table.upsert(rows(spark, [1], "b"), upsert_embeddings, ("s", number)) == first
    assert sorted(glob.glob(f"{table.path[7:]}/data/**/*.parquet", recursive=True)) == files
    assert table.upsert(rows(spark, [1], "c"), upsert_embeddings, ("other", 4)).number == first.number + 1
    assert content(table.read())[1] == (1, "ec")


def test_one_of_two_writers_tries_again(spark, table, monkeypatch):
    """Both have read version 0 when they publish; the one that loses goes on from the other's version."""
    meet, publish, conflicts = threading.Barrier(2, timeout=120), VersionedTable._publish, []

    def both(self, version):
        if version.number == 1:
            meet.wait()
        try:
            publish(self, version)
        except Conflict:
            conflicts.append(version.number)
            raise

    monkeypatch.setattr(VersionedTable, "_publish", both)
    errors = []

    def write(ids, text):
        try:
            VersionedTable(spark, table.path).upsert(rows(spark, ids, text), upsert_embeddings)
        except Exception as e:  # noqa: BLE001
            errors.append(e)

    threads = [threading.Thread(target=write, args=x) for x in ((range(0, 60), "one"), (range(200, 230), "two"))]
    [x.start() for x in threads]
    [x.join() for x in threads]
    assert not errors and conflicts == [1] and table.version().number == 2
    want = {i: (1, "eone" if i < 60 else "eold") for i in range(100)} | {i: (1, "etwo") for i in range(200, 230)}
    assert content(table.read()) == want


def test_files_of_untouched_buckets_are_used_again_after_a_conflict(spark, table, monkeypatch):
    publish, writes, write = VersionedTable._publish, [], VersionedTable._write
    other = VersionedTable(spark, table.path)

    def late(self, version):
        if self is table and version.number == 1:
            other.upsert(rows(spark, [7], "other"), upsert_embeddings)
        publish(self, version)

    def counted(self, df, keys, buckets, touched):
        if self is table:
            writes.append(touched)
        return write(self, df, keys, buckets, touched)

    monkeypatch.setattr(VersionedTable, "_publish", late)
    monkeypatch.setattr(VersionedTable, "_write", counted)
    table.upsert(rows(spark, range(100), "mine"), upsert_embeddings)
    assert len(writes) == 2 and len(writes[0]) == 8 and len(writes[1]) == 1  # the other writer's bucket alone
    assert content(table.read()) == {i: (1, "emine") for i in range(100)}


def test_publishing_never_replaces(spark, tmp_path):
    folder = Folder(spark, f"file://{tmp_path}/f")
    folder.publish("x.json", "one")
    with pytest.raises(Conflict):
        folder.publish("x.json", "two")
    assert folder.read("x.json") == "one" and os.listdir(tmp_path / "f") == ["x.json"] or ".x" not in folder.names()


def test_stream_writes_each_batch_once(spark, table, tmp_path):
    source = f"{tmp_path}/in"
    rows(spark, [1, 2], "s1").coalesce(1).write.parquet(source)
    stream = lambda: spark.readStream.schema(SCHEMA).parquet(source).writeStream.foreachBatch(table.each_batch("in", upsert_embeddings)).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    stream().awaitTermination(120)
    rows(spark, [2, 300], "s2").coalesce(1).write.mode("append").parquet(source)
    stream().awaitTermination(120)
    found = content(table.read())
    assert (found[1], found[2], found[300]) == ((1, "es1"), (1, "es2"), (1, "es2"))
    number = table.version().number
    table.each_batch("in", upsert_embeddings)(rows(spark, [1], "again"), 1)
    assert table.version().number == number


def test_vacuum(spark, table):
    for i in range(3):
        table.upsert(rows(spark, [5], f"v{i}"), upsert_embeddings)
    want = content(table.read())
    assert len(table.vacuum(keep=1)) == 2
    assert content(table.read()) == want and table.vacuum(keep=1) == []
    assert table.read(buckets=[]).count() == 0

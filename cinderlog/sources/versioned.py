"""A keyed table of immutable files with atomic versions: readers see whole versions, writers rewrite only the buckets they touch.

A table is a folder with `data/` (Parquet files, never changed) and `versions/`, in which file N names the data files of
version N by bucket, and which batches are in it. A row's bucket is a hash of its key. An upsert reads the
buckets that its changes fall in, writes their new files, and publishes version N + 1 only if nobody else has: the
file is made whole under another name and then given its own in one step that fails if it exists. Who loses looks at the
new version and goes on from there; files it wrote for buckets that the winner didn't touch are used again.

A batch carries an id (a stream's name and its number). A version that has the batch, or a later one of the stream, is
left as it is, so a batch that is handed over again changes nothing; this makes foreachBatch exactly-once.

The driver holds file names only: as many as there are buckets, each bucket being one file, or several where it is large.
Old versions and files of failed attempts stay until vacuum() is called.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

Merge = Callable[[DataFrame, DataFrame], DataFrame]


class Conflict(Exception):
    """Another writer published this version first."""


@dataclass(frozen=True)
class Version:
    number: int
    files: dict[int, list[str]] = field(default_factory=dict)  # bucket -> names under data/
    batches: dict[str, int] = field(default_factory=dict)  # stream -> its last batch
    schema: str = ""
    keys: list[str] = field(default_factory=list)
    buckets: int = 0

    def text(self) -> str:
        return json.dumps({**self.__dict__, "files": {str(k): v for k, v in self.files.items()}}, sort_keys=True)


class Folder:
    """Whole small files of a folder, by the file system that its path names."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.jvm = spark._jvm
        self.path = self.jvm.org.apache.hadoop.fs.Path(path)
        self.conf = spark._jsc.hadoopConfiguration()
        self.files = self.path.getFileSystem(self.conf)
        self.local = self.files.getUri().getScheme() == "file"
        self.files.mkdirs(self.path)

    def _at(self, name: str):  # noqa: ANN202
        return self.jvm.org.apache.hadoop.fs.Path(self.path, name)

    def names(self, suffix: str = "") -> list[str]:
        return sorted(x.getPath().getName() for x in self.files.listStatus(self.path) if x.getPath().getName().endswith(suffix))

    def read(self, name: str) -> str:
        stream = self.files.open(self._at(name))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def publish(self, name: str, text: str) -> None:
        """Makes a file that wasn't there, whole, in one step; Conflict if it is there."""
        temporary = f".{uuid.uuid4().hex}.tmp"
        stream = self.files.create(self._at(temporary), False)
        stream.write(bytearray(text.encode()))
        stream.close()
        try:
            if self.local:  # a local rename would replace the other writer's file, a link doesn't
                folder = self.path.toUri().getPath()
                os.link(f"{folder}/{temporary}", f"{folder}/{name}")
            else:
                context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.path.toUri(), self.conf)
                none = self.jvm.org.apache.hadoop.fs.Options.Rename.NONE
                options = self.jvm.java.lang.reflect.Array.newInstance(none.getClass(), 1)
                options[0] = none
                context.rename(self._at(temporary), self._at(name), options)
        except FileExistsError:
            raise Conflict(name) from None
        except Exception as e:
            if self.files.exists(self._at(name)):
                raise Conflict(name) from e
            raise
        finally:
            self.files.delete(self._at(temporary), False)

    def delete(self, name: str) -> None:
        self.files.delete(self._at(name), True)


class VersionedTable:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.versions = Folder(spark, f"{self.path}/versions")

    @classmethod
    def create(cls, rows: DataFrame, path: str, keys: list[str], buckets: int = 64) -> VersionedTable:
        """A table of rows, which must have one row for each key."""
        table = cls(rows.sparkSession, path)
        files = table._write(rows, keys, buckets, list(range(buckets)))
        table._publish(Version(0, files, {}, rows.schema.json(), keys, buckets))
        return table

    def version(self, number: int | None = None) -> Version:
        """The newest version, or the one of a number."""
        names = self.versions.names(".json")
        name = names[-1] if number is None else f"{number:012d}.json"
        got = json.loads(self.versions.read(name))
        return Version(**got | {"files": {int(k): v for k, v in got["files"].items()}})

    def read(self, number: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        """The table as of a version; buckets: those only."""
        return self._of(self.version(number), buckets)

    def _of(self, version: Version, buckets: list[int] | None = None) -> DataFrame:
        schema = StructType.fromJson(json.loads(version.schema))
        names = [f"{self.path}/data/{x}" for b, files in version.files.items() if buckets is None or b in buckets for x in files]
        return self.spark.read.schema(schema).parquet(*names) if names else self.spark.createDataFrame([], schema)

    def _publish(self, version: Version) -> None:
        self.versions.publish(f"{version.number:012d}.json", version.text())

    @staticmethod
    def bucket(keys: list[str], buckets: int):  # noqa: ANN205
        return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")

    def _write(self, rows: DataFrame, keys: list[str], buckets: int, touched: list[int]) -> dict[int, list[str]]:
        """Writes rows by bucket to new files; the names by bucket, empty buckets with none."""
        name = uuid.uuid4().hex
        rows = rows.withColumn("__bucket", self.bucket(keys, buckets))
        rows.repartition("__bucket").sortWithinPartitions("__bucket", *keys).write.partitionBy("__bucket").parquet(f"{self.path}/data/{name}")
        files: dict[int, list[str]] = {b: [] for b in touched}
        written = Folder(self.spark, f"{self.path}/data/{name}")
        for folder in written.names():
            if folder.startswith("__bucket="):
                inner = Folder(self.spark, f"{self.path}/data/{name}/{folder}")
                files[int(folder.removeprefix("__bucket="))] = [f"{name}/{folder}/{x}" for x in inner.names(".parquet")]
        return files

    def upsert(self, changes: DataFrame, merge: Merge, batch: tuple[str, int] | None = None, attempts: int = 20) -> Version:
        """Publishes the table after changes, as merge(rows, changes) makes it of the buckets that changes fall in.

        Idempotent for a batch (stream, number). The changes are read once for each attempt that has buckets to do.
        """
        done: dict[int, tuple[list[str], list[str]]] = {}  # bucket -> the files it was made from, and those made
        for _ in range(attempts):
            now = self.version()
            if batch is not None and now.batches.get(batch[0], -1) >= batch[1]:
                return now
            own = changes.withColumn("__bucket", self.bucket(now.keys, now.buckets))
            touched = sorted(r[0] for r in own.select("__bucket").distinct().collect())  # at most as many as buckets
            stale = [b for b in touched if b not in done or done[b][0] != now.files.get(b, [])]
            if stale:
                some = own.where(F.col("__bucket").isin(stale)).drop("__bucket")
                made = self._write(merge(self._of(now, stale), some), now.keys, now.buckets, stale)
                done |= {b: (now.files.get(b, []), made[b]) for b in stale}
            files = now.files | {b: done[b][1] for b in touched}
            batches = now.batches | ({batch[0]: batch[1]} if batch else {})
            new = Version(now.number + 1, files, batches, now.schema, now.keys, now.buckets)
            try:
                self._publish(new)
                return new
            except Conflict:
                continue
        raise Conflict(f"{self.path}: {attempts} other writers were faster")

    def each_batch(self, stream: str, merge: Merge) -> Callable[[DataFrame, int], None]:
        """For foreachBatch: every micro-batch is in the table once, however often it is handed over."""

        def run(rows: DataFrame, number: int) -> None:
            rows = rows.persist()
            try:
                self.upsert(rows, merge, (stream, number))
            finally:
                rows.unpersist()

        return run

    def vacuum(self, keep: int = 1) -> list[str]:
        """Deletes all versions but the newest `keep`, and the folders of files that none of these name. Not while others write."""
        names = self.versions.names(".json")
        for name in names[:-keep]:
            self.versions.delete(name)
        used = {x.split("/")[0] for name in names[-keep:] for files in json.loads(self.versions.read(name))["files"].values() for x in files}
        data = Folder(self.spark, f"{self.path}/data")
        gone = [x for x in data.names() if x not in used]
        for x in gone:
            data.delete(x)
        return gone

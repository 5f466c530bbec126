"""A failure's history on a stream: state for each team and signature, read and brought forward as the failure comes in.

An extension: there is nothing to match but the roll-up and the history of a table, which a stream equals in the end.
State is kept by transformWithState in RocksDB, which spills to disk, so keys aren't bounded by memory; set
spark.sql.streaming.stateStore.providerClass to its provider. Each key's state is a few numbers and the ids of its
projects, and goes when nothing came for the key within `ttl`.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from cinderlog.workers import workers_find_package

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: What a stream of failures and resolutions has; a row with a log_id is a failure, one without is a resolution.
INPUT = "team_id long, signature_hash string, log_id long, project_id long, ts timestamp, resolution string"
OUTPUT = "team_id long, signature_hash string, log_id long, ts timestamp, occurrence_count long, projects_affected long, first_seen_at timestamp, last_seen_at timestamp, is_known boolean, known_resolution string"
_SEEN = "occurrences long, projects long, first_us long, last_us long"


def _micros(ts: pd.Series) -> pd.Series:
    return ts.astype("datetime64[us]").astype("int64")


class Histories(StatefulProcessor):
    """Counts failures as they arrive, and remembers the last resolution that has text."""

    def __init__(self, ttl_ms: int | None) -> None:
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", _SEEN, self.ttl_ms)
        self.known = handle.getValueState("known", "resolution string")
        self.projects = handle.getMapState("projects", "project_id long", "there boolean", self.ttl_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        n, projects, first, last = self.seen.get() or (0, 0, None, None)
        resolution = (self.known.get() or (None,))[0]
        before = n
        for part in rows:
            said = part[part.log_id.isna()].resolution.dropna()
            said = said[said.str.strip() != ""]
            if len(said):
                resolution = said.iloc[-1]
                self.known.update((resolution,))
            failures = part[part.log_id.notna()]
            if not len(failures):
                continue
            new = {}
            for project in failures.project_id.dropna().unique():
                if not self.projects.containsKey((int(project),)):
                    self.projects.updateValue((int(project),), (True,))
                    new[project] = True
            fresh = failures.project_id.isin(list(new)) & ~failures.project_id.duplicated()
            at = _micros(failures.ts)
            low, high = at.cummin(), at.cummax()
            low, high = (low, high) if first is None else (low.clip(upper=first), high.clip(lower=last))
            counts, affected = range(n + 1, n + 1 + len(failures)), projects + fresh.cumsum()
            yield pd.DataFrame({
                "team_id": key[0], "signature_hash": key[1], "log_id": failures.log_id.astype("int64"), "ts": failures.ts, "occurrence_count": list(counts), "projects_affected": affected.astype("int64"),
                "first_seen_at": pd.to_datetime(low, unit="us"), "last_seen_at": pd.to_datetime(high, unit="us"), "is_known": resolution is not None, "known_resolution": pd.Series([resolution] * len(failures), index=failures.index, dtype=object),
            })
            n, projects, first, last = n + len(failures), int(affected.iloc[-1]), int(low.iloc[-1]), int(high.iloc[-1])
        if n > before:
            self.seen.update((n, projects, first, last))

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues: object) -> None:  # noqa: N802, N803
        found = initialState.known_resolution.dropna()
        found = found[found.str.strip() != ""]
        if len(found):
            self.known.update((found.iloc[-1],))

    def close(self) -> None:
        pass


def with_history(stream: DataFrame, ttl_seconds: float | None = None, known: DataFrame | None = None) -> DataFrame:
    """OUTPUT: each failure of a stream (INPUT) with what its team has seen of its signature, itself included.

    known: team_id, signature_hash, known_resolution at the stream's start; resolutions that come in replace it, from
    the failures after them on. Resolutions don't go with the ttl. Rows are counted in the order in which they arrive.
    With a ttl Spark makes batches for the clock's sake, too, so such a stream runs until it is stopped (availableNow doesn't end).
    """
    workers_find_package(stream.sparkSession)
    keys = ["team_id", "signature_hash"]
    start = None if known is None else known.select(*keys, "known_resolution").where(F.col("known_resolution").isNotNull()).groupBy(*keys)
    ttl = None if ttl_seconds is None else int(ttl_seconds * 1000)
    return stream.groupBy(*keys).transformWithStateInPandas(Histories(ttl), OUTPUT, "Append", "ProcessingTime" if ttl else "None", start)

from __future__ import annotations

import random
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from cinderlog.operators import signature
from cinderlog.streaming import signatures


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, signatures.PROVIDER)
    yield spark
    spark.conf.set(name, before)


def failures(rng, n):
    at = datetime(2024, 1, 1)
    rows = [(rng.randrange(3), f"h{rng.randrange(6) if rng.random() < 0.4 else 0}", i, rng.choice([1, 2, 3, None]), at + timedelta(seconds=i * 7), None) for i in range(n)]
    rng.shuffle(rows)
    return rows


def run(spark, source, out, checkpoint, **options):
    stream = spark.readStream.schema(signatures.INPUT).option("maxFilesPerTrigger", 1).parquet(source)
    found = signatures.with_history(stream, **options)
    found.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination(300)


def test_a_shuffled_replay_with_a_restart_equals_the_table(rocks, tmp_path):
    spark, rows = rocks, failures(random.Random(5), 240)
    source, out, checkpoint = (f"{tmp_path}/{x}" for x in ("in", "out", "c"))
    known = spark.createDataFrame([(0, "h0", "restart it"), (1, "h1", " "), (1, "h2", None)], "team_id long, signature_hash string, known_resolution string")
    for i in range(4):
        part = rows[i * 60 : (i + 1) * 60]
        if i == 2:
            part = [*part, (2, "h0", None, None, datetime(2024, 1, 2), "raise the limit"), (2, "h1", None, None, datetime(2024, 1, 2), "")]
        spark.createDataFrame(part, signatures.INPUT).coalesce(1).write.mode("append").parquet(source)
        if i in (1, 3):  # the second time it goes on from the checkpoint
            run(spark, source, out, checkpoint, known=known)
    found = spark.read.parquet(out)
    table = signature.rollup(spark.createDataFrame(rows, signatures.INPUT))
    ends = found.groupBy("team_id", "signature_hash").agg(F.max("occurrence_count").alias("occurrence_count"), F.max("projects_affected").alias("projects_affected"), F.min("first_seen_at").alias("first_seen_at"), F.max("last_seen_at").alias("last_seen_at"))
    assert sorted(map(tuple, ends.collect())) == sorted(map(tuple, table.select(*ends.columns).collect()))
    got = found.collect()
    assert sorted(r.log_id for r in got) == list(range(240))
    for team in range(3):
        for h in range(6):
            own = sorted((r for r in got if (r.team_id, r.signature_hash) == (team, f"h{h}")), key=lambda r: r.occurrence_count)
            assert [r.occurrence_count for r in own] == list(range(1, len(own) + 1))
            for i, r in enumerate(own):  # each row tells what came up to it
                assert (r.first_seen_at, r.last_seen_at) == (min(x.ts for x in own[: i + 1]), max(x.ts for x in own[: i + 1]))
    assert {(r.is_known, r.known_resolution) for r in got if (r.team_id, r.signature_hash) == (0, "h0")} == {(True, "restart it")}
    assert {r.is_known for r in got if r.team_id == 1} == {False}
    late = {r.log_id for r in spark.createDataFrame(rows[180:], signatures.INPUT).collect()}
    assert {r.known_resolution for r in got if (r.team_id, r.signature_hash) == (2, "h0") and r.log_id in late} == {"raise the limit"}
    assert {r.known_resolution for r in got if (r.team_id, r.signature_hash) == (2, "h0") and r.log_id in {x[2] for x in rows[:120]}} == {None}


def test_state_goes_after_its_time(rocks, tmp_path):
    spark, at = rocks, datetime(2024, 1, 1)
    source, out, checkpoint = (f"{tmp_path}/{x}" for x in ("in", "out", "c"))
    for i in range(3):  # two at once, one after the state is gone
        spark.createDataFrame([(1, "h", i, 1, at, None)], signatures.INPUT).coalesce(1).write.mode("append").parquet(source)
        if i == 0:
            continue
        stream = signatures.with_history(spark.readStream.schema(signatures.INPUT).parquet(source), ttl_seconds=1)
        query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).start()
        for _ in range(60):
            time.sleep(1)
            if sum(p.numInputRows for p in query.recentProgress) >= 2 - i // 2:
                break
        query.stop()
        time.sleep(2)
    assert sorted(r.occurrence_count for r in spark.read.parquet(out).collect()) == [1, 1, 2]

"""The log path on a stream of logs, and a running roll-up of signatures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinderlog.plans.pipeline import process_logs


def process_stream(stream: DataFrame, column: str = "raw_log") -> DataFrame:
    """The same projection as on a table: it keeps no state."""
    return process_logs(stream, column)


def signature_windows(processed: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """How often each signature occurred in each window of event time; state goes once a window is past the watermark."""
    return processed.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", window), "team_id", "signature_hash").agg(F.count("*").alias("occurrence_count"), F.max("ts").alias("last_seen_at"))

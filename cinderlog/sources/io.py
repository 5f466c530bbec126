"""Reading logs, requests and tables; writing responses, embeddings and contracts."""

from __future__ import annotations

import json
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import _parse_datatype_string

from cinderlog.operators.ledger import upsert_embeddings
from cinderlog.sources import contracts, schemas


def read_log_files(spark: SparkSession, path: str) -> DataFrame:
    """One row for each file: path, raw_log. A file is one log."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("raw_log"))


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """Logs in Parquet, with the request's defaults."""
    rows = spark.read.parquet(path)
    missing = {f.name: F.lit(None).cast(f.dataType) for f in _parse_datatype_string(schemas.LOGS) if f.name not in rows.columns}
    return rows.withColumns(missing).withColumn("strict_redaction", F.coalesce("strict_redaction", F.lit(True)))


def read_requests(spark: SparkSession, path: str, kind: str = "analyze_requests", strict: bool = True) -> DataFrame:
    """JSON requests by their contract; unknown fields are ignored, a malformed row fails the read unless not strict."""
    return spark.read.schema(schemas.ALL[kind]).option("mode", "FAILFAST" if strict else "PERMISSIVE").json(path)


def read_table(spark: SparkSession, location: str, name: str, **options: str) -> DataFrame:
    """A table from a folder of Parquet, or over JDBC if location is such a URL."""
    if location.startswith("jdbc:"):
        return spark.read.format("jdbc").options(url=location, dbtable=name, **options).load()
    return spark.read.parquet(f"{location}/{name}.parquet")


def write_responses(rows: DataFrame, path: str) -> None:
    rows.write.mode("errorifexists").json(path)


def as_json(rows: DataFrame) -> DataFrame:
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("value"))


def write_embeddings(spark: SparkSession, target: str, changes: DataFrame) -> str:
    """Upserts into a Parquet table partitioned by team; returns the new version's path, which readers switch to."""
    merged = upsert_embeddings(spark.read.parquet(target), changes)
    path = f"{target.rstrip('/')}-{uuid.uuid4().hex}"
    merged.write.partitionBy("team_id").parquet(path)
    return path


def export_contracts(folder: str) -> list[str]:
    """Writes each contract as JSON Schema; returns the names of those that changed."""
    changed = []
    Path(folder).mkdir(parents=True, exist_ok=True)
    for name, contract in contracts.CONTRACTS.items():
        text = json.dumps(contracts.json_schema(contract), indent=2, sort_keys=True) + "\n"
        file = Path(folder) / f"{name}.json"
        if not file.exists() or file.read_text() != text:
            file.write_text(text)
            changed.append(name)
    return changed


def broken_contracts(folder: str) -> dict[str, list[tuple[str, str]]]:
    """What an export of now would break for those who rely on the schemas in a folder: (path, reason) by name."""
    out = {}
    for file in sorted(Path(folder).glob("*.json")):
        old = contracts.from_json_schema(json.loads(file.read_text()))
        now = contracts.CONTRACTS.get(file.stem)
        found = [("", "removed")] if now is None else contracts.breaking(old, now)
        if found:
            out[file.stem] = found
    return out


def read_checked_requests(spark: SparkSession, path: str, kind: str = "analyze_requests") -> tuple[DataFrame, DataFrame]:
    """(requests, quarantine) of JSON lines: requests with their defaults, and lines with (path, reason) of each violation."""
    return contracts.split(spark.read.text(path), contracts.CONTRACTS[kind])


def is_alive(spark: SparkSession) -> bool:
    """Whether the engine answers at all."""
    try:
        return spark.range(1).count() == 1
    except Exception:  # noqa: BLE001
        return False

"""Append-only audit log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def audit_rows(events: DataFrame, details: list[str]) -> DataFrame:
    """`events(id, action, resource_type, resource_id, actor_id, created_at, ...)` with the details as JSON."""
    return events.select("id", "action", "resource_type", "resource_id", "actor_id", F.to_json(F.struct(*details)).alias("details_json"),
                         "created_at")


def append_audit(events: DataFrame, path: str, checkpoint: str, details: list[str]):
    """Start the streaming append; rows are never updated or deleted, the checkpoint keeps restarts exact."""
    return audit_rows(events, details).writeStream.format("parquet").outputMode("append").option(
        "checkpointLocation", checkpoint).trigger(availableNow=True).start(path)

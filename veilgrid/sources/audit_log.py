"""Append-only audit log and the step records of the dashboard."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ACTION = "struct<type:string,target_element_id:string,value:string,risk_tier:string,reasoning_short:string>"
NOTES = "array<struct<element_id:string,confidence:double,method:string>>"
AUDIT_SCHEMA = (
    "timestamp timestamp, session_id string, step_number int, instruction_hash string,"
    f" action {ACTION}, confidence double, payload_notes {NOTES}"
)
STEP_SCHEMA = (
    "sessionId string, stepNumber int, timestamp bigint, action " + ACTION + ","
    " redactedRegions array<struct<element_id:string,sensitivity_type:string,detection_source:string,reason:string,semantic_token:string>>,"
    f" confidenceNotes {NOTES}, metrics array<struct<name:string,durationMs:double>>"
)


def append_audit(records: DataFrame, path: str) -> None:
    """Append one JSON line per decision, gzipped, stamped with the time of the write."""
    if "timestamp" not in records.columns:
        records = records.withColumn("timestamp", F.current_timestamp())
    records.write.mode("append").json(path, compression="gzip")


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(AUDIT_SCHEMA).json(path)


def read_steps(spark: SparkSession, path: str) -> DataFrame:
    """Dashboard step records: session_id, step_number, ts, action, regions, notes, metrics."""
    return spark.read.schema(STEP_SCHEMA).json(path).select(
        F.col("sessionId").alias("session_id"), F.col("stepNumber").alias("step_number"),
        F.timestamp_millis("timestamp").alias("ts"), "action", F.col("redactedRegions").alias("regions"),
        F.col("confidenceNotes").alias("notes"), "metrics")


def step_metrics(steps: DataFrame) -> DataFrame:
    """One row per measure of a step; the measure's last name part is kept."""
    return steps.select("session_id", "step_number", F.explode("metrics").alias("m")).select(
        "session_id", "step_number", F.regexp_extract("m.name", "[^:]*$", 0).alias("name"),
        F.col("m.durationMs").alias("duration_ms"))


def step_regions(steps: DataFrame) -> DataFrame:
    """One row per region; a region without a source came from the page itself."""
    return steps.select("session_id", "step_number", F.explode("regions").alias("r")).select(
        "session_id", "step_number", "r.element_id", "r.sensitivity_type",
        F.coalesce("r.detection_source", F.lit("dom_heuristic")).alias("detection_source"), "r.reason", "r.semantic_token")

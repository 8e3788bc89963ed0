"""JSON artifacts of flow runs as an append-only table."""

from __future__ import annotations

import json
import time
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugemill.sources.tables import read_parquet_or_none

ARTIFACT_SCHEMA = "flow_run_id string, name string, payload string, written_ns bigint"


def write_artifact(spark: SparkSession, path: str, flow_run_id: str, name: str, payload: Any) -> None:
    row = (flow_run_id, name, json.dumps(payload, sort_keys=True), time.time_ns())
    spark.createDataFrame([row], ARTIFACT_SCHEMA).coalesce(1).write.mode("append").partitionBy("flow_run_id").parquet(path)


def latest_artifacts(artifacts: DataFrame) -> DataFrame:
    """Latest payload of every (flow run, name)."""
    return artifacts.groupBy("flow_run_id", "name").agg(F.max_by("payload", "written_ns").alias("payload"))


def read_artifact(spark: SparkSession, path: str, flow_run_id: str, name: str) -> Any:
    """Latest payload; the run id prunes partitions. Missing ones raise FileNotFoundError."""
    table = read_parquet_or_none(spark, path, ARTIFACT_SCHEMA)
    found = None
    if table is not None:
        found = latest_artifacts(
            table.where((F.col("flow_run_id") == flow_run_id) & (F.col("name") == name))
        ).first()
    if found is None:
        raise FileNotFoundError(f"Missing artifact {name!r} of flow run {flow_run_id!r}")
    return json.loads(found["payload"])

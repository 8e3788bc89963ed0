"""Tracking runs as an append-only table."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugemill.settings import FLOW_VERSION_TAG

RUN_SCHEMA = T.StructType([
    T.StructField("run_id", T.StringType(), False),
    T.StructField("experiment", T.StringType(), False),
    T.StructField("run_name", T.StringType()),
    T.StructField("params", T.MapType(T.StringType(), T.StringType())),
    T.StructField("metrics", T.MapType(T.StringType(), T.DoubleType())),
    T.StructField("tags", T.MapType(T.StringType(), T.StringType())),
    T.StructField("start_time", T.TimestampType(), False),
])


class NotRecorded(LookupError):
    """No run carries the requested tag."""


def new_run_id() -> str:
    return uuid.uuid4().hex


def mint_flow_run_id() -> str:
    return uuid.uuid4().hex[:12]


def experiment_name(base: Column | str, experiment_id: Column | str | None = None) -> Column:
    """Base name, prefixed by the experiment id when there is one."""
    base = F.lit(base) if isinstance(base, str) else base
    eid = F.lit(experiment_id) if not isinstance(experiment_id, Column) else experiment_id
    return F.when(F.coalesce(eid, F.lit("")) == "", base).otherwise(F.concat(eid, F.lit(":"), base))


def experiment_tags(experiment_id: Column, flow_run_id: Column) -> Column:
    """Map of the ids that are set."""
    pairs = F.array(
        F.struct(F.lit("experiment_id").alias("key"), experiment_id.alias("value")),
        F.struct(F.lit("flow_run_id").alias("key"), flow_run_id.alias("value")),
    )
    return F.map_from_entries(F.filter(pairs, lambda p: F.coalesce(p["value"], F.lit("")) != ""))


def log_run(
    spark: SparkSession,
    path: str,
    experiment: str,
    run_name: str | None = None,
    params: Mapping[str, object] | None = None,
    metrics: Mapping[str, float] | None = None,
    tags: Mapping[str, object] | None = None,
    run_id: str | None = None,
) -> str:
    """Append one run and return its id."""
    run_id = run_id or new_run_id()
    row = (
        run_id, experiment, run_name,
        {k: str(v) for k, v in (params or {}).items()},
        {k: float(v) for k, v in (metrics or {}).items() if v is not None},
        {k: str(v) for k, v in (tags or {}).items()},
        datetime.now(timezone.utc),
    )
    spark.createDataFrame([row], RUN_SCHEMA).coalesce(1).write.mode("append").parquet(path)
    return run_id


def resolve_versions(runs: DataFrame, version: str, order: Sequence[str] = ("start_time", "run_id")) -> DataFrame:
    """Latest run of every version."""
    return runs.where(F.col(version).isNotNull()).groupBy(version).agg(
        F.max_by("run_id", F.struct(*order)).alias("run_id"), F.count("*").alias("runs")
    )


def resolve(runs: DataFrame, experiment: str, value: str, tag: str = FLOW_VERSION_TAG) -> str:
    """Latest run id with ``tag`` = ``value`` in an experiment, else NotRecorded."""
    found = (
        runs.where((F.col("experiment") == experiment) & (F.col("tags")[tag] == value))
        .agg(F.max_by("run_id", F.struct("start_time", "run_id")))
        .first()[0]
    )
    if found is None:
        raise NotRecorded(f"No run tagged {tag}={value!r} in {experiment!r}.")
    return found

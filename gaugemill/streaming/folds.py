"""Streaming forms of the event fold, the event fan-out and the retrain cooldown."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from gaugemill.settings import RETRAIN_COOLDOWN_SECONDS


def _newest(value: Column, seq: str) -> Column:
    """``value`` of the event with the largest ``seq``; each is kept with its own ``seq``, so files may come in any order."""
    return F.max_by(value, seq)


def step_state_stream(events: DataFrame) -> DataFrame:
    """Running state, container, exit code and creation of every (run, step), for update or complete mode.

    A run's creation counts as an event of each step it declares, so resets and unknown runs need no join in the stream;
    ``current_steps`` reads the rows off. Every column only ever grows with its ``seq``, whatever the order of files.
    """
    creates, moves = F.col("type") == "FlowRunCreated", F.col("type") == "StepStateChanged"
    starts, exits = F.col("type") == "ContainerStarted", F.col("type") == "ContainerExited"
    one = F.array(F.struct(F.lit(None).cast("int").alias("at"), F.col("step_name").alias("step_name")))
    declared = F.transform("step_names", lambda name, at: F.struct(at.alias("at"), name.alias("step_name")))
    return (
        events.where(creates | moves | starts | exits)
        .select("flow_run_id", F.explode(F.when(creates, declared).otherwise(one)).alias("step"), "to_state", "exit_code",
                F.struct("container_id", "host_id").alias("container"), F.when(creates, F.col("seq")).alias("created_seq"),
                F.when(moves, F.col("seq")).alias("moved_seq"), F.when(starts, F.col("seq")).alias("started_seq"),
                F.when(exits, F.col("seq")).alias("exited_seq"))
        .select("flow_run_id", "step.step_name", "step.at", "to_state", "exit_code", "container", "created_seq", "moved_seq", "started_seq", "exited_seq")
        .groupBy("flow_run_id", "step_name")
        .agg(_newest(F.col("at"), "created_seq").alias("step_position"), F.max("created_seq").alias("created_seq"),
             _newest(F.col("to_state"), "moved_seq").alias("state"), F.max("moved_seq").alias("moved_seq"),
             _newest(F.col("container"), "started_seq").alias("container"), F.max("started_seq").alias("started_seq"),
             _newest(F.col("exit_code"), "exited_seq").alias("exit_code"), F.max("exited_seq").alias("exited_seq"))
    )


def current_steps(latest: DataFrame) -> DataFrame:
    """The row of every step that its run's latest creation declares, from the newest row of each (run, step)."""
    newest = latest.groupBy("flow_run_id").agg(F.max("created_seq").alias("created_seq"))

    def since_creation(seq: str, value: str) -> Column:
        return F.when(F.col(seq) > F.col("created_seq"), F.col(value))

    return latest.join(newest, ["flow_run_id", "created_seq"]).select(
        "flow_run_id", "step_name", "step_position", F.coalesce(since_creation("moved_seq", "state"), F.lit("pending")).alias("state"),
        since_creation("started_seq", "container.container_id").alias("container_id"),
        since_creation("started_seq", "container.host_id").alias("host_id"),
        since_creation("exited_seq", "exit_code").alias("exit_code"))


def run_state_stream(events: DataFrame) -> DataFrame:
    """Running creation, state and times of every run, for update or complete mode; ``current_runs`` reads the rows off."""
    creates, moves = F.col("type") == "FlowRunCreated", F.col("type") == "FlowStateChanged"
    steps = F.col("type") == "StepStateChanged"
    fields = F.struct("flow_name", "parent_flow_run_id", "parent_step_name", F.col("ts").alias("created_ts"))
    return (
        events.where(creates | moves | steps)
        .select("flow_run_id", fields.alias("created"), "to_state", "ts", "seq",
                F.when(creates, F.col("seq")).alias("created_seq"), F.when(moves, F.col("seq")).alias("moved_seq"))
        .groupBy("flow_run_id")
        .agg(_newest(F.col("created"), "created_seq").alias("created"), F.max("created_seq").alias("created_seq"),
             _newest(F.col("to_state"), "moved_seq").alias("state"), F.max("moved_seq").alias("moved_seq"),
             _newest(F.col("ts"), "seq").alias("updated_ts"))
    )


def current_runs(latest: DataFrame) -> DataFrame:
    """Runs that were created, as ``operators.runlog.run_states`` has them, from the newest row of each run."""
    return latest.where("created_seq is not null").select(
        "flow_run_id", "created.flow_name", "created.parent_flow_run_id", "created.parent_step_name", "created_seq",
        F.when(F.col("moved_seq") > F.col("created_seq"), F.col("state")).otherwise("pending").alias("state"),
        "created.created_ts", "updated_ts")


def latest_per_key(updates: DataFrame, keys: Sequence[str], order: str = "batch_id") -> DataFrame:
    """Collapse what ``parquet_sink`` stored in update mode to the row of each key's last micro-batch.

    A key has one row a batch at most. An event's ``seq`` would not do as ``order``: two batches may leave it the same.
    """
    values = [c for c in updates.columns if c not in (*keys, order)]
    return updates.groupBy(*keys).agg(F.max_by(F.struct(*values), order).alias("_v")).select(*keys, "_v.*")


def fan_out(
    stream: DataFrame, checkpoint: str, sinks: Sequence[Callable[[DataFrame, int], None]]
) -> StreamingQuery:
    """Hand every micro-batch to each sink in turn."""

    def deliver(batch: DataFrame, batch_id: int) -> None:
        held = batch.persist()
        try:
            for sink in sinks:
                sink(held, batch_id)
        finally:
            held.unpersist()

    return (
        stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(deliver)
        .trigger(availableNow=True).start()
    )


def parquet_sink(path: str) -> Callable[[DataFrame, int], None]:
    """Sink that replaces a batch's own folder, so a replayed batch is not stored twice."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return write


def cooldown_stream(
    requests: DataFrame, key: str, at: str, seq: str, seconds: float = RETRAIN_COOLDOWN_SECONDS
) -> DataFrame:
    """Streaming cooldown: the state of a key is the instant of its last accepted request.

    Requests of a key must arrive in time order across batches; within one they are sorted.
    Rate-limit the source, as one key's share of a micro-batch is sorted in one task.
    """
    window = int(seconds * 1_000_000)
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    timed = requests.select(
        key, seq, F.timestamp_diff("MICROSECOND", epoch, F.col(at).cast("timestamp_ntz")).alias("_at")
    )
    output = T.StructType([timed.schema[key], timed.schema[seq], T.StructField("accepted", T.BooleanType())])
    state_type = T.StructType([T.StructField("last", T.LongType())])

    def judge(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values(["_at", seq])
        accepted = []
        for instant in rows["_at"].tolist():
            fires = last is None or instant - last >= window
            accepted.append(fires)
            last = instant if fires else last
        if last is not None:
            state.update((last,))
        yield pd.DataFrame({key: rows[key], seq: rows[seq], "accepted": accepted})

    return timed.groupBy(key).applyInPandasWithState(
        judge, output, state_type, "append", GroupStateTimeout.NoTimeout
    )

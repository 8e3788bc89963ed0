"""Run and step tables folded from the event log.

Every fold is a keyed aggregate by arrival number ``seq``, so partial aggregates shrink
even a run that owns most of the log before it is shuffled. Creation resets a run:
anything recorded for it at or before that ``seq`` no longer counts, which for last-value
columns can be checked after the aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugemill.functions.text import WHITESPACE
from gaugemill.operators.ordered import with_previous, with_row_number

PERSISTED = ("FlowRunCreated", "FlowStateChanged", "StepStateChanged", "ContainerStarted", "ContainerExited")
STEP_EVENTS = ("StepStateChanged", "ContainerStarted", "ContainerExited")
# The states of a run or a step.
STATES = ("pending", "scheduled", "running", "succeeded", "failed", "skipped")

EVENT_SCHEMA = T.StructType([
    T.StructField("type", T.StringType()),
    T.StructField("flow_run_id", T.StringType()),
    T.StructField("ts", T.DoubleType()),
    T.StructField("seq", T.LongType()),
    T.StructField("flow_name", T.StringType()),
    T.StructField("step_names", T.ArrayType(T.StringType())),
    T.StructField("parent_flow_run_id", T.StringType()),
    T.StructField("parent_step_name", T.StringType()),
    T.StructField("step_name", T.StringType()),
    T.StructField("from_state", T.StringType()),
    T.StructField("to_state", T.StringType()),
    T.StructField("container_id", T.StringType()),
    T.StructField("host_id", T.StringType()),
    T.StructField("exit_code", T.IntegerType()),
    T.StructField("stream", T.StringType()),
    T.StructField("data", T.StringType()),
])


def _code(state: Column) -> Column:
    """States as small integers: their aggregates stay fixed-width, hence hash-based."""
    code = F.lit(None).cast("int")
    for number, name in enumerate(STATES, 1):
        code = F.when(state == name, number).otherwise(code)
    return code


def _state(code: Column) -> Column:
    return F.element_at(F.array(*[F.lit(s) for s in STATES]), code)


def _is(*types: str) -> Column:
    return F.col("type").isin(*types)


def _last(value: Column, *types: str) -> Column:
    return F.max_by(F.when(_is(*types), value), F.when(_is(*types), F.col("seq")))


def _last_seq(*types: str) -> Column:
    return F.max(F.when(_is(*types), F.col("seq")))


def persisted(events: DataFrame) -> DataFrame:
    """State-bearing events only; log chunks and unknown types are dropped."""
    return events.where(_is(*PERSISTED))


def created(events: DataFrame) -> DataFrame:
    """The latest creation of each run."""
    fields = F.struct("flow_name", "step_names", "parent_flow_run_id", "parent_step_name", "ts")
    return (
        events.where(_is("FlowRunCreated"))
        .groupBy("flow_run_id")
        .agg(F.max_by(fields, "seq").alias("_c"), F.max("seq").alias("created_seq"))
        .select(
            "flow_run_id", "created_seq", "_c.flow_name", "_c.step_names",
            "_c.parent_flow_run_id", "_c.parent_step_name", F.col("_c.ts").alias("created_ts"),
        )
    )


def run_seed(events: DataFrame) -> DataFrame:
    """One pending step per name of a created run, in declaration order."""
    return created(events).select(
        "flow_run_id", "created_seq",
        F.posexplode("step_names").alias("step_position", "step_name"),
        F.lit("pending").alias("state"),
    )


def run_states(events: DataFrame) -> DataFrame:
    """Runs with their last state and creation and update times; unknown runs are left out."""
    moving = ("FlowRunCreated", "FlowStateChanged", "StepStateChanged")
    latest = (
        events.where(_is(*moving))
        .groupBy("flow_run_id")
        .agg(
            _last(_code(F.col("to_state")), "FlowStateChanged").alias("_code"),
            _last_seq("FlowStateChanged").alias("_seq"),
            F.max_by("ts", "seq").alias("updated_ts"),
        )
    )
    return created(events).join(latest, "flow_run_id").select(
        "flow_run_id", "flow_name", "parent_flow_run_id", "parent_step_name", "created_seq",
        F.when(F.col("_seq") > F.col("created_seq"), _state(F.col("_code"))).otherwise("pending").alias("state"),
        "created_ts", "updated_ts",
    )


def step_states(events: DataFrame) -> DataFrame:
    """Every declared step with its last state, container and exit code."""
    latest = (
        events.where(_is(*STEP_EVENTS))
        .groupBy("flow_run_id", "step_name")
        .agg(
            _last(_code(F.col("to_state")), "StepStateChanged").alias("_code"),
            _last_seq("StepStateChanged").alias("_state_seq"),
            _last(F.struct("container_id", "host_id"), "ContainerStarted").alias("_container"),
            _last_seq("ContainerStarted").alias("_start_seq"),
            _last(F.col("exit_code"), "ContainerExited").alias("_exit"),
            _last_seq("ContainerExited").alias("_exit_seq"),
        )
    )

    def since_creation(seq: str, value: Column) -> Column:
        return F.when(F.col(seq) > F.col("created_seq"), value)

    return run_seed(events).drop("state").join(latest, ["flow_run_id", "step_name"], "left").select(
        "flow_run_id", "step_name", "step_position",
        F.coalesce(since_creation("_state_seq", _state(F.col("_code"))), F.lit("pending")).alias("state"),
        since_creation("_start_seq", F.col("_container.container_id")).alias("container_id"),
        since_creation("_start_seq", F.col("_container.host_id")).alias("host_id"),
        since_creation("_exit_seq", F.col("_exit")).alias("exit_code"),
    )


def _step_changes(events: DataFrame) -> DataFrame:
    """State changes of declared steps since their run's creation."""
    changes = events.where(_is("StepStateChanged")).select(
        "flow_run_id", "step_name", "ts", "seq", "from_state", "to_state"
    )
    return (
        changes.join(run_seed(events).drop("state"), ["flow_run_id", "step_name"])
        .where(F.col("seq") > F.col("created_seq"))
        .select(*changes.columns)
    )


def step_history(events: DataFrame) -> DataFrame:
    """State changes numbered per step, one row each: a history of any length stays distributed."""
    return with_row_number(_step_changes(events), ["flow_run_id", "step_name"], ["seq"], "position")


def transition_check(events: DataFrame) -> DataFrame:
    """State changes whose ``from_state`` is not where the step then was."""
    known = with_previous(
        _step_changes(events), ["flow_run_id", "step_name"], ["seq"], {"current_state": "to_state"}
    ).withColumn("current_state", F.coalesce("current_state", F.lit("pending")))
    return known.where(F.col("from_state") != F.col("current_state"))


def orphans(events: DataFrame) -> DataFrame:
    """Persisted events that name a run or a step nobody declared."""
    names = created(events).select("flow_run_id", F.col("step_names").alias("_declared"))
    return (
        persisted(events).where(~_is("FlowRunCreated"))
        .join(names, "flow_run_id", "left")
        .where(
            F.col("_declared").isNull()
            | (_is(*STEP_EVENTS) & ~F.array_contains("_declared", F.col("step_name")))
        )
        .select("type", "flow_run_id", "step_name", "seq")
    )


def roots(runs: DataFrame) -> DataFrame:
    return runs.where(F.col("parent_flow_run_id").isNull())


def children(runs: DataFrame) -> DataFrame:
    """Child runs of each (run, step), one row each in creation order of the log."""
    return runs.where(F.col("parent_flow_run_id").isNotNull() & F.col("parent_step_name").isNotNull()).select(
        F.col("parent_flow_run_id"), F.col("parent_step_name"),
        F.col("flow_run_id").alias("child_run_id"), "created_seq", "state",
    )


def state_summary(steps: DataFrame) -> DataFrame:
    return steps.groupBy("state").agg(F.count("*").alias("steps"))


def exit_classes(steps: DataFrame, expected: DataFrame) -> DataFrame:
    """Exited steps judged by their expected codes ({0} where ``expected`` names none)."""
    codes = F.coalesce(F.col("expected_exit_codes"), F.array(F.lit(0)))
    return (
        steps.where(F.col("exit_code").isNotNull())
        .join(expected, ["flow_run_id", "step_name"], "left")
        .select(
            "flow_run_id", "step_name", "exit_code",
            F.when(F.array_contains(codes, F.col("exit_code")), "succeeded").otherwise("failed").alias("outcome"),
        )
    )


def flow_rollup(steps: DataFrame) -> DataFrame:
    """Run state implied by its steps, and whether steps still run under a failed run."""
    failed = F.bool_or(F.col("state") == "failed")
    done = F.bool_and(F.col("state").isin("succeeded", "skipped"))
    return steps.groupBy("flow_run_id").agg(
        F.when(failed, "failed").when(done, "succeeded").otherwise("running").alias("state"),
        (failed & F.bool_or(F.col("state") == "running")).alias("running_under_failed"),
    )


def render(events: DataFrame) -> DataFrame:
    """One display line per event that has one."""
    short = F.left(F.col("container_id"), F.lit(12))
    shown = F.regexp_replace("data", WHITESPACE + r"\z", "")
    line = (
        F.when(_is("FlowStateChanged"), F.concat(F.lit("flow "), "from_state", F.lit(" → "), "to_state"))
        .when(
            _is("StepStateChanged"),
            F.concat(F.lit("  step "), "step_name", F.lit(" "), "from_state", F.lit(" → "), "to_state"),
        )
        .when(
            _is("ContainerStarted"),
            F.concat(F.lit("    container "), short, F.lit(" started on "), "host_id", F.lit(" ("), "step_name", F.lit(")")),
        )
        .when(
            _is("ContainerExited"),
            F.concat(
                F.lit("    container "), short, F.lit(" exited code="), F.col("exit_code").cast("string"),
                F.lit(" ("), "step_name", F.lit(")"),
            ),
        )
        .when(
            _is("LogChunk") & (shown != ""),
            F.concat(F.lit("      "), "step_name", F.lit("| "), shown),
        )
    )
    return events.select("seq", line.alias("line")).where(F.col("line").isNotNull())

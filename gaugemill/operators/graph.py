"""Run trees and dependency tables.

Rounds are DataFrame joins on (graph, node) keys; each round's result is written to the
shared folder, so plans stay short and a lost executor costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugemill.session import discard, scratch_path, stage


class CycleError(ValueError):
    """Some nodes depend on themselves."""


def _sortable(number: Column, width: int) -> Column:
    return F.lpad(number.cast("string"), width, "0")


def run_tree(runs: DataFrame, steps: DataFrame | None = None) -> DataFrame:
    """Root, depth and sortable path of every run below a root.

    Pointer doubling: each round replaces a run's pointer by its pointer's pointer and
    glues the paths, so a tree of depth d takes about log2(d) rounds. A round after which as many runs as
    before wait for a root has only cycles left: above any deep run there is one at every smaller depth. Runs on
    a cycle or below an unknown parent hang under no root and are left out. With ``steps`` the path
    sorts children under their parent step, as the report prints them.
    """
    own = _sortable(F.col("created_seq"), 19)
    linked = runs
    if steps is not None:
        places = steps.select(
            F.col("flow_run_id").alias("parent_flow_run_id"),
            F.col("step_name").alias("parent_step_name"),
            F.col("step_position").alias("_at"),
        )
        linked = runs.join(places, ["parent_flow_run_id", "parent_step_name"], "left").where(
            F.col("parent_flow_run_id").isNull() | F.col("_at").isNotNull()
        )
        own = F.when(F.col("_at").isNull(), own).otherwise(F.concat(_sortable(F.col("_at"), 10), F.lit("."), own))
    known = stage(
        linked.select(
            F.col("flow_run_id").alias("run_id"),
            F.col("parent_flow_run_id").alias("up"),
            F.col("flow_run_id").alias("top"),
            F.lit(0).alias("depth"),
            own.alias("path"),
        ),
        "run-tree",
    )
    before = None
    while True:
        pending = known.where(F.col("up").isNotNull())
        waiting = pending.count()
        if waiting in (0, before):
            return known.where(F.col("up").isNull()).select("run_id", F.col("top").alias("root_id"), "depth", "path")
        before = waiting
        ancestors = known.select(
            F.col("run_id").alias("up"), F.col("up").alias("_up"), F.col("top").alias("_top"),
            F.col("depth").alias("_depth"), F.col("path").alias("_path"),
        )
        climbed = pending.join(ancestors, "up").select(
            "run_id",
            F.col("_up").alias("up"),
            F.col("_top").alias("top"),
            (F.col("depth") + F.col("_depth") + 1).alias("depth"),
            F.concat("_path", F.lit("/"), "path").alias("path"),
        )
        known = stage(known.where(F.col("up").isNull()).unionByName(climbed), "run-tree")


def tree_report(runs: DataFrame, steps: DataFrame) -> DataFrame:
    """Indented lines of every tree; ordering by (root_id, path) prints them."""
    placed = run_tree(runs, steps)
    pad = F.repeat(F.lit("  "), F.col("depth") * 2)
    run_lines = placed.join(
        runs.select(F.col("flow_run_id").alias("run_id"), "flow_name", "state"), "run_id"
    ).select(
        "root_id", "path",
        F.concat(pad, "flow_name", F.lit(" ["), "state", F.lit("] ("), "run_id", F.lit(")")).alias("line"),
    )
    code = F.coalesce(F.concat(F.lit(" exit="), F.col("exit_code").cast("string")), F.lit(""))
    step_lines = placed.join(steps.withColumnRenamed("flow_run_id", "run_id"), "run_id").select(
        "root_id",
        F.concat("path", F.lit("/"), _sortable(F.col("step_position"), 10)).alias("path"),
        F.concat(pad, F.lit("  - "), "step_name", F.lit(": "), "state", code).alias("line"),
    )
    return run_lines.unionByName(step_lines)


def dag_problems(nodes: DataFrame, edges: DataFrame, conditional: DataFrame | None = None) -> DataFrame:
    """Duplicate steps, dependencies on unknown steps, conditions without dependencies.

    nodes(graph, step), edges(graph, step, dep), conditional(graph, step).
    """
    problems = nodes.groupBy("graph", "step").count().where("count > 1").select(
        "graph", "step", F.lit("duplicate step name").alias("problem")
    )
    known = nodes.select("graph", F.col("step").alias("dep"))
    problems = problems.unionByName(
        edges.join(known, ["graph", "dep"], "left_anti")
        .select("graph", "step", F.concat(F.lit("depends on unknown step "), F.col("dep").cast("string")).alias("problem"))
    )
    if conditional is not None:
        problems = problems.unionByName(
            conditional.join(edges, ["graph", "step"], "left_anti")
            .select("graph", "step", F.lit("condition without dependency").alias("problem"))
        )
    return problems


def dag_levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Longest-path level of each step.

    A step waits for max(least, level of each open dependency + add). Each round settles the steps without open
    dependencies and folds their levels into the ``least`` of those that wait for them; then every edge to a step with one
    open dependency left is led past it, as x -> max(least, x + add) composes to a function of the same form. A chain of
    depth d takes about log2(d) rounds, no graph more than d, and edges never grow in number. ``dag_cycles`` names the
    steps on a cycle.
    """
    spark, path, turn = nodes.sparkSession, scratch_path(nodes.sparkSession, "dag-levels"), 0
    waiting = stage(nodes.select("graph", "step", F.lit(0).cast("bigint").alias("least")).distinct(), "dag-waiting")
    longest = waiting.count()  # no path of an acyclic table is longer; keeps the sums on cycles small
    open_edges = stage(edges.select("graph", "step", "dep", F.lit(1).cast("bigint").alias("add")).distinct(), "dag-edges")
    while True:
        # a folder for each round, so the plan does not grow
        waiting.join(open_edges, ["graph", "step"], "left_anti").write.parquet(f"{path}/turn={turn}")
        ready = spark.read.schema(waiting.schema).parquet(f"{path}/turn={turn}")
        if turn and ready.isEmpty():
            raise CycleError("dependency table contains a cycle or an unknown dependency")
        if open_edges.isEmpty():
            discard(waiting, open_edges)
            return spark.read.schema(waiting.schema).parquet(path).select("graph", "step", F.col("least").cast("int").alias("level"))
        settled = ready.select("graph", F.col("step").alias("dep"), F.col("least").alias("level"))
        folded = open_edges.join(settled, ["graph", "dep"]).select("graph", "step", (F.col("level") + F.col("add")).alias("least"))
        left = waiting.join(ready, ["graph", "step"], "left_anti").unionByName(folded).groupBy("graph", "step").agg(F.max("least").alias("least"))
        left = stage(left, "dag-waiting")
        still = open_edges.join(settled, ["graph", "dep"], "left_anti")
        single = (
            still.groupBy("graph", "step").agg(F.count("*").alias("n"), F.max("dep").alias("up"), F.max("add").alias("up_add")).where("n = 1")
            .join(left, ["graph", "step"]).select("graph", F.col("step").alias("dep"), "up", "up_add", F.col("least").alias("up_least"))
        )
        past = F.col("up").isNotNull() & (F.col("add") + F.col("up_add") <= longest)
        led = stage(still.join(single, ["graph", "dep"], "left").select(
            "graph", "step", F.when(past, F.col("up")).otherwise(F.col("dep")).alias("dep"),
            F.when(past, F.col("add") + F.col("up_add")).otherwise(F.col("add")).alias("add"),
            F.when(past, F.col("up_least") + F.col("add")).alias("least")), "dag-led")
        gained = led.where("least is not null").select("graph", "step", "least")
        former = (waiting, open_edges)
        waiting = stage(left.unionByName(gained).groupBy("graph", "step").agg(F.max("least").alias("least")), "dag-waiting")
        open_edges = stage(led.groupBy("graph", "step", "dep").agg(F.max("add").alias("add")), "dag-edges")
        discard(*former, left, led)
        turn += 1


def _trim(edges: DataFrame) -> DataFrame:
    """Edges left when steps without dependency or without dependant are taken off until none is left."""
    kept, before = edges, None
    while True:
        n = kept.count()
        if n in (0, before):
            return kept
        inner = kept.join(kept.select("graph", F.col("step").alias("dep")).distinct(), ["graph", "dep"], "left_semi")
        inner = inner.join(kept.select("graph", F.col("dep").alias("step")).distinct(), ["graph", "step"], "left_semi")
        former, kept, before = kept, stage(inner.select("graph", "step", "dep"), "cycle-edges"), n
        if former is not edges:
            discard(former)


def dag_cycles(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Steps on a cycle: (graph, step, cycle), where ``cycle`` is the smallest step of the strongly connected component.

    Steps off every cycle are trimmed. Then colours run forward, a step taking the smallest step that reaches it; the
    steps of one colour that reach the step naming it are its component. Components found are taken off and the rest is coloured
    again. Rounds follow the longest way a colour runs. Dependencies on unknown steps close no cycle; self-edges do.
    """
    spark, path, turn = nodes.sparkSession, scratch_path(nodes.sparkSession, "cycles"), 0
    known = nodes.select("graph", "step").distinct()
    left = stage(
        edges.select("graph", "step", "dep").distinct().join(known, ["graph", "step"], "left_semi")
        .join(known.withColumnRenamed("step", "dep"), ["graph", "dep"], "left_semi").select("graph", "step", "dep"), "cycle-edges")
    known.withColumn("cycle", F.col("step")).limit(0).write.parquet(f"{path}/turn={turn}/part=0")
    while True:
        left = _trim(left)
        if left.isEmpty():
            found = spark.read.parquet(path).select("graph", "step", "cycle")
            # a step between two cycles is a component of its own, and on none
            several = found.groupBy("graph", "cycle").count().where("count > 1").select("graph", "cycle")
            alone = edges.where("step = dep").select("graph", F.col("step").alias("cycle"))
            return found.join(several.unionByName(alone), ["graph", "cycle"], "left_semi").select("graph", "step", "cycle")
        turn += 1
        colour = stage(left.select("graph", "step", F.col("step").alias("cycle")).distinct(), "cycle-colours")
        while True:
            heard = left.join(colour.select("graph", F.col("step").alias("dep"), F.col("cycle").alias("heard")), ["graph", "dep"]).groupBy("graph", "step").agg(F.min("heard").alias("heard"))
            nearer = stage(colour.join(heard, ["graph", "step"], "left").select(
                "graph", "step", F.least("cycle", "heard").alias("cycle"), F.coalesce(F.col("heard") < F.col("cycle"), F.lit(False)).alias("_moved")), "cycle-colours")
            discard(colour)
            colour = nearer.drop("_moved")
            colour._staged_at = nearer.__dict__.pop("_staged_at")
            if nearer.where("_moved").isEmpty():
                break
        ends = {side: colour.select("graph", F.col("step").alias(side), F.col("cycle").alias(f"_{side}")) for side in ("step", "dep")}
        within = stage(left.join(ends["step"], ["graph", "step"]).join(ends["dep"], ["graph", "dep"]).where("_step = _dep")
                       .select("graph", "step", "dep"), "cycle-within")
        found = colour.where("step = cycle").select("graph", "step", "cycle")
        found.write.parquet(f"{path}/turn={turn}/part=0")
        back, fresh = 0, spark.read.parquet(f"{path}/turn={turn}/part=0")
        while not fresh.isEmpty():
            back += 1
            reached = within.join(fresh, ["graph", "step"]).select("graph", F.col("dep").alias("step"), "cycle").distinct()
            seen = spark.read.parquet(f"{path}/turn={turn}").select("graph", "step")
            reached.join(seen, ["graph", "step"], "left_anti").write.parquet(f"{path}/turn={turn}/part={back}")
            fresh = spark.read.schema(found.schema).parquet(f"{path}/turn={turn}/part={back}")
        done = spark.read.schema(found.schema).parquet(f"{path}/turn={turn}").select("graph", "step")
        rest = left.join(done, ["graph", "step"], "left_anti").join(done.withColumnRenamed("step", "dep"), ["graph", "dep"], "left_anti")
        former, left = left, stage(rest.select("graph", "step", "dep"), "cycle-edges")
        discard(former, colour, within)


def exited_with(conditions: DataFrame, exits: DataFrame) -> DataFrame:
    """conditions(graph, step, dep, codes) judged by exits(graph, step, exit_code); no exit is false."""
    seen = exits.select("graph", F.col("step").alias("dep"), "exit_code")
    holds = F.coalesce(F.array_contains("codes", F.col("exit_code")), F.lit(False))
    return conditions.join(seen, ["graph", "dep"], "left").select("graph", "step", holds.alias("holds"))


def step_decisions(states: DataFrame, edges: DataFrame, conditions: DataFrame | None = None) -> DataFrame:
    """wait, blocked, skip or launch for every pending step.

    states(graph, step, state), edges(graph, step, dep), conditions(graph, step, holds).
    A skip makes its step terminal and may settle those that depend on it. All steps are judged once, from counts of their
    dependencies; each further round joins the skips of the round before with the edges between pending steps, counts them off at the
    steps they reach, and judges those only. A step is skipped once, so an edge is followed once. Steps of a graph have one
    state each (``dag_problems`` finds others); repeated edges count once.
    """
    unmet = None
    if conditions is not None:
        unmet = conditions.groupBy("graph", "step").agg((~F.bool_and("holds")).alias("unmet"))
    deps = states.select("graph", F.col("step").alias("dep"), F.col("state").alias("dep_state"))
    counts = (
        edges.select("graph", "step", "dep").distinct().join(deps, ["graph", "dep"], "left").groupBy("graph", "step")
        .agg(F.count_if(~F.coalesce(F.col("dep_state").isin("succeeded", "failed", "skipped"), F.lit(False))).alias("open"),
             F.coalesce(F.bool_or(F.col("dep_state") == "failed"), F.lit(False)).alias("failed"),
             F.coalesce(F.bool_or(F.col("dep_state") == "skipped"), F.lit(False)).alias("skipped"))
    )
    pending = states.where("state = 'pending'").select("graph", "step").join(counts, ["graph", "step"], "left")
    pending = pending.join(unmet, ["graph", "step"], "left") if unmet is not None else pending.withColumn("unmet", F.lit(False))
    no = F.lit(False)
    judged = stage(pending.select("graph", "step", F.coalesce("open", F.lit(0)).alias("open"), F.coalesce("failed", no).alias("failed"),
                                  F.coalesce("skipped", no).alias("skipped"), F.coalesce("unmet", no).alias("unmet")), "step-counts")
    between = stage(
        edges.select("graph", "step", "dep").distinct().join(deps.where("dep_state = 'pending'").select("graph", "dep"), ["graph", "dep"])
        .join(judged.select("graph", "step"), ["graph", "step"]).select("graph", "step", "dep"), "step-edges")
    skips = (F.col("open") == 0) & ~F.col("failed") & (F.col("skipped") | F.col("unmet"))
    spark, path = states.sparkSession, scratch_path(states.sparkSession, "step-closed")
    fresh, turn = stage(judged.where(skips).select("graph", "step"), "step-skips"), 0
    while not fresh.isEmpty():
        # how many dependencies of a step this round closed; a folder for each round, so the plan does not grow
        reached = fresh.withColumnRenamed("step", "dep").join(between, ["graph", "dep"])
        reached.groupBy("graph", "step").agg(F.count("*").alias("closed")).write.parquet(f"{path}/turn={turn}")
        touched = spark.read.parquet(f"{path}/turn={turn}").select("graph", "step")
        closed = spark.read.parquet(path).join(touched, ["graph", "step"], "left_semi").groupBy("graph", "step").agg(F.sum("closed").alias("closed"))
        now = closed.join(judged, ["graph", "step"]).withColumn("open", F.col("open") - F.col("closed")).withColumn("skipped", F.lit(True))
        last, fresh = fresh, stage(now.where(skips).select("graph", "step"), "step-skips")
        discard(last)
        turn += 1
    discard(fresh, between)
    if turn:
        closed = spark.read.parquet(path).groupBy("graph", "step").agg(F.sum("closed").alias("closed"))
        judged = judged.join(closed, ["graph", "step"], "left").withColumns({
            "open": F.col("open") - F.coalesce("closed", F.lit(0)), "skipped": F.col("skipped") | F.col("closed").isNotNull()})
    return judged.select("graph", "step", F.when(F.col("open") > 0, "wait").when(F.col("failed"), "blocked").when(skips, "skip").otherwise("launch").alias("decision"))

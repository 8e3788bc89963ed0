import random

import pytest
from pyspark.sql import functions as F

from gaugemill.operators import graph, runlog
from gaugemill.sources import events as event_files
from gaugemill.streaming import folds


def _log(spark):
    """prep -> hp-a, hp-b (each a child run of train -> robustness) -> gather, all succeeded."""
    rows, seq = [], [0]

    def add(type_, run, **fields):
        seq[0] += 1
        rows.append({"type": type_, "flow_run_id": run, "ts": float(seq[0] // 3), "seq": seq[0], **fields})

    def step(run, name, code=0, container=True):
        add("StepStateChanged", run, step_name=name, from_state="pending", to_state="scheduled")
        if container:
            add("ContainerStarted", run, step_name=name, container_id=f"c-{run}-{name}-0123456789", host_id="h")
        add("StepStateChanged", run, step_name=name, from_state="scheduled", to_state="running")
        if container:
            add("LogChunk", run, step_name=name, container_id="c", stream="stdout", data="hello \n")
            add("ContainerExited", run, step_name=name, container_id="c", exit_code=code)
        add("StepStateChanged", run, step_name=name, from_state="running", to_state="succeeded")

    add("FlowRunCreated", "root", flow_name="sweep", step_names=["prep", "hp-a", "hp-b", "gather"])
    add("FlowStateChanged", "root", from_state="pending", to_state="running")
    step("root", "prep")
    for tag in "ab":
        child = f"child-{tag}"
        add("FlowRunCreated", child, flow_name=f"train-{tag}", step_names=["train", "robustness"],
            parent_flow_run_id="root", parent_step_name=f"hp-{tag}")
        step(child, "train")
        step(child, "robustness")
        add("FlowStateChanged", child, from_state="running", to_state="succeeded")
        step("root", f"hp-{tag}", container=False)
    step("root", "gather")
    add("FlowStateChanged", "root", from_state="running", to_state="succeeded")
    return spark.createDataFrame([tuple(r.get(f.name) for f in runlog.EVENT_SCHEMA) for r in rows], runlog.EVENT_SCHEMA)


@pytest.fixture(scope="module")
def log(spark):
    return _log(spark).repartition(3)


def test_every_step_succeeded(log):
    assert [tuple(r) for r in runlog.state_summary(runlog.step_states(log)).collect()] == [("succeeded", 8)]
    rolled = {r["flow_run_id"]: r["state"] for r in runlog.flow_rollup(runlog.step_states(log)).collect()}
    assert rolled == {"root": "succeeded", "child-a": "succeeded", "child-b": "succeeded"}
    assert runlog.transition_check(log).isEmpty() and runlog.orphans(log).isEmpty()


def test_tree_report_prints_children_under_their_step(log):
    report = graph.tree_report(runlog.run_states(log), runlog.step_states(log)).orderBy("root_id", "path")
    assert [r["line"] for r in report.collect()] == [
        "sweep [succeeded] (root)",
        "  - prep: succeeded exit=0",
        "  - hp-a: succeeded",
        "    train-a [pending] (child-a)".replace("pending", "succeeded"),
        "      - train: succeeded exit=0",
        "      - robustness: succeeded exit=0",
        "  - hp-b: succeeded",
        "    train-b [succeeded] (child-b)",
        "      - train: succeeded exit=0",
        "      - robustness: succeeded exit=0",
        "  - gather: succeeded exit=0",
    ]


def test_second_creation_resets(spark, log):
    again = spark.createDataFrame(
        [("FlowRunCreated", "root", 99.0, 999, "sweep", ["prep"])],
        "type string, flow_run_id string, ts double, seq bigint, flow_name string, step_names array<string>")
    both = log.unionByName(again, allowMissingColumns=True)
    steps = runlog.step_states(both).where("flow_run_id = 'root'").collect()
    assert [(s["step_name"], s["state"], s["container_id"], s["exit_code"]) for s in steps] == [("prep", "pending", None, None)]
    run = runlog.run_states(both).where("flow_run_id = 'root'").first()
    assert (run["state"], run["created_ts"], run["updated_ts"]) == ("pending", 99.0, 99.0)
    assert runlog.step_history(both).where("flow_run_id = 'root'").isEmpty()


def test_replay_and_stream_equal_the_batch(spark, log, tmp_path):
    path = str(tmp_path / "log")
    event_files.write_events(log, path)
    (tmp_path / "log" / "extra.txt").write_text('\n\n{"type": "Mystery", "data": {}}\n')
    read = event_files.read_events(spark, path)
    key = lambda df: sorted(map(tuple, df.collect()), key=repr)
    assert key(runlog.step_states(read)) == key(runlog.step_states(log))
    assert key(runlog.run_states(read)) == key(runlog.run_states(log))


@pytest.mark.parametrize("order", [(0, 1, 2), (2, 1, 0), (1, 2, 0), (2, 0, 1)])
def test_live_folds_equal_the_batch_in_any_order_of_files(spark, log, tmp_path, order):
    """Three parts of the log, one micro-batch each, come in any order; the middle one creates a run anew."""
    again = spark.createDataFrame(
        [("FlowRunCreated", "child-b", 99.0, 20, "train-b", ["robustness", "late"])],
        "type string, flow_run_id string, ts double, seq bigint, flow_name string, step_names array<string>")
    both = log.where("not (flow_run_id = 'child-b' and seq = 20)").unionByName(again, allowMissingColumns=True)
    stray = spark.createDataFrame([("StepStateChanged", "unknown", 1.0, 7, "x", "running")],
                                  "type string, flow_run_id string, ts double, seq bigint, step_name string, to_state string")
    both = both.unionByName(stray, allowMissingColumns=True)
    key = lambda df: sorted(map(tuple, df.collect()), key=repr)
    parts = [both.where("seq < 14"), both.where("seq between 14 and 30"), both.where("seq > 30")]
    source, out, checkpoint = (str(tmp_path / n) for n in ("log", "out", "ck"))
    (tmp_path / "log").mkdir()
    for fold, keys, current, batch in (
        (folds.step_state_stream, ["flow_run_id", "step_name"], folds.current_steps, runlog.step_states),
        (folds.run_state_stream, ["flow_run_id"], folds.current_runs, runlog.run_states),
    ):
        at, name = f"{source}-{fold.__name__}", fold.__name__
        for k in order:
            event_files.write_events(parts[k].coalesce(1), at)
            stream = fold(event_files.stream_events(spark, at))
            (stream.writeStream.outputMode("update").option("checkpointLocation", f"{checkpoint}-{name}")
             .foreachBatch(folds.parquet_sink(f"{out}-{name}")).trigger(availableNow=True).start().awaitTermination())
        latest = folds.latest_per_key(spark.read.parquet(f"{out}-{name}"), keys)
        want = batch(both)
        assert key(current(latest).select(*want.columns)) == key(want)


def test_render(log):
    lines = [r["line"] for r in runlog.render(log).orderBy("seq").limit(5).collect()]
    assert lines[0] == "flow pending → running"
    assert lines[1] == "  step prep pending → scheduled"
    assert lines[2] == "    container c-root-prep- started on h (prep)"
    assert lines[4] == "      prep| hello"


def _runs(spark, pairs):
    rows = [(child, parent, i) for i, (child, parent) in enumerate(pairs)]
    return spark.createDataFrame(rows, "flow_run_id string, parent_flow_run_id string, created_seq bigint")


def test_deep_tree_and_cycle(spark):
    chain = [("n0", None)] + [(f"n{i}", f"n{i - 1}") for i in range(1, 150)]
    lost = [("x", "y"), ("y", "z"), ("z", "x"), ("w", "x"), ("lone", "missing")]
    found = {r["run_id"]: r["depth"] for r in graph.run_tree(_runs(spark, chain + lost)).collect()}
    assert found == {f"n{i}": i for i in range(150)}


def _edges(spark, rows):
    return spark.createDataFrame(rows, "graph int, step string, dep string")


def test_levels_and_cycles(spark):
    nodes = spark.createDataFrame([(1, s) for s in "abcd"], "graph int, step string")
    edges = _edges(spark, [(1, "b", "a"), (1, "c", "b"), (1, "d", "a"), (1, "d", "c")])
    assert {r["step"]: r["level"] for r in graph.dag_levels(nodes, edges).collect()} == {"a": 0, "b": 1, "c": 2, "d": 3}
    with pytest.raises(graph.CycleError):
        graph.dag_levels(nodes, edges.unionByName(_edges(spark, [(1, "a", "d")])))


def test_levels_of_a_long_chain_end_in_few_rounds(spark, monkeypatch):
    rounds, write = [], graph.stage
    monkeypatch.setattr(graph, "stage", lambda df, name: rounds.append(name) or write(df, name))
    nodes = spark.createDataFrame([(1, f"s{i}") for i in range(1000)], "graph int, step string")
    edges = _edges(spark, [(1, f"s{i + 1}", f"s{i}") for i in range(999)])
    assert {r["step"]: r["level"] for r in graph.dag_levels(nodes, edges).collect()} == {f"s{i}": i for i in range(1000)}
    assert rounds.count("dag-led") <= 12


def _plain_reach(edges):
    reach = set(edges)
    while True:
        more = {(a, d) for a, b in reach for c, d in edges if b == c} - reach
        if not more:
            return reach
        reach |= more


def test_levels_and_cycles_of_random_graphs(spark):
    rng = random.Random(5)
    graphs = {g: [(s, d) for s in "abcdefgh" for d in "abcdefgh" if rng.random() < 0.13 and (g % 2 or d < s)] for g in range(40)}
    graphs[1] = [("a", "a"), ("b", "a"), ("c", "d"), ("d", "c"), ("e", "c"), ("e", "gone")]
    rows = [(g, s, d) for g, x in graphs.items() for s, d in x]
    nodes = spark.createDataFrame([(g, s) for g in graphs for s in "abcdefgh"], "graph int, step string")
    expected = {}
    for g, x in graphs.items():
        reach = _plain_reach(x)
        expected |= {(g, a): min(b for b in "abcdefgh" if (a, b) in reach and (b, a) in reach) for a in "abcdefgh" if (a, a) in reach}
    found = graph.dag_cycles(nodes, _edges(spark, rows)).collect()
    assert len(found) == len(expected) and {(r.graph, r.step): r.cycle for r in found} == expected

    even = [r for r in rows if r[0] % 2 == 0]
    levels = {}
    for g in range(0, 40, 2):
        for s in "abcdefgh":  # dependencies come first in the alphabet
            levels[g, s] = max((levels[g, d] + 1 for step, d in graphs[g] if step == s), default=0)
    got = graph.dag_levels(nodes.where("graph % 2 = 0"), _edges(spark, even)).collect()
    assert {(r.graph, r.step): r.level for r in got} == levels and len(got) == len(levels)


@pytest.mark.parametrize("code,retrain,promote", [(0, "launch", "wait"), (64, "skip", "skip")])
def test_conditional_branch(spark, code, retrain, promote):
    states = spark.createDataFrame(
        [(1, "drift", "succeeded", code), (1, "retrain", "pending", None), (1, "promote", "pending", None)],
        "graph int, step string, state string, exit_code int")
    edges = _edges(spark, [(1, "retrain", "drift"), (1, "promote", "retrain")])
    conditions = graph.exited_with(
        spark.createDataFrame([(1, "retrain", "drift", [0])], "graph int, step string, dep string, codes array<int>"), states)
    got = {r["step"]: r["decision"] for r in graph.step_decisions(states, edges, conditions).collect()}
    assert got == {"retrain": retrain, "promote": promote}


def test_failed_dependency_blocks(spark):
    states = spark.createDataFrame(
        [(1, "a", "failed"), (1, "b", "skipped"), (1, "c", "pending"), (1, "d", "pending")], "graph int, step string, state string")
    edges = _edges(spark, [(1, "c", "a"), (1, "c", "b"), (1, "d", "c")])
    got = {r["step"]: r["decision"] for r in graph.step_decisions(states, edges).collect()}
    assert got == {"c": "blocked", "d": "wait"}


def _plain_decisions(states, edges, holds):
    """Judge every pending step again until a round adds no skip."""
    now, decided = dict(states), {}
    while True:
        decided = {}
        for step, state in now.items():
            if state != "pending":
                continue
            deps = [now.get(d) for s, d in edges if s == step]
            if any(d not in ("succeeded", "failed", "skipped") for d in deps):
                decided[step] = "wait"
            elif "failed" in deps:
                decided[step] = "blocked"
            elif "skipped" in deps or not all(h for s, h in holds if s == step):
                decided[step] = "skip"
            else:
                decided[step] = "launch"
        fresh = [s for s, d in decided.items() if d == "skip"]
        if not fresh:
            return decided | {s: "skip" for s, state in now.items() if state == "skipped" and states[s] == "pending"}
        now |= dict.fromkeys(fresh, "skipped")


def test_step_decisions_equal_judging_all_steps_in_every_round(spark):
    rng = random.Random(11)
    graphs = {}
    for g in range(60):
        steps = [f"s{i:02}" for i in range(9)]
        states = {s: rng.choices(["pending", "succeeded", "failed", "skipped", "running"], [12, 3, 1, 1, 1])[0] for s in steps}
        edges = [(s, d) for i, s in enumerate(steps) for d in steps[:i] if rng.random() < 0.3] + [("s08", "gone")] * (g % 5 == 0)
        graphs[g] = states, edges + edges[:2], [(s, rng.random() < 0.6) for s in steps if rng.random() < 0.4]
    # one chain whose first step is skipped, and a pair that waits for each other
    graphs[60] = {f"s{i:02}": "pending" for i in range(7)}, [(f"s{i + 1:02}", f"s{i:02}") for i in range(6)], [("s00", False)]
    graphs[61] = {"a": "pending", "b": "pending"}, [("a", "b"), ("b", "a")], [("a", False)]
    states = spark.createDataFrame([(g, s, v) for g, (x, _, _) in graphs.items() for s, v in x.items()], "graph int, step string, state string")
    edges = _edges(spark, [(g, s, d) for g, (_, x, _) in graphs.items() for s, d in x])
    holds = spark.createDataFrame([(g, s, h) for g, (_, _, x) in graphs.items() for s, h in x], "graph int, step string, holds boolean")
    found = graph.step_decisions(states, edges, holds).collect()
    expected = {(g, s): d for g, parts in graphs.items() for s, d in _plain_decisions(*parts).items()}
    assert len(found) == len(expected) and {(r.graph, r.step): r.decision for r in found} == expected

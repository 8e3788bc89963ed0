"""Run-event analytics over the derived event log."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.views import oracle, view
from gaugemill.operators import graph, runlog


def _events(spark, sf):
    return view(spark, sf, "run_events")


def persisted_filter(spark, sf):
    return runlog.persisted(_events(spark, sf)).groupBy("type").agg(
        F.count("*").alias("n"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq")
    )


def run_seed(spark, sf):
    return runlog.run_seed(_events(spark, sf))


def run_state(spark, sf):
    return runlog.run_states(_events(spark, sf)).select("flow_run_id", "flow_name", "state")


def run_times(spark, sf):
    return runlog.run_states(_events(spark, sf)).select("flow_run_id", "created_ts", "updated_ts")


def step_state(spark, sf):
    return runlog.step_states(_events(spark, sf)).select("flow_run_id", "step_name", "state")


def container_attrs(spark, sf):
    return runlog.step_states(_events(spark, sf)).select(
        "flow_run_id", "step_name", "container_id", "host_id", "exit_code"
    )


def step_history(spark, sf):
    return runlog.step_history(_events(spark, sf))


def transition_check(spark, sf):
    return runlog.transition_check(_events(spark, sf))


def orphan_events(spark, sf):
    return runlog.orphans(_events(spark, sf))


def roots(spark, sf):
    return runlog.roots(runlog.run_states(_events(spark, sf))).select("flow_run_id", "state")


def children(spark, sf):
    return runlog.children(runlog.run_states(_events(spark, sf)))


def state_summary(spark, sf):
    return runlog.state_summary(runlog.step_states(_events(spark, sf)))


def run_tree(spark, sf):
    runs = runlog.run_states(_events(spark, sf))
    return graph.run_tree(runs, runlog.step_states(_events(spark, sf)))


def tree_report(spark, sf):
    events = _events(spark, sf)
    return graph.tree_report(runlog.run_states(events), runlog.step_states(events))


def exit_class(spark, sf):
    steps = runlog.step_states(_events(spark, sf))
    allowed = steps.where("step_name IN ('click', 'view')").select(
        "flow_run_id", "step_name", F.array(F.lit(0), F.lit(64)).alias("expected_exit_codes")
    )
    return runlog.exit_classes(steps, allowed)


def flow_rollup(spark, sf):
    return runlog.flow_rollup(runlog.step_states(_events(spark, sf)))


QUERIES = {
    f.__name__: f
    for f in (persisted_filter, run_seed, run_state, run_times, step_state, container_attrs, step_history,
              transition_check, orphan_events, roots, children, state_summary, run_tree, tree_report, exit_class,
              flow_rollup)
}

# created, seeds, runs and steps as plain window SQL
FOLD = """
created AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY flow_run_id ORDER BY seq DESC) AS rn
            FROM run_events WHERE type = 'FlowRunCreated') WHERE rn = 1),
seeds AS (SELECT flow_run_id, seq AS created_seq, unnest(step_names) AS step_name,
                 cast(generate_subscripts(step_names, 1) - 1 AS int) AS step_position FROM created),
live AS (SELECT e.* FROM run_events e JOIN seeds s USING (flow_run_id, step_name) WHERE e.seq > s.created_seq),
changes AS (SELECT flow_run_id, step_name, ts, seq, from_state, to_state FROM live WHERE type = 'StepStateChanged'),
runs AS (SELECT c.flow_run_id, c.flow_name, c.parent_flow_run_id, c.parent_step_name, c.seq AS created_seq, c.ts AS created_ts,
   coalesce((SELECT arg_max(to_state, e.seq) FROM run_events e WHERE e.type = 'FlowStateChanged'
             AND e.flow_run_id = c.flow_run_id AND e.seq > c.seq), 'pending') AS state,
   (SELECT arg_max(ts, e.seq) FROM run_events e WHERE e.flow_run_id = c.flow_run_id
      AND e.type IN ('FlowRunCreated', 'FlowStateChanged', 'StepStateChanged')) AS updated_ts
 FROM created c),
folded AS (SELECT flow_run_id, step_name,
   arg_max(to_state, seq) FILTER (WHERE type = 'StepStateChanged') AS state,
   arg_max(container_id, seq) FILTER (WHERE type = 'ContainerStarted') AS container_id,
   arg_max(host_id, seq) FILTER (WHERE type = 'ContainerStarted') AS host_id,
   arg_max(exit_code, seq) FILTER (WHERE type = 'ContainerExited') AS exit_code
 FROM live GROUP BY 1, 2),
steps AS (SELECT s.flow_run_id, s.step_name, s.step_position, coalesce(f.state, 'pending') AS state,
                 f.container_id, f.host_id, f.exit_code FROM seeds s LEFT JOIN folded f USING (flow_run_id, step_name))
"""
_TREE = FOLD + """,
tree AS (SELECT flow_run_id AS run_id, flow_run_id AS root_id, 0 AS depth, lpad(created_seq::varchar, 19, '0') AS path
         FROM runs WHERE parent_flow_run_id IS NULL
  UNION ALL
  SELECT r.flow_run_id, t.root_id, t.depth + 1,
         t.path || '/' || lpad(s.step_position::varchar, 10, '0') || '.' || lpad(r.created_seq::varchar, 19, '0')
  FROM tree t JOIN runs r ON r.parent_flow_run_id = t.run_id
  JOIN seeds s ON s.flow_run_id = r.parent_flow_run_id AND s.step_name = r.parent_step_name)
"""


def _fold(sql: str, ctes: str = FOLD, recursive: bool = False) -> str:
    return oracle(f"WITH {ctes.strip()} {sql}", "run_events", recursive=recursive)


ORACLES = {
    "persisted_filter": oracle("SELECT type, count(*) AS n, min(seq) AS first_seq, max(seq) AS last_seq FROM run_events "
                               "WHERE type <> 'LogChunk' GROUP BY type", "run_events"),
    "run_seed": _fold("SELECT flow_run_id, created_seq, step_position, step_name, 'pending' AS state FROM seeds"),
    "run_state": _fold("SELECT flow_run_id, flow_name, state FROM runs"),
    "run_times": _fold("SELECT flow_run_id, created_ts, updated_ts FROM runs"),
    "step_state": _fold("SELECT flow_run_id, step_name, state FROM steps"),
    "container_attrs": _fold("SELECT flow_run_id, step_name, container_id, host_id, exit_code FROM steps"),
    "step_history": _fold("SELECT *, row_number() OVER (PARTITION BY flow_run_id, step_name ORDER BY seq) AS position FROM changes"),
    "transition_check": _fold(
        "SELECT * FROM (SELECT *, coalesce(lag(to_state) OVER (PARTITION BY flow_run_id, step_name ORDER BY seq), 'pending') "
        "AS current_state FROM changes) WHERE from_state <> current_state"),
    "orphan_events": oracle("""
WITH names AS (SELECT flow_run_id, arg_max(step_names, seq) AS step_names FROM run_events WHERE type = 'FlowRunCreated' GROUP BY 1)
SELECT e.type, e.flow_run_id, e.step_name, e.seq FROM run_events e LEFT JOIN names n USING (flow_run_id)
WHERE e.type NOT IN ('FlowRunCreated', 'LogChunk') AND (n.step_names IS NULL
  OR (e.type <> 'FlowStateChanged' AND NOT list_contains(n.step_names, e.step_name)))""", "run_events"),
    "roots": _fold("SELECT flow_run_id, state FROM runs WHERE parent_flow_run_id IS NULL"),
    "children": _fold("SELECT parent_flow_run_id, parent_step_name, flow_run_id AS child_run_id, created_seq, state FROM runs "
                      "WHERE parent_flow_run_id IS NOT NULL AND parent_step_name IS NOT NULL"),
    "state_summary": _fold("SELECT state, count(*) AS steps FROM steps GROUP BY state"),
    "run_tree": _fold("SELECT run_id, root_id, depth, path FROM tree", _TREE, True),
    "tree_report": _fold("""
SELECT root_id, path, repeat('    ', depth) || flow_name || ' [' || state || '] (' || run_id || ')' AS line
FROM tree JOIN runs ON flow_run_id = run_id
UNION ALL
SELECT root_id, path || '/' || lpad(step_position::varchar, 10, '0'), repeat('    ', depth) || '  - ' || step_name || ': ' || state
  || case when exit_code IS NULL then '' else ' exit=' || exit_code end FROM tree JOIN steps ON flow_run_id = run_id""", _TREE, True),
    "exit_class": _fold("SELECT flow_run_id, step_name, exit_code, case when exit_code = 0 OR (exit_code = 64 AND step_name IN ('click', 'view')) "
                        "then 'succeeded' else 'failed' end AS outcome FROM steps WHERE exit_code IS NOT NULL"),
    "flow_rollup": _fold("""
SELECT flow_run_id, case when bool_or(state = 'failed') then 'failed' when bool_and(state IN ('succeeded', 'skipped')) then 'succeeded'
  else 'running' end AS state, bool_or(state = 'failed') AND bool_or(state = 'running') AS running_under_failed FROM steps GROUP BY 1"""),
}

"""Dependency-table queries over the conversations table."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.views import oracle, table, view
from gaugemill.operators import graph


def dag_validate(spark, sf):
    """Problems of a damaged copy: one doubled node, dangling edges and a bare condition per graph."""
    nodes, edges = view(spark, sf, "dag_nodes"), view(spark, sf, "dag_edges")
    doubled = nodes.unionByName(nodes.where("step = 1"))
    dangling = edges.unionByName(nodes.where("step = 2").withColumn("dep", F.col("step") + 90))
    conditional = nodes.where("step IN (0, 1)")
    return graph.dag_problems(doubled, dangling, conditional)


def dag_levels(spark, sf):
    return graph.dag_levels(view(spark, sf, "dag_nodes"), view(spark, sf, "dag_edges"))


def dag_cycles(spark, sf):
    """Every fifth conversation's last turn is made a dependency of its middle one, and of its first in every tenth."""
    nodes, edges = view(spark, sf, "dag_nodes"), view(spark, sf, "dag_edges")
    last = nodes.groupBy("graph").agg(F.max("step").alias("dep"))
    closing = nodes.join(last, "graph").where((F.col("graph") % 5 == 0) & (
        (F.col("step") * 2 == F.col("dep")) | ((F.col("step") == 0) & (F.col("graph") % 10 == 0)))).select("graph", "step", "dep")
    return graph.dag_cycles(nodes, edges.unionByName(closing))


def _conditions(spark, sf):
    return table(spark, sf, "conversations").where("turn = 1").select(
        F.col("conv_id").alias("graph"), F.col("turn").alias("step"), (F.col("turn") - 1).alias("dep"),
        F.array(F.lit(0), F.lit(64)).alias("codes"),
    )


def exited_with(spark, sf):
    return graph.exited_with(_conditions(spark, sf), view(spark, sf, "dag_states"))


def step_decision(spark, sf):
    states = view(spark, sf, "dag_states")
    return graph.step_decisions(states, view(spark, sf, "dag_edges"), graph.exited_with(_conditions(spark, sf), states))


def run_parents_tree(spark, sf):
    """Region, nation and customer rows as one tree of runs."""
    def key(prefix, column):
        return F.concat(F.lit(prefix), F.col(column).cast("string"))

    region, nation, customer = (table(spark, sf, t) for t in ("region", "nation", "customer"))
    runs = region.select(key("r", "r_regionkey").alias("flow_run_id"), F.lit(None).cast("string").alias("parent_flow_run_id"),
                         F.col("r_regionkey").cast("bigint").alias("created_seq"))
    runs = runs.unionByName(nation.select(
        key("n", "n_nationkey").alias("flow_run_id"), key("r", "n_regionkey").alias("parent_flow_run_id"),
        F.col("n_nationkey").cast("bigint").alias("created_seq")))
    runs = runs.unionByName(customer.select(
        key("c", "c_custkey").alias("flow_run_id"), key("n", "c_nationkey").alias("parent_flow_run_id"),
        F.col("c_custkey").alias("created_seq")))
    return graph.run_tree(runs)


QUERIES = {f.__name__: f for f in (dag_validate, dag_levels, dag_cycles, exited_with, step_decision, run_parents_tree)}

ORACLES = {
    "dag_validate": oracle("""
SELECT graph, step, 'duplicate step name' AS problem FROM dag_nodes WHERE step = 1
UNION ALL SELECT graph, step, 'depends on unknown step ' || (step + 90) FROM dag_nodes WHERE step = 2
UNION ALL SELECT graph, step, 'condition without dependency' FROM dag_nodes n
 WHERE step IN (0, 1) AND NOT EXISTS (SELECT 1 FROM dag_edges e WHERE e.graph = n.graph AND e.step = n.step)""",
                           "dag_nodes", "dag_edges"),
    "dag_levels": oracle("""
WITH walk AS (SELECT graph, step, 0 AS level FROM dag_nodes
  UNION SELECT e.graph, e.step, w.level + 1 FROM walk w JOIN dag_edges e ON e.graph = w.graph AND e.dep = w.step)
SELECT graph, step, cast(max(level) AS int) AS level FROM walk GROUP BY graph, step""", "dag_nodes", "dag_edges", recursive=True),
    "dag_cycles": oracle("""
WITH closed AS (SELECT graph, step, dep FROM dag_edges
  UNION SELECT n.graph, n.step, l.dep FROM dag_nodes n JOIN (SELECT graph, max(step) AS dep FROM dag_nodes GROUP BY graph) l USING (graph)
  WHERE n.graph % 5 = 0 AND (n.step * 2 = l.dep OR (n.step = 0 AND n.graph % 10 = 0))),
reach AS (SELECT graph, step, dep FROM closed UNION SELECT r.graph, r.step, c.dep FROM reach r JOIN closed c ON c.graph = r.graph AND c.step = r.dep)
SELECT a.graph, a.step, min(a.dep) AS cycle FROM reach a JOIN reach b ON b.graph = a.graph AND b.step = a.dep AND b.dep = a.step
GROUP BY a.graph, a.step""", "dag_nodes", "dag_edges", recursive=True),
    "exited_with": "SELECT conv_id AS graph, turn AS step, conv_id % 3 * 32 IN (0, 64) AS holds FROM conversations WHERE turn = 1",
    # dependencies always point to earlier turns, so one walk over the turns settles every step
    "step_decision": oracle("""
WITH last_turn AS (SELECT graph, max(step) AS top FROM dag_states GROUP BY graph),
walk AS (SELECT graph, cast(0 AS bigint) AS step, [state] AS seen, cast(NULL AS varchar) AS decision
         FROM dag_states WHERE step = 0
  UNION ALL
  SELECT graph, step, list_append(seen, case decision when 'skip' then 'skipped' else 'pending' end), decision
  FROM (SELECT w.graph, w.step + 1 AS step, w.seen,
          case when w.seen[w.step + 1] NOT IN ('succeeded', 'failed', 'skipped')
                 OR (w.step >= 2 AND w.seen[w.step - 1] NOT IN ('succeeded', 'failed', 'skipped')) then 'wait'
               when w.seen[w.step + 1] = 'failed' OR (w.step >= 2 AND w.seen[w.step - 1] = 'failed') then 'blocked'
               when w.seen[w.step + 1] = 'skipped' OR (w.step >= 2 AND w.seen[w.step - 1] = 'skipped')
                 OR (w.step = 0 AND w.graph % 3 = 1) then 'skip'
               else 'launch' end AS decision
        FROM walk w JOIN last_turn l ON l.graph = w.graph AND w.step < l.top))
SELECT graph, step, decision FROM walk WHERE step > 0""", "dag_states", recursive=True),
    "run_parents_tree": """
WITH RECURSIVE runs AS (
  SELECT 'r' || r_regionkey AS id, NULL::varchar AS parent, r_regionkey::bigint AS seq FROM region
  UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_nationkey FROM nation
  UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, c_custkey FROM customer),
t AS (SELECT id AS run_id, id AS root_id, 0 AS depth, lpad(seq::varchar, 19, '0') AS path FROM runs WHERE parent IS NULL
  UNION ALL SELECT r.id, t.root_id, t.depth + 1, t.path || '/' || lpad(r.seq::varchar, 19, '0') FROM t JOIN runs r ON r.parent = t.run_id)
SELECT * FROM t""",
}

"""Stand-in views over the given tables, in SQL that Spark and DuckDB both read.

The tables hold no reviews and no run log, so each view derives such rows from every row
of the tables it names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

_STEP_NAMES = "click,error,purchase,signup,view"
_PARENT_STEP = (
    "case user_id % 5 when 0 then 'click' when 1 then 'error' when 2 then 'purchase' "
    "when 3 then 'signup' else 'view' end"
)
_CREATED = f"""
select 'FlowRunCreated' as type, 'run-' || cast(user_id as string) as flow_run_id,
       cast(1000000000 + born as double) as ts, seq,
       'flow-' || cast(user_id % 7 as string) as flow_name,
       split('{_STEP_NAMES}', ',') as step_names,
       case when user_id >= 3 then 'run-' || cast(cast(floor(user_id / 3) as bigint) as string) end
         as parent_flow_run_id,
       case when user_id >= 3 then {_PARENT_STEP} end as parent_step_name,
       cast(null as string) as step_name, cast(null as string) as from_state,
       cast(null as string) as to_state, cast(null as string) as container_id,
       cast(null as string) as host_id, cast(null as int) as exit_code, cast(null as string) as data
"""

VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "reviews_raw": (("documents",), """
select doc_id as uniqueID, source as drugName,
       case when doc_id % 97 = 0 then null else lang end as condition,
       text || case doc_id % 4 when 0 then ' caf&eacute;&nbsp;&nbsp;&amp;quot; it&#39;s'
                               when 1 then ' &copy=1 &lt;b&gt;  ' else '' end as review,
       cast(1 + (doc_id * 7) % 10 as int) as rating,
       cast(1 + doc_id % 28 as string) || '-'
         || substr('JanFebMarAprMayJunJulAugSepOctNovDec', cast(1 + 3 * (doc_id % 12) as int), 3) || '-'
         || lpad(cast((95 + doc_id % 13) % 100 as string), 2, '0') as date,
       cast(n_chars % 100 as int) as usefulCount,
       case when doc_id % 5 < 3 then 'reference' else 'current' end as split
from {documents}"""),
    "ratings": (("lineitem",), """
select cast(ceil(l_quantity / 5) as int) as rating,
       l_shipdate < timestamp '1999-01-01 00:00:00' as is_ref from {lineitem}"""),
    "categories": (("orders",), """
select case when o_orderkey % 50 = 0 then null else o_orderpriority end as category,
       o_orderdate < timestamp '1999-01-01 00:00:00' as is_ref from {orders}"""),
    "preds": (("documents", "labels"), """
select d.doc_id as unique_id, l.quality as y,
       case when d.n_chars > 300 then 1 else 0 end as yhat_a,
       case when d.doc_id % 3 <> 0 then 1 else 0 end as yhat_b
from {documents} d join {labels} l on d.doc_id = l.doc_id"""),
    "shipments": (("lineitem",), """
select l_quantity, l_extendedprice, l_discount, l_returnflag, l_linenumber % 3 as y,
       case when l_quantity > 25 then l_linenumber % 3 else 1 end as yhat,
       l_shipdate < timestamp '1998-06-01 00:00:00' as is_ref from {lineitem}"""),
    "labelled_reviews": (("documents", "labels"), """
select d.doc_id as uniqueID, d.source as drugName, d.lang as condition, d.text as review,
       cast(case when l.quality = 1 then 7 + d.doc_id % 4 else 1 + d.doc_id % 4 end as int) as rating,
       '3-Feb-12' as date, cast(d.n_chars % 100 as int) as usefulCount,
       case when d.doc_id % 5 < 3 then 'reference' else 'current' end as split
from {documents} d join {labels} l on d.doc_id = l.doc_id"""),
    "run_events": (("events",), f"""
with users as (select user_id, min(event_id) as born, min(event_id) * 10 as seq from {{events}} group by user_id),
resets as (select user_id, event_id as born, event_id * 10 + 7 as seq from {{events}} where event_id % 911 = 0)
{_CREATED} from users
union all {_CREATED} from resets
union all
select case event_id % 9 when 5 then 'ContainerStarted' when 6 then 'ContainerExited'
            when 7 then 'FlowStateChanged' when 8 then 'LogChunk' else 'StepStateChanged' end as type,
       case when event_id % 501 = 500 then 'ghost-' || cast(event_id as string)
            else 'run-' || cast(user_id as string) end as flow_run_id,
       cast(1000000000 + event_id as double) as ts, event_id * 10 + 5 as seq,
       cast(null as string) as flow_name, null as step_names,
       cast(null as string) as parent_flow_run_id, cast(null as string) as parent_step_name,
       case when event_id % 9 = 7 then null when event_id % 333 = 0 then 'ghost-step' else event_type end as step_name,
       case when event_id % 9 in (5, 6, 8) then null
            else case event_id % 3 when 0 then 'pending' when 1 then 'scheduled' else 'running' end end as from_state,
       case when event_id % 9 in (5, 6, 8) then null
            when event_id % 9 = 7 then case event_id % 4 when 1 then 'succeeded' when 2 then 'failed' else 'running' end
            else case event_id % 5 when 0 then 'scheduled' when 1 then 'running' when 2 then 'succeeded'
                      when 3 then 'failed' else 'skipped' end end as to_state,
       case when event_id % 9 in (5, 6, 8) then 'container-' || lpad(cast(event_id as string), 8, '0') end as container_id,
       case when event_id % 9 = 5 then 'host-' || cast(event_id % 4 as string) end as host_id,
       case when event_id % 9 = 6 then case event_id % 4 when 0 then 64 when 1 then 1 else 0 end end as exit_code,
       case when event_id % 9 = 8 then case when event_id % 27 = 8 then '   ' else 'log ' || cast(event_id as string) || '  ' end end as data
from {{events}}"""),
    "dag_nodes": (("conversations",), "select conv_id as graph, turn as step from {conversations}"),
    "dag_edges": (("conversations",), """
select a.conv_id as graph, a.turn as step, b.turn as dep from {conversations} a
join {conversations} b on a.conv_id = b.conv_id and (b.turn = a.turn - 1 or b.turn = a.turn - 3)"""),
    "dag_states": (("conversations",), """
select conv_id as graph, turn as step,
       case when turn > 0 then 'pending'
            else case conv_id % 4 when 0 then 'succeeded' when 1 then 'failed' when 2 then 'skipped' else 'running' end
       end as state,
       cast(case when turn > 0 then null else conv_id % 3 * 32 end as int) as exit_code
from {conversations}"""),
    "promotions": (("orders",), """
select o_custkey as line, o_orderdate as at, o_orderkey as seq,
       'v' || cast(o_orderkey % 7 as string) as flow_version_id,
       'r' || cast(o_orderkey as string) as run_id, o_totalprice from {orders}"""),
    "measurements": (("events",), """
select user_id as feature_key, ts, event_id as seq, value / 1000 as psi from {events}"""),
    "configs": (("part",), """
select p_partkey as id, p_retailprice * power(cast(10 as double), p_partkey % 3 * 4) / power(cast(10 as double), p_partkey % 20) as c,
       1 + p_partkey % 3 as ngram_max, p_size as min_df, 7 as floor, 4 as ceiling, p_partkey % 5 as seed
from {part}"""),
    "experiments": (("orders",), """
select 'exp-' || cast(o_orderkey as string) as experiment_id,
       'va' || cast(o_custkey as string) as version_a, 'vb' || cast(o_custkey as string) as version_b,
       (o_orderkey * 37 % 1000) / cast(1000 as double) as f1_a,
       case when o_orderkey % 5 = 0 then null else (o_orderkey * 91 % 1000) / cast(1000 as double) end as f1_b,
       case when o_orderkey % 3 = 0 then 'FAIL' else 'PASS' end as verdict
from {orders}"""),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    tables, sql = VIEWS[name]
    return spark.sql(sql, **{t: table(spark, sf_dir, t) for t in tables})


def oracle(sql: str, *names: str, recursive: bool = False) -> str:
    """DuckDB text of ``sql`` with the named views in front of it."""
    parts = [f"{n} AS ({VIEWS[n][1].format(**{t: t for t in VIEWS[n][0]})})" for n in names]
    text = sql.strip()
    head = "WITH RECURSIVE " if recursive else "WITH "
    if not parts:
        return text
    if text.upper().startswith("WITH "):
        return head + ",\n".join(parts) + ",\n" + text[5:]
    return head + ",\n".join(parts) + "\n" + text

"""Version ids, digests and tracking-table queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.views import oracle, table, view
from gaugemill.functions.canonical import json_object, json_string
from gaugemill.operators import tracking, versions
from gaugemill.sources import tables

# Every column of every table; # marks doubles, @ timestamps and * vectors, whose texts differ between engines.
_COLUMNS = {
    table: columns.split() for table, columns in {
        "region": "r_regionkey r_name",
        "nation": "n_nationkey n_name n_regionkey",
        "supplier": "s_suppkey s_name s_nationkey s_acctbal#",
        "customer": "c_custkey c_name c_nationkey c_acctbal# c_mktsegment",
        "part": "p_partkey p_name p_brand p_type p_size p_retailprice#",
        "orders": "o_orderkey o_custkey o_orderstatus o_totalprice# o_orderdate@ o_orderpriority",
        "lineitem": "l_orderkey l_partkey l_suppkey l_linenumber l_quantity# l_extendedprice# l_discount# l_tax# l_returnflag l_linestatus l_shipdate@",
        "events": "event_id ts@ user_id event_type value# props",
        "documents": "doc_id text lang source n_chars",
        "embeddings": "vec_id embedding* label",
        "pages": "page_id url html",
        "benchmark": "item_id text",
        "labels": "doc_id quality toxic",
        "conversations": "conv_id turn role text",
    }.items()
}
_DIGESTED = tuple(_COLUMNS)
_SPARK_TEXT = {
    "#": "cast(cast({c} as decimal(24,6)) as string)", "@": "date_format({c}, 'yyyy-MM-dd HH:mm:ss.SSSSSS')",
    "*": "array_join(transform({c}, x -> cast(cast(cast(x as double) as decimal(24,6)) as string)), ',')",
}
_DUCK_TEXT = {
    "#": "cast(cast({c} as decimal(24,6)) as varchar)", "@": "strftime({c}, '%Y-%m-%d %H:%M:%S.%f')",
    "*": "array_to_string(list_transform({c}, lambda x: cast(cast(cast(x as double) as decimal(24,6)) as varchar)), ',')",
}


def _texts(table: str, kinds: dict[str, str], plain: str) -> list[tuple[str, str]]:
    """Each column's name and the expression of its text."""
    names = [(c.rstrip("#@*"), c[-1]) for c in _COLUMNS[table]]
    return [(name, kinds.get(kind, plain).format(c=name)) for name, kind in names]


def config_version(spark, sf):
    c = view(spark, sf, "configs")
    return c.select("id", versions.config_version(*[F.col(n) for n in ("c", "ngram_max", "min_df", "floor", "ceiling", "seed")])
                    .alias("flow_version_id"))


def component_version(spark, sf):
    """Version of every customer as a component with its segment and nation as payload."""
    c = table(spark, sf, "customer")
    payload = json_object(nation=F.col("c_nationkey").cast("string"), segment=json_string(F.col("c_mktsegment")))
    return c.select("c_custkey", versions.component_version(F.col("c_name"), payload).alias("version_id"))


def component_version_text(spark, sf):
    """Version of every document as a component named by its whole text."""
    doc = table(spark, sf, "documents")
    payload = json_object(lang=json_string(F.col("lang")), n_chars=F.col("n_chars").cast("string"))
    return doc.select("doc_id", versions.component_version(F.col("text"), payload).alias("version_id"))


def _digests(spark, sf):
    parts = [
        versions.table_digest(table(spark, sf, t).selectExpr(*[f"{text} AS {name}" for name, text in _texts(t, _SPARK_TEXT, "{c}")]))
        .select(F.lit(t).alias("name"), "rows", "digest")
        for t in _DIGESTED
    ]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def table_digest(spark, sf):
    return _digests(spark, sf)


def file_digest(spark, sf):
    return tables.file_digests(spark, sf, "*.parquet").select("name", "length", "digest")


def dataset_version(spark, sf):
    return versions.dataset_version(_digests(spark, sf))


def prep_version(spark, sf):
    found = versions.dataset_version(_digests(spark, sf))
    return found.select("dataset_version_id", versions.prep_version(F.col("dataset_version_id")).alias("prep_version_id"))


def run_resolve(spark, sf):
    runs = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("run_id"), F.col("o_custkey").alias("version"), F.col("o_orderdate").alias("start_time")
    )
    return tracking.resolve_versions(runs, "version")


def run_log(spark, sf):
    """Runs with params, metrics and tags as maps, summed up per tag."""
    runs = table(spark, sf, "orders").select(
        F.create_map(F.lit("priority"), F.col("o_orderpriority")).alias("params"),
        F.create_map(F.lit("price"), F.col("o_totalprice")).alias("metrics"),
        F.create_map(F.lit("status"), F.col("o_orderstatus")).alias("tags"),
    )
    return runs.groupBy(F.col("tags")["status"].alias("status"), F.col("params")["priority"].alias("priority")).agg(
        F.count("*").alias("runs"), F.max(F.col("metrics")["price"]).alias("best")
    )


def namespace(spark, sf):
    e = table(spark, sf, "orders").select(
        "o_orderkey", F.when(F.col("o_orderkey") % 3 > 0, F.concat(F.lit("exp-"), F.col("o_custkey").cast("string"))).alias("eid"),
        F.when(F.col("o_orderkey") % 2 > 0, F.lower(F.hex("o_orderkey"))).alias("fid"), "o_orderstatus",
    )
    tags = tracking.experiment_tags(F.col("eid"), F.col("fid"))
    return e.select(
        "o_orderkey", tracking.experiment_name(F.col("o_orderstatus"), F.col("eid")).alias("experiment"),
        F.element_at(tags, "experiment_id").alias("experiment_id"), F.element_at(tags, "flow_run_id").alias("flow_run_id"),
        F.size(tags).alias("tags"),
    )


QUERIES = {
    f.__name__: f
    for f in (config_version, component_version, component_version_text, table_digest, file_digest, dataset_version, prep_version, run_resolve,
              run_log, namespace)
}


def _digest_sql(name: str) -> str:
    cells = ", ".join(f"coalesce('v' || {text}, 'n')" for _, text in _texts(name, _DUCK_TEXT, "cast({c} AS varchar)"))
    return (f"SELECT '{name}' AS name, rows, sha256(rows || ':' || total) AS digest FROM (SELECT count(*) AS rows, "
            f"cast(sum(('0x' || left(sha256(concat_ws(chr(31), {cells})), 15))::bigint) AS varchar) AS total FROM {name})")


_ALL = " UNION ALL ".join(_digest_sql(t) for t in _DIGESTED)
_DATASET = (f"d AS ({_ALL}), v AS (SELECT left(sha256('{{\"component\": \"dataset-pull\", \"payload\": {{\"dataset_slug\": "
            "\"jessicali9530/kuc-hackathon-winter-2018\", \"files\": {' || string_agg('\"' || name || '\": \"' || digest || '\"', ', ' ORDER BY name) "
            "|| '}}}'), 12) AS dataset_version_id FROM d)")
_PREP = ('{"dataset": "UCI Drug Review Dataset", "date_format": "%d-%b-%y", "derived_columns": '
         '["review_length", "review_word_count", "review_year", "rating_bucket"], "rating_bucket_bins": [0, 4, 7, 10], '
         '"rating_bucket_labels": ["low", "medium", "high"], "reference_split_label": "reference", "current_split_label": "current"}')
_PREP = ('{"current_split_label": "current", ' + _PREP[1:].replace(', "current_split_label": "current"', ""))
ORACLES = {
    "config_version": oracle("""
SELECT id, left(sha256('{"C": ' || cast(c AS varchar) || ', "min_df": ' || min_df || ', "negative_rating_ceiling": ' || ceiling
  || ', "ngram_max": ' || ngram_max || ', "positive_rating_floor": ' || floor || ', "random_seed": ' || seed || '}'), 12) AS flow_version_id
FROM configs""", "configs"),
    "component_version": "SELECT c_custkey, left(sha256('{\"component\": \"' || c_name || '\", \"payload\": {\"nation\": ' || c_nationkey "
                         "|| ', \"segment\": \"' || c_mktsegment || '\"}}'), 12) AS version_id FROM customer",
    "table_digest": _ALL,
    "dataset_version": f"WITH {_DATASET} SELECT dataset_version_id FROM v",
    "prep_version": f"WITH {_DATASET} SELECT dataset_version_id, left(sha256('{{\"component\": \"data-prep\", \"payload\": "
                    f"{{\"dataset_version_id\": \"' || dataset_version_id || '\", \"params\": {_PREP}}}}}'), 12) AS prep_version_id FROM v",
    "run_resolve": "SELECT o_custkey AS version, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS run_id, count(*) AS runs FROM orders GROUP BY 1",
    "run_log": "SELECT o_orderstatus AS status, o_orderpriority AS priority, count(*) AS runs, max(o_totalprice) AS best FROM orders GROUP BY 1, 2",
    "namespace": """
SELECT o_orderkey, case when o_orderkey % 3 > 0 then 'exp-' || o_custkey || ':' || o_orderstatus else o_orderstatus end AS experiment,
  case when o_orderkey % 3 > 0 then 'exp-' || o_custkey end AS experiment_id,
  case when o_orderkey % 2 > 0 then lower(to_hex(o_orderkey)) end AS flow_run_id,
  cast((o_orderkey % 3 > 0)::int + (o_orderkey % 2 > 0)::int AS int) AS tags FROM orders""",
}

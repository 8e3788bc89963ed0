"""Content-derived version ids of configs, tables, files and components."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugemill.functions.canonical import json_float, json_object, json_string, short_id
from gaugemill.settings import DATASET_NAME, DATASET_SLUG, DATE_FORMAT

# The preparation contract that a data-prep version covers.
PREP_PARAMS = {
    "dataset": DATASET_NAME,
    "date_format": DATE_FORMAT,
    "reference_split_label": "reference",
    "current_split_label": "current",
    "rating_bucket_bins": [0, 4, 7, 10],
    "rating_bucket_labels": ["low", "medium", "high"],
    "derived_columns": ["review_length", "review_word_count", "review_year", "rating_bucket"],
}
# Named training configs.
PRESETS = {
    "baseline": {"C": 1.0, "ngram_max": 2, "min_df": 5},
    "challenger": {"C": 0.05, "ngram_max": 1, "min_df": 50},
    "c03": {"C": 0.3, "ngram_max": 2, "min_df": 5},
}


def _text(number: Column) -> Column:
    return number.cast("string")


def config_version(
    c: Column, ngram_max: Column, min_df: Column, floor: Column, ceiling: Column, seed: Column
) -> Column:
    """Version id of a training config given as columns."""
    return short_id(json_object(
        C=json_float(c),
        ngram_max=_text(ngram_max),
        min_df=_text(min_df),
        positive_rating_floor=_text(floor),
        negative_rating_ceiling=_text(ceiling),
        random_seed=_text(seed),
    ))


def component_version(component: Column, payload: Column) -> Column:
    """Version id of a component from its name and canonical payload text."""
    return short_id(json_object(component=json_string(component), payload=payload))


def table_digest(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row: row count and an order-free content digest.

    Each row is hashed by its tagged text; the sum of 60-bit prefixes needs no ordering,
    so the digest is a single partial aggregate over any number of files.
    """
    cells = [F.coalesce(F.concat(F.lit("v"), F.col(c).cast("string")), F.lit("n")) for c in columns or df.columns]
    prefix = F.conv(F.left(F.sha2(F.concat_ws("\x1f", *cells), 256), F.lit(15)), 16, 10)
    total = F.coalesce(F.sum(prefix.cast("decimal(28,0)")), F.lit(0).cast("decimal(38,0)"))
    rows = F.count("*")
    return df.agg(
        rows.alias("rows"),
        F.sha2(F.concat(rows.cast("string"), F.lit(":"), total.cast("string")), 256).alias("digest"),
    )


def dataset_version(digests: DataFrame, groups: Sequence[str] = (), slug: str = DATASET_SLUG) -> DataFrame:
    """Version of a dataset from its (name, digest) rows; a dataset names a handful of inputs."""
    listed = F.array_sort(F.collect_list(F.struct("name", "digest")))
    pair = lambda f: F.concat(json_string(f["name"]), F.lit(": "), json_string(f["digest"]))
    files = F.concat(F.lit("{"), F.array_join(F.transform("_files", pair), ", "), F.lit("}"))
    payload = json_object(dataset_slug=F.lit(json.dumps(slug)), files=files)
    return digests.groupBy(*groups).agg(listed.alias("_files")).select(
        *groups, component_version(F.lit("dataset-pull"), payload).alias("dataset_version_id")
    )


def prep_version(dataset_version_id: Column, params: dict | None = None) -> Column:
    """Version of the prepared data, chained from the dataset it consumed."""
    contract = json.dumps(params or PREP_PARAMS, sort_keys=True)
    payload = json_object(dataset_version_id=json_string(dataset_version_id), params=F.lit(contract))
    return component_version(F.lit("data-prep"), payload)

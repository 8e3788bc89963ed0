"""Raw files to the four processed tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugemill.operators import quality, splits, versions
from gaugemill.plans.workspace import Workspace
from gaugemill.settings import COMPONENTS_EXPERIMENT, CURRENT_SPLIT, REFERENCE_SPLIT
from gaugemill.sources import tables

BUILD_SCHEMA = "version string, dataset_version string, built_ns bigint"


@dataclass(frozen=True)
class Datasets:
    reference: DataFrame
    current: DataFrame
    training: DataFrame
    combined: DataFrame
    summary: DataFrame
    version: str
    rebuilt: bool


NAMES = ("reference", "current", "training", "combined", "summary")


def raw_version(ws: Workspace, reference_csv: str, current_csv: str) -> str:
    """Dataset version from the bytes of every raw file."""
    named = tables.file_digests(ws.spark, reference_csv).select(
        F.concat(F.lit("reference/"), "name").alias("name"), "digest"
    ).unionByName(
        tables.file_digests(ws.spark, current_csv).select(
            F.concat(F.lit("current/"), "name").alias("name"), "digest"
        )
    )
    return versions.dataset_version(named).first()[0]


def load(ws: Workspace, version: str, rebuilt: bool = False) -> Datasets:
    read = {n: ws.spark.read.parquet(ws.path(f"processed/{version}/{n}")) for n in NAMES}
    return Datasets(**read, version=version, rebuilt=rebuilt)


def build(
    ws: Workspace,
    reference_csv: str,
    current_csv: str,
    incoming_csv: str | None = None,
    overwrite: bool = False,
) -> Datasets:
    """Build the processed tables, or return the stored ones when the same files made them.

    Each raw file is parsed and cleaned once: later tables read the Parquet already
    written, never the CSV. A dropped file takes the place of the current split.
    """
    source = incoming_csv or current_csv
    tables.require_header(ws.spark, reference_csv)
    tables.require_header(ws.spark, source)
    dataset_version = raw_version(ws, reference_csv, source)
    prep_id = ws.spark.range(1).select(versions.prep_version(F.lit(dataset_version))).first()[0]
    version = f"{prep_id}-{'incoming' if incoming_csv else 'regular'}"

    built = ws.table("dataset_builds", BUILD_SCHEMA)
    if not overwrite and built is not None and not built.where(F.col("version") == version).isEmpty():
        return load(ws, version)

    def write(df: DataFrame, name: str) -> DataFrame:
        path = ws.path(f"processed/{version}/{name}")
        df.write.mode("overwrite").parquet(path)
        return ws.spark.read.parquet(path)

    reference = write(splits.prepare_split(tables.read_csv(ws.spark, reference_csv), REFERENCE_SPLIT), "reference")
    arrived = write(splits.prepare_split(tables.read_csv(ws.spark, source), CURRENT_SPLIT), "arrived")
    training, current = splits.assemble_splits(reference, arrived, incoming_csv is not None)
    training, current = write(training, "training"), write(current, "current")
    write(splits.combine_sort(reference, current), "combined")
    summary = write(quality.quality_summary(reference, current, training), "summary").first().asDict()
    ws.append("dataset_builds", BUILD_SCHEMA, (version, dataset_version, 0))
    ws.log(
        COMPONENTS_EXPERIMENT, f"data-prep:{prep_id}",
        params={"dataset": summary["dataset"]},
        metrics={k: v for k, v in summary.items() if isinstance(v, (int, float))},
        tags={"component_name": "data-prep", "component_version_id": prep_id, "dataset_version_id": dataset_version},
    )
    return load(ws, version, rebuilt=True)


def enforce_quality(data: Datasets) -> None:
    """Raise at the first failed data-quality gate."""
    both = data.reference.withColumn("is_ref", F.lit(True)).unionByName(
        data.current.withColumn("is_ref", F.lit(False))
    )
    for split in (data.reference, data.current):
        quality.enforce(quality.missing_gate(split, "condition"), "condition_missing_rate", "Missing rate")
    quality.enforce(quality.ks_gate(both, "rating", "is_ref"), "ks", "Rating KS statistic")
    quality.enforce(quality.tvd_gate(both, "condition", "is_ref"), "tvd", "Condition TVD")

"""What an ingestion run has to (re)create."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ingest_plan(states: DataFrame) -> DataFrame:
    """Add the four action flags to rows of five booleans about a dataset."""
    incoming, overwrite = F.col("has_incoming"), F.col("overwrite")
    pull_test = ~incoming & (overwrite | ~F.col("test_exists"))
    return states.select(
        "*",
        (overwrite | ~F.col("train_exists")).alias("need_train"),
        pull_test.alias("need_test"),
        incoming.alias("use_incoming"),
        (incoming | pull_test | overwrite | ~F.col("test_parquet_exists")).alias("rebuild_test_parquet"),
    )


def choose_current(states: DataFrame) -> DataFrame:
    """Path the current split is read from: the dropped file when there is one."""
    return states.withColumn(
        "current_path", F.coalesce(F.nullif(F.col("incoming_path"), F.lit("")), F.col("default_path"))
    )

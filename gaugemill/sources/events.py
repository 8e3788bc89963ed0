"""Run-event log files: one {"type", "data"} JSON record per line."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugemill.operators.ordered import with_row_number
from gaugemill.operators.runlog import EVENT_SCHEMA, PERSISTED, persisted

_FIELDS = [f for f in EVENT_SCHEMA if f.name != "type"]
RECORD_SCHEMA = T.StructType([
    T.StructField("type", T.StringType()),
    T.StructField("data", T.StructType(_FIELDS)),
])


def to_records(events: DataFrame) -> DataFrame:
    """Persisted events as record lines; log chunks never reach the log."""
    data = F.struct(*[F.col(f.name) for f in _FIELDS if f.name in events.columns])
    return persisted(events).select(F.to_json(F.struct("type", data.alias("data"))).alias("value"))


def write_events(events: DataFrame, path: str) -> None:
    to_records(events).write.mode("append").text(path)


def from_records(records: DataFrame, order: Sequence[str] = ("_file", "_block", "_line")) -> DataFrame:
    """Wide events of known types, numbered by ``order`` where the log holds no ``seq``."""
    wide = records.where(F.col("type").isin(*PERSISTED)).select("type", "data.*", *order)
    return (
        with_row_number(wide, [], order, "_number")
        .withColumn("seq", F.coalesce("seq", F.col("_number") - 1)).drop(*order, "_number")
    )


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Events of a log of any number of files. Blank lines and unknown types are skipped.

    A log without ``seq`` is read in the order of file names and of lines in a file, whatever files Spark packs into a task.
    """
    records = spark.read.schema(RECORD_SCHEMA).json(path)
    if records.where(F.col("type").isin(*PERSISTED) & F.col("data.seq").isNull()).isEmpty():
        return records.where(F.col("type").isin(*PERSISTED)).select("type", "data.*")
    # numbers grow within a block of a file, which one task reads from start to end
    return from_records(records.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"),
                                       F.monotonically_increasing_id().alias("_line")))


def stream_events(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """The log as a stream; such logs must carry ``seq``."""
    records = spark.readStream.schema(RECORD_SCHEMA).option("maxFilesPerTrigger", files_per_trigger).json(path)
    return records.where(F.col("type").isin(*PERSISTED)).select("type", "data.*")

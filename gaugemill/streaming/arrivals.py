"""Files that arrive in a folder, each handled once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

_FILE = T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("modificationTime", T.TimestampType()),
    T.StructField("length", T.LongType()),
    T.StructField("content", T.BinaryType()),
])


def list_files(spark: SparkSession, path: str, suffix: str = "") -> DataFrame:
    """Names and sizes of the regular files in a folder; none if there is no such folder. Their content is not read."""
    try:
        files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").load(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        files = spark.createDataFrame([], _FILE)
    return files.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), "length")


def new_files(listing: DataFrame, seen: DataFrame) -> DataFrame:
    """Files without an entry in the ``seen`` manifest."""
    return listing.join(seen.select("file").distinct(), "file", "left_anti")


def arrivals(spark: SparkSession, path: str, suffix: str = ".csv", files_per_trigger: int = 1000) -> DataFrame:
    """Stream of newly arrived files as (file, path); their content is not read here."""
    files = (
        spark.readStream.format("binaryFile").schema(_FILE)
        .option("pathGlobFilter", f"*{suffix}")
        .option("maxFilesPerTrigger", files_per_trigger)
        .load(path)
    )
    return files.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), "path")


def on_arrival(
    spark: SparkSession,
    path: str,
    checkpoint: str,
    handle: Callable[[DataFrame, int], None],
    suffix: str = ".csv",
    watch_every: str | None = None,
) -> StreamingQuery:
    """Call ``handle(files, batch_id)`` for every batch of new files.

    The checkpoint remembers handled files. Delivery is at least once, so handlers should
    be idempotent on the batch id. Without ``watch_every`` the query stops when it has
    caught up.
    """
    writer = arrivals(spark, path, suffix).writeStream.option("checkpointLocation", checkpoint).foreachBatch(handle)
    trigger = {"processingTime": watch_every} if watch_every else {"availableNow": True}
    return writer.trigger(**trigger).start()


def baseline(spark: SparkSession, path: str, checkpoint: str, suffix: str = ".csv") -> None:
    """Mark every file already present as handled."""
    on_arrival(spark, path, checkpoint, lambda files, batch_id: None, suffix).awaitTermination()

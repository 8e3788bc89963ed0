"""Session defaults and the shared folder that intermediate tables live in."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "gaugemill", cores: int | str = "*", partitions: int = 8) -> SparkSession:
    """Session for tests and single-node runs; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


#: Folders made for local sessions that name none, by application.
_made: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as the session's spark.checkpoint.dir names it.

    Only a local session without that setting gets a folder of its own, the same one as long as it runs.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    application = spark.sparkContext.applicationId
    if application not in _made:
        _made[application] = tempfile.mkdtemp(prefix="gaugemill-")
    return _made[application]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder."""
    return f"{shared_dir(spark)}/gaugemill/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and return a scan of it.

    Cuts the lineage of iterative jobs with a table that outlives lost executors. ``discard`` removes it.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._staged_at = path
    return table


def discard(*tables: DataFrame) -> None:
    """Remove staged tables that nothing will read any more; what was made from them must have been written itself.

    Tables that ``stage`` did not return are left alone.
    """
    for table in tables:
        path = table.__dict__.pop("_staged_at", None)
        if path:
            jvm, conf = table.sparkSession._jvm, table.sparkSession._jsparkSession.sessionState().newHadoopConf()
            place = jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(conf).delete(place, True)


def reclaim(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of plans that nobody holds any more, for loops of many large plans.

    Its cleaner acts when the driver's garbage is collected, which an idle driver does twice an hour.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()

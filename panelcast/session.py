"""Session settings and the shared folder for intermediate tables."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession

_WRITTEN: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()  # tables of cut_lineage: their folders
#: What a task hands to Python at once, so that memory does not follow the length of texts.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}


def local_session(cpus: int | str = 8, memory: str = "12g") -> SparkSession:
    """A local session for tests and the benchmark; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("panelcast")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="panelcast-", dir=os.environ.get("TMPDIR", "/tmp")))
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir. Only a local session that names none gets
    a temporary one."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder is None:
        if context.master != "local" and not context.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
        folder = tempfile.mkdtemp(prefix="panelcast-")
        context.setCheckpointDir(folder)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write an intermediate result as a table in the shared folder and go on from there. What reads it
    reads only the columns it needs, and lost executors cost a re-read, not a recomputation of
    everything before."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/panelcast-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    _WRITTEN[table] = path
    return table


def discard(table: DataFrame) -> None:
    """Delete a table that `cut_lineage` has returned. Only for its owner, once all that reads it has been written."""
    context = table.sparkSession.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop(table))
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession) -> None:
    """Set the session's Arrow batches to `BATCHES`, for jobs that hand whole texts to Python."""
    for name, value in BATCHES.items():
        spark.conf.set(name, value)


def release_shuffles(spark: SparkSession) -> None:
    """Have Spark remove the shuffle files that no DataFrame in use needs any more. Its cleaner does so when the driver collects its
    garbage, and a driver with little to do may not for a whole job. The last query stays referenced until another one has run."""
    spark.range(1).count()
    gc.collect()
    spark._jvm.System.gc()

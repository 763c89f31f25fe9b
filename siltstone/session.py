"""Session helpers: durable intermediate tables and a local session."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints, as the session names it.

    Only a local session without the setting gets a folder of its own; on a
    cluster a machine-local folder would be lost with its machine.
    """
    context = spark.sparkContext
    folder = context.getCheckpointDir()
    if folder is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="siltstone-checkpoint-")
        context.setCheckpointDir(folder)
    return folder


def run_folder(spark: SparkSession, name: str = "table") -> str:
    """The path of a new folder, not yet made, below the shared folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def durable(df: DataFrame) -> DataFrame:
    """Compute ``df`` once into the shared folder and cut its lineage.

    The rows are written as Parquet: later readers take only their columns and
    Spark knows the size of the table.  ``discard`` removes the files.
    """
    spark = df.sparkSession
    path = run_folder(spark)
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._stored_at = path
    return table


def discard(*tables: DataFrame) -> None:
    """Remove the files of tables from ``durable`` that nothing will read again."""
    for table in tables:
        path = table.__dict__.get("_stored_at")
        if path:
            jvm = table.sparkSession._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def spread(df: DataFrame) -> DataFrame:
    """Use every core for costly work per row when the input has few splits.

    A narrow, small input can arrive as one split.  It is redistributed only
    then; an input with as many splits as cores stays where it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def local_session(cores: str = "*", memory: str = "16g", name: str = "siltstone") -> SparkSession:
    """A single-machine session for tests and benchmarks."""
    n = os.cpu_count() if cores == "*" else int(cores)
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(n))
        # Recording the call site of every column costs more than planning.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark

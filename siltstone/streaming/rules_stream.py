"""Row-wise checks on source files and functions as they arrive.

Duplicates, graph and top-k look at the whole table and stay batch jobs.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.config import ScanConfig
from siltstone.operators.duplicates import fingerprints
from siltstone.operators.extract import extract_functions
from siltstone.operators.issues import rule_issues
from siltstone.schemas import FILES
from siltstone.session import checkpoint_dir, discard, durable
from siltstone.sources.tree import ANY_SOURCE, decoded, relative_path, wanted

_BINARY = "path string, modificationTime timestamp, length bigint, content binary"


def stream_tree(spark: SparkSession, root: str, config: ScanConfig | None = None) -> DataFrame:
    """Streaming FILES: every new file below ``root`` that a scan would take."""
    arriving = (
        spark.readStream.format("binaryFile")
        .schema(_BINARY)
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", ANY_SOURCE)
        .load(root)
    )
    named = arriving.select(relative_path(F.col("path"), root).alias("path"), "content")
    return decoded(named.where(wanted(F.col("path"), config or ScanConfig())))


def stream_issues(functions: DataFrame) -> DataFrame:
    return rule_issues(functions)


def stream_fingerprints(functions: DataFrame) -> DataFrame:
    return fingerprints(functions)


def run_available(stream: DataFrame, output: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """Process what has arrived into Parquet files and return them as a frame.

    A later call with the same folders goes on where this one stopped.
    """
    spark = stream.sparkSession
    base = f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    output, checkpoint = output or f"{base}/rows", checkpoint or f"{base}/state"
    query = (
        stream.writeStream.format("parquet")
        .option("path", output)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(output)


def run_available_files(
    files: DataFrame, check: Callable[[DataFrame], DataFrame], output: str | None = None, checkpoint: str | None = None
) -> DataFrame:
    """Cut functions from the files that have arrived and keep what ``check`` makes of them.

    Extraction looks at whole files, not at one line, so it runs on each batch
    of files.  A batch writes a folder of its own, which it overwrites when it is
    done again after a failure.  A later call goes on where this one stopped.
    """
    spark = files.sparkSession
    base = f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    output, checkpoint = output or f"{base}/rows", checkpoint or f"{base}/state"

    def work(batch: DataFrame, number: int) -> None:
        arrived = durable(batch)
        check(extract_functions(arrived)).write.mode("overwrite").parquet(f"{output}/batch={number}")
        discard(arrived)

    query = files.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    folder = spark._jvm.org.apache.hadoop.fs.Path(output)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return check(extract_functions(spark.createDataFrame([], FILES)))
    return spark.read.parquet(output).drop("batch")

"""Session settings that the library expects, and tables written to the folder that all executors share."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a side that a broadcast may hold; beyond it the same join shuffles and Spark splits skewed partitions.
BROADCAST_ROWS = 400_000


def session(master: str = "local[*]", **conf: str) -> SparkSession:
    builder = SparkSession.builder.master(master).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; a folder of our own only where a local session names none."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="quillstone-checkpoints-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def own_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/quillstone/{spark.sparkContext.applicationId}"


def settled(df: DataFrame, tag: str = "settled") -> DataFrame:
    """Computes a table once: written to the shared folder and read back, so that several branches of a plan may read it.

    Nothing stays in the executors' memory, and a lost executor costs a new read."""
    path = f"{own_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sweep(spark: SparkSession) -> None:
    """Removes this application's intermediate tables, once results that read them have been written."""
    path = spark._jvm.org.apache.hadoop.fs.Path(own_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint behind a count of the rows, for tables that are cheap to count."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def spread(df: DataFrame, rows: int = 20_000) -> DataFrame:
    """Deals rows to all cores, at most some `rows` to a task, where they come in fewer partitions, ahead of work that costs more than the move."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    found = df.rdd.getNumPartitions()
    tasks = max(found if found >= cores else 2 * cores, -(-df.count() // rows))
    return df.repartition(tasks) if found < tasks else df


def lean(spark: SparkSession) -> None:
    """Batches that go to Python hold at most 8 MB, so that a worker's memory does not grow with the texts of 10,000 rows."""
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")


def utc_now() -> Column:
    """The current time as ISO text with its offset."""
    return F.concat(F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+00:00"))

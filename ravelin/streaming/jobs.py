"""Structured Streaming jobs. Each runs over a finished file source with the availableNow trigger into a Parquet sink in
the shared folder, with a checkpoint beside it, and returns what the sink holds: exactly once, and restartable."""

from __future__ import annotations

import os
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stream_folder(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, which driver and executors share; in a local session without one, a temporary folder."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = "file://" + tempfile.mkdtemp(prefix="ravelin-stream-")
    return f"{shared.rstrip('/')}/stream-{uuid.uuid4().hex}"


def file_stream(spark: SparkSession, path: str) -> DataFrame:
    """The Parquet files under a path as a stream."""
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 8).parquet(path if os.path.splitext(path)[1] != ".parquet" else path + "*")


def ordered_stream(spark: SparkSession, path: str, order: str) -> DataFrame:
    """The rows under a path as a stream in order of a column: a copy in the shared folder, a range of the column in each file.

    The file source takes files by modification time, so the copies' times are set in order of their ranges; the folder's
    file system has to keep them.
    """
    folder = f"{stream_folder(spark)}/in-order"
    spark.read.parquet(path).repartitionByRange(order).sortWithinPartitions(order).write.parquet(folder)
    files = [r[0] for r in spark.read.parquet(folder).groupBy("_metadata.file_path").agg(F.min(order).alias("least")).orderBy(F.col("least").asc_nulls_first()).collect()]
    now, jvm = int(time.time() * 1000), spark._jvm
    for k, name in enumerate(files):
        file, at = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(name)), now - 10 * (len(files) - k)
        fs = file.getFileSystem(spark._jsc.hadoopConfiguration())
        fs.setTimes(file, at, -1)
        if fs.getFileStatus(file).getModificationTime() != at:
            raise RuntimeError(f"the file system of {folder} doesn't keep modification times, so the order of events is lost")
    return file_stream(spark, folder)


def drained(stream: DataFrame, name: str) -> DataFrame:
    """The rows of an append stream, written once and read again."""
    spark = stream.sparkSession
    folder = stream_folder(spark)
    stream.writeStream.format("parquet").option("path", f"{folder}/{name}").option("checkpointLocation", f"{folder}/{name}-state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/{name}")


def periodic_dump(events: DataFrame, ts: str, value: str, period: str, lateness: str) -> DataFrame:
    """(dump, n, total) per period; a period is given out once the watermark has passed its end."""
    timed = events.withColumn("__ts", F.col(ts).cast("timestamp")).withWatermark("__ts", lateness)
    return timed.groupBy(F.window("__ts", period).alias("w")).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.unix_micros("w.start").alias("dump"), "n", "total")

"""A catalog of sorted files on blocks, kept as a DataFrame: mapping(file, lbn)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHANNELS = 4


def insert(mapping: DataFrame, new: DataFrame) -> DataFrame:
    """mapping with the new files; a file that is there already keeps its block, one named twice gets its least."""
    fresh = new.groupBy("file").agg(F.min("lbn").alias("lbn")).join(mapping, "file", "left_anti")
    return mapping.unionByName(fresh)


def remove(mapping: DataFrame, files: DataFrame) -> DataFrame:
    """mapping without those files; unknown ones change nothing."""
    return mapping.join(files.select("file").distinct(), "file", "left_anti")


def lookup(mapping: DataFrame, files: DataFrame) -> DataFrame:
    """(file, lbn) of the files that are there."""
    return files.select("file").distinct().join(mapping, "file")


def round_robin(files: DataFrame, channels: int = CHANNELS, first: int = 0) -> DataFrame:
    """files(file, seq from 0) -> (file, channel): each file on the channel after the one before."""
    return files.select("file", ((F.col("seq") + first) % channels).cast("int").alias("channel"))


def save(mapping: DataFrame, path: str) -> None:
    mapping.write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("file string, lbn long").parquet(path)

"""Helpers that the corpus operators share: shared-folder staging, row keys and input tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in a local session without one a temporary folder."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="ravelin-")
        sc.setCheckpointDir(folder)
    return folder.rstrip("/")


_SCRATCH: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """What staged() writes inside is deleted at the end, but for the staged DataFrames that are given to what this yields."""
    kept: set[str] = set()

    def keep(df: DataFrame) -> DataFrame:
        kept.update(_folders(df))
        return df

    _SCRATCH.append([])
    try:
        yield keep
    finally:
        names = {f.rpartition("/")[2] for f in kept}
        _delete(spark, [p for p in _SCRATCH.pop() if p.rpartition("/")[2] not in names])


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder as Parquet and read again: cuts the lineage and survives the loss of executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/ravelin/{name}-{uuid.uuid4().hex}"
    if _SCRATCH:
        _SCRATCH[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _folders(df: DataFrame) -> set[str]:
    return {f.rpartition("/")[0] for f in df.inputFiles()}


def _delete(spark: SparkSession, folders: list[str]) -> None:
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for folder in folders:
        path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(folder))
        path.getFileSystem(conf).delete(path, True)


def unstaged(*dfs: DataFrame) -> None:
    """Deletes what staged() wrote for these, once nothing that is still to run reads it."""
    for df in dfs:
        _delete(df.sparkSession, sorted(_folders(df)))


def plain_names(df: DataFrame) -> tuple[DataFrame, Callable[[str], str], Callable[[DataFrame], DataFrame]]:
    """df with columns c0, c1, .. which clash with no name made by an operator; the new name of a column; and the way back to df's columns."""
    own = df.columns
    plain = [f"c{k}" for k in range(len(own))]
    back = lambda done: done.select(*(F.col(c).alias(n) for c, n in zip(plain, own, strict=True)))
    return df.toDF(*plain), lambda name: plain[own.index(name)], back


def bit_words(rows: DataFrame, slot: Column, *by: str) -> pa.Table:
    """(by.., word_no, word) of the bits at the slots, 64 to a word: packed on the executors, 16 bytes for each word with a bit."""
    words = rows.select(*by, slot.alias("slot")).groupBy(*by, F.expr("slot div 64").alias("word_no")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot % 64 as int))")).alias("word"))
    return words.toArrow()


def bit_table(words: pa.Table, bits: int) -> bytes:
    """A table of 2 ** bits bits."""
    table = np.zeros(1 << (bits - 6), "<i8")
    table[words.column("word_no").to_numpy()] = words.column("word").to_numpy()
    return table.tobytes()


def row_key(id_col: str, text_col: str) -> Column:
    """A key for joins that is never null: equal rows, and only those, share it (up to 64-bit hash collisions)."""
    return F.xxhash64(F.lit(7), F.col(id_col).isNull(), F.col(id_col), F.col(text_col).isNull(), F.col(text_col))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8(text_col: str = "text") -> Column:
    """The text as UTF-8 bytes; a null text counts as empty."""
    return F.coalesce(F.col(text_col), F.lit("")).cast("binary")

"""Packet traces: text files of cmd,addr,size,tick and length-framed binary records."""

from __future__ import annotations

import gzip
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The command codes of a trace.
READ, WRITE = 1, 4
SCHEMA = "cmd string, addr long, size int, tick long"


def read_text_trace(spark: SparkSession, path: str) -> DataFrame:
    """(tick, cmd, addr, size) of a text trace, plain or gzip; a command other than r is a write."""
    rows = spark.read.schema(SCHEMA).csv(path)
    return rows.select("tick", F.when(F.col("cmd") == "r", READ).otherwise(WRITE).alias("cmd"), "addr", "size")


def write_text_trace(df: DataFrame, path: str) -> None:
    decoded(df).select("cmd", "addr", "size", "tick").write.csv(path)


def decoded(df: DataFrame) -> DataFrame:
    """Command codes as letters; u for any other."""
    return df.withColumn("cmd", F.when(F.col("cmd") == READ, "r").when(F.col("cmd") == WRITE, "w").otherwise("u"))


def frames(data: bytes) -> Iterator[bytes]:
    """Records behind their length as a base-128 number; length zero or the end of the file ends them."""
    data = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data
    at = 0
    while at < len(data):
        size = shift = 0
        while True:
            if at >= len(data):
                raise ValueError("a record's length is cut off")
            size |= (data[at] & 127) << shift
            shift, at = shift + 7, at + 1
            if data[at - 1] < 128:
                break
        if not size:
            return
        if at + size > len(data):
            raise ValueError("a record is cut off")
        yield data[at : at + size]
        at += size


def read_framed(spark: SparkSession, path: str) -> DataFrame:
    """(path, record_no, record) of framed files, plain or gzip; a file is one task's, as its frames must be read in order."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for name, content in zip(part["path"], part["content"], strict=True):
                records = list(frames(bytes(content)))
                yield pd.DataFrame({"path": name, "record_no": range(len(records)), "record": records})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, record_no long, record binary")


# The numbers of a packet record's fields.
PACKET = {1: "tick", 2: "cmd", 3: "addr", 4: "size", 5: "flags", 6: "pkt_id", 7: "pc"}


def fields(record: bytes) -> dict[int, int | bytes]:
    """Number -> value of a record's fields: integers, or the bytes of fields with a length. The last of repeated ones stays."""
    out: dict[int, int | bytes] = {}
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            value |= (record[at] & 127) << shift
            shift, at = shift + 7, at + 1
            if record[at - 1] < 128:
                return value

    while at < len(record):
        tag = number()
        kind = tag & 7
        if kind == 0:
            out[tag >> 3] = number()
        else:
            size = {1: 8, 5: 4}.get(kind) or number()
            out[tag >> 3] = record[at : at + size] if kind == 2 else int.from_bytes(record[at : at + size], "little")
            at += size
    return out


def decoded_packets(framed: DataFrame) -> DataFrame:
    """read_framed's records, but the first of each file (its header) -> (path, record_no, tick, cmd, addr, size, flags, pkt_id, pc); null where a field is missing."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            got = [fields(bytes(r)) for r in part["record"]]
            yield pd.DataFrame({"path": part["path"], "record_no": part["record_no"]} | {name: pd.array([f.get(n) for f in got], dtype="Int64") for n, name in PACKET.items()})

    return framed.where("record_no > 0").mapInPandas(run, "path string, record_no long, " + ", ".join(f"{n} long" for n in PACKET.values()))

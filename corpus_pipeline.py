"""Corpus pipeline: STAGES are applied to documents in order, each written as Parquet and read again by the next.

Every stage calls one operator on all that the stage before kept. Stages but the last return the columns of documents.
Nulls, repeated rows and empty tables are handled as the operators' docstrings say; a row whose id and text both repeat
another's counts as a copy of it, and one of the copies stays.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ravelin.llm.common import plain_names, row_key, scratch, staged, table, unstaged
from ravelin.llm.decontaminate import contamination
from ravelin.llm.line_dedup import drop_boilerplate
from ravelin.llm.packing import pack_documents
from ravelin.llm.quality import filter_quality
from ravelin.llm.similar import similar_groups

TOKENIZER = "byte_bpe_50k.json"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the rules keep."""
    return filter_quality(docs, table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the boilerplate lines of their source, however few pages that has."""
    return drop_boilerplate(docs, host_col="source")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts linked by a Jaccard similarity of 0.8 (five-word shingles; SimHash and its index, then MinHash) the document with the least id (of several, the one with the least row key)."""
    return _first_of_key(docs, similar_groups(docs).select(F.col("row_key").alias("__key")), "left_semi")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without a passage of the benchmark."""
    hit = contamination(docs, table(spark, sf_dir, "benchmark")).where("contaminated").select(F.col("row_key").alias("__key")).distinct()
    named, at, back = plain_names(docs)
    return back(named.withColumn("__key", row_key(at("doc_id"), at("text"))).join(staged(hit, "hit"), "__key", "left_anti"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences."""
    return pack_documents(docs, public_tokenizers.path(TOKENIZER))


def _first_of_key(docs: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """Rows of docs whose key is among `keys`; one of several with a key. Only rows that repeat are dealt by their key."""
    named, at, back = plain_names(docs)
    keyed = named.withColumn("__key", row_key(at("doc_id"), at("text")))
    keys = staged(keys, "kept-keys")
    repeated = staged(keyed.select("__key").join(keys, "__key", how).groupBy("__key").agg(F.count("*").alias("n")).where("n > 1").select("__key"), "repeated-keys")
    kept = keyed.join(keys, "__key", how)
    return back(kept.join(repeated, "__key", "left_anti").unionByName(kept.join(repeated, "__key", "left_semi").dropDuplicates(["__key"])))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality),
    ("line_dedup", lines),
    ("near_dedup", near_dedup),
    ("decontamination", decontaminate),
    ("packing", packing),
]
ORACLE_SQL = None  # the fingerprints, the token ids and the packing aren't expressible in SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES[:-1]:
        with scratch(spark) as keep:  # what a stage staged on its way goes with the stage before
            docs = keep(staged(stage(spark, docs, sf_dir), f"pipeline-{name}"))
        if before is not None:
            unstaged(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)

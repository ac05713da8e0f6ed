"""Line dedup by site-relative frequency, in DataFrame functions only.

A host's boilerplate are the lines that stand in more than `ratio` of its pages. Pages are counted once per line, by host
and the line's hash, on the map side first, so a host with a third of all pages is no heavier than others. A host has at
most (lines of a page) / ratio such lines, however many pages it has: only these are brought back to the pages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ravelin.llm.common import plain_names, staged

RATIO, MIN_PAGES, MIN_COPIES = 0.2, 0, 5  # MIN_COPIES alone keeps small hosts safe
BROADCAST_LINES = 200_000  # of 8 bytes each; above, hosts are joined by a shuffle
NEWLINE = "\n"


def _host(docs: DataFrame, host_col: str) -> Column:
    return F.coalesce(F.col(host_col).cast("string"), F.lit(""))


def _has_text(line: Column) -> Column:
    return F.trim(F.translate(line, "\t\r\x0b\f", " ")) != ""


def boilerplate(docs: DataFrame, text_col: str = "text", host_col: str = "source", ratio: float = RATIO, min_pages: int = MIN_PAGES, min_copies: int = MIN_COPIES) -> DataFrame:
    """(host, line hash, pages, total): lines in more than `ratio` of the pages of a host with `min_pages` pages, and in `min_copies` at least."""
    host = _host(docs, host_col)
    totals = docs.groupBy(host.alias("host")).agg(F.count("*").alias("total")).where(F.col("total") >= min_pages)
    lines = docs.select(host.alias("host"), F.explode(F.array_distinct(F.filter(F.split(F.col(text_col), NEWLINE), _has_text))).alias("line"))
    pages = lines.groupBy("host", F.xxhash64("line").alias("line")).agg(F.count("*").alias("pages")).where(F.col("pages") >= min_copies)
    return pages.join(totals, "host").where(F.col("pages") > F.lit(ratio) * F.col("total"))


def drop_boilerplate(docs: DataFrame, text_col: str = "text", host_col: str = "source", ratio: float = RATIO, min_pages: int = MIN_PAGES, min_copies: int = MIN_COPIES, counts: bool = False) -> DataFrame:
    """docs without its hosts' boilerplate lines; with counts also the columns __lines and __dropped.

    Lines are what \\n separates; lines without a visible character are kept. Null and empty texts stay as they are, but
    count as pages; a null host and the host '' are one. Rows repeated in docs are pages of their own. Empty tables stay
    empty. All columns are returned under their own names; n_chars, if there, is the new text's length.
    """
    found = staged(boilerplate(docs, text_col, host_col, ratio, min_pages, min_copies), "boilerplate")
    per_host = found.groupBy(F.col("host").alias("__host")).agg(F.collect_set("line").alias("__drop"))
    if found.count() <= BROADCAST_LINES:
        per_host = F.broadcast(per_host)
    plain, at, back = plain_names(docs)
    out = plain.withColumn("__host", _host(plain, at(host_col))).join(per_host, "__host", "left")
    lines = F.split(F.col(at(text_col)), NEWLINE)
    keep = lambda x: ~(_has_text(x) & F.array_contains("__drop", F.xxhash64(x)))
    kept = F.filter(lines, keep)
    out = out.withColumn("__text", F.when(F.col("__drop").isNull(), F.col(at(text_col))).otherwise(F.array_join(kept, NEWLINE)))
    size = F.coalesce(F.size(lines), F.lit(0))
    out = out.withColumn("__lines", F.when(F.col(at(text_col)).isNull(), 0).otherwise(size).cast("long"))
    out = out.withColumn("__dropped", F.when(F.col("__drop").isNull() | F.col(at(text_col)).isNull(), 0).otherwise(size - F.size(kept)).cast("long"))
    changed = {at(text_col): F.col("__text")}
    if "n_chars" in docs.columns:
        changed[at("n_chars")] = F.length("__text").cast(docs.schema["n_chars"].dataType)
    out = out.select(*(changed.get(c, F.col(c)).alias(c) for c in plain.columns), "__lines", "__dropped")
    if not counts:
        return back(out)
    return out.select(*(F.col(c).alias(n) for c, n in zip(plain.columns, docs.columns, strict=True)), "__lines", "__dropped")

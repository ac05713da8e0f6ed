"""Benchmark decontamination by winnowing.

Words are hashed k at a time; the least hash of each window of w such hashes is a fingerprint. A shared span of at least
k + w - 1 = `span` words shares a fingerprint, whatever stands around it. Documents keep the fingerprints that the
benchmark has too (looked up in a bit table of fixed size, so the size of the benchmark is no matter), extended to every
`span`-word window around each; these windows are joined to the benchmark's windows as text, which makes a hit exact.
Items of fewer than `span` words are one window of their own length and are looked up at every word.

Only the bit table and, in one Spark join that picks its side by size, the benchmark's windows are broadcast.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ravelin.llm.common import bit_table, bit_words, row_key, utf8

SPAN, K = 10, 5
TABLE_BITS = 24  # of the bit table: 2 MB, whatever the benchmark holds
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
BROADCAST_WINDOWS = 200_000
SALT = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: bytes) -> list[bytes]:
    return WORD.findall(text.lower())  # of bytes: A-Z only


class Hasher:
    """64-bit hashes of words, from a bounded memory, and of n words at a time."""

    WORDS = 500_000

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}

    def words(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        try:
            return np.array([known[w] for w in words], np.uint64)
        except KeyError:
            if len(known) > self.WORDS:
                known.clear()
            for w in words:
                if w not in known:
                    known[w] = xxhash.xxh3_64_intdigest(w)
            return np.array([known[w] for w in words], np.uint64)

    @staticmethod
    def grams(h: np.ndarray, n: int) -> np.ndarray:
        out = np.zeros(max(0, len(h) - n + 1), np.uint64)
        for k in range(n):
            out = (out ^ h[k : len(h) - n + 1 + k]) * SALT
            out ^= out >> np.uint64(31)
        return out


def winnow(grams: np.ndarray, w: int) -> np.ndarray:
    """Places of the least (rightmost of equals) of each w neighbours; of all, if there are fewer."""
    if not len(grams):
        return np.zeros(0, np.int64)
    w = min(w, len(grams))
    best = np.arange(len(grams) - w + 1)
    least = grams[: len(best)].copy()
    for k in range(1, w):
        other = grams[k : k + len(best)]
        better = other <= least
        least[better] = other[better]
        best[better] = (np.arange(len(best)) + k)[better]
    return np.unique(best)


def _slots(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).astype(np.int64)


def _item_windows(span: int):
    """Distinct windows of each item, as text, and the bit-table slots of its fingerprints (length 0: winnowed)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, windows, sizes = [], [], []
            for own, text in zip(b.column("item").to_pylist(), b.column("text").to_pylist(), strict=True):
                words = words_of(text)
                n = min(span, len(words))
                found = {b" ".join(words[k : k + n]) for k in range(len(words) - n + 1)} if n else set()
                ids += [own] * len(found)
                windows += found
                sizes += [n] * len(found)
            yield pa.RecordBatch.from_arrays([pa.array(ids, b.schema.field("item").type), pa.array(windows, pa.binary()), pa.array(sizes, pa.int32())], names=["item", "window", "size"])

    return run


def _item_slots(span: int, k: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for b in batches:
            sizes, slots = [], []
            for text in b.column("text").to_pylist():
                words = words_of(text)
                h, n = hasher.words(words), len(words)
                if n >= span:
                    grams = hasher.grams(h, k)
                    got, size = grams[winnow(grams, span - k + 1)], span
                else:
                    got, size = hasher.grams(h, n) if n else np.zeros(0, np.uint64), n
                for s in set(_slots(got, bits).tolist()):
                    sizes.append(size)
                    slots.append(s)
            yield pa.RecordBatch.from_arrays([pa.array(sizes, pa.int32()), pa.array(slots, pa.int64())], names=["size", "slot"])

    return run


def _candidates(span: int, k: int, bits: int, tables: dict[int, bytes]):
    """Per document its number of words and the windows around fingerprints that the benchmark may have too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        known = {n: np.frombuffer(t, np.uint8) for n, t in tables.items()}

        def at(n: int, hashes: np.ndarray) -> np.ndarray:
            slots = _slots(hashes, bits)
            return (known[n][slots >> 3] >> (slots & 7)) & 1 == 1

        for b in batches:
            counts, found = [], []
            for text in b.column("text").to_pylist():
                words = words_of(text)
                counts.append(len(words))
                h = hasher.words(words)
                out = []
                for n in known:
                    if len(words) < n:
                        continue
                    if n < span:
                        starts = np.flatnonzero(at(n, hasher.grams(h, n))).tolist()
                    else:
                        grams = hasher.grams(h, k)
                        places = winnow(grams, span - k + 1)
                        places = places[at(n, grams[places])]
                        starts = sorted({s for p in places.tolist() for s in range(max(0, p + k - span), min(p, len(words) - span) + 1)})
                    out += [{"at": s, "size": n, "window": b" ".join(words[s : s + n])} for s in starts]
                found.append(out)
            kind = pa.list_(pa.struct([("at", pa.int32()), ("size", pa.int32()), ("window", pa.binary())]))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("row_key"), pa.array(counts, pa.int64()), pa.array(found, kind)], names=["id", "row_key", "n_words", "found"])

    return run


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", span: int = SPAN, k: int = K, table_bits: int = TABLE_BITS) -> DataFrame:
    """One row per row of docs: id, n_words, n_hit, n_items, items_sha256, contaminated, row_key.

    Rows repeated in docs are looked up together and come back as often as given. A null text or item has no words and is no window; items with a null id
    count as words hit, but not as items. An empty docs gives an empty result; an empty benchmark hits nothing. Other
    columns are ignored.
    """
    items = benchmark.select(F.col(item_col).alias("item"), utf8(item_text_col).alias("text"))
    item_type = items.schema["item"].dataType.simpleString()
    windows = items.mapInArrow(_item_windows(span), f"item {item_type}, window binary, size int").distinct()
    slots = items.mapInArrow(_item_slots(span, k, table_bits), "size int, slot long").distinct()
    words = bit_words(slots, F.col("slot"), "size")  # twice 2 ** (table_bits - 3) bytes at most, for each of at most `span` sizes
    tables = {n: bit_table(words.filter(pc.field("size") == n), table_bits) for n in words.column("size").unique().to_pylist()}
    given = docs.select(F.col(id_col).alias("id"), row_key(id_col, text_col).alias("row_key"), utf8(text_col).alias("text"))
    id_type = given.schema["id"].dataType.simpleString()
    schema = f"id {id_type}, row_key long, n_words long, found array<struct<at:int,size:int,window:binary>>"
    per_doc = given.mapInArrow(_candidates(span, k, table_bits, tables), schema)
    each = per_doc.select("id", "row_key", "n_words", F.explode_outer("found").alias("f")).select("id", "row_key", "n_words", "f.*")
    counts = each.groupBy("id", "row_key", "n_words", "at", "size", "window").agg(F.count("*").alias("copies"))
    # no candidate: a key of its own, so that these rows don't meet in one task
    alone = F.concat(F.lit("\0"), F.col("row_key").cast("string")).cast("binary")
    counts = counts.withColumn("window", F.coalesce("window", alone)).withColumn("size", F.coalesce("size", F.lit(0)))
    holders = windows.groupBy("window", "size").agg(F.collect_set("item").alias("items"))
    if windows.count() <= BROADCAST_WINDOWS:
        holders = F.broadcast(holders)
    hits = counts.join(holders, ["window", "size"], "left")
    stop = F.when(F.col("items").isNotNull(), F.col("at") + F.col("size"))
    order = Window.partitionBy("row_key").orderBy("at", "size").rowsBetween(Window.unboundedPreceding, -1)
    marked = hits.withColumn("stop", stop).withColumn("before", F.max("stop").over(order))
    fresh = F.greatest(F.lit(0), F.col("stop") - F.greatest(F.col("at"), F.coalesce("before", F.lit(0))))
    summed = marked.groupBy("id", "row_key", "n_words").agg(
        F.coalesce(F.sum(F.when(F.col("stop").isNotNull(), fresh)), F.lit(0)).cast("long").alias("n_hit"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
        F.max("copies").alias("copies"),
    )
    named = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    return summed.select(
        F.col("id").alias(id_col), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(named, ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "row_key", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))).alias("copy"),
    ).drop("copy")

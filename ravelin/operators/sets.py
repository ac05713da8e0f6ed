"""Approximate membership, shortest paths, dependency edges, and rankings of candidates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ravelin.functions.bits import div

Staged = Callable[[DataFrame], DataFrame]


def _slot(key: Column, seed: int, bits: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), key), F.lit(bits))


def bloom_words(df: DataFrame, key: str, bits: int = 1 << 20, hashes: int = 3) -> DataFrame:
    """A Bloom filter as (word_no, word) rows of 32 bits; filters of one size are united by bit_or over both."""
    slots = F.array(*(_slot(F.col(key), k, bits) for k in range(hashes)))
    rows = df.select(F.explode(slots).alias("slot"))
    return rows.groupBy(div(F.col("slot"), 32).alias("word_no")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot % 32 as int))")).alias("word"))


def bloom_semi_join(df: DataFrame, key: str, words: DataFrame, bits: int = 1 << 20, hashes: int = 3) -> DataFrame:
    """Rows of df whose key may be in the filter; never loses one that is. The filter has bits / 32 rows at most, which bounds the broadcast."""
    distinct = df.select(key).distinct()
    probes = distinct.select(key, F.explode(F.array(*(_slot(F.col(key), k, bits) for k in range(hashes)))).alias("__slot"))
    w = F.broadcast(words.select(F.col("word_no").alias("__no"), "word"))
    hit = probes.join(w, div(F.col("__slot"), 32) == F.col("__no")).where(F.expr("(word >> cast(__slot % 32 as int)) & 1 = 1"))
    there = hit.groupBy(key).agg(F.count("*").alias("__n")).where(F.col("__n") == hashes)
    return df.join(there.select(key), key, "left_semi")


def dependency_edges(df: DataFrame, seq: str, deps: str, window: int) -> DataFrame:
    """(seq, dep, distance) of dependencies on earlier rows that are there and at most `window` back."""
    edges = df.select(seq, F.explode(F.array_distinct(deps)).alias("dep")).where((F.col("dep") < F.col(seq)) & (F.col(seq) - F.col("dep") <= window))
    return edges.join(df.select(F.col(seq).alias("dep")).distinct(), "dep", "left_semi").select(seq, "dep", (F.col(seq) - F.col("dep")).alias("distance"))


def shortest_paths(edges: DataFrame, sources: DataFrame, rounds: int | None, staged: Staged) -> DataFrame:
    """edges(a, b, w >= 0), sources(source) -> (source, node, cost) of paths of fewer than 2 ** rounds edges from each source; None: of any number.

    Each round joins the paths with the edges of twice as many steps; `staged` writes what a round gives, so that lineage
    stays short.
    """
    hops = staged(edges.groupBy("a", "b").agg(F.min("w").alias("w")))
    reach = staged(sources.select("source", F.col("source").alias("node"), F.lit(0).cast("long").alias("cost")))
    size = lambda: tuple(reach.agg(F.count("*"), F.sum(F.col("cost").cast("decimal(38,0)"))).first())
    before, done = None if rounds is not None else size(), 0
    while rounds is None or done < rounds:
        done += 1
        further = reach.join(hops, F.col("node") == F.col("a")).select("source", F.col("b").alias("node"), (F.col("cost") + F.col("w")).cast("long").alias("cost"))
        reach = staged(reach.unionByName(further).groupBy("source", "node").agg(F.min("cost").alias("cost")))
        if rounds is None:
            after = size()
            if after == before:  # paths only get more or cheaper
                break
            before = after
        left, right = hops.select(F.col("a"), F.col("b").alias("m"), "w"), hops.select(F.col("a").alias("m"), F.col("b"), F.col("w").alias("w2"))
        hops = staged(hops.unionByName(left.join(right, "m").select("a", "b", (F.col("w") + F.col("w2")).cast("long").alias("w"))).groupBy("a", "b").agg(F.min("w").alias("w")))
    return reach


def collection_victims(blocks: DataFrame, valid: str, block: str, n: int) -> DataFrame:
    """The n blocks with fewest valid pages (ties: the least block): those that a greedy collection empties."""
    return blocks.orderBy(valid, block).limit(n)


def wear_evenness(df: DataFrame, by: list[str], erases: str) -> DataFrame:
    """(sum e)^2 / (n sum e^2): 1 if all blocks are worn alike."""
    return df.groupBy(*by).agg(F.round(F.try_divide(F.pow(F.sum(erases), F.lit(2)), F.count(erases) * F.sum(F.col(erases) * F.col(erases))), 9).alias("evenness"))


def compressed_sizes(df: DataFrame, words: Column) -> DataFrame:
    """df with the size in bits of a line of 64-bit words: zero (1 bit), repeated (64), base and deltas of 1, 2 or 4 bytes, else as it is."""
    n = F.size(words)
    spread = F.array_max(words) - F.array_min(words)
    raw = n * 64
    with_delta = lambda b: F.when(spread < (1 << (8 * b - 1)), 64 + n * 8 * b)
    zero = F.when(F.array_max(words).eqNullSafe(F.lit(0).cast("long")) & F.array_min(words).eqNullSafe(F.lit(0).cast("long")), 1)
    same = F.when(spread == 0, 64)
    return df.withColumn("bits", F.least(F.coalesce(zero, raw), F.coalesce(same, raw), *(F.coalesce(with_delta(b), raw) for b in (1, 2, 4)), raw).cast("long"))


def encodings(words: Column) -> Column:
    """(pattern, bits) of each way to store a line of 64-bit words that fits and isn't longer: zero, repeated, a base of 8, 4 or 2 bytes with deltas of fewer, raw."""
    raw = F.size(words) * 64
    parts = lambda width: F.flatten(F.transform(words, lambda x: F.array(*(F.shiftrightunsigned(x, k).bitwiseAND((1 << width) - 1) for k in range(0, 64, width)))))
    spread = lambda p: F.try_subtract(F.array_max(p), F.array_min(p))
    ways = {"zero": F.when((F.array_max(words) == 0) & (F.array_min(words) == 0), 1), "repeated": F.when(spread(words) == 0, 64)}
    for base, deltas in ((8, (1, 2, 4)), (4, (1, 2)), (2, (1,))):
        p = words if base == 8 else parts(8 * base)
        ways |= {f"base{base}_delta{d}": F.when(spread(p) < (1 << (8 * d - 1)), 8 * base + F.size(p) * 8 * d) for d in deltas}
    every = F.array(*(F.struct(F.lit(k).alias("pattern"), v.cast("long").alias("bits")) for k, v in (ways | {"raw": raw}).items()))
    return F.filter(every, lambda e: e["bits"] <= raw)


def ranked(df: DataFrame, by: list[str], order: list[Column], name: str = "place") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long"))

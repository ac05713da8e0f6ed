"""Reuse distances of a trace: how many distinct other keys came since a key's last access, within each set of keys.

The order is cut into blocks, so a set's trace is never in one task. With p the last access before a to a's key, and every
access knowing the next one to its key, the distance is the number of accesses after p whose next one is after a:

* in a's own block the earlier accesses that are first in the block to their key, unless their own last one was after p;
* in p's block those after p whose next access isn't before a's block;
* in the blocks between a count by block pair, from a grid of at most `max_blocks` squared numbers for each set.

Blocks are counted by Arrow batches in tasks, everything else is joins and sums.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ravelin.functions.bits import div

BLOCK, MAX_BLOCKS = 65_536, 1024
NEVER = np.iinfo(np.int64).max


def earlier_above(values: np.ndarray, limits: np.ndarray, base: int = 64) -> np.ndarray:
    """For each i how many k < i have values[k] > limits[i]; runs of doubling length are compared with those before them."""
    n = len(values)
    out = np.zeros(n, np.int64)
    for lo in range(0, n, base):
        v, m = values[lo : lo + base], limits[lo : lo + base]
        out[lo : lo + base] = np.tril(v[None, :] > m[:, None], -1).sum(axis=1)
    size = base
    while size < n:
        for lo in range(0, n - size, 2 * size):
            before, at = np.sort(values[lo : lo + size]), slice(lo + size, lo + 2 * size)
            out[at] += size - np.searchsorted(before, limits[at], side="right")
        size *= 2
    return out


def _block_counts(width: int):
    """Rows of a set's block, in order -> (set, at, own, came_from, next, ahead), see reuse_distance."""

    def counted(group: tuple, rows: list[np.ndarray]) -> pa.RecordBatch:
        at, before, after = rows
        start = group[1] * width
        came = np.where(before == -NEVER, -NEVER, before // width)
        inside = came == group[1]
        place = np.searchsorted(at, before)
        later = earlier_above(before, before)
        reuses = np.cumsum(inside) - inside  # earlier accesses whose last one is in the block
        firsts = np.arange(len(at)) - reuses
        own = np.where(inside, np.arange(len(at)) - place - 1 - later, firsts - (later - reuses))
        goes = np.where(after == NEVER, NEVER, after // width)
        ahead = earlier_above(goes[::-1], goes[::-1] - 1)[::-1]
        leaves = (after != NEVER) & (goes > group[1])
        assert start <= at[0]
        nullable = lambda x, ok: pa.array(x, pa.int64(), mask=~ok)
        return pa.RecordBatch.from_arrays(
            [pa.array([group[0]] * len(at), pa.int64()), pa.array(at), pa.array(own), nullable(came, (before != -NEVER) & ~inside), pa.array(before == -NEVER), nullable(after, leaves), pa.array(ahead)],
            names=["set", "at", "own", "came_from", "fresh", "next", "ahead"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        now: tuple | None = None
        for b in batches:
            columns = [b.column(c).to_numpy(zero_copy_only=False) for c in ("set", "block", "at", "before", "after")]
            cuts = np.flatnonzero((np.diff(columns[0]) != 0) | (np.diff(columns[1]) != 0)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, b.num_rows], strict=True):
                if lo == hi:
                    continue
                group = (int(columns[0][lo]), int(columns[1][lo]))
                if now is not None and group != now:
                    yield counted(now, [np.concatenate(c) for c in zip(*held, strict=True)])
                    held = []
                now = group
                held.append(tuple(c[lo:hi] for c in columns[2:]))
        if held:
            yield counted(now, [np.concatenate(c) for c in zip(*held, strict=True)])

    return run


def reuse_distance(df: DataFrame, line: str, order: str, set_col: str, first: bool = False, block: int = BLOCK, max_blocks: int = MAX_BLOCKS) -> DataFrame:
    """(set, order, distance) of each access; at a key's first access null or, with `first`, all keys that were there before.

    order is an integer >= 0 without ties in a set; set an integer. Blocks are as wide as keeps their number within
    max_blocks, `block` at least.
    """
    most = df.agg(F.max(order)).first()[0] or 0
    width = max(block, -(-(most + 1) // max_blocks))
    w = Window.partitionBy(set_col, line).orderBy(order)
    rows = df.select(F.col(set_col).cast("long").alias("set"), F.col(order).cast("long").alias("at"), F.coalesce(F.lag(order).over(w), F.lit(-NEVER)).alias("before"), F.coalesce(F.lead(order).over(w), F.lit(NEVER)).alias("after"))
    rows = rows.withColumn("block", div(F.col("at"), width))
    counted = rows.repartition("set", "block").sortWithinPartitions("set", "block", "at").mapInArrow(_block_counts(width), "set long, at long, own long, came_from long, fresh boolean, next long, ahead long")
    # block pairs (from, to): accesses in `from` whose next one is in `to`, or never comes
    last = -(-(most + 1) // width)
    pairs = rows.groupBy("set", F.col("block").alias("from"), F.when(F.col("after") == NEVER, last).otherwise(div(F.col("after"), width)).alias("to")).agg(F.count("*").alias("n"))
    grid = pairs.select("set", "from").distinct().withColumn("to", F.explode(F.sequence(F.col("from") + 1, F.lit(last).cast("long"))))
    filled = grid.join(pairs, ["set", "from", "to"], "left")
    live = filled.withColumn("live", F.sum(F.coalesce("n", F.lit(0))).over(Window.partitionBy("set", "from").orderBy(F.col("to").desc())))
    # between: live accesses at the start of block `to` that lie in `from` or after it
    between = live.withColumn("between", F.sum("live").over(Window.partitionBy("set", "to").orderBy(F.col("from").desc()))).select("set", F.col("from"), F.col("to"), "between")
    asked = F.col("came_from").isNotNull() | (F.col("fresh") if first else F.lit(False))
    own = counted.select("set", "at", "own", F.when(asked, F.coalesce(F.col("came_from") + 1, F.lit(0))).alias("least"), "fresh", F.lit(None).cast("long").alias("ahead"))
    ahead = counted.where("next is not null").select("set", F.col("next").alias("at"), F.lit(None).cast("long").alias("own"), F.lit(None).cast("long").alias("least"), F.lit(None).cast("boolean").alias("fresh"), "ahead")
    merged = own.unionByName(ahead).groupBy("set", "at").agg(*(F.max(c).alias(c) for c in ("own", "least", "fresh", "ahead")))
    merged = merged.withColumn("to", div(F.col("at"), width))
    # the first block with accesses at or after `least`: blocks without any have no row
    froms = between.groupBy("set", "to").agg(F.array_sort(F.collect_list(F.struct("from", "between"))).alias("rows"))  # max_blocks rows at most
    joined = merged.join(froms, ["set", "to"], "left")
    hit = F.get(F.filter("rows", lambda r: r["from"] >= F.col("least")), F.lit(0))["between"]
    total = F.col("own") + F.coalesce("ahead", F.lit(0)) + F.when(F.col("least").isNull(), 0).otherwise(F.coalesce(hit, F.lit(0)))
    distance = total if first else F.when(~F.col("fresh"), total)
    return joined.select(F.col("set").cast(df.schema[set_col].dataType).alias(set_col), F.col("at").cast(df.schema[order].dataType).alias(order), distance.alias("distance"))

"""Ordered traces: footprints, gaps, outstanding requests, intervals, sessions, call trees.

Sums along the whole trace are made in two phases (totals of blocks of the order key, then inside each block), so that no
task holds the trace.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ravelin.functions.bits import div

BLOCK = 65_536


def running_sum(df: DataFrame, order: str, value: Column, name: str, block: int = BLOCK, inclusive: bool = True) -> DataFrame:
    """df with the sum of `value` up to each row in order of an integer column without ties."""
    marked = df.withColumn("__value", value).withColumn("__block", div(F.col(order).cast("long"), block))
    totals = marked.groupBy("__block").agg(F.sum("__value").alias("__total"))
    before = totals.select("__block", F.coalesce(F.sum("__total").over(Window.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    inside = Window.partitionBy("__block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    return marked.join(before, "__block").withColumn(name, F.col("__before") + F.coalesce(F.sum("__value").over(inside), F.lit(0))).drop("__block", "__before", "__value")


def footprint(df: DataFrame, addr: Column, units: dict[str, int], by: list[str] | None = None) -> DataFrame:
    """Bytes of the distinct units (name -> size) that are touched."""
    return df.groupBy(*(by or [])).agg(*((F.countDistinct(div(addr.cast("long"), n)) * n).alias(k) for k, n in units.items()))


def running_footprint(df: DataFrame, line: str, order: str) -> DataFrame:
    """(order, lines): distinct lines seen up to each access that is the first to its line."""
    first = df.groupBy(line).agg(F.min(order).alias(order))
    return running_sum(first, order, F.lit(1).cast("long"), "lines").select(order, "lines")


def inter_arrival(df: DataFrame, by: list[str], kind: str, ts: str, order: str) -> DataFrame:
    """(kind, n, least, most): gaps in microseconds between neighbours of one key, by the later one's kind."""
    now = F.unix_micros(F.col(ts).cast("timestamp"))
    gaps = df.withColumn("__gap", now - F.lag(now).over(Window.partitionBy(*by).orderBy(ts, order))).where("__gap is not null")
    return gaps.groupBy(kind).agg(F.count("*").alias("n"), F.min("__gap").alias("least"), F.max("__gap").alias("most"))


def outstanding(df: DataFrame, by: list[str], start: Column, end: Column) -> DataFrame:
    """(by.., most): the largest number of requests open at once; a request that ends when another starts is closed first."""
    steps = df.select(*by, F.explode(F.array(F.struct(start.alias("t"), F.lit(1).alias("d")), F.struct(end.alias("t"), F.lit(-1).alias("d")))).alias("s")).select(*by, "s.*")
    steps = steps.groupBy(*by, "t").agg(F.sum(F.when(F.col("d") > 0, 1).otherwise(0)).alias("opened"), F.sum(F.when(F.col("d") < 0, 1).otherwise(0)).alias("closed"))
    upto = Window.partitionBy(*by).orderBy("t")
    return steps.withColumn("open", F.sum(F.col("opened") - F.col("closed")).over(upto)).groupBy(*by).agg(F.max("open").alias("most"))


def busy_time(df: DataFrame, by: list[str], start: str, end: str) -> DataFrame:
    """(by.., busy, slots): length and number of the merged [start, end) intervals of each resource.

    Each interval adds what lies beyond the ends before it, so islands are never grouped: one sort, then a sum for each resource.
    """
    before = Window.partitionBy(*by).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
    told = df.select(*by, start, end).withColumn("__reached", F.max(end).over(before))
    apart = F.when(F.col("__reached") >= F.col(start), False).otherwise(True)
    added = F.when(apart, F.col(end) - F.col(start)).otherwise(F.greatest(end, "__reached") - F.col("__reached"))
    return told.groupBy(*by).agg(F.sum(added).alias("busy"), F.count_if(apart).alias("slots"))


def block_intervals(df: DataFrame, by: list[str], order: str, ends_block: Column, size: int) -> DataFrame:
    """(by.., interval, block_size, blocks): basic blocks end at `ends_block`; an interval ends with the block that fills it, and at most one ends per block."""
    upto = Window.partitionBy(*by).orderBy(order)
    before = upto.rowsBetween(Window.unboundedPreceding, -1)
    rows = df.withColumn("__block", F.coalesce(F.sum(F.when(ends_block, 1).otherwise(0)).over(before), F.lit(0)))
    blocks = rows.groupBy(*by, "__block").agg(F.count("*").alias("block_size"))
    in_order = Window.partitionBy(*by).orderBy("__block")
    told = blocks.withColumn("__n", F.row_number().over(in_order)).withColumn("__sum", F.sum("block_size").over(in_order))
    told = told.withColumn("__least", F.min(div(F.col("__sum"), size) - F.col("__n")).over(in_order)).withColumn("__closed", F.col("__n") + F.least(F.lit(0), F.col("__least")))
    return told.withColumn("interval", F.coalesce(F.lag("__closed").over(in_order), F.lit(0)).cast("long")).groupBy(*by, "interval", "block_size").agg(F.count("*").alias("blocks"))


def sessions(df: DataFrame, by: list[str], ts: str, order: str, gap_seconds: int) -> DataFrame:
    """(by.., session, n, length): a new session begins after a gap; length in microseconds."""
    now = F.unix_micros(F.col(ts).cast("timestamp"))
    w = Window.partitionBy(*by).orderBy(ts, order)
    marked = df.withColumn("__t", now).withColumn("__new", F.when(now - F.lag(now).over(w) <= gap_seconds * 1_000_000, 0).otherwise(1))
    marked = marked.withColumn("session", F.sum("__new").over(w))
    return marked.groupBy(*by, "session").agg(F.count("*").alias("n"), (F.max("__t") - F.min("__t")).alias("length"))


def call_tree(df: DataFrame, by: str, order: str, name: Column) -> DataFrame:
    """(path, calls): how often each path of names is walked, whole paths and their beginnings. A key is one walk of bounded length."""
    paths = df.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order), name.alias("name")))), lambda x: x["name"]).alias("p"))
    begun = F.transform(F.sequence(F.lit(1), F.size("p")), lambda n: F.array_join(F.slice("p", F.lit(1), n), "/"))
    return paths.select(F.explode(begun).alias("path")).groupBy("path").agg(F.count("*").alias("calls"))


def hot_keys(df: DataFrame, key: str, counts: dict[str, Column], k: int) -> DataFrame:
    """The k keys with most rows (ties: the least key), with counts by condition."""
    profile = df.groupBy(key).agg(F.count("*").alias("total"), *(F.count_if(c).alias(n) for n, c in counts.items()))
    return profile.orderBy(F.col("total").desc(), key).limit(k)


def rolling_mean(df: DataFrame, by: list[str], order: list[str], value: str, n: int) -> DataFrame:
    """df's keys with the mean of the last n values."""
    return df.select(*by, *order, F.round(F.avg(value).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(-(n - 1), 0)), 6).alias("mean"))


def activity(df: DataFrame, by: list[str], second: Column, length: int) -> DataFrame:
    """(by.., second, active): active seconds among the last `length`, at each active second."""
    distinct = df.select(*by, second.alias("second")).distinct()
    return distinct.withColumn("active", F.count("*").over(Window.partitionBy(*by).orderBy("second").rangeBetween(-(length - 1), 0)))


def replay(df: DataFrame, by: list[str], order: list[str], delay: Column, at: str = "at") -> DataFrame:
    """Times of an elastic replay: each row comes `delay` after the one before."""
    return df.select(*by, *order, F.sum(delay).over(Window.partitionBy(*by).orderBy(*order)).alias(at))


def stride_runs(df: DataFrame, by: str, at: str) -> DataFrame:
    """(by, at, stride, times): the step from the access before (0 at the first) and how often it has come in a row."""
    w = Window.partitionBy(by).orderBy(at)
    steps = df.select(by, at, F.coalesce(F.col(at) - F.lag(at).over(w), F.lit(0)).alias("stride"))
    fresh = steps.withColumn("__new", F.when(F.col("stride") == F.lag("stride").over(w), 0).otherwise(1))
    runs = fresh.withColumn("__run", F.sum("__new").over(w))
    return runs.withColumn("times", F.row_number().over(Window.partitionBy(by, "__run").orderBy(at)).cast("long")).drop("__new", "__run")

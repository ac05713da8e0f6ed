"""Joins on ranges, neighbours and prefixes, as equi-joins on buckets, and a leveled catalog of key ranges.

A range stands in the buckets of the key space it touches, WIDE at most: buckets come in LEVELS widths, each COARSER times
the one before, and a range takes the finest it fits in. A point meets it in one bucket of each width that ranges really
take, which is counted first: points never go to a width that no range is in. Coarse buckets hold many points, so they are
split into SALT parts by the point's hash, and a range stands in each part; ranges beyond all widths have such parts only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ravelin.functions.bits import div

COARSER, LEVELS, WIDE, SALT = 64, 6, 64, 16
MAX_GROUPS = 4096


def _widths(width: int) -> list[int]:
    return [width * COARSER**k for k in range(LEVELS)]


def _level_of(lo: Column, hi: Column, width: int) -> Column:
    """The finest level at which a range touches WIDE buckets at most; LEVELS for wider ones."""
    out = F.lit(LEVELS)
    for k, w in reversed(list(enumerate(_widths(width)))):
        out = F.when(div(hi, w) - div(lo, w) < WIDE, F.lit(k)).otherwise(out)
    return out


def _bucket(key: Column, level: Column, width: int) -> Column:
    return F.coalesce(*(F.when(level == k, div(key, w)) for k, w in enumerate(_widths(width))), F.lit(0).cast("long"))


def _salt(key: Column, level: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(SALT)).cast("int") if level else F.lit(0)


def bucketed_points(points: DataFrame, key: str, levels: list[int], width: int) -> DataFrame:
    """points with the struct __b(level, bucket, salt), once for each level."""
    k = F.col(key).cast("long")
    at = lambda n: F.struct(F.lit(n).alias("level"), _bucket(k, F.lit(n), width).alias("bucket"), _salt(k, n).alias("salt"))
    return points.withColumn("__b", F.explode(F.array(*map(at, levels))) if len(levels) > 1 else at(levels[0]))


def point_in_range(points: DataFrame, ranges: DataFrame, key: str, lo: str, hi: str, width: int = 1024, on: dict[str, str] | None = None) -> DataFrame:
    """points joined with each range [lo, hi] that holds the key (>= 0); `on` names columns of both that must be equal, too."""
    first, last = F.col(lo).cast("long"), F.col(hi).cast("long")
    r = ranges.where(F.col(lo) <= F.col(hi)).withColumn("__level", _level_of(first, last, width))
    taken = [row[0] for row in r.select("__level").distinct().orderBy("__level").collect()]  # LEVELS + 1 rows at most
    p = bucketed_points(points, key, taken or [0], width)
    r = r.withColumn("__bucket", F.explode(F.sequence(_bucket(first, F.col("__level"), width), _bucket(last, F.col("__level"), width))))
    r = r.withColumn("__salt", F.explode(F.when(F.col("__level") == 0, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.lit(SALT - 1)))))
    same = (F.col("__b.level") == F.col("__level")) & (F.col("__b.bucket") == F.col("__bucket")) & (F.col("__b.salt") == F.col("__salt"))
    for a, b in (on or {}).items():
        same = same & (F.col(a) == F.col(b))
    return p.join(r, same & F.col(key).between(F.col(lo), F.col(hi))).drop("__b", "__level", "__bucket", "__salt")


def overlaps(left: DataFrame, right: DataFrame, lo: tuple[str, str], hi: tuple[str, str], width: int = 1024, on: tuple[str, str] | None = None) -> DataFrame:
    """Pairs of ranges with a common key: the later start lies in the other range, so two point searches find each pair once. `on`: columns that must be equal."""
    a = left.where(F.col(lo[0]) <= F.col(hi[0]))
    b = right.where(F.col(lo[1]) <= F.col(hi[1]))
    inside = point_in_range(b, a, lo[1], lo[0], hi[0], width, {on[1]: on[0]} if on else None)
    outside = point_in_range(a, b, lo[0], lo[1], hi[1], width, {on[0]: on[1]} if on else None).where(F.col(lo[0]) > F.col(lo[1]))
    return inside.unionByName(outside)


def as_of(left: DataFrame, right: DataFrame, by: str | None, left_at: str, right_at: str, value: str, tie: str) -> DataFrame:
    """left with the `value` of the latest row of right at or before its time (of several the one of greatest `tie`); null before the first."""
    keys = [by] if by else []
    a = left.select(*left.columns, F.col(left_at).alias("__at"), F.lit(1).alias("__side"), F.lit(None).cast(right.schema[tie].dataType).alias("__tie"), F.lit(None).cast(right.schema[value].dataType).alias("__value"))
    b = right.select(*(F.col(c) if c in keys else F.lit(None).cast(left.schema[c].dataType).alias(c) for c in left.columns), F.col(right_at).alias("__at"), F.lit(0).alias("__side"), F.col(tie).alias("__tie"), F.col(value).alias("__value"))
    order = Window.partitionBy(*keys).orderBy("__at", "__side", "__tie").rowsBetween(Window.unboundedPreceding, 0)
    return a.unionByName(b).withColumn(value, F.last("__value", ignorenulls=True).over(order)).where("__side = 1").select(*left.columns, value)


def shortest_prefix(keys: DataFrame, prefixes: DataFrame, key: str, prefix: str, value: str, widths: list[int]) -> DataFrame:
    """keys with the value of the shortest stored prefix that begins the key; null for none. One equi-join for all widths."""
    begun = keys.withColumn("__p", F.explode(F.array_distinct(F.array(*(F.substring(key, 1, w) for w in widths)))))
    found = begun.join(prefixes.select(F.col(prefix).alias("__p"), F.col(value).alias("__v")), "__p", "left")
    return found.groupBy(*keys.columns).agg(F.min_by("__v", F.when(F.col("__v").isNotNull(), F.length("__p"))).alias(value))


def remap(df: DataFrame, addr: str, ranges: DataFrame, width: int = 1024) -> DataFrame:
    """df with `mapped`: ranges(rank, lo, hi, to) move an address to `to`; the range of least rank wins; others stay."""
    hit = point_in_range(df.select(addr).distinct(), ranges, addr, "lo", "hi", width).groupBy(addr).agg(F.min_by(F.col(addr) - F.col("lo") + F.col("to"), "rank").alias("__to"))
    return df.join(hit, addr, "left").withColumn("mapped", F.coalesce("__to", addr)).drop("__to")


def level_links(catalog: DataFrame, width: int = 1024) -> DataFrame:
    """(parent, child): catalog(file, level, lo, hi) ranges that overlap and lie on neighbouring levels."""
    a = catalog.select(F.col("file").alias("parent"), F.col("level").alias("pl"), F.col("lo").alias("plo"), F.col("hi").alias("phi"))
    b = catalog.select(F.col("file").alias("child"), F.col("level").alias("cl"), F.col("lo").alias("clo"), F.col("hi").alias("chi"))
    a = a.withColumn("below", F.col("pl") + 1)
    return overlaps(a, b, ("plo", "clo"), ("phi", "chi"), width, ("below", "cl")).select("parent", "child")


def counts_upto(points: DataFrame, at: str, among: DataFrame, key: str, kinds: dict[str, Column], own: list[str], block: int = 4096) -> DataFrame:
    """points(.., at, own..) with a column for each of `kinds` (name -> condition on among): how many such keys, of rows that agree in `own`, are <= at.

    Running sums instead of pairs, a row for each distinct key or point: inside blocks of the key, after the totals of the blocks before.
    """
    keys = among.select(*own, F.col(key).cast("long").alias("__key"), *(F.coalesce(c.cast("int"), F.lit(0)).alias(k) for k, c in kinds.items()))
    keys = keys.groupBy(*own, "__key").agg(*(F.sum(k).alias(k) for k in kinds)).withColumn("__ask", F.lit(0))
    asked = points.select(*own, F.col(at).cast("long").alias("__key")).distinct().select("*", *(F.lit(0).cast("long").alias(k) for k in kinds), F.lit(1).alias("__ask"))
    both = keys.unionByName(asked).withColumn("__block", div(F.col("__key"), block))
    before = Window.partitionBy(*own).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = both.groupBy(*own, "__block").agg(*(F.sum(k).alias(k) for k in kinds))
    blocks = blocks.select(*own, "__block", *(F.coalesce(F.sum(k).over(before), F.lit(0)).alias(f"__before_{k}") for k in kinds))
    inside = Window.partitionBy(*own, "__block").orderBy("__key", "__ask").rowsBetween(Window.unboundedPreceding, 0)
    told = both.select(*own, "__key", "__ask", "__block", *(F.sum(k).over(inside).alias(k) for k in kinds)).where("__ask = 1").join(blocks, [*own, "__block"])
    told = told.select(*own, F.col("__key").alias("__at"), *((F.col(k) + F.col(f"__before_{k}")).alias(k) for k in kinds))
    return points.withColumn("__at", F.col(at).cast("long")).join(told, ["__at", *own]).drop("__at")


def related_channels(catalog: DataFrame) -> DataFrame:
    """(file, channel, n): per channel the ranges of other levels that overlap a file's, and its neighbours on its own level.

    Ranges that overlap [lo, hi] are those that start at hi or before, less those that end before lo: two counts, no pairs,
    less the same two on the file's own level. The counts of WIDE channels at a time stand in columns, so a file has four
    rows for them, however many channels and levels there are.
    """
    files = catalog.where((F.col("lo") <= F.col("hi")) & F.col("level").isNotNull())
    channels = [r[0] for r in files.select("channel").where("channel is not null").distinct().limit(MAX_GROUPS + 1).collect()]
    if len(channels) > MAX_GROUPS:
        raise ValueError(f"more than {MAX_GROUPS} channels")
    channels.sort()
    across = []
    for first in range(0, len(channels), WIDE):
        named = {f"__n{k}": c for k, c in enumerate(channels[first : first + WIDE])}
        kinds, parts = {k: F.col("channel") == F.lit(c) for k, c in named.items()}, []
        for at, key, sign in ((F.col("hi"), "lo", 1), (F.col("lo") - 1, "hi", -1)):
            points = files.select("file", "level", at.alias("at"))
            for own, of in (([], sign), (["level"], -sign)):
                parts.append(counts_upto(points, "at", files, key, kinds, own).select("file", *((F.col(k) * of).alias(k) for k in kinds)))
        summed = reduce(DataFrame.unionByName, parts).groupBy("file").agg(*(F.sum(k).alias(k) for k in kinds))
        kind = catalog.schema["channel"].dataType
        across.append(summed.select("file", F.explode(F.array(*(F.struct(F.lit(c).cast(kind).alias("channel"), F.col(k).alias("n")) for k, c in named.items()))).alias("x")).select("file", "x.*"))
    w = Window.partitionBy("level").orderBy("lo", "hi", "file")
    both = catalog.select("file", F.array(F.lag("channel").over(w), F.lead("channel").over(w)).alias("both"))
    beside = both.select("file", F.explode("both").alias("channel")).where("channel is not null").groupBy("file", "channel").agg(F.count("*").alias("n"))
    return reduce(DataFrame.unionByName, across, beside).groupBy("file", "channel").agg(F.sum("n").alias("n")).where("n > 0")


def place(catalog: DataFrame, channels: int) -> DataFrame:
    """(file, channel): the channel with fewest related ranges, of several the first."""
    grid = catalog.select("file", F.explode(F.sequence(F.lit(0), F.lit(channels - 1))).alias("channel"))
    counted = grid.join(related_channels(catalog).withColumn("channel", F.col("channel").cast("int")), ["file", "channel"], "left")
    return counted.groupBy("file").agg(F.min_by("channel", F.struct(F.coalesce("n", F.lit(0)), "channel")).alias("channel"))


def latest_version(df: DataFrame, key: list[str], newest: list[Column], deleted: Column | None = None) -> DataFrame:
    """The newest row of each key; none if that is a deletion."""
    w = Window.partitionBy(*key).orderBy(*newest)
    kept = df.withColumn("__place", F.row_number().over(w)).where("__place = 1").drop("__place")
    return kept if deleted is None else kept.where(~deleted)


def overlay(parent: DataFrame, child: DataFrame, key: str, value: str, deleted: str) -> DataFrame:
    """parent's entries with child's over them; keys deleted in child go."""
    c = child.select(key, F.col(value).alias("__v"), F.col(deleted).alias("__d"), F.lit(True).alias("__there"))
    both = parent.select(key, value).join(c, key, "full_outer").where(~F.coalesce("__d", F.lit(False)))
    return both.select(key, F.when(F.col("__there"), F.col("__v")).otherwise(F.col(value)).alias(value))

"""Typed statistics in long form: counters, vectors, distributions, histograms, formulas, periodic dumps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ravelin.functions.bits import bit_length, div


def counters(df: DataFrame, values: dict[str, Column]) -> DataFrame:
    """(stat, value): each aggregate of one pass as a row."""
    one = df.agg(*(v.cast("double").alias(k) for k, v in values.items()))
    return one.unpivot([], list(values), "stat", "value")


def vector(df: DataFrame, index: str, value: Column) -> DataFrame:
    """(index, value) and the row `total`."""
    sums = df.groupBy(F.col(index).cast("string").alias("index")).agg(value.alias("value"))
    return sums.rollup("index").agg(F.sum("value").alias("value"), F.grouping("index").alias("g")).select(F.when(F.col("g") == 1, "total").otherwise(F.col("index")).alias("index"), "value")


def pdf_cdf(vector_rows: DataFrame, index: str = "index", value: str = "value") -> DataFrame:
    """Share and running share of each element in order of index; elements of value 0 count, but aren't shown. The vector is one row per index."""
    every, upto = Window.partitionBy(), Window.orderBy(index)
    shares = vector_rows.withColumn("pdf", F.try_divide(F.col(value).cast("double"), F.sum(value).over(every)))
    return shares.withColumn("cdf", F.sum("pdf").over(upto)).where(F.col(value) != 0)


def distribution(df: DataFrame, value: Column, low: float, high: float, width: float) -> DataFrame:
    """(bucket, n): fixed buckets with underflow and overflow."""
    bucket = F.when(value < low, "underflow").when(value > high, "overflow").otherwise(F.lpad(F.floor((value - low) / width).cast("string"), 4, "0"))
    return df.where(value.isNotNull()).groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


def autoscale_histogram(df: DataFrame, value: Column, bins: int) -> DataFrame:
    """(bin, bin_size, n) of integers >= 0: the bin size is the least power of two at which all values fall in `bins` bins (an even number)."""
    given = df.select(value.cast("long").alias("v")).where("v >= 0").groupBy("v").agg(F.count("*").alias("n"))
    most = given.agg(F.max("v").alias("most"))  # one row
    size = F.pow(F.lit(2), bit_length(div(F.col("most"), bins))).cast("long")
    return given.join(F.broadcast(most)).withColumn("bin_size", size).groupBy(div(F.col("v"), F.col("bin_size")).alias("bin"), "bin_size").agg(F.sum("n").alias("n"))


def log2_histogram(df: DataFrame, value: Column, bins: int) -> DataFrame:
    """(bin, n): 0 for 0, else 1 + floor(log2), the last bin holds what is beyond."""
    return df.select(F.least(bit_length(value.cast("long")), F.lit(bins - 1)).cast("long").alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))


def sparse_histogram(df: DataFrame, value: Column) -> DataFrame:
    return df.groupBy(value.alias("value")).agg(F.count("*").alias("n"))


def merge_histograms(one: DataFrame, other: DataFrame) -> DataFrame:
    """Two (bin, bin_size, n): counts at the larger of both bin sizes."""
    both = one.unionByName(other)
    size = both.agg(F.max("bin_size").alias("size"))
    return both.join(F.broadcast(size)).groupBy(div(F.col("bin") * F.col("bin_size"), F.col("size")).alias("bin"), F.col("size").alias("bin_size")).agg(F.sum("n").alias("n"))


def moments(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Mean, sample deviation and geometric mean (of positive values)."""
    return df.groupBy(*by).agg(F.round(F.avg(value), 6).alias("mean"), F.round(F.stddev_samp(value), 6).alias("stdev"), F.round(F.exp(F.avg(F.when(F.col(value) > 0, F.ln(value)))), 6).alias("geomean"))


def periodic_dump(df: DataFrame, ts: str, value: Column, period: str) -> DataFrame:
    """(dump, n, total, running_n): per period what was counted since the last reset, and since the start."""
    per = df.groupBy(F.window(F.col(ts).cast("timestamp"), period).alias("w")).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return per.select(F.unix_micros("w.start").alias("dump"), "n", "total", F.sum("n").over(Window.orderBy("w")).alias("running_n"))  # a row for each period


def prefix_totals(df: DataFrame, path: Column, value: Column, separator: str = ".") -> DataFrame:
    """(prefix, value) for each prefix of a dotted path: totals of a hierarchy of groups."""
    parts = F.split(path, F.concat(F.lit("["), F.lit(separator), F.lit("]")))
    leaves = df.groupBy(parts.alias("parts")).agg(value.alias("value"))
    prefixes = F.transform(F.sequence(F.lit(1), F.size("parts")), lambda n: F.array_join(F.slice("parts", F.lit(1), n), separator))
    return leaves.select(F.explode(prefixes).alias("prefix"), "value").groupBy("prefix").agg(F.sum("value").alias("value"))


def match_names(df: DataFrame, name: Column, patterns: list[str]) -> DataFrame:
    """Rows whose dotted name has the same number of parts as a pattern and equals it part by part; * stands for any part."""
    parts, found = F.split(name, r"\."), F.lit(False)
    for p in patterns:
        wanted = p.split(".")
        same = F.size(parts) == len(wanted)
        for k, w in enumerate(wanted):
            if w != "*":
                same = same & F.coalesce(F.get(parts, F.lit(k)) == w, F.lit(False))
        found = found | same
    return df.where(found)


def categories(df: DataFrame, text: Column, rules: list[tuple[str, str]], rest: str = "other") -> DataFrame:
    """(category, n, share): the first rule (name, regular expression) that is found decides."""
    name = F.when(F.lit(False), "")
    for k, pattern in rules:
        name = name.when(text.rlike(pattern), k)
    counted = df.groupBy(name.otherwise(rest).alias("category")).agg(F.count("*").alias("n"))
    return counted.withColumn("share", F.round(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy()), 6))  # a row for each rule


def least_over_repeats(df: DataFrame, position: Column, repeats: int, value: Column) -> DataFrame:
    """(cell, value): the least of each cell, where a run of `repeats` positions measures the cells once."""
    return df.groupBy((position % repeats).alias("cell")).agg(F.min(value).alias("value"))

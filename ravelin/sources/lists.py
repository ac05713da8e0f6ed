"""Lists, names and records in text, as Column expressions and DataFrame steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def nested_list(text: Column) -> Column:
    """`(a,b),c` as [[a, b], [c]]; brackets don't nest further. Null for null."""
    parts = F.regexp_extract_all(text, F.lit("[(][^()]*[)]|[^,()]+"), F.lit(0))
    return F.transform(parts, lambda p: F.split(F.regexp_replace(p, "[()]", ""), ","))


def indexed_list(text: Column) -> Column:
    """`(i,v),(j,w)` as structs (index, value); whatever isn't a pair is left out."""
    pairs = F.filter(nested_list(text), lambda p: F.size(p) == 2)
    return F.transform(pairs, lambda p: F.struct(p[0].alias("index"), p[1].alias("value")))


def category(name: Column, rules: list[tuple[str, int, int]]) -> Column:
    """(known, weight, category) by the first rule (pattern, weight, category) that matches the whole name in any case; else (false, 1, 0)."""
    told = lambda known, weight, kind: F.struct(F.lit(known).alias("known"), F.lit(weight).alias("weight"), F.lit(kind).alias("category"))
    out = told(False, 1, 0)
    for pattern, weight, kind in reversed(rules):
        out = F.when(name.rlike(f"^(?i:{pattern})$"), told(True, weight, kind)).otherwise(out)
    return out


def ignored(name: Column, exact: list[str], patterns: list[str]) -> Column:
    """Whether a name is in the list or matches one of the patterns at its start."""
    out = name.isin(exact)
    for p in patterns:
        out = out | name.rlike(f"^(?:{p})")
    return out


def directory_path(path: Column) -> Column:
    """An absolute path with single slashes and one at its end."""
    return F.regexp_replace(F.concat(F.lit("/"), path, F.lit("/")), "/+", "/")


def redirect(path: Column, rules: list[tuple[str, str]]) -> Column:
    """The normalised path, its beginning replaced by the first rule (from, to) that fits whole parts of it."""
    whole = directory_path(path)
    out = whole
    for old, new in reversed([(f"/{a.strip('/')}/", f"/{b.strip('/')}/") for a, b in rules]):
        out = F.when(whole.startswith(old), F.concat(F.lit(new), F.substring(whole, F.lit(len(old) + 1), F.length(whole)))).otherwise(out)
    return out


def with_default(records: DataFrame, pattern: str, key: str, value: str) -> DataFrame:
    """(section, key, value): the key with a default in each section that matches the pattern and lacks it."""
    sections = records.where(F.col("section").rlike(pattern)).groupBy("section").agg(F.count_if(F.col("key") == key).alias("n"))
    return records.unionByName(sections.where("n = 0").select("section", F.lit(key).alias("key"), F.lit(value).alias("value")))


def moved(records: DataFrame, pattern: str, key_pattern: str, suffix: str) -> DataFrame:
    """(section, key, value): keys that match go from sections that match to the section with a suffix."""
    goes = F.col("section").rlike(pattern) & F.col("key").rlike(key_pattern)
    return records.withColumn("section", F.when(goes, F.concat("section", F.lit(suffix))).otherwise(F.col("section")))


def crc(data: Column, polynomial: int, start: int = 0xFFFFFFFF) -> Column:
    """32-bit CRC of a text's UTF-8 bytes with a reversed polynomial, low bit first, without a last exclusive or."""
    step = lambda c, _: F.shiftrightunsigned(c, 1).bitwiseXOR(c.bitwiseAND(1) * polynomial)
    codes = F.transform(F.regexp_extract_all(F.hex(F.encode(data, "UTF-8")), F.lit(".."), F.lit(0)), lambda x: F.conv(x, 16, 10).cast("long"))
    eight = F.array(*(F.lit(k) for k in range(8)))
    return F.aggregate(codes, F.lit(start).cast("long"), lambda c, b: F.aggregate(eight, c.bitwiseXOR(b), step))

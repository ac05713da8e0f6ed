"""Text sources of traces and settings: symbol lists, command traces, sectioned settings, statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_symbols(spark: SparkSession, path: str) -> DataFrame:
    """(addr, symbol) of lines `addr,symbol` with a hexadecimal address; lines without both are left out."""
    parts = F.split(F.trim("value"), ",", 2)
    rows = spark.read.text(path).select(F.conv(F.regexp_replace(F.trim(F.get(parts, F.lit(0))), "^0[xX]", ""), 16, 10).cast("long").alias("addr"), F.trim(F.get(parts, F.lit(1))).alias("symbol"))
    return rows.where("addr is not null and symbol <> ''")


def read_commands(spark: SparkSession, path: str) -> DataFrame:
    """(time, command, bank) of lines `time,COMMAND,bank`; names are upper-cased, blanks around fields don't count."""
    rows = spark.read.schema("time string, command string, bank string").option("mode", "DROPMALFORMED").csv(path)
    return rows.select(F.trim("time").cast("long").alias("time"), F.upper(F.trim("command")).alias("command"), F.trim("bank").cast("int").alias("bank")).where("time is not null")


def read_settings(spark: SparkSession, path: str) -> DataFrame:
    """(path, section, key, value) of files of [section] lines and key=value or key+=value lines.

    A key given again in a section replaces its value, with += it is added behind a blank; sections that come again are
    one. Lines from # or ; on are remarks. A file is settings, small enough for one row.
    """
    lines = spark.read.option("wholetext", True).text(path).select(F.input_file_name().alias("path"), F.posexplode(F.split("value", r"\r?\n")).alias("at", "line"))
    lines = lines.withColumn("line", F.trim(F.regexp_replace("line", r"[#;].*$", ""))).where("line <> ''")
    header = F.regexp_extract("line", r"^\[\s*(.*?)\s*\]$", 1)
    placed = lines.withColumn("section", F.last(F.when(F.col("line").startswith("["), header), ignorenulls=True).over(Window.partitionBy("path").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)))
    entries = placed.where("not startswith(line, '[') and contains(line, '=')").select("path", "section", "at", F.trim(F.regexp_extract("line", r"^([^=]*?)\+?=", 1)).alias("key"), F.trim(F.regexp_extract("line", r"^[^=]*=(.*)$", 1)).alias("value"), F.regexp_extract("line", r"^[^=]*?(\+?)=", 1).alias("more"))
    held = F.array_sort(F.collect_list(F.struct("at", "more", "value")))
    whole = F.aggregate(held, F.lit(None).cast("string"), lambda a, x: F.when((x["more"] == "+") & a.isNotNull(), F.concat(a, F.lit(" "), x["value"])).otherwise(x["value"]))
    return entries.groupBy("path", "section", "key").agg(whole.alias("value"))


def read_statistics(spark: SparkSession, path: str) -> DataFrame:
    """(path, dump, name, value, remark) of `name value # remark` lines between Begin and End marks; dumps count from 0.

    `nan`, `inf` and percentages after the value are read as Spark casts them; lines of other forms are left out.
    """
    lines = spark.read.option("wholetext", True).text(path).select(F.input_file_name().alias("path"), F.posexplode(F.split("value", r"\r?\n")).alias("at", "line"))
    begun = F.sum(F.when(F.col("line").contains("Begin Simulation Statistics"), 1).otherwise(0)).over(Window.partitionBy("path").orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    pattern = r"^(\S+)\s+([-+0-9.eE]+|nan|inf)(?:\s[^#]*)?(?:#\s*(.*))?$"
    rows = lines.withColumn("dump", (begun - 1).cast("long")).where((F.col("dump") >= 0) & F.col("line").rlike(pattern))
    return rows.select("path", "dump", F.regexp_extract("line", pattern, 1).alias("name"), F.regexp_extract("line", pattern, 2).try_cast("double").alias("value"), F.trim(F.regexp_extract("line", pattern, 3)).alias("remark"))


def section_texts(rows: DataFrame) -> DataFrame:
    """(section, value): for rows (section, key, value) the text of each section, its keys in order; null values are empty.

    `read_settings` gives the same rows back. What it couldn't read (remark signs, line ends, + before =, blanks at an end) is an error.
    """
    value = F.coalesce("value", F.lit(""))
    bad = F.concat("section", F.lit("\n"), "key").rlike(r"[#;\r=\[\]]|\+$|^\s|\s$|\n.*\n|\n\s|\s\n") | F.col("key").isin("") | value.rlike(r"[#;\r\n]|^\s|\s$")
    line = F.when(bad, F.raise_error(F.concat(F.lit("not a settings entry: "), "section", F.lit("/"), "key"))).otherwise(F.concat("key", F.lit("="), value))
    held = rows.select("section", F.struct("key", line.alias("line")).alias("x")).groupBy("section").agg(F.array_sort(F.collect_list("x")).alias("x"))
    return held.select("section", F.concat(F.lit("["), "section", F.lit("]\n"), F.array_join(F.transform("x", lambda x: x["line"]), "\n")).alias("value"))


def write_sections(rows: DataFrame, path: str) -> None:
    """Text files of sections; a section isn't cut."""
    section_texts(rows).select("value").write.text(path)

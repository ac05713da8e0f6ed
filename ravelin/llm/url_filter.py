"""URL filter: allow and block rules, then gradient-boosted trees on lexical features, in DataFrame functions only.

The labelled URLs are those that a rule decides, all of them. One half gives the suffix statistics, the other the trees
(pyspark.ml, which trains in Spark jobs), so that the trees don't see a label through a suffix. Judging is one narrow pass
over the url column: the suffix statistics are broadcast up to BROADCAST_SUFFIXES rows, and beyond that joined by a shuffle.

Labels made by rules say nothing of hosts that no rule is for, and trees can learn a rule's top-level domain by heart. So
the trees are tried on rules they haven't seen: those of one top-level domain are left out in turn. The cutoff for
blocking is the least probability that at most `false_block` of the URLs to allow exceed in these trials.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ravelin.llm.common import staged

#: host/path of each rule, and what it says.
RULES: dict[str, str] = {"com/en/": "block", "example.com/en/7": "allow", "net/de/": "allow", "example.net/de/8": "block", "org/es/": "block"}
BROADCAST_SUFFIXES = 100_000  # a name and two numbers each
ROWS_A_PARTITION = 20_000  # of the trees' input: a level of a tree on few rows is one short task
FALSE_BLOCK, FOLDS = 0.05, 4
TREES, DEPTH, STEP = 10, 4, 0.3
SMOOTH = 5.0
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FEATURES = ("length", "host_length", "path_length", "depth", "host_labels", "digit_ratio", "host_digits", "hyphens", "entropy", "parameters", "fragment", "secure", "suffix_rate", "suffix_share", "domain_rate")


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path, both without what follows ? or #; empty for null and where :// is missing."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return F.translate(host, UPPER, LOWER), F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)


def rule_of(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """The longest rule whose host is `host` or stands above it and whose path begins `path`; else null."""
    found = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r), r)):
        name, _, start = rule.partition("/")
        found = F.when(((host == name) | host.endswith("." + name)) & path.startswith("/" + start), F.lit(rule)).otherwise(found)
    return found


def entropy(text: Column) -> Column:
    """Bits per character, from the runs of the sorted characters."""
    runs = F.aggregate(
        F.array_sort(F.split(text, "")), F.struct(F.lit("").alias("c"), F.lit(0.0).alias("n"), F.lit(0.0).alias("s")),
        lambda a, c: F.when(a["c"] == c, F.struct(c.alias("c"), (a["n"] + 1.0).alias("n"), a["s"].alias("s")))
        .otherwise(F.struct(c.alias("c"), F.lit(1.0).alias("n"), (a["s"] + a["n"] * F.log2(F.greatest(a["n"], F.lit(1.0)))).alias("s"))),
        lambda a: a["s"] + a["n"] * F.log2(F.greatest(a["n"], F.lit(1.0))),
    )
    n = F.length(text)
    return F.when(n > 0, F.log2(F.greatest(n, F.lit(1)).cast("double")) - runs / F.greatest(n, F.lit(1))).otherwise(0.0)


def _count(text: Column, chars: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, chars, ""))).cast("double")


def suffixes(host: Column) -> tuple[Column, Column]:
    """The last label of a host, and its last two."""
    return F.substring_index(host, ".", -1), F.substring_index(host, ".", -2)


def with_features(df: DataFrame) -> DataFrame:
    """df(__url, __host, __path) with the features but for the suffix statistics."""
    url, host, path = F.coalesce("__url", F.lit("")), F.col("__host"), F.col("__path")
    query = F.when(F.locate("?", url) > 0, F.substring_index(F.substring(url, F.locate("?", url) + 1, F.length(url)), "#", 1)).otherwise("")
    values = {
        "length": F.length(url), "host_length": F.length(host), "path_length": F.length(path), "depth": _count(path, "/"), "host_labels": _count(host, "."),
        "digit_ratio": F.coalesce(F.try_divide(_count(url, "0123456789"), F.length(url)), F.lit(0.0)), "host_digits": _count(host, "0123456789"), "hyphens": _count(url, "-_"),
        "entropy": entropy(url), "parameters": F.when(query == "", 0.0).otherwise(_count(query, "&") + 1), "fragment": (F.locate("#", url) > 0).cast("double"), "secure": F.lower(F.substring(url, 1, 6)).eqNullSafe("https:").cast("double"),
    }
    last, two = suffixes(host)
    return df.select("*", *(v.cast("double").alias(k) for k, v in values.items()), last.alias("__suffix"), two.alias("__domain"))


class UrlModel:
    """Suffix statistics and trees; without labels of both kinds, one verdict for all."""

    def __init__(self, labelled: DataFrame, seed: int = 7, trees: int = TREES, depth: int = DEPTH, step: float = STEP):
        """labelled: features and `label` (1.0: block)."""
        half = F.pmod(F.xxhash64(F.lit("half"), "__url"), F.lit(2))
        total, blocked, first, second, low, high = labelled.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0.0)), F.sum((half == 0).cast("int")), F.sum((half == 1).cast("int")), F.min(F.when(half == 1, F.col("label"))), F.max(F.when(half == 1, F.col("label")))).first()
        self.rate, self.first = (blocked + 1) / (total + 2), first or 0
        self.by = {k: staged(self._statistics(labelled.where(half == 0), k), f"rates-of{k}") for k in ("__suffix", "__domain")}
        self.small = {k: table.count() <= BROADCAST_SUFFIXES for k, table in self.by.items()}
        self.model = None
        if second and low != high:
            from pyspark.ml.classification import GBTClassifier

            rows = self.with_suffixes(labelled.where(half == 1)).select(self.vector().alias("features"), "label")
            self.model = GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=step, seed=seed, maxBins=32, minInstancesPerNode=5).fit(rows.coalesce(1 + second // ROWS_A_PARTITION))

    def _statistics(self, rows: DataFrame, key: str) -> DataFrame:
        n, b = F.count("*"), F.sum("label")
        return rows.groupBy(key).agg(((b + SMOOTH * self.rate) / (n + SMOOTH)).alias(f"{key}_rate"), (n / max(1, self.first)).alias(f"{key}_share"))

    def with_suffixes(self, df: DataFrame) -> DataFrame:
        for key, table in self.by.items():
            df = df.join(F.broadcast(table) if self.small[key] else table, key, "left")
        return df.withColumns({"suffix_rate": F.coalesce("__suffix_rate", F.lit(self.rate)), "suffix_share": F.coalesce("__suffix_share", F.lit(0.0)), "domain_rate": F.coalesce("__domain_rate", F.lit(self.rate))})

    @staticmethod
    def vector() -> Column:
        from pyspark.ml.functions import array_to_vector

        return array_to_vector(F.array(*FEATURES))

    def scored(self, df: DataFrame) -> DataFrame:
        """df with `__p`, the probability of `block`."""
        if self.model is None:
            return df.withColumn("__p", F.lit(float(self.rate)))
        from pyspark.ml.functions import vector_to_array

        done = self.model.transform(self.with_suffixes(df).withColumn("features", self.vector()))
        return done.withColumn("__p", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")


def fold_of_rules(rules: dict[str, str]) -> dict[str, int]:
    """The fold of each rule: one for each top-level domain, FOLDS at most."""
    tops = sorted({r.partition("/")[0].rpartition(".")[2] for r in rules})
    return {r: tops.index(r.partition("/")[0].rpartition(".")[2]) % FOLDS for r in rules}


def tried(labelled: DataFrame) -> DataFrame:
    """labelled (with `__fold`) -> (__fold, label, __p): each fold as models see it that were trained without it."""
    folds = [r[0] for r in labelled.select("__fold").distinct().orderBy("__fold").collect()]  # FOLDS rows at most
    parts = [UrlModel(labelled.where(F.col("__fold") != f)).scored(labelled.where(F.col("__fold") == f)).select("__fold", "label", "__p") for f in folds] if len(folds) > 1 else []
    if not parts:
        return labelled.select("__fold", "label", F.lit(0.5).alias("__p")).limit(0)
    return staged(reduce(DataFrame.union, parts), "tried-urls")


def cutoff_of(trials: DataFrame, false_block: float = FALSE_BLOCK) -> float:
    """The probability above which at most `false_block` of the URLs to allow are; 0.5 at least, and where nothing was tried."""
    counted = trials.where("label = 0").groupBy("__p").agg(F.count("*").alias("n"))  # one task holds different probabilities only
    found = counted.agg(F.percentile("__p", F.lit(1 - false_block), F.col("n"))).first()[0]
    return max(0.5, found if found is not None else 0.5)


def labelled_urls(given: DataFrame, rules: dict[str, str]) -> DataFrame:
    """The distinct URLs that a rule decides, all of them, with features, `label` (1.0: block) and `__fold`."""
    folds = fold_of_rules(rules)
    label, fold = F.lit(None).cast("double"), F.lit(None).cast("int")
    for rule, verdict in rules.items():
        label = F.when(F.col("__rule") == rule, float(verdict == "block")).otherwise(label)
        fold = F.when(F.col("__rule") == rule, folds[rule]).otherwise(fold)
    known = given.where(F.col("__rule").isNotNull()).select("__url", "__host", "__path", label.alias("label"), fold.alias("__fold")).distinct()
    return staged(with_features(known.orderBy("__url")), "labelled-urls")


def ruled(pages: DataFrame, id_col: str, url_col: str, rules: dict[str, str]) -> DataFrame:
    host, path = url_parts(F.col(url_col))
    given = pages.select(F.col(id_col).alias("__id"), F.col(url_col).alias("__url"), host.alias("__host"), path.alias("__path"))
    return given.withColumn("__rule", rule_of(F.col("__host"), F.col("__path"), rules))


def judge_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: dict[str, str] | None = None, false_block: float = FALSE_BLOCK) -> DataFrame:
    """One row per row of pages: id, host, path, rule and verdict (allow or block).

    A null url, and one without ://, has an empty host and path, fits no rule and gets the trees' verdict for the text it
    has. Repeated rows and null ids are judged like any other; a URL that occurs often counts once as a label. An empty
    table gives an empty result. Without labelled URLs of both kinds the more frequent label is the verdict (none: allow); with
    rules for one top-level domain only nothing can be tried and the cutoff is one half.
    Other columns are ignored.
    """
    rules = RULES if rules is None else rules
    given = ruled(pages, id_col, url_col, rules)
    says = F.when(F.lit(False), "")
    for rule, verdict in rules.items():
        says = says.when(F.col("__rule") == rule, F.lit(verdict))
    labelled = labelled_urls(given, rules)
    model, cutoff = UrlModel(labelled), cutoff_of(tried(labelled), false_block)
    judged = model.scored(with_features(given)).withColumn("__verdict", F.when(F.col("__p") > cutoff, "block").otherwise("allow"))
    return judged.select(F.col("__id").alias(id_col), F.col("__host").alias("host"), F.col("__path").alias("path"), F.col("__rule").alias("rule"), F.coalesce(says, F.col("__verdict")).alias("verdict"))

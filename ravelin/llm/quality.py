"""Quality rules whose cutoffs carry a guarantee, in DataFrame functions only.

Each signal (higher is worse) has a fixed row of cutoffs, loosest first. For a stratum, the labelled good documents that a
cutoff would reject are k of n. The exact binomial test accepts it if P(Binomial(n, rate) <= k) is at most the level:
then the false rejection rate is below `rate` except with that probability. Cutoffs of a signal are tested in their fixed
order up to the first that fails, which needs no correction; signals and strata share the error `delta` equally
(Bonferroni), and the signals of a stratum share `risk`, so that a stratum rejects at most `risk` of its good documents
with confidence 1 - delta over all strata. Of the accepted cutoffs the loosest of those that reject most labelled bad
documents is taken. A stratum with too few labels for any proof has no cutoff and rejects nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ravelin.llm.common import plain_names, staged

RISK, DELTA = 0.03, 0.05
CUTOFFS: dict[str, list[float]] = {
    "symbols_per_word": [2.0, 1.5, 1.0, 0.8, 0.6, 0.4, 0.3, 0.2, 0.15, 0.1],
    "repeated_share": [0.5, 0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15],
    "duplicate_lines": [0.9, 0.75, 0.6, 0.5, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15],
    "capital_share": [0.9, 0.75, 0.6, 0.5, 0.4, 0.3, 0.2, 0.15, 0.1],
    "word_length": [20.0, 15.0, 12.0, 11.0, 10.0, 9.0, 8.0],
}
SPACE, SYMBOLS, CAPITALS = " \t\n\x0b\f\r", "#*$%&|<>", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
MIN_WORDS, MAX_REPEATED = 50, 0.5
BROADCAST_STRATA = 10_000  # above, strata are joined by a shuffle


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once: a lambda's argument isn't expanded into its places by the optimiser."""
    return F.transform(F.array(value), use)[0]


def _repeat_words(words: Column) -> Column:
    """Words in the 3-word windows that are in the text twice or more."""
    windows = F.when(F.size(words) >= 3, F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))))

    def of(h: Column) -> Column:
        same = lambda s, x, at: F.coalesce(F.get(s, at)["h"] == x["h"], F.lit(False))
        placed = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        starts = _let(placed, lambda s: F.array_sort(F.transform(F.filter(s, lambda x, i: same(s, x, i - 1) | same(s, x, i + 1)), lambda x: x["i"])))
        covered = F.aggregate(starts, F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n")), lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(3), i - a["last"])).alias("n")), lambda a: a["n"])
        return F.when(F.size(F.array_distinct(h)) < F.size(h), covered).otherwise(0)  # only texts with some window twice are sorted

    return F.coalesce(_let(windows, of), F.lit(0))


def with_signals(df: DataFrame, text: Column) -> DataFrame:
    """df with the struct `__q`: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, capitals. To be staged before it is used in conditions, which would each compute it anew."""

    def of(t: Column) -> Column:
        words = F.filter(F.split(t, r"[\x20\x09-\x0D]+"), lambda w: w != "")
        lines = F.filter(F.split(t, "\n"), lambda x: F.length(F.translate(x, SPACE, "")) > 0)
        counts = _let(words, lambda w: F.struct(F.size(w).alias("words"), _repeat_words(w).alias("repeats")))
        by_line = _let(lines, lambda x: F.struct(F.size(x).alias("lines"), (F.size(x) - F.size(F.array_distinct(x))).alias("repeats")))
        without = lambda chars: F.length(F.translate(t, chars, ""))
        whole = F.struct(counts.alias("w"), by_line.alias("l"), F.length(t).alias("n"), without(SPACE).alias("visible"), without(SYMBOLS).alias("plain"), without(CAPITALS).alias("small"))
        values = lambda x: {"n_words": x["w"]["words"], "word_chars": x["visible"], "n_symbols": x["n"] - x["plain"], "n_dup_lines": x["l"]["repeats"], "n_repeat_words": x["w"]["repeats"], "n_lines": x["l"]["lines"], "capitals": x["n"] - x["small"]}
        return _let(whole, lambda x: F.struct(*(v.cast("long").alias(k) for k, v in values(x).items())))

    return df.withColumn("__q", _let(F.coalesce(text, F.lit("")), of))


def base_failed(q: Column) -> Column:
    return (q["n_words"] < MIN_WORDS) | (100 * q["n_repeat_words"] > int(100 * MAX_REPEATED) * q["n_words"])


def signal_values(q: Column) -> dict[str, Column]:
    share = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return {
        "symbols_per_word": share(q["n_symbols"], q["n_words"]),
        "repeated_share": share(q["n_repeat_words"], q["n_words"]),
        "duplicate_lines": share(q["n_dup_lines"], q["n_lines"]),
        "capital_share": share(q["capitals"], q["word_chars"]),
        "word_length": share(q["word_chars"], q["n_words"]),
    }


def binomial_tail(k: Column, n: Column, rate: float) -> Column:
    """P(Binomial(n, rate) <= k), summed from its terms' logarithms; 1 where k is above the mean, which proves nothing."""
    import math

    odds = math.log(rate / (1 - rate))
    term = lambda a, i: F.when(i == 0, n * F.lit(math.log1p(-rate))).otherwise(a["lp"] + F.log(n - i + 1.0) - F.log(i.cast("double")) + odds)
    total = F.aggregate(
        F.sequence(F.lit(0).cast("long"), k.cast("long")), F.struct(F.lit(0.0).alias("lp"), F.lit(0.0).alias("p")),
        lambda a, i: F.struct(term(a, i).alias("lp"), (a["p"] + F.exp(term(a, i))).alias("p")), lambda a: a["p"],
    )
    return F.when(k > n * F.lit(rate), F.lit(1.0)).otherwise(total)


def choose_cutoffs(labelled: DataFrame, risk: float = RISK, delta: float = DELTA, cutoffs: dict[str, list[float]] | None = None) -> DataFrame:
    """labelled(stratum, good boolean, q) -> (stratum, signal, cutoff, n, k, caught, p): the chosen cutoffs only."""
    cutoffs = cutoffs or CUTOFFS
    values = signal_values(F.col("q"))
    # a document that cutoff i of a row (0: loosest) rejects is beyond len(row) - i of its cutoffs at least
    over = F.explode(F.array(*(F.struct(F.lit(s).alias("signal"), sum(((values[s] > c).cast("int") for c in row), F.lit(0)).alias("beyond")) for s, row in cutoffs.items())))
    counts = labelled.select("stratum", "good", over.alias("x")).groupBy("stratum", "good", "x.signal", "x.beyond").agg(F.count("*").alias("rows"))
    counts = staged(counts, "quality-counts")
    grid = F.explode(F.array(*(F.struct(F.lit(s).alias("s"), F.lit(len(row) - i).alias("least"), F.lit(i).alias("step"), F.lit(c).alias("cutoff")) for s, row in cutoffs.items() for i, c in enumerate(row))))
    tests = counts.select("*", grid.alias("g")).where("signal = g.s").groupBy("stratum", "signal", F.col("g.step").alias("step"), F.col("g.cutoff").alias("cutoff"), F.col("g.least").alias("least")).agg(
        F.sum(F.when(F.col("good"), F.col("rows")).otherwise(0)).alias("n"),
        F.sum(F.when(F.col("good") & (F.col("beyond") >= F.col("g.least")), F.col("rows")).otherwise(0)).alias("k"),
        F.sum(F.when(~F.col("good") & (F.col("beyond") >= F.col("g.least")), F.col("rows")).otherwise(0)).alias("caught"),
    )
    level = delta / max(1, counts.select("stratum").distinct().count() * len(cutoffs))
    tested = tests.withColumn("p", binomial_tail(F.col("k"), F.col("n"), risk / len(cutoffs))).withColumn("fails", (F.col("p") > F.lit(level)).cast("int"))
    sequence = Window.partitionBy("stratum", "signal").orderBy("step")
    passed = tested.withColumn("failed", F.max("fails").over(sequence)).where("failed = 0 and caught > 0")
    best = Window.partitionBy("stratum", "signal").orderBy(F.col("caught").desc(), "step")
    return passed.withColumn("place", F.row_number().over(best)).where("place = 1").select("stratum", "signal", "cutoff", "n", "k", "caught", "p")


def judged(df: DataFrame, chosen: DataFrame, stratum: Column) -> DataFrame:
    """df with `__q` -> the same with booleans __failed (base rules) and __kept. chosen has a row for each stratum at most."""
    limits = chosen.groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("signal", "cutoff"))).alias("__limits")).withColumnRenamed("stratum", "__stratum")
    if limits.count() <= BROADCAST_STRATA:
        limits = F.broadcast(limits)
    out = df.withColumn("__stratum", stratum).join(limits, "__stratum", "left").drop("__stratum")
    rejected = F.lit(False)
    for s, v in signal_values(F.col("__q")).items():
        rejected = rejected | F.coalesce(v > F.col("__limits")[s], F.lit(False))
    return out.withColumn("__failed", base_failed(F.col("__q"))).withColumn("__kept", ~(F.col("__failed") | rejected)).drop("__limits")


def labels_of(labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    usable = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
    return usable.groupBy(F.col(id_col).alias("__id")).agg((F.min(F.col(label_col).cast("int")) == 1).alias("good"))


def trials(known: DataFrame) -> DataFrame:
    """known(stratum, good, q, text_key) with one row for each text of a stratum: copies are no further trials. A text is good if all its labels are."""
    return known.groupBy("stratum", "text_key").agg(F.min("good").alias("good"), F.first("q").alias("q")).drop("text_key")


def cutoffs_for(known: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """Cutoffs from known(stratum, good, q, text_key), of which those that fail the base rules don't count. Written to the shared folder: a few rows."""
    known = trials(known)
    return staged(choose_cutoffs(known.where(~base_failed(F.col("q"))), risk, delta), "cutoffs")


def stratum_of(df: DataFrame, stratum_col: str) -> Column:
    return F.coalesce(F.col(stratum_col).cast("string"), F.lit("")) if stratum_col in df.columns else F.lit("")


def judge_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", label_col: str = "quality", risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """One row per row of docs: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept.

    A null text has no words and fails the base rules, as an empty one. A null stratum is a stratum of its own. Null ids
    and labels don't count for cutoffs; an id or a text labelled twice is good only if always, and copies of a text are
    one trial of the binomial test, which needs independent ones. Repeated rows are judged alike. Empty
    tables work: without labels only the base rules reject. Other columns are ignored.
    """
    given = docs.select(F.col(id_col).alias(id_col), stratum_of(docs, stratum_col).alias("__lang"), F.col(text_col).alias("__given"))
    signals = staged(with_signals(given, F.col("__given")).withColumn("__text_key", F.xxhash64("__given")).drop("__given"), "signals")
    known = signals.join(labels_of(labels, id_col, label_col), F.col(id_col) == F.col("__id")).select(F.col("__lang").alias("stratum"), "good", F.col("__q").alias("q"), F.col("__text_key").alias("text_key"))
    chosen = cutoffs_for(known, risk, delta)
    return judged(signals, chosen, F.col("__lang")).select(id_col, *(F.col(f"__q.{c}") for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), F.col("__failed").alias("base_failed"), F.col("__kept").alias("kept"))


def filter_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", label_col: str = "quality", risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """The rows of docs that judge_quality keeps, with all their columns, whatever they are called."""
    own = docs.columns
    docs, at, back = plain_names(docs)
    measured = staged(with_signals(docs, F.col(at(text_col))).withColumn("__text_key", F.xxhash64(at(text_col))), "measured")  # once with its text, so that nothing is measured or shuffled again
    stratum = F.coalesce(F.col(at(stratum_col)).cast("string"), F.lit("")) if stratum_col in own else F.lit("")
    known = measured.select(F.col(at(id_col)).alias("__own"), stratum.alias("stratum"), F.col("__q").alias("q"), F.col("__text_key").alias("text_key")).join(labels_of(labels, id_col, label_col), F.col("__own") == F.col("__id")).select("stratum", "good", "q", "text_key")
    return back(judged(measured, cutoffs_for(known, risk, delta), stratum).where("__kept"))

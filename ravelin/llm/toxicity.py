"""Toxicity by a weighted lexicon that is learned from labels and matched by Aho-Corasick.

Texts are folded first: lower case, homoglyphs of other scripts to Latin letters, digits and signs that stand for letters
to those letters. Lexicon entries are word beginnings (so that inflected forms match) with the shrunken log-odds of the
label. Exception phrases, given or learned, cancel what they cover. A text's score is a logistic function of its summed
weights, the same normalised by the number of words, and its strongest entry.

The lexicon comes from one part of a bounded sample of labelled rows (`max_labelled`, those of least hash), the logistic
function from the other part, so that it sees the lexicon on texts the lexicon was not made from. The sample's ids are
the only thing that is broadcast; texts are never shuffled.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_LABELLED = 20_000
STEM = (4, 10)  # letters of a word's beginning
MIN_SUPPORT, MIN_WEIGHT, SHRINK = 5, 2.0, 4.0
THRESHOLD = 0.3

# Letters of other scripts that look like Latin ones, and characters that stand for letters.
HOMOGLYPHS = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x",
    "ѕ": "s", "і": "i", "ј": "j", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ѵ": "v", "һ": "h", "ӏ": "l", "г": "r", "п": "n",
    "α": "a", "β": "b", "γ": "y", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "σ": "o", "τ": "t", "υ": "u", "χ": "x", "ω": "w",
    "ı": "i", "ȷ": "j", "ɑ": "a", "ɡ": "g", "ɩ": "i", "ʟ": "l", "ⅰ": "i", "ⅼ": "l", "ⅽ": "c", "ⅾ": "d", "ⅿ": "m", "ⅹ": "x", "ⅴ": "v",
    "​": "", "‌": "", "‍": "", "⁠": "", "﻿": "", "­": "",
}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s"}
EXCEPTIONS = ("clownfish", "clown fish", "trash can", "trash bin", "pond scum", "sore loser")

_TABLE = str.maketrans(HOMOGLYPHS | DIGITS | {chr(0xFF21 + k): chr(97 + k) for k in range(26)} | {chr(0xFF41 + k): chr(97 + k) for k in range(26)} | {chr(0xFF10 + k): DIGITS.get(str(k), str(k)) for k in range(10)})
_INSIDE = re.compile(r"(?<=[^\W\d_])[!|](?=[^\W\d_])")
_WORD = re.compile(r"[^\W\d_]+")


def fold(text: str) -> str:
    text = text.lower().translate(_TABLE)
    return _INSIDE.sub("i", text) if "!" in text or "|" in text else text


class Lexicon:
    def __init__(self, weights: dict[str, float], exceptions: tuple[str, ...] = EXCEPTIONS):
        self.automaton = ahocorasick.Automaton()
        for stem, w in weights.items():
            self.automaton.add_word(stem, (len(stem), w))
        for phrase in exceptions:
            self.automaton.add_word(fold(phrase), (len(fold(phrase)), None))
        if len(self.automaton):
            self.automaton.make_automaton()

    def features(self, text: str) -> tuple[float, float, float]:
        """Sum of weights as a logarithm, the same for each hundred words, largest weight."""
        if not len(self.automaton):
            return 0.0, 0.0, 0.0
        folded, at, excused = fold(text), {}, []
        for end, (n, w) in self.automaton.iter(folded):
            start = end - n + 1
            if start and folded[start - 1].isalpha():
                continue
            if w is None:
                if end + 1 == len(folded) or not folded[end + 1].isalpha():
                    excused.append((start, end))
            else:
                at[start] = max(w, at.get(start, 0.0))
        if excused:
            at = {s: w for s, w in at.items() if not any(a <= s <= b for a, b in excused)} if len(excused) < 50 else _outside(at, excused)
        if not at:
            return 0.0, 0.0, 0.0
        total, words = sum(at.values()), 1 + sum(map(folded.count, " \n\t"))
        return math.log1p(total), math.log1p(100 * total / words), max(at.values())


def _outside(at: dict[int, float], excused: list[tuple[int, int]]) -> dict[int, float]:
    covered = {k for a, b in excused for k in range(a, b + 1)}
    return {s: w for s, w in at.items() if s not in covered}


def stems(text: str) -> set[str]:
    out = set()
    for w in set(_WORD.findall(fold(text))):
        if len(w) < STEM[0]:
            continue
        out.update(w[:n] for n in range(STEM[0], min(len(w), STEM[1]) + 1))
        out.add(w + " ")  # the whole word
    return out


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with each word beginning, by label; summed in the task."""
    by = (Counter(), Counter())

    def rows() -> pa.RecordBatch:
        keys = list(by[0].keys() | by[1].keys())
        batch = pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *(pa.array([c[k] for k in keys], pa.int64()) for c in by)], names=["stem", "clean", "toxic"])
        for c in by:
            c.clear()
        return batch

    for b in batches:
        for text, label in zip(b.column("text").to_pylist(), b.column("label").to_pylist(), strict=True):
            by[label].update(stems(text))
            if len(by[0]) + len(by[1]) > 500_000:
                yield rows()
    yield rows()


def choose(counts: list[tuple[str, int, int]], clean: int, toxic: int) -> tuple[dict[str, float], tuple[str, ...]]:
    """Lexicon weights and learned exceptions from (stem, clean, toxic) counts of documents."""
    if not toxic or not clean:
        return {}, ()
    rate = toxic / (clean + toxic)
    weight = lambda c, t: math.log((t + SHRINK * rate) / (c + SHRINK * (1 - rate)) * (1 - rate) / rate)
    kept: dict[str, float] = {}
    words = [(s[:-1], c, t) for s, c, t in counts if s.endswith(" ")]
    for s, c, t in sorted((x for x in counts if not x[0].endswith(" ")), key=lambda x: (len(x[0]), x[0])):
        w = weight(c, t)
        if t < MIN_SUPPORT or w < MIN_WEIGHT:
            continue
        shorter = max((kept[s[:n]] for n in range(STEM[0], len(s)) if s[:n] in kept), default=0.0)
        if w > shorter + 0.5:
            kept[s] = w
    count = {s: (c, t) for s, c, t in counts}
    for s in sorted(kept, key=len, reverse=True):  # what longer entries explain doesn't count for a shorter one
        longer = [x for x in kept if len(x) > len(s) and x.startswith(s) and not any(len(s) < len(y) < len(x) and x.startswith(y) for y in kept)]
        c, t = (count[s][k] - sum(count[x][k] for x in longer) for k in (0, 1))
        if longer and (t < MIN_SUPPORT or weight(max(c, 0), t) < MIN_WEIGHT):
            del kept[s]
    excused = tuple(w for w, c, t in words if t == 0 and c >= 3 and any(w[:n] in kept for n in range(STEM[0], len(w) + 1)))
    return kept, excused


def _sample_features(lexicon: tuple[dict[str, float], tuple[str, ...]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Lexicon(*lexicon)
        for b in batches:
            rows = np.array([matcher.features(t) for t in b.column("text").to_pylist()]).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([*(pa.array(rows[:, k]) for k in range(3)), b.column("label").cast(pa.int32())], names=["total", "density", "strongest", "label"])

    return run


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 40) -> np.ndarray:
    """Newton steps for a logistic function with a free constant and ridge on the slopes; no slope below zero."""
    x = np.column_stack([np.ones(len(x)), x])
    beta, penalty = np.zeros(x.shape[1]), np.diag([1e-3] + [ridge] * (x.shape[1] - 1))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-x @ beta))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ beta)
        beta = np.clip(beta + np.clip(step, -2, 2), [-20] + [0.0] * (x.shape[1] - 1), 20)
        if np.abs(step).max() < 1e-6:
            break
    return beta


def fold_of(id_col: str) -> Column:
    """crc32 of the id as text, modulo 4; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 4


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_labelled: int = MAX_LABELLED) -> tuple[dict[str, float], tuple[str, ...], np.ndarray]:
    """Lexicon weights, exceptions and logistic coefficients from labels (id, label) whose fold isn't 2.

    Ids or labels that are null, labels other than 0 and 1 and ids without a document are left out; an id labelled twice counts as toxic if it is
    once. Without usable labels of both kinds the lexicon is empty and every score is the rate of toxic labels.
    """
    usable = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("label"))
    sample = usable.where(fold_of("id") != 2).orderBy(F.xxhash64("id"), "id").limit(max_labelled)
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(sample), "id")
    part = F.pmod(F.xxhash64(F.lit("part"), "id"), F.lit(10))
    first, second = (texts.where(c).select("text", "label") for c in (part < 7, part >= 7))
    sizes = {r.label: r.n for r in sample.where(part < 7).groupBy("label").agg(F.count("*").alias("n")).collect()}
    table = first.mapInArrow(_counts, "stem string, clean long, toxic long").groupBy("stem").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    rate = sizes.get(1, 0) / max(1, sum(sizes.values()))
    likely = table.where((F.col("toxic") >= MIN_SUPPORT) & (F.col("toxic") > 2 * rate * (F.col("clean") + F.col("toxic"))) | F.col("stem").endswith(" ") & (F.col("toxic") == 0) & (F.col("clean") >= 3))
    stems_only = likely.where("toxic > 0").select("stem", "clean", "toxic").collect()  # bounded by the sample: each has MIN_SUPPORT toxic texts
    weights, _ = choose([tuple(r) for r in stems_only], sizes.get(0, 0), sizes.get(1, 0))
    clean_words = likely.where("toxic = 0").where(F.substring("stem", 1, STEM[0]).isin(sorted({w[: STEM[0]] for w in weights}) or [""])).select("stem", "clean", "toxic").collect()
    weights, learned = choose([tuple(r) for r in [*stems_only, *clean_words]], sizes.get(0, 0), sizes.get(1, 0))
    exceptions = (*EXCEPTIONS, *learned)
    got = np.array([tuple(r) for r in second.mapInArrow(_sample_features((weights, exceptions)), "total double, density double, strongest double, label int").collect()]).reshape(-1, 4)
    if not len(got) or len(set(got[:, 3])) < 2:
        return {}, EXCEPTIONS, np.array([math.log((rate + 1e-3) / (1 - rate + 1e-3)), 0.0, 0.0, 0.0])
    return weights, exceptions, fit_logistic(got[:, :3], got[:, 3])


def _scores(weights: dict[str, float], exceptions: tuple[str, ...], beta: list[float]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Lexicon(weights, exceptions)
        for b in batches:
            x = np.array([matcher.features(t) for t in b.column("text").to_pylist()]).reshape(-1, 3)
            score = 1 / (1 + np.exp(-(beta[0] + x @ np.array(beta[1:]))))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("held_out"), pa.array(score)], names=["id", "held_out", "score"])

    return run


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_labelled: int = MAX_LABELLED) -> DataFrame:
    """One row per row of docs: id, held_out, score (0 to 1) and predicted (score >= THRESHOLD).

    A null text is empty; empty texts get the score of a text without a hit. Repeated rows and null ids are scored like
    any other. An empty table gives an empty result; without labels see train(). Other columns are ignored.
    """
    weights, exceptions, beta = train(docs, labels, id_col, text_col, label_col, max_labelled)
    given = docs.select(F.col(id_col).alias("id"), (fold_of(id_col) == 2).alias("held_out"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    id_type = given.schema["id"].dataType.simpleString()
    scored = given.mapInArrow(_scores(weights, exceptions, beta.tolist()), f"id {id_type}, held_out boolean, score double")
    return scored.select(F.col("id").alias(id_col), "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))

import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from ravelin.llm import quality as Q

SCHEMA = "doc_id long, text string, lang string"


def measured(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    often = Counter(zip(words, words[1:], words[2:]))
    inside = {k + j for k in range(len(words) - 2) if often[tuple(words[k : k + 3])] > 1 for j in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside), len(lines), len(re.findall("[A-Z]", text))


def signals(m):
    n, chars, symbols, dup, rep, lines, caps = m
    share = lambda a, b: a / b if b else 0.0
    return {"symbols_per_word": share(symbols, n), "repeated_share": share(rep, n), "duplicate_lines": share(dup, lines), "capital_share": share(caps, chars), "word_length": share(chars, n)}


def fails(m):
    return m[0] < 50 or 100 * m[4] > 50 * m[0]


def tail(k, n, p):
    return sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)) for i in range(k + 1))


def cutoffs(rows, labels, risk, delta):
    """Straightforward choice: {lang: {signal: cutoff}}."""
    data = [(lang or "", labels[d] == 1, signals(m)) for d, m, lang in rows if d in labels and not fails(m)]
    strata, out = {x[0] for x in data}, defaultdict(dict)
    for lang in strata:
        for s, row in Q.CUTOFFS.items():
            best = None
            for c in row:
                good = [x[2][s] > c for x in data if x[0] == lang and x[1]]
                caught = sum(x[2][s] > c for x in data if x[0] == lang and not x[1])
                if sum(good) > len(good) * risk / len(Q.CUTOFFS) or tail(sum(good), len(good), risk / len(Q.CUTOFFS)) > delta / (len(strata) * len(Q.CUTOFFS)):
                    break
                if caught and (best is None or caught > best[0]):
                    best = (caught, c)
            if best:
                out[lang][s] = best[1]
    return out


def corpus():
    rng = random.Random(12)
    words = ["".join(rng.choices("abcdefg", k=rng.randint(2, 8))) for _ in range(400)]
    rows, labels = [], {}
    for k in range(1500):
        good = rng.random() < 0.8
        w = rng.choices(words, k=rng.randint(20, 120))
        if not good:
            w = rng.choice([[x + "%#*" for x in w], [x.upper() for x in w], w[:12] + w[:12] + w])
        rows.append((k, "\n".join(" ".join(w[i : i + 9]) for i in range(0, len(w), 9)) + rng.choice(["", "\n", "\n\n  \n"]), rng.choice(["en", "de", None])))
        if rng.random() < 0.8:
            labels[k] = int(good if rng.random() < 0.99 else not good)
    rows += [(2001, None, "en"), (2002, "", None), (2003, "a\tb\x0bc\fd\r\ne é🙂\xa0f", "fr"), (2004, "one two three " * 20000, "en"), (2005, "same\nsame\nsame\n\n", "en"), (7, rows[7][1], rows[7][2])]
    return rows, labels


@pytest.mark.parametrize("risk,delta", [(Q.RISK, Q.DELTA), (0.3, 0.2)])
def test_against_brute_force(spark, risk, delta):
    rows, labels = corpus()
    docs = spark.createDataFrame([*rows, (None, rows[3][1], "en")], SCHEMA).withColumn("q", F.lit(1)).withColumn("stratum", F.lit(2)).withColumn("n_words", F.lit("x"))
    marks = spark.createDataFrame([*((d, q) for d, q in labels.items()), (None, 1), (3000, None)], "doc_id long, quality int")
    got = sorted((tuple(r) for r in Q.judge_quality(docs, marks, risk=risk, delta=delta).collect()), key=str)
    limits = cutoffs([(d, measured(t), lang) for d, t, lang in rows], labels, risk, delta)
    if risk == 0.3:
        assert limits
    want = []
    for d, t, lang in [*rows, (None, rows[3][1], "en")]:
        m = measured(t)
        bad = fails(m)
        want.append((d, *m[:5], bad, not bad and not any(signals(m)[s] > c for s, c in limits[lang or ""].items())))
    assert got == sorted(want, key=str)


def test_tail_is_the_binomial_one(spark):
    cases = [(k, n, p) for n in (1, 40, 3000) for k in (0, 1, 7) for p in (0.005, 0.2) if k <= n * p]
    for k, n, p in cases:
        got = spark.range(1).select(Q.binomial_tail(F.lit(k).cast("long"), F.lit(n).cast("long"), p)).first()[0]
        assert math.isclose(got, tail(k, n, p), rel_tol=1e-9)


def test_filter_keeps_columns_and_empty_tables_work(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("n_chars", F.length("text"))
    marks = spark.createDataFrame(list(labels.items()), "doc_id long, quality int")
    kept = Q.filter_quality(docs, marks)
    judged = Q.judge_quality(docs, marks).where("kept")
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in judged.collect())
    assert Q.judge_quality(docs.limit(0), marks).count() == 0
    assert Q.filter_quality(docs, marks.limit(0)).count() == sum(not fails(measured(t)) for _, t, _ in rows)


def test_copies_are_no_trials(spark):
    """Forty good texts prove nothing about the share of good texts that a cutoff rejects, however often they are copied."""
    rng = random.Random(1)
    prose = lambda mark: " ".join("".join(rng.choices("abcdefg", k=5)) + mark for _ in range(60))
    good, bad = [prose("") for _ in range(40)], [prose("#%") for _ in range(20)]
    once = [(k, t, "en") for k, t in enumerate(good + bad)]
    copies = [(100 + k, good[k % 40], "en") for k in range(4000)]
    marks = spark.createDataFrame([(d, int(d < 40 or d >= 100)) for d, *_ in once + copies], "doc_id long, quality int")
    kept = {r.doc_id for r in Q.judge_quality(spark.createDataFrame(once + copies, SCHEMA), marks).where("kept").collect()}
    assert set(range(60)) <= kept
    many = [(5000 + k, prose(""), "en") for k in range(3000)]
    marks = marks.union(spark.createDataFrame([(d, 1) for d, *_ in many], "doc_id long, quality int"))
    kept = {r.doc_id for r in Q.judge_quality(spark.createDataFrame(once + many, SCHEMA), marks).where("kept").collect()}
    assert set(range(40)) <= kept and not kept & set(range(40, 60))


def test_filter_with_clashing_names(spark):
    rows, labels = corpus()
    names = ["__q", "__kept", "__limits", "__stratum", "__text_key", "c0"]
    docs = spark.createDataFrame(rows, SCHEMA).select("*", *(F.lit(k).alias(n) for k, n in enumerate(names)))
    marks = spark.createDataFrame(list(labels.items()), "doc_id long, quality int")
    kept = Q.filter_quality(docs, marks)
    assert kept.columns == docs.columns and kept.first()["__limits"] == 2
    assert kept.count() == Q.filter_quality(docs.drop(*names), marks).count()

import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from ravelin.llm import suffix_dedup as S

SCHEMA = "doc_id long, text string"


def brute(texts, span):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + span] for d in data for i in range(len(d) - span + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - span + 1):
            if seen[d[i : i + span]] > 1:
                gone[i : i + span] = b"\1" * span
        kept = bytes(c for c, g in zip(d, gone) if not g)
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((len(d), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


def brute_words(texts, span):
    data = [(t or "").encode().split() for t in texts]
    windows = lambda d: [tuple(d[i : i + span]) for i in range(len(d) - span + 1)]
    seen = Counter(w for d in data for w in windows(d))
    return [len({k for i, w in enumerate(windows(d)) if seen[w] > 1 for k in range(i, i + span)}) for d in data]


def same(spark, texts, **options):
    rows = [(i, t) for i, t in enumerate(texts)]
    got = {r.doc_id: tuple(r)[1:] for r in S.remove_repeats(spark.createDataFrame(rows, SCHEMA).repartition(3), **options).collect()}
    assert [got[i][:4] for i in range(len(texts))] == brute(texts, options.get("span", S.SPAN))
    assert [got[i][4] for i in range(len(texts))] == brute_words(texts, options.get("words", (S.PASSAGE,))[0])


def small_texts():
    rng = random.Random(11)
    base = ["".join(rng.choices("ab é", k=rng.randint(0, 120))) for _ in range(40)]
    texts = list(base)
    for t in base[:25]:
        at = rng.randint(0, max(0, len(t)))
        texts.append(t[:at] + "Z" + t[at + 1 :])
        texts.append("x" * rng.randint(0, 5) + t[10:70] + rng.choice(base)[5:60])
    return [*texts, None, "", "q" * 100, "orre " * 30, base[3], base[3]]


@pytest.mark.parametrize("limit", [20_000, 3])
def test_against_brute_force(spark, limit):
    rng = random.Random(5)
    some = [" ".join(rng.choices(["a", "bc", "d", "efg"], k=rng.randint(0, 25))) for _ in range(25)]
    same(spark, [*small_texts(), *some, *(f" {t[3:]}\t\n x" for t in some[:12])], span=24, anchor=8, group_limit=limit, words=(6, 2))


@pytest.mark.parametrize("limit", [20_000, 3])
def test_groups_have_all_occurrences(spark, limit):
    rng = random.Random(8)
    long = "".join(rng.choices("abcdef ", k=700))
    texts = list(dict.fromkeys(t for t in small_texts() if t)) + ["1" + long + "2", "3" + long, long + "4", "5" + long[::-1][:300] + "6", "8" + long[::-1][100:400]]
    docs = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    key = {r.row_key: r.text.encode() for r in docs.select("text", S.row_key("doc_id", "text").alias("row_key")).collect()}
    groups = {}
    for r in S.repeat_groups(docs, span=24, anchor=8, group_limit=limit).collect():
        groups.setdefault((r.repeat_id, r.n), set()).add((r.row_key, r.lo, r.hi))
    covered = {k: bytearray(len(t)) for k, t in key.items()}
    strings = set()
    for (_, n), places in groups.items():
        held = {key[k][lo:hi] for k, lo, hi in places}
        assert len(held) == 1 and len(places) == n > 1
        (word,) = held
        assert len(word) >= 24
        strings.add(word)
        assert places == {(k, i, i + len(word)) for k, t in key.items() for i in range(len(t) - len(word) + 1) if t[i : i + len(word)] == word}
        for k, lo, hi in places:
            covered[k][lo:hi] = b"\1" * (hi - lo)
    gone = {t: n for t, (_, n, _, _) in zip(texts, brute(texts, 24), strict=True)}
    assert all(sum(covered[k]) == gone[t.decode()] for k, t in key.items())
    assert limit == 3 or long.encode() in strings  # over many anchors


def test_production_parameters(spark, monkeypatch):
    rng = random.Random(2)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 9))) for _ in range(300)]
    prose = lambda n: " ".join(rng.choices(words, k=n))
    shared = prose(140)
    texts = [prose(50) + shared + prose(30), shared, prose(20) + shared[100:600], shared[:399] + "!", "Say it. " * 200, prose(30) + shared[5:] + "\n" + shared, prose(3000)]
    texts += [texts[6][:9000] + "#" + texts[6][9001:]]
    monkeypatch.setattr(S, "SEGMENT", 4096)  # so that the long ones go in slices
    for text in texts:
        sampler = S.Sampler(S.SPAN, S.ANCHOR)
        sliced = list(sampler.anchors([text.encode()]))
        monkeypatch.setattr(S, "SEGMENT", 1 << 20)
        assert sliced == list(S.Sampler(S.SPAN, S.ANCHOR).anchors([text.encode()]))
        monkeypatch.setattr(S, "SEGMENT", 4096)
    monkeypatch.setattr(S, "SEGMENT", 1 << 20)
    same(spark, texts)


def test_repeat_groups_hold_equal_bytes(spark):
    rows = [(i, t) for i, t in enumerate(small_texts()) if t]
    docs = spark.createDataFrame(rows, SCHEMA)
    keys = docs.select("text", S.row_key("doc_id", "text").alias("row_key"))
    by = {}
    for r in S.repeat_spans(docs, span=24, anchor=8).join(keys, "row_key").collect():
        by.setdefault(r.repeat_id, []).append(r.text.encode()[r.lo : r.hi])
    assert by and all(len(set(x)) == 1 for x in by.values())


def test_repeated_rows_nulls_and_clashing_columns(spark):
    text = "".join(random.Random(4).choices("abcdefgh ", k=900))
    rows = [(1, text), (1, text), (None, "n" * 10), (None, None)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("bytes", F.lit(1)).withColumn("row_key", F.lit("x")).withColumn("id", F.lit(2))
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_removed) for r in S.remove_repeats(docs).collect())
    assert got == [(0, 0, 0), (0, 10, 0), (1, 900, 900), (1, 900, 900)]
    assert S.remove_repeats(spark.createDataFrame([], SCHEMA)).count() == 0

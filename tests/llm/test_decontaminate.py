import hashlib
import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from ravelin.llm import decontaminate as D

DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"


def words_of(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def brute(docs, items, span=10):
    out = []
    for d, text in docs:
        words, hit, holders = words_of(text), set(), set()
        for i, t in items:
            own = words_of(t)
            n = min(span, len(own))
            for k in range(len(own) - n + 1 if n else 0):
                for s in range(len(words) - n + 1):
                    if words[s : s + n] == own[k : k + n]:
                        hit.update(range(s, s + n))
                        if i is not None:
                            holders.add(i)
        named = ",".join(sorted(map(str, holders)))
        out.append((d, len(words), len(hit), len(holders), hashlib.sha256(named.encode()).hexdigest(), bool(hit)))
    return out


def test_against_brute_force(spark):
    rng = random.Random(8)
    vocabulary = ["".join(rng.choices("abcé1", k=3)) for _ in range(25)] + ["STRASSE", "İx", "ÑU"]
    prose = lambda n: " ".join(rng.choices(vocabulary, k=n))
    items = [(k, prose(rng.choice([3, 6, 9, 10, 11, 30, 60]))) for k in range(40)] + [(99, None), (98, "..."), (None, prose(20)), (7, prose(12))]
    docs = []
    for k in range(60):
        parts = [prose(rng.randint(0, 40))]
        for _ in range(rng.randint(0, 3)):
            own = (rng.choice(items)[1] or "").split()
            a = rng.randint(0, max(0, len(own) - 1))
            parts += ["-".join(own[a : a + rng.randint(1, 30)]).upper() if rng.random() < 0.3 else " ".join(own[a:]), prose(rng.randint(0, 9))]
        docs.append((k, " ".join(parts)))
    docs += [(100, None), (101, ""), (None, items[5][1]), (0, docs[0][1]), (0, docs[0][1]), (102, "word " * 60000)]
    frame = spark.createDataFrame(docs, DOCS).withColumn("id", F.lit(1)).withColumn("window", F.lit("x")).repartition(3)
    got = D.contamination(frame, spark.createDataFrame(items, ITEMS), table_bits=12).drop("row_key").collect()
    assert Counter(map(str, (tuple(r) for r in got))) == Counter(map(str, brute(docs, items)))


def test_winnowing_keeps_the_least_of_each_window():
    rng = np.random.default_rng(1)
    for n, w in ((0, 6), (3, 6), (40, 6), (41, 1)):
        g = rng.integers(0, 9, n).astype(np.uint64)
        places = set(D.winnow(g, w).tolist())
        for k in range(n - w + 1):
            assert any(p in places and g[p] == g[k : k + w].min() for p in range(k, k + w))


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b c")], DOCS), spark.createDataFrame([(1, "a b c")], ITEMS)
    assert D.contamination(docs.limit(0), items).count() == 0
    assert D.contamination(docs, items.limit(0)).first().n_hit == 0
    assert D.contamination(docs, items).first().n_hit == 3

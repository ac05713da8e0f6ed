import random

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import functions as F

from ravelin.llm.simhash import GrayIndex, fingerprint, links, near_duplicates
from ravelin.llm.connected import components

SCHEMA = "doc_id long, text string, source string, fp string"


def slow_fingerprint(text, k=3):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text).replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\v", " ").replace("\f", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(pairs):
    """pairs: (doc_id, fp) -> component ids."""
    root = list(range(len(pairs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(pairs)):
        for j in range(i):
            if (pairs[i][1] ^ pairs[j][1]).bit_count() <= 3:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(pairs):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [least.get(find(i)) for i in range(len(pairs))]


def test_against_brute_force(spark):
    rng = random.Random(3)
    vocabulary = ["".join(rng.choices("abcdeÉñ", k=4)) for _ in range(200)]
    texts = [" ".join(rng.choices(vocabulary, k=rng.randint(1, 60))) for _ in range(80)]
    for t in texts[:40]:
        words = t.split()
        words[rng.randrange(len(words))] = "Changed"
        texts.append("\n".join(words))
    texts += [None, "", " \t\n", "One", "one", texts[0], "long " * 30000]
    rows = [(i * 7 + 1, t, "s", "x") for i, t in enumerate(texts)] + [(None, "", None, None), (None, "null id alone here", None, None), (8, texts[1], "s", "x"), (8, texts[1], "s", "x")]
    got = sorted(near_duplicates(spark.createDataFrame(rows, SCHEMA)).drop("row_key").collect(), key=str)
    fps = [(r[0], slow_fingerprint(r[1] or "")) for r in rows]
    want = sorted([(d, f"{fp:016x}", c) for (d, fp), c in zip(fps, slow_components(fps))], key=str)
    assert [str(tuple(x)) for x in got] == [str(x) for x in want]


def test_index_keeps_every_link():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 300, dtype=np.uint64)
    values = np.unique(np.concatenate([base] + [base ^ (np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64)) for _ in range(4)]))
    index = GrayIndex(values)
    got = {frozenset(map(int, index.values[index.groups(3) == h])) for h in set(index.groups(3).tolist())}
    pairs = [(int(v), int(v)) for v in values]
    by = {}
    for (v, _), c in zip(pairs, slow_components(pairs)):
        by.setdefault(c, set()).add(v)
    assert got == {frozenset(x) for x in by.values()}


def test_large_buckets_are_dealt_again(spark):
    rng = random.Random(1)
    values = sorted({(rng.getrandbits(6) << 40) | rng.getrandbits(10) for _ in range(500)})
    fps = spark.createDataFrame([(v,) for v in values], "fp long")
    for limit in (10**6, 20):
        stars = links(fps, 3, bucket_limit=limit)
        heads = dict(components(stars).collect())
        groups = slow_components([(v, v) for v in values])
        least = [heads.get(v, v) for v in values]
        assert len(set(zip(least, groups))) == len(set(least)) == len(set(groups))


def test_empty_and_clashing_columns(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert near_duplicates(empty).count() == 0
    odd = spark.createDataFrame([(1, "a b c d", "s", "z")], SCHEMA).withColumn("row_key", F.lit(1)).withColumn("bytes", F.lit(2)).withColumn("id", F.lit(3))
    assert near_duplicates(odd).select("doc_id", "component_id").collect() == [(1, 1)]
    assert fingerprint(b"", 3) == 0

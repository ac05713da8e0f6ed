import random

import corpus_pipeline as P
from ravelin.llm.similar import shingle_set, similar_groups

SCHEMA = "doc_id long, text string"


def brute(texts, similarity=0.8):
    """Numbers of the groups' heads by comparing all pairs of sets."""
    sets = [set(shingle_set((t or "").encode(), 5).tolist()) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] == sets[j] or len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))]


def corpus():
    rng = random.Random(9)
    vocabulary = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(400)]
    texts = [" ".join(rng.choices(vocabulary, k=rng.randint(50, 200))) for _ in range(60)]
    for t in list(texts[:40]):  # chains: each copy is changed further from the one before
        for _ in range(4):
            words = t.split()
            for _ in range(rng.choice((1, 1, 2, 4))):
                words[rng.randrange(len(words))] = "changed"
            t = " ".join(words)
            texts.append(t)
    return texts + [None, "", "One two", "one  TWO", texts[0]]


def test_groups_are_those_of_all_pairs(spark):
    texts = corpus()
    heads = brute(texts)
    got = sorted(r.id for r in similar_groups(spark.createDataFrame(list(enumerate(texts)), SCHEMA).repartition(5)).collect())
    assert got == sorted(set(heads)) and len(got) < len(texts) - 100


def test_stage_drops_changed_copies(spark, tmp_path):
    texts = corpus()
    docs = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    got = sorted(r.doc_id for r in P.near_dedup(spark, docs, str(tmp_path)).collect())
    assert got == sorted(set(brute(texts)))
    assert P.near_dedup(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_ids_dont_join_groups(spark, tmp_path):
    texts = [" ".join(f"{w}{k}" for k in range(60)) for w in ("red", "blue", "green", "grey")]
    near = texts[0].replace("red30", "changed")
    rows = [(None, texts[0]), (None, texts[1]), (5, texts[2]), (5, texts[3]), (None, near), (9, texts[1] + " more")]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = P.near_dedup(spark, docs, str(tmp_path)).collect()
    assert sorted(r.text.split()[0] for r in got) == ["blue0", "green0", "grey0", "red0"]
    assert sorted(r.doc_id for r in got if r.doc_id is not None) == [5, 5, 9]
    again = docs.union(docs)  # repeated rows: one stays
    assert P.near_dedup(spark, again, str(tmp_path)).count() == 4


def test_pairs_hidden_in_a_bucket_of_unlike_sets(spark, monkeypatch):
    """All texts share a core and so their buckets, but only those of a pair are like each other."""
    from ravelin.llm import similar

    rng = random.Random(4)
    core, texts = [f"core{k}" for k in range(300)], []
    for k in range(150):
        own = [f"own{k}x{i}" for i in range(45)]
        texts.append(" ".join(core + own))
        for i in rng.sample(range(45), 4):
            own[i] = f"changed{k}x{i}"
        texts.append(" ".join(core + own))
    want = sorted(set(brute(texts)))
    assert len(want) == 150
    docs = spark.createDataFrame(list(enumerate(texts)), SCHEMA).repartition(4)
    monkeypatch.setattr(similar, "SLICE", 24, raising=False)
    monkeypatch.setattr(similar, "CELL", 16, raising=False)
    assert sorted(r.id for r in similar_groups(docs).collect()) == want


def test_fingerprints_give_candidates(spark):
    """Close fingerprints are candidates, whatever the buckets say."""
    from ravelin.llm.similar import _of_fingerprints

    sets = spark.createDataFrame([(1, 0), (2, 0), (3, 7), (4, 1 << 40), (5, (1 << 62) - 1)], "set long, fp long")
    got = {(min(r), max(r)) for r in _of_fingerprints(sets).collect()}
    assert (1, 2) in got and {3, 4} <= {x for p in got for x in p} and not any(5 in p for p in got)


def test_nearly_alike_sets_make_no_rows_of_their_pairs(spark, monkeypatch):
    """One group of texts most of which are a little less alike than 0.8: what is staged grows with the sets and their buckets."""
    from ravelin.llm import similar

    rng, real, rows = random.Random(6), similar.staged, {}
    base, texts = [f"base{k}" for k in range(100)], []
    for k in range(300):
        words = list(base)
        for i in rng.sample(range(100), rng.choice((2, 2, 2, 2, 2, 1))):
            words[i] = f"changed{k}x{i}"
        texts.append(" ".join(words))
    want = sorted(set(brute(texts)))
    assert 1 < len(want) < 300

    def counted(df, name):
        out = real(df, name)
        rows[name] = max(rows.get(name, 0), out.count())
        return out

    docs = spark.createDataFrame(list(enumerate(texts)), SCHEMA).repartition(4)
    monkeypatch.setattr(similar, "staged", counted)
    assert sorted(r.id for r in similar_groups(docs).collect()) == want
    assert max(rows.values()) <= similar.BANDS * len(texts), rows
    monkeypatch.setattr(similar, "SHINGLES", 5_000, raising=False)  # slices by shingles: about 6 of the group's 30,000
    assert sorted(r.id for r in similar_groups(docs).collect()) == want

import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from ravelin.llm import toxicity as T

DATA = "/root/testdata/sf0.1"


def test_fold_undoes_disguises():
    assert T.fold("ST0P 1D10T") == "stop idiot"
    assert T.fold("іdіоt mоrоn ｓｃｕｍ $tup1d l!ar") == "idiot moron scum stupid liar"
    assert T.fold("s​tupid") == "stupid"


def test_lexicon_counts_word_beginnings_but_not_exceptions():
    lexicon = T.Lexicon({"clown": 3.0, "trash": 2.0, "scum": 1.0}, ("trash can", "clownfish"))
    assert lexicon.features("") == lexicon.features("a clean text") == (0.0, 0.0, 0.0)
    assert lexicon.features("Clowns!")[2] == 3.0
    assert lexicon.features("the unclown clownfish in the trash can") == (0.0, 0.0, 0.0)
    assert lexicon.features("the trash canister")[2] == 2.0
    assert lexicon.features("scum " + "word " * 10)[1] > lexicon.features("scum " + "word " * 1000)[1]


def naive(text, weights, exceptions):
    """Every start and entry, one after the other."""
    import math

    t = T.fold(text)
    covered = set()
    for e in map(T.fold, exceptions):
        for i in range(len(t)):
            if t.startswith(e, i) and (i == 0 or not t[i - 1].isalpha()) and not t[i + len(e) : i + len(e) + 1].isalpha():
                covered.update(range(i, i + len(e)))
    hits = [max((w for s, w in weights.items() if t.startswith(s, i)), default=0) for i in range(len(t)) if i not in covered and (i == 0 or not t[i - 1].isalpha())]
    total = sum(hits)
    return (math.log1p(total), math.log1p(100 * total / (1 + sum(map(t.count, " \n\t")))), max(hits, default=0)) if total else (0, 0, 0)


def test_automaton_against_naive_matching():
    rng = random.Random(6)
    weights, exceptions = {"abba": 2.0, "abbab": 3.0, "baab": 1.5}, ("abbabb", "aa baab")
    lexicon = T.Lexicon(weights, exceptions)
    for _ in range(300):
        text = "".join(rng.choices("ab A4 8", k=rng.randint(0, 80)))
        assert np.allclose(lexicon.features(text), naive(text, weights, exceptions)), text


def test_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    got = T.score_documents(docs, labels).join(labels.select("doc_id", "toxic"), "doc_id").where("held_out").toPandas()
    assert all((zlib.crc32(str(d).encode()) % 4 == 2) for d in got.doc_id)
    assert got.score.between(0, 1).all() and ((got.score >= 0.3) == (got.predicted == 1)).all()
    hit = got[got.predicted == 1]
    assert (hit.toxic == 1).mean() > 0.9 and (hit.toxic == 1).sum() / (got.toxic == 1).sum() > 0.85
    assert (got.toxic == got.predicted).mean() > 0.97


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "stupid"), (3, "x" * 100_000), (3, "x" * 100_000)], "doc_id long, text string").withColumn("score", F.lit("s")).withColumn("id", F.lit(1)).withColumn("label", F.lit(1))
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (5, None)], "doc_id long, toxic int").withColumn("id", F.lit(1))
    got = T.score_documents(docs, labels).collect()
    assert len(got) == 5 and len({r.score for r in got}) == 1
    assert T.score_documents(docs.limit(0), labels).count() == 0
    assert T.score_documents(docs, labels.limit(0)).count() == 5


def test_labels_other_than_0_and_1_do_not_count(spark):
    docs = spark.read.parquet(f"{DATA.replace('0.1', '0.001')}/documents.parquet")
    ids = [r.doc_id for r in docs.select("doc_id").collect()]
    right = [(d, int(d % 5 == 0)) for d in ids]
    odd = [(d, x) for d in ids[:60] for x in (2, -1, None)]
    schema = "doc_id long, toxic int"
    score = lambda rows: sorted((r.doc_id, r.score) for r in T.score_documents(docs, spark.createDataFrame(rows, schema)).collect())
    assert score(right) == score(right + odd)


def test_whole_score_against_brute_force(spark):
    """Training in tasks gives what plain code gives from the sample's texts; the scores are its naive features under the logistic."""
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(3, 8))) for _ in range(300)]
    rows, marks = [], []
    for k in range(500):
        bad = k % 4 == 0
        text = " ".join(rng.choices(words, k=30) + (["Stupendo" + rng.choice(["", "s", "us"]), "grumbly"][: 1 + k % 2] if bad else []))
        rows.append((k, text.replace("grumbly", "gru mbly") if k % 7 == 0 else text))
        marks.append((k, int(bad)))
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string").repartition(3), spark.createDataFrame(marks, "doc_id long, toxic int")
    hashes = {r.id: (r.h, r.p) for r in labels.selectExpr("doc_id AS id", "xxhash64(doc_id) AS h", "pmod(xxhash64('part', doc_id), 10) AS p").collect()}
    text, label = dict(rows), dict(marks)
    used = [k for k, _ in marks if zlib.crc32(str(k).encode()) % 4 != 2]
    first, second = [k for k in used if hashes[k][1] < 7], [k for k in used if hashes[k][1] >= 7]
    counts = {}
    for k in first:
        for s in set(T.stems(text[k])):
            counts.setdefault(s, [0, 0])[label[k]] += 1
    toxic = sum(label[k] for k in first)
    table = [(s, c, t) for s, (c, t) in counts.items()]
    weights, learned = T.choose(table, len(first) - toxic, toxic)
    exceptions = (*T.EXCEPTIONS, *learned)
    beta = T.fit_logistic(np.array([naive(text[k], weights, exceptions) for k in second]), np.array([label[k] for k in second], float))
    assert weights and beta[1:].max() > 0
    for r in T.score_documents(docs, labels).collect():
        want = 1 / (1 + np.exp(-(beta[0] + np.array(naive(text[r.doc_id], weights, exceptions)) @ beta[1:])))
        assert abs(r.score - want) < 1e-6 and r.predicted == int(r.score >= T.THRESHOLD)

import os
import random
from collections import defaultdict

import corpus_pipeline as P
from ravelin.llm.common import shared_dir
from ravelin.llm.simhash import fingerprint

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n):
    return " ".join("".join(rng.choices("abcdefghijklmnop", k=rng.randint(3, 8))) for _ in range(n))


def tables(spark, folder, rows, labels, items):
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


def test_stages(spark, tmp_path):
    rng = random.Random(8)
    passage = prose(rng, 12)
    rows = []
    for k in range(60):
        body = f"{prose(rng, 60)}\n{prose(rng, 40)}"
        if k % 2:
            body = f"Subscribe to our letter\n{body}"
        if k in (7, 20):
            body += f"\n{passage}"
        rows.append((k, body, "en", f"src{k % 2}", len(body)))
    rows.append((60, rows[5][1], "en", "src1", 1))  # a copy
    rows += [(61, "too short", "en", "src0", 9), (62, None, None, None, None), (63, "", "en", "src0", 0), rows[3]]
    tables(spark, tmp_path, rows, [], [(1, passage), (2, None)])
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in P.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        seen[name] = docs.collect()
        if name != "packing":
            assert docs.columns == SCHEMA.replace(" long", "").replace(" string", "").split(", ")
    ids = lambda name: sorted(r.doc_id for r in seen[name])
    assert ids("quality_rules") == sorted([*range(61), 3])
    assert ids("line_dedup") == ids("quality_rules") and not any("Subscribe" in r.text for r in seen["line_dedup"])
    groups = defaultdict(list)
    for r in seen["line_dedup"]:
        groups[fingerprint(r.text.encode(), 3)].append(r.doc_id)
    assert ids("near_dedup") == list(range(60)) == sorted(min(g) for g in groups.values())
    assert ids("decontamination") == [k for k in range(60) if k not in (7, 20)]
    texts = {r.doc_id: r.text for r in seen["decontamination"]}
    assert {r.doc_id for r in seen["packing"]} == set(texts)
    again = P.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in again if r.start == 0 and r.length == r.doc_tokens) and {r.doc_id for r in again} == set(texts)


def test_empty_tables(spark, tmp_path):
    tables(spark, tmp_path, [], [], [])
    assert P.run(spark, str(tmp_path)).collect() == []


def test_lines_of_small_hosts(spark, tmp_path):
    rows = [(k, f"Menu of six\npage {k}", "en", "six", 1) for k in range(6)] + [(10 + k, f"Menu of four\npage {k}", "en", "four", 1) for k in range(4)]
    got = {r.doc_id: r.text for r in P.lines(spark, spark.createDataFrame(rows, SCHEMA), str(tmp_path)).collect()}
    assert got == {k: f"page {k}" for k in range(6)} | {10 + k: f"Menu of four\npage {k}" for k in range(4)}


def test_clashing_names_and_very_long_texts(spark, tmp_path):
    rng = random.Random(3)
    rows = [(k, prose(rng, 80), "en", f"src{k % 2}", 1) for k in range(8)] + [(8, prose(rng, 60_000), "en", "src0", 1)]
    tables(spark, tmp_path, rows, [], [])
    path = f"{tmp_path}/documents.parquet"
    names = ["__q", "__kept", "__host", "__text", "__key", "row_key", "bytes", "id", "c0"]
    docs = spark.read.parquet(path).selectExpr("*", *(f"{k} AS {n}" for k, n in enumerate(names)))
    for name, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns[5:] == names and {tuple(r)[5:] for r in docs.collect()} == {tuple(range(len(names)))}, name
        assert docs.count() == 9
    assert {r.doc_id for r in P.packing(spark, docs, str(tmp_path)).collect()} == set(range(9))
    folder = f"{shared_dir(spark).removeprefix('file:')}/ravelin"
    before = set(os.listdir(folder))
    P.run(spark, str(tmp_path)).count()
    left = set(os.listdir(folder)) - before  # what run() staged on its way is gone
    assert len(left) == 1 and next(iter(left)).startswith("pipeline-decontamination")

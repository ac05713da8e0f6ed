import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from ravelin.llm import line_dedup as L

SCHEMA = "doc_id long, text string, source string"


def brute(rows, ratio, min_pages, min_copies):
    pages, totals = defaultdict(Counter), Counter()
    shown = lambda x: x.strip(" \t\r\x0b\f") != ""
    for _, text, host in rows:
        totals[host or ""] += 1
        pages[host or ""].update({x for x in (text or "").split("\n") if shown(x)})
    drop = {h: {x for x, n in c.items() if totals[h] >= min_pages and n >= min_copies and n > ratio * totals[h]} for h, c in pages.items()}
    out = []
    for d, text, host in rows:
        lines = (text or "").split("\n") if text is not None else []
        kept = [x for x in lines if x not in drop[host or ""]]
        out.append((d, None if text is None else "\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


@pytest.mark.parametrize("broadcast", [True, False])
def test_against_brute_force(spark, monkeypatch, broadcast):
    monkeypatch.setattr(L, "BROADCAST_LINES", 10**6 if broadcast else -1)
    rng = random.Random(5)
    own = {h: [f"menu {h} {k}" for k in range(3)] for h in ("a", "b", None)}
    rows = []
    for k in range(200):
        host = rng.choices(["a", "b", None, "tiny"], [5, 2, 2, 0.3])[0]
        lines = [f"line {rng.randint(0, 400)}" for _ in range(rng.randint(0, 6))] + ["", "  \t"]
        lines += [x for x in own.get(host, []) if rng.random() < 0.4]
        rng.shuffle(lines)
        rows.append((k, "\n".join(lines), host))
    rows += [(900, None, "a"), (901, "", "a"), (3, rows[3][1], rows[3][2]), (None, "menu a 1\nmenu a 1", "a"), (902, "menu a 0\n" * 20000, "a")]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("n_chars", F.lit(0)).withColumn("host", F.lit("x")).withColumn("line", F.lit(1)).withColumn("pages", F.lit(1))
    got = L.drop_boilerplate(docs, ratio=0.25, min_pages=10, min_copies=3, counts=True)
    assert got.columns == [*docs.columns, "__lines", "__dropped"]
    assert sorted(map(str, (tuple(r) for r in got.select("doc_id", "text", "__lines", "__dropped").collect()))) == sorted(map(str, brute(rows, 0.25, 10, 3)))
    assert got.where("text is not null and n_chars <> length(text)").count() == 0
    assert L.drop_boilerplate(docs.limit(0)).count() == 0


def test_clashing_names(spark):
    text = "same line\n"
    docs = spark.createDataFrame([(k, f"{text}own {k}", "a") for k in range(30)], "doc_id long, text string, source string")
    odd = docs.selectExpr("*", "1 AS __host", "2 AS __drop", "3 AS __text", "4 AS c0")
    got = L.drop_boilerplate(odd)
    assert got.columns == odd.columns and {tuple(r)[3:] for r in got.collect()} == {(1, 2, 3, 4)}
    assert {r.doc_id: r.text for r in got.collect()} == {k: f"own {k}" for k in range(30)}


def test_small_hosts(spark):
    """A host of 6 pages loses a line that all 6 have; one of 4 pages keeps its own, which is in fewer than 5."""
    rows = [(k, f"menu\nown {k}", "six") for k in range(6)] + [(10 + k, f"menu\nown {k}", "four") for k in range(4)]
    got = {r.doc_id: r.text for r in L.drop_boilerplate(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {d: t.removeprefix("menu\n") if h == "six" else t for d, t, h in rows}

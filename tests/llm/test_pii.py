import hashlib
import math
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ravelin.llm import pii as P

SCHEMA = "doc_id long, text string"
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def passes(kind, s):
    digits = [int(c) for c in s if c in "0123456789"]
    if kind == "ip":
        return all(int(x) <= 255 for x in s.split("."))
    if kind == "card":
        total = sum(d if k % 2 == 0 else sum(divmod(2 * d, 10)) for k, d in enumerate(reversed(digits)))
        return 16 <= len(digits) <= 19 and total % 10 == 0
    return kind == "email" or 8 <= len(digits) <= 15


def brute(text):
    return [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if passes(k, m.group())]


PARTS = ["a", "b.c", "@", "@x.y", ".", "-", "_", "+", " ", "1", "12.3.4.5", "256.1.1.1", "1.2.3.4.5.6.7.8", "+1 (743) 555-3824", "4785380592391139", "4785 3805 9239 1139", "4785-3805-9239-1139 ", "(", ")", "é", "٣", "0", "00012.0255.1.1", "me@mail.example.com", "a@b.c@d.e", "%", "\n", "+49", "555 ", "9" * 20]


@settings(max_examples=1500, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=9).map("".join))
def test_base_matches_the_patterns(text):
    assert P.base_spans(text) == brute(text)


def test_long_texts_are_linear():
    for text in ("a" * 400_000, "1" * 400_000, "1." * 200_000, "+" * 400_000, "1 " * 200_000, "a@" * 200_000, "+1" + " " * 400_000, "-." * 200_000 + "@"):
        P.base_spans(text)


def corpus():
    rng = random.Random(6)
    words = ["".join(rng.choices("abcdefgh", k=6)) for _ in range(300)]
    prose = lambda n: " ".join(rng.choices(words, k=n))
    rows = []
    for k in range(240):
        text = prose(60)
        if k % 8 == 0:
            text += f" Zorblatt {prose(2)} call me: who@mail.example.com {prose(3)} the Quux42 {prose(40)}"
        if k % 30 == 1:
            text += f" {prose(20)} 10.1.2.3 {prose(20)}"
        rows.append((k, text))
    lonely = f"{prose(10)} hapaxword me@only.example.com uniqueword {prose(10)}"
    rows += [(1000 + k, lonely) for k in range(20)]  # copies are one mention
    rows += [(2000, None), (2001, ""), (None, "x 1.2.3.4"), (2002, "Zorblatt went home"), rows[0], rows[0]]
    return rows


def classes(kind, value):
    """The entity and its classes."""
    digits = "".join(c for c in value if c.isdigit())
    inner = {"email": value.lower().split("@")[-1], "ip": ".".join(value.split(".")[:2]), "card": digits[:6], "phone": digits[:4]}[kind]
    return [(kind, "whole", value.lower() if kind in ("email", "ip") else digits), (kind,), (kind, "in", inner)]


def expected_terms(rows):
    """Straightforward count: {(entity text, term): disclosure}."""
    total, words, mentions = 0, {}, {}
    for _, text in rows:
        text = text or ""
        spans = brute(text)
        inside = lambda m: any(m.start() < b and a < m.end() for _, a, b in spans)  # noqa: E731, B023
        found = list(re.finditer(r"[^\W_]{3,}", text))
        total += len(found)
        for m in found:
            words[m.group().lower()] = words.get(m.group().lower(), 0) + 1
        for k, a, b in spans:
            around = [m.group().lower() for m in found if m.end() <= a and not inside(m)][-P.WINDOW :] + [m.group().lower() for m in found if m.start() >= b and not inside(m)][: P.WINDOW]
            for c in classes(k, text[a:b]):
                mentions.setdefault(c, set()).add(frozenset(around))
    out = {}
    for e, sets in mentions.items():
        for t in set().union(*sets):
            n = sum(t in s for s in sets)
            if n >= P.MIN_SUPPORT and n >= P.MIN_SHARE * len(sets):
                p = len(sets) / total
                d = min(1.0, math.log((n + P.SMOOTH * p) / ((max(n, words[t]) + P.SMOOTH) * p)) / -math.log(p))
                if d >= P.GENERALISE:
                    out[e, t] = d
    return out


def test_operator_matches_brute_force(spark):
    rows = corpus()
    terms = expected_terms(rows)
    assert {t for _, t in terms} >= {"zorblatt", "quux42"} and not {t for _, t in terms} & {"hapaxword", "uniqueword"}
    expected = []
    for d, text in rows:
        text = text or ""
        base = brute(text)
        own = {c for k, a, b in base for c in classes(k, text[a:b])}
        level = {t for e, t in terms if e in own}
        extra = [("term", m.start(), m.end()) for m in re.finditer(r"[^\W_]{3,}", text) if m.group().lower() in level and not any(m.start() < b and a < m.end() for _, a, b in base)]
        line = lambda x: ",".join(f"{k}:{a}:{b}" for k, a, b in x)
        expected.append((d, *(sum(x[0] == k for x in base) for k in P.KINDS), hashlib.sha256(line(base).encode()).hexdigest(), line(base + extra)))
    got = P.digest_spans(spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA + ", spans string, row_key int").repartition(5)).drop("n_terms").collect()
    key = lambda r: (r[0] is None, r[0] or 0, *map(str, r[1:]))
    assert sorted(map(tuple, got), key=key) == sorted(expected, key=key)


def test_sanitised_texts(spark):
    got = {r.doc_id: r.text for r in P.sanitise(spark.createDataFrame(corpus(), SCHEMA)).collect()}
    assert "who@" not in got[8] and "[EMAIL]" in got[8] and "Zorblatt" not in got[8] and "Quux42" not in got[8]
    assert got[2002] == "Zorblatt went home" and got[2000] is None and got[2001] == "" and got[None] == "x [IP]"
    assert "hapaxword [EMAIL] uniqueword" in got[1001]


@pytest.mark.parametrize("rows", [[], [(1, "nothing here")]])
def test_small_tables(spark, rows):
    got = P.digest_spans(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [(r.doc_id, r.n_email, r.spans) for r in got] == [(d, 0, "") for d, _ in rows]


def hot_corpus():
    """One address in 100 different mentions, a term of its own beside 10 of them."""
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdefgh", k=6)) for _ in range(300)]
    prose = lambda n: " ".join(rng.choices(words, k=n))
    rows = [(k, f"{prose(40)} {'Xanadu' if k < 10 else prose(1)} hot@mail.example.com {prose(40)}") for k in range(100)]
    return rows, [(1000 + k, prose(60)) for k in range(100)]


@pytest.mark.parametrize("few", [True, False])
def test_terms_beside_a_small_share_of_the_mentions(spark, monkeypatch, few):
    monkeypatch.setattr(P, "BROADCAST_PAIRS", 10**6 if few else -1)
    rows, others = hot_corpus()
    got = {r.doc_id: r for r in P.protected_spans(spark.createDataFrame(rows + others, SCHEMA)).collect()}
    assert all([rows[k][1][t.start : t.end] for t in got[k].terms].count("Xanadu") == (k < 10) for k in range(100))
    assert all(t.disclosure > P.REMOVE for t in got[3].terms if rows[3][1][t.start : t.end] == "Xanadu")


def test_entities_mentioned_once_disclose_by_their_class(spark):
    """150 addresses and 150 numbers, each there once, with a word beside most of those of one domain or prefix."""
    rng = random.Random(9)
    words = ["".join(rng.choices("abcdefgh", k=6)) for _ in range(400)]
    prose = lambda n: " ".join(rng.choices(words, k=n))
    rows = []
    for k in range(150):
        rows.append((len(rows), f"{prose(40)} {'Bluefalcon' if k % 3 else prose(1)} p{k}@acme.example.com {prose(40)}"))
        rows.append((len(rows), f"{prose(40)} {'Hotline' if k % 2 else prose(1)} +1 (743) 555-{1000 + k} {prose(40)}"))
        rows.append((len(rows), f"{prose(40)} q{k}@mail{k % 7}.example.org {prose(40)}"))
        rows.append((len(rows), prose(80)))
    got = {r.doc_id: r.terms for r in P.protected_spans(spark.createDataFrame(rows, SCHEMA)).collect()}
    marked = [(d, text[t.start : t.end]) for d, text in rows for t in got[d]]
    planted = [(d, w) for d, text in rows for w in ("Bluefalcon", "Hotline") if w in text]
    right = len(set(marked) & set(planted))
    print("recall", right / len(planted), "precision", right / len(marked), len(marked))
    assert right / len(planted) == 1.0 and right / len(marked) >= 0.95


def test_copies_change_nothing(spark):
    rows, others = hot_corpus()
    once = spark.createDataFrame(rows + others, SCHEMA)
    copied = once.where("doc_id < 10").join(spark.range(1000).select("id"), how="cross").selectExpr("doc_id + 10000 * (id + 1) AS doc_id", "text")
    spans = lambda docs: {r.doc_id: r.terms for r in P.protected_spans(docs).where("doc_id < 10000").collect()}
    want = spans(once)
    assert sum(len(t) for t in want.values()) >= 10 and spans(once.union(copied)) == want

import random
import re

from ravelin.llm import url_filter as U

SCHEMA = "page_id long, url string, html string"


def brute(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url[url.index("://") + 3 :]
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host) :]).group()
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = []
    for rule in U.RULES:
        name, start = rule.split("/", 1)
        if (host == name or host.endswith("." + name)) and path.startswith("/" + start):
            fits.append(rule)
    return host, path, max(fits, key=len, default=None)


def urls():
    rng = random.Random(3)
    out = [None, "", "no scheme", "http://", "://x", "HTTP://WWW.EXAMPLE.COM/en/7?x#y", "http://Ünï.Example.NET/de/8", "http://example.org", "http://a.org/es/\nline?q", "http://com/en/", "http://xcom/en/1", "a://b://c.com/en/"]
    for k in range(600):
        host = rng.choice(["www.", "m.", ""]) + rng.choice(["casino-win", "journal", "pills4u", "garden"]) + rng.choice([".example.com", ".example.net", ".example.org", ".info"])
        out.append(f"http{rng.choice(['', 's'])}://{host}/{rng.choice(['en', 'de', 'es', 'fr'])}/{k}{rng.choice(['', '?a=1&b=2', '#top'])}")
    return out + ["http://journal.example.com/en/70"] * 3


def test_matches_brute_force(spark):
    given = [(k, u, "x") for k, u in enumerate(urls())] + [(None, "http://a.net/de/1", None)]
    got = U.judge_urls(spark.createDataFrame(given, SCHEMA)).collect()
    assert sorted((r.page_id, r.host, r.path, r.rule) for r in got if r.page_id is not None) == sorted(((k, *brute(u)) for k, u, _ in given if k is not None), key=lambda x: x[0])
    assert all(r.verdict == U.RULES[r.rule] for r in got if r.rule)
    assert {r.verdict for r in got} == {"allow", "block"}
    free = {r.verdict for r in got if not r.rule}
    assert free <= {"allow", "block"} and free


def test_trees_follow_labels(spark):
    """A host mark that decides the label is found again in URLs no rule fits."""
    given = [(k, f"http://{'casino' * (k % 2)}site{k}.example.com/{'en/' if k % 2 else 'en/7'}{k}", None) for k in range(400)]
    rules = {"example.com/en/": "block", "example.com/en/7": "allow"}
    free = [(1000 + k, f"http://{'casino' * (k % 2)}site{k}.example.com/fr/{k}", None) for k in range(200)]
    got = U.judge_urls(spark.createDataFrame(given + free, SCHEMA), rules=rules)
    right = [(r.verdict == "block") == bool(r.page_id % 2) for r in got.collect() if r.page_id >= 1000]
    assert sum(right) > 180


def test_edges(spark):
    assert U.judge_urls(spark.createDataFrame([], SCHEMA)).collect() == []
    one = U.judge_urls(spark.createDataFrame([(1, None, "h", 3), (2, "http://x.fr/", "h", 4)], "page_id long, url string, host string, label long"))
    assert [(r.host, r.path, r.verdict) for r in one.orderBy("page_id").collect()] == [("", "", "allow"), ("x.fr", "/", "allow")]


def test_entropy(spark):
    from pyspark.sql import functions as F

    got = spark.createDataFrame([("",), ("aaaa",), ("abab",), ("abcd",)], "u string").select(F.round(U.entropy(F.col("u")), 9).alias("e")).collect()
    assert [r.e for r in got] == [0.0, 0.0, 1.0, 2.0]


def test_rules_learnt_by_heart_do_not_block(spark):
    """Where trees fail on the rules left out, hosts that no rule is for are left alone."""
    given = [(k, f"http://site{k}.example.{('com', 'net', 'org')[k % 3]}/{('en', 'de', 'es')[k % 3]}/{k}", None) for k in range(900)]
    free = [(1000 + k, f"http://site{k}.example.org/en/{k}", None) for k in range(200)]
    got = U.judge_urls(spark.createDataFrame(given + free, SCHEMA), rules={"com/en/": "block", "net/de/": "allow", "org/es/": "block"})
    assert sum(r.verdict == "block" for r in got.collect() if r.page_id >= 1000) <= 10


def test_very_long_urls(spark):
    rows = [(1, "http://a.example.net/de/" + "x" * 300_000, None), (2, "y" * 300_000, None), (3, "http://" + "h" * 100_000 + ".com/en/", None)]
    got = {r.page_id: (len(r.host), len(r.path), r.rule) for r in U.judge_urls(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {1: (13, 300_004, "net/de/"), 2: (0, 0, None), 3: (100_004, 4, "com/en/")}


def test_every_ruled_url_is_a_label(spark):
    pages = spark.range(10_500).selectExpr("id AS page_id", "concat('http://h', id % 7, '.com/en/', id) AS url", "'' AS html")
    given = U.ruled(pages.union(pages), "page_id", "url", U.RULES)
    labelled = U.labelled_urls(given, U.RULES)
    assert labelled.count() == labelled.select("__url").distinct().count() == 10_500

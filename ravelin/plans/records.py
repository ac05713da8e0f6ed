"""Queries on lists, names, records, latencies and write masks, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ravelin.functions.bits import bit_length, ceil_log2, div, floor_log2
from ravelin.operators import sets, trace
from ravelin.plans.catalogue import cents, query
from ravelin.sources import lists

CENTS = "CAST(round(l_extendedprice * 100) AS BIGINT)"
CRC = 0x82F63B78  # the Castagnoli polynomial, low bit first


@query(f"SELECT l_returnflag, count(*) AS samples, CAST(sum({CENTS}) AS BIGINT) AS total, CAST(sum(CAST(l_quantity AS BIGINT) * CAST(l_quantity AS BIGINT)) AS BIGINT) AS squares, min({CENTS}) AS least, max({CENTS}) AS most, count(*) FILTER (l_quantity < 5) AS underflow, count(*) FILTER (l_quantity > 45) AS overflow, round(avg(ln(l_quantity)), 6) AS mean_log FROM lineitem GROUP BY 1")
def stat_distribution_totals(t):
    """What a distribution keeps beside its buckets."""
    price, n = cents("l_extendedprice"), F.col("l_quantity").cast("long")
    return t("lineitem").groupBy("l_returnflag").agg(
        F.count("*").alias("samples"), F.sum(price).alias("total"), F.sum(n * n).alias("squares"), F.min(price).alias("least"), F.max(price).alias("most"),
        F.count_if(F.col("l_quantity") < 5).alias("underflow"), F.count_if(F.col("l_quantity") > 45).alias("overflow"), F.round(F.avg(F.ln("l_quantity")), 6).alias("mean_log"),
    )


@query("""WITH b AS (SELECT l_returnflag AS f, l_linestatus AS s, CAST(CASE WHEN l_quantity < 1 THEN 0 ELSE length(bin(CAST(l_quantity AS BIGINT))) END AS BIGINT) AS bin FROM lineitem)
SELECT coalesce(f, '*') AS flag, coalesce(s, '*') AS status, bin, count(*) AS n FROM b GROUP BY GROUPING SETS ((bin), (f, bin), (s, bin), (f, s, bin))""")
def trace_latency_histograms(t):
    """Histograms by powers of two: of all, by each of two keys and by both; counted once, then summed up."""
    b = t("lineitem").groupBy("l_returnflag", "l_linestatus", bit_length(F.col("l_quantity").cast("long")).cast("long").alias("bin")).agg(F.count("*").alias("n"))
    f, s = F.col("l_returnflag"), F.col("l_linestatus")
    sets = b.groupingSets([["bin"], [f, "bin"], [s, "bin"], [f, s, "bin"]], f, s, "bin").agg(F.sum("n").alias("n"))
    return sets.select(F.coalesce(f, F.lit("*")).alias("flag"), F.coalesce(s, F.lit("*")).alias("status"), "bin", "n")


@query("""WITH r AS (SELECT *, coalesce(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run FROM events),
s AS (SELECT user_id, run, min(event_id) FILTER (event_type <> 'purchase') AS a, max(event_id) FILTER (event_type <> 'purchase') AS b, max(event_id) FILTER (event_type = 'purchase') AS e FROM r GROUP BY 1, 2),
m AS (SELECT 'first_end' AS measure, e - a AS v FROM s UNION ALL SELECT 'last_end', e - b FROM s UNION ALL SELECT 'first_last', b - a FROM s WHERE e IS NOT NULL)
SELECT measure, CAST(CASE WHEN v = 0 THEN 0 ELSE length(bin(v)) END AS BIGINT) AS bin, count(*) AS n FROM m WHERE v IS NOT NULL GROUP BY 1, 2""")
def trace_store_lifetimes(t):
    """How long a key's rows stay until the event that ends them, from the first and the last one, and between these."""
    ends = F.col("event_type") == "purchase"
    before = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, -1)
    runs = t("events").select("user_id", "event_id", "event_type", F.coalesce(F.count_if(ends).over(before), F.lit(0)).alias("run"))
    at = F.col("event_id")
    s = runs.groupBy("user_id", "run").agg(F.min(F.when(~ends, at)).alias("a"), F.max(F.when(~ends, at)).alias("b"), F.max(F.when(ends, at)).alias("e")).where("e is not null and a is not null")
    long = s.select((F.col("e") - F.col("a")).alias("first_end"), (F.col("e") - F.col("b")).alias("last_end"), (F.col("b") - F.col("a")).alias("first_last"))
    return long.unpivot([], long.columns, "measure", "v").groupBy("measure", bit_length(F.col("v")).cast("long").alias("bin")).agg(F.count("*").alias("n"))


@query("SELECT p_partkey, 2 AS lists, split_part(p_type, ' ', 1) AS head, p_brand AS tail FROM part")
def nested_lists(t):
    """Lists in lists, read from text."""
    text = F.concat(F.lit("("), F.regexp_replace("p_type", " ", ","), F.lit("),"), "p_brand")
    rows = t("part").select("p_partkey", lists.nested_list(text).alias("x"))
    return rows.select("p_partkey", F.size("x").alias("lists"), F.col("x")[0][0].alias("head"), F.col("x")[1][0].alias("tail"))


@query("SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS \"index\", o_orderstatus AS value FROM orders UNION ALL SELECT o_orderkey, 'p', o_orderpriority FROM orders")
def indexed_lists(t):
    """Pairs of an index and a value, read from text; what isn't a pair goes."""
    text = F.concat(F.lit("("), "o_custkey", F.lit(","), "o_orderstatus", F.lit("),alone,(p,"), "o_orderpriority", F.lit(")"))
    return t("orders").select("o_orderkey", F.explode(lists.indexed_list(text)).alias("p")).select("o_orderkey", "p.index", "p.value")


@query("SELECT event_type, event_type IN ('click', 'view', 'purchase') AS known, CASE event_type WHEN 'click' THEN 2 WHEN 'purchase' THEN 5 ELSE 1 END AS weight, CASE WHEN event_type IN ('click', 'view') THEN 1 WHEN event_type = 'purchase' THEN 2 ELSE 0 END AS category, count(*) AS n FROM events GROUP BY 1")
def name_categories(t):
    """The first pattern that matches a whole name gives its weight and category."""
    counts = t("events").groupBy("event_type").agg(F.count("*").alias("n"))
    told = lists.category(F.col("event_type"), [("CLI.*", 2, 1), ("vie[w]", 1, 1), ("purchase", 5, 2), ("p.*e", 7, 3), ("erro", 9, 4)])
    return counts.select("event_type", "n", told.alias("c")).select("event_type", "c.known", "c.weight", "c.category", "n")


@query("SELECT p_type, count(*) AS n FROM part WHERE NOT (p_brand = 'Brand#11' OR regexp_matches(p_type, '^(PROMO|SMALL)')) GROUP BY 1")
def ignore_list(t):
    rows = t("part").where(~(lists.ignored(F.col("p_brand"), ["Brand#11"], []) | lists.ignored(F.col("p_type"), [], ["PROMO", "SMALL"])))
    return rows.groupBy("p_type").agg(F.count("*").alias("n"))


@query("WITH g AS (SELECT l_suppkey, list_sort(list(DISTINCT l_returnflag)) AS tags FROM lineitem GROUP BY 1) SELECT l_suppkey, array_to_string(tags, ',') AS tags FROM g WHERE list_contains(tags, 'R')")
def tag_union_filter(t):
    """The union of the tags of a group's members, for groups with a tag."""
    tags = t("lineitem").groupBy("l_suppkey").agg(F.array_sort(F.collect_set("l_returnflag")).alias("tags"))
    return tags.where(F.array_contains("tags", "R")).select("l_suppkey", F.array_join("tags", ",").alias("tags"))


PATH = "regexp_extract(url, '://[^/?#]*([^?#]*)', 1)"


@query(f"WITH p AS (SELECT page_id, regexp_replace('/' || {PATH} || '/', '/+', '/', 'g') AS path FROM pages WHERE url IS NOT NULL) SELECT page_id, path, CASE WHEN starts_with(path, '/en/') THEN '/gb/root/' || substr(path, 5) WHEN starts_with(path, '/de/') THEN '/at/' || substr(path, 5) ELSE path END AS told FROM p")
def path_redirect(t):
    """Paths whose beginning is replaced by whole parts."""
    rows = t("pages").where("url is not null").select("page_id", F.regexp_extract("url", "://[^/?#]*([^?#]*)", 1).alias("p"))
    return rows.select("page_id", lists.directory_path(F.col("p")).alias("path"), lists.redirect(F.col("p"), [("en", "gb/root"), ("/de/", "/at")]).alias("told"))


@query(f"WITH p AS (SELECT page_id, regexp_extract({PATH}, '^(.*)/', 1) AS directory, {PATH} AS file FROM pages WHERE url IS NOT NULL) SELECT directory, count(DISTINCT file) AS files, count(*) AS changes, min(page_id) AS first_page FROM p GROUP BY 1")
def files_by_directory(t):
    """Files and changes of each directory, with its first appearance."""
    path = F.regexp_extract("url", "://[^/?#]*([^?#]*)", 1)
    rows = t("pages").where("url is not null").select("page_id", path.alias("file"), F.regexp_extract(path, "^(.*)/", 1).alias("directory"))
    return rows.groupBy("directory").agg(F.count_distinct("file").alias("files"), F.count("*").alias("changes"), F.min("page_id").alias("first_page"))


@query("WITH n AS (SELECT s_name AS name, CAST(regexp_extract(s_name, '([0-9]+)', 1) AS BIGINT) AS k FROM supplier) SELECT * FROM (SELECT name, lead(name) OVER (ORDER BY k) AS next_name FROM n) WHERE next_name IS NOT NULL")
def checkpoint_pairs(t):
    """Each name with the next one by its number: places in two phases, then a join of neighbours."""
    names = t("supplier").select(F.col("s_name").alias("name"), F.regexp_extract("s_name", "([0-9]+)", 1).cast("long").alias("k"))
    placed = trace.running_sum(names, "k", F.lit(1).cast("long"), "place", inclusive=False)
    after = placed.select((F.col("place") - 1).alias("place"), F.col("name").alias("next_name"))
    return placed.join(after, "place").select("name", "next_name")


@query("WITH b AS (SELECT l_suppkey, count(*) FILTER (l_returnflag <> 'R') AS valid, count(*) AS pages, max(l_orderkey) AS last FROM lineitem GROUP BY 1) SELECT l_suppkey, round((pages - valid) * 1.0 * (1000000 - last) / (2 * valid), 6) AS benefit FROM b WHERE valid > 0 ORDER BY 2 DESC, 1 LIMIT 5")
def collection_cost_benefit(t):
    """The five blocks with most benefit: free share times age over twice the valid share."""
    b = t("lineitem").groupBy("l_suppkey").agg(F.count_if(F.col("l_returnflag") != "R").alias("valid"), F.count("*").alias("pages"), F.max("l_orderkey").alias("last"))
    benefit = F.round((F.col("pages") - F.col("valid")) * 1.0 * (1_000_000 - F.col("last")) / (2 * F.col("valid")), 6)
    return b.where("valid > 0").select("l_suppkey", benefit.alias("benefit")).orderBy(F.col("benefit").desc(), "l_suppkey").limit(5)


@query("WITH w AS (SELECT l_orderkey * 7 // 32 AS line, l_orderkey * 7 % 32 AS off, least(CAST(l_linenumber AS BIGINT), 32 - l_orderkey * 7 % 32) AS n FROM lineitem), m AS (SELECT line, bit_or(((1::BIGINT << CAST(n AS INT)) - 1) << CAST(off AS INT)) AS mask FROM w GROUP BY 1) SELECT line, CAST(mask AS BIGINT) AS mask, bit_count(CAST(mask AS BIGINT)) AS dirty FROM m")
def line_write_masks(t):
    """The bytes of a line that any write touches."""
    at = F.col("l_orderkey") * 7
    w = t("lineitem").select(div(at, 32).alias("line"), (at % 32).cast("int").alias("off"), F.least(F.col("l_linenumber").cast("long"), 32 - at % 32).cast("int").alias("n"))
    m = w.groupBy("line").agg(F.bit_or(F.expr("shiftleft(shiftleft(1L, n) - 1L, off)")).alias("mask"))
    return m.select("line", "mask", F.bit_count("mask").alias("dirty"))


@query("SELECT l_orderkey, CAST(max(l_linenumber * 10 + CAST(l_quantity AS BIGINT) * 2) + 100 AS BIGINT) AS finished, count(*) AS parts FROM lineitem GROUP BY 1")
def request_completion(t):
    """A request is done when its last part is, and a fixed time later."""
    done = F.max(F.col("l_linenumber") * 10 + F.col("l_quantity").cast("long") * 2) + 100
    return t("lineitem").groupBy("l_orderkey").agg(done.cast("long").alias("finished"), F.count("*").alias("parts"))


@query("""WITH r AS (SELECT c_mktsegment AS section, 'c' || c_custkey AS key, CAST(c_nationkey AS VARCHAR) AS value FROM customer), d AS (SELECT * FROM r UNION ALL SELECT DISTINCT section, 'pid', '0' FROM r WHERE regexp_matches(section, '^[A-H]'))
SELECT CASE WHEN regexp_matches(section, '^B') AND regexp_matches(key, '^c1') THEN section || '.memory' ELSE section END AS section, key, value FROM d""")
def record_upgrades(t):
    """Two versions of records: a key gets a default, then keys move to a section of their own."""
    r = t("customer").select(F.col("c_mktsegment").alias("section"), F.concat(F.lit("c"), "c_custkey").alias("key"), F.col("c_nationkey").cast("string").alias("value"))
    return lists.moved(lists.with_default(r, "^[A-H]", "pid", "0"), "^B", "^c1", ".memory")


@query(f"SELECT n_name, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(n_name) + 1), lambda k: CAST(ord(substr(n_name, k, 1)) AS BIGINT))), lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda d, k: xor(d >> 1, (d & 1) * {CRC}))) AS crc FROM nation")
def crc_polynomial(t):
    return t("nation").select("n_name", lists.crc(F.col("n_name"), CRC).alias("crc"))


def _most(width: int, pick: str) -> str:
    """SQL for the greatest or least of a line's parts of some bits."""
    edge = {"max": "greatest", "min": "least"}[pick]
    return f"{edge}(" + ", ".join(f"list_{pick}(list_transform(w, lambda x: (x >> {k}) & {(1 << width) - 1}))" for k in range(0, 64, width)) + ")"


ENCODED = f"""WITH l AS (SELECT l_orderkey, list(l_partkey * (l_linenumber % 3)) AS w FROM lineitem GROUP BY 1),
s AS (SELECT l_orderkey, CAST(len(w) AS BIGINT) AS n, list_max(w) AS hi, list_max(w) - list_min(w) AS s8, {_most(32, "max")} - {_most(32, "min")} AS s4, {_most(16, "max")} - {_most(16, "min")} AS s2 FROM l),
e AS (SELECT l_orderkey, n, 'raw' AS pattern, n * 64 AS bits FROM s UNION ALL SELECT l_orderkey, n, 'zero', 1 FROM s WHERE hi = 0 AND s8 = 0 UNION ALL SELECT l_orderkey, n, 'repeated', 64 FROM s WHERE s8 = 0
UNION ALL SELECT l_orderkey, n, 'base8_delta1', 64 + n * 8 FROM s WHERE s8 < 128 UNION ALL SELECT l_orderkey, n, 'base8_delta2', 64 + n * 16 FROM s WHERE s8 < 32768 UNION ALL SELECT l_orderkey, n, 'base8_delta4', 64 + n * 32 FROM s WHERE s8 < 2147483648
UNION ALL SELECT l_orderkey, n, 'base4_delta1', 32 + n * 16 FROM s WHERE s4 < 128 UNION ALL SELECT l_orderkey, n, 'base4_delta2', 32 + n * 32 FROM s WHERE s4 < 32768 UNION ALL SELECT l_orderkey, n, 'base2_delta1', 16 + n * 32 FROM s WHERE s2 < 128),
r AS (SELECT l_orderkey, n, pattern, bits, row_number() OVER (PARTITION BY l_orderkey ORDER BY length(bin(n * 64 // bits)) DESC, bits, pattern) AS place FROM e WHERE bits <= n * 64)"""


def _encoded(t):
    """(l_orderkey, n, pattern, bits, place): the ways to store a line, by their factor as a power of two, then by size."""
    lines = t("lineitem").groupBy("l_orderkey").agg(F.collect_list(F.col("l_partkey") * (F.col("l_linenumber") % 3)).alias("w"))
    ways = lines.select("l_orderkey", F.size("w").cast("long").alias("n"), F.explode(sets.encodings(F.col("w"))).alias("e")).select("l_orderkey", "n", "e.pattern", "e.bits")
    return sets.ranked(ways, ["l_orderkey"], [floor_log2(div(F.col("n") * 64, F.col("bits"))).desc(), F.col("bits"), F.col("pattern")])


@query(f"{ENCODED} SELECT l_orderkey, pattern, bits, place FROM r")
def line_encoding_rank(t):
    return _encoded(t).drop("n")


@query(f"{ENCODED} SELECT pattern, count(*) AS fits, count(*) FILTER (place = 1) AS best FROM r GROUP BY 1")
def line_encoding_patterns(t):
    return _encoded(t).groupBy("pattern").agg(F.count("*").alias("fits"), F.count_if(F.col("place") == 1).alias("best"))


@query(f"{ENCODED} SELECT CAST(CASE WHEN bits = 1 THEN 0 ELSE length(bin(bits - 1)) END AS BIGINT) AS class, count(*) AS n, round(avg(bits), 6) AS mean_bits FROM r WHERE place = 1 GROUP BY 1")
def line_size_classes(t):
    """Lines by the power of two that holds them, at their best encoding."""
    best = _encoded(t).where("place = 1")
    return best.groupBy(ceil_log2(F.col("bits")).cast("long").alias("class")).agg(F.count("*").alias("n"), F.round(F.avg("bits"), 6).alias("mean_bits"))

"""The library's queries over the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ravelin.functions import bits
from ravelin.operators import ranges, reuse, sets, stats, trace

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
Tables = Callable[[str], DataFrame]


def query(sql: str | None = None):
    """Registers f(t), where t(name) reads a table."""

    def add(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def catalog(t: Tables) -> DataFrame:
    """Key ranges of files on levels and channels, from the parts."""
    return t("part").select(F.col("p_partkey").alias("file"), (F.col("p_size") % 7 + 1).alias("level"), (F.col("p_partkey") % 4).cast("int").alias("channel"), F.col("p_partkey").alias("lo"), (F.col("p_partkey") + F.col("p_size")).cast("long").alias("hi"))


CATALOG = "SELECT p_partkey AS file, p_size % 7 + 1 AS level, CAST(p_partkey % 4 AS INT) AS channel, p_partkey AS lo, CAST(p_partkey + p_size AS BIGINT) AS hi FROM part"
CENTS = "CAST(round({0} * 100) AS BIGINT)"
cents = lambda c: F.round(F.col(c) * 100).cast("long")


@query("SELECT * FROM (SELECT 'rows' AS stat, CAST(count(*) AS DOUBLE) AS value FROM lineitem UNION ALL SELECT 'quantity', CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) FROM lineitem)")
def stat_scalar_counters(t):
    return stats.counters(t("lineitem"), {"rows": F.count("*"), "quantity": F.sum(F.col("l_quantity").cast("long"))})


@query('SELECT coalesce(l_returnflag, \'total\') AS "index", count(*) AS value FROM lineitem GROUP BY ROLLUP (l_returnflag)')
def stat_vector_total(t):
    return stats.vector(t("lineitem"), "l_returnflag", F.count("*"))


@query('WITH v AS (SELECT l_returnflag AS "index", count(*) AS value FROM lineitem GROUP BY 1) SELECT "index", value, round(value / sum(value) OVER (), 9) AS pdf, round(sum(value) OVER (ORDER BY "index") / sum(value) OVER (), 9) AS cdf FROM v')
def stat_vector_pdf_cdf(t):
    v = t("lineitem").groupBy(F.col("l_returnflag").alias("index")).agg(F.count("*").alias("value"))
    return stats.pdf_cdf(v).withColumns({c: F.round(c, 9) for c in ("pdf", "cdf")})


@query("SELECT l_returnflag, count(*) FILTER (l_linestatus = 'F') AS \"F\", count(*) FILTER (l_linestatus = 'O') AS \"O\" FROM lineitem GROUP BY 1")
def stat_vector2d_pivot(t):
    return t("lineitem").groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).agg(F.count(F.lit(1))).na.fill(0)


@query("SELECT CASE WHEN l_quantity < 5 THEN 'underflow' WHEN l_quantity > 45 THEN 'overflow' ELSE lpad(CAST(CAST(floor((l_quantity - 5) / 4) AS BIGINT) AS VARCHAR), 4, '0') END AS bucket, count(*) AS n FROM lineitem GROUP BY 1")
def stat_distribution(t):
    return stats.distribution(t("lineitem"), F.col("l_quantity"), 5, 45, 4)


@query("SELECT l_returnflag, round(avg(l_quantity), 6) AS mean, round(stddev_samp(l_quantity), 6) AS stdev, round(exp(avg(ln(l_quantity))), 6) AS geomean FROM lineitem GROUP BY 1")
def stat_deviation_geomean(t):
    return stats.moments(t("lineitem"), ["l_returnflag"], "l_quantity")


AUTOSCALE = """SELECT CAST(v // s AS BIGINT) AS bin, s AS bin_size, count(*) AS n FROM (
 SELECT v, CAST(pow(2, CASE WHEN max(v) OVER () // {bins} = 0 THEN 0 ELSE length(bin(max(v) OVER () // {bins})) END) AS BIGINT) AS s FROM (SELECT CAST(floor({value}) AS BIGINT) AS v FROM {table})) GROUP BY 1, 2"""


@query(AUTOSCALE.format(bins=50, value="l_extendedprice", table="lineitem"))
def hist_linear_autoscale(t):
    return stats.autoscale_histogram(t("lineitem"), F.floor("l_extendedprice"), 50)


@query("SELECT CAST(least(CASE WHEN l_partkey = 0 THEN 0 ELSE length(bin(l_partkey)) END, 11) AS BIGINT) AS bin, count(*) AS n FROM lineitem GROUP BY 1")
def hist_log2(t):
    return stats.log2_histogram(t("lineitem"), F.col("l_partkey"), 12)


@query("SELECT event_type AS value, count(*) AS n FROM events GROUP BY 1")
def hist_sparse(t):
    return stats.sparse_histogram(t("events"), F.col("event_type"))


@query(f"WITH a AS ({AUTOSCALE.format(bins=20, value='l_quantity', table='lineitem')}), b AS ({AUTOSCALE.format(bins=20, value='l_extendedprice', table='lineitem')}), u AS (SELECT * FROM a UNION ALL SELECT * FROM b) SELECT CAST(bin * bin_size // (SELECT max(bin_size) FROM u) AS BIGINT) AS bin, (SELECT max(bin_size) FROM u) AS bin_size, CAST(sum(n) AS BIGINT) AS n FROM u GROUP BY 1")
def hist_merge(t):
    return stats.merge_histograms(*(stats.autoscale_histogram(t("lineitem"), F.floor(c), 20) for c in ("l_quantity", "l_extendedprice")))


@query(f"SELECT l_linestatus, round(sum({CENTS.format('l_extendedprice')}) / nullif(sum(CAST(l_quantity AS BIGINT)), 0), 6) AS price_per_unit FROM lineitem GROUP BY 1")
def stat_formula_ratio(t):
    return t("lineitem").groupBy("l_linestatus").agg(F.round(F.try_divide(F.sum(cents("l_extendedprice")), F.sum(F.col("l_quantity").cast("long"))), 6).alias("price_per_unit"))


@query("SELECT c_mktsegment, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1 HAVING count(*) FILTER (o_orderstatus = 'O') > 0")
def stat_prereq_suppress(t):
    rows = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "O").alias("needed"))
    return rows.where("needed > 0").drop("needed")


@query(f"WITH p AS (SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS dump, count(*) AS n, CAST(sum({CENTS.format('value')}) AS BIGINT) AS total FROM events GROUP BY 1) SELECT *, CAST(sum(n) OVER (ORDER BY dump) AS BIGINT) AS running_n FROM p")
def stat_periodic_dump(t):
    return stats.periodic_dump(t("events"), "ts", cents("value"), "1 hour")


@query("SELECT p_partkey, p_type FROM part WHERE p_type LIKE 'STANDARD %' OR p_type LIKE 'PROMO%'")
def stat_name_match(t):
    named = t("part").withColumn("__name", F.when(F.col("p_type").startswith("STANDARD "), F.concat(F.lit("STANDARD."), F.lit("x"))).when(F.col("p_type").startswith("PROMO"), F.lit("PROMO")).otherwise("other.x.y"))
    return stats.match_names(named, F.col("__name"), ["STANDARD.*", "PROMO"]).select("p_partkey", "p_type")


@query("WITH l AS (SELECT r_name, n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2) SELECT r_name AS prefix, CAST(sum(n) AS BIGINT) AS value FROM l GROUP BY 1 UNION ALL SELECT r_name || '.' || n_name, n FROM l")
def stat_group_paths(t):
    rows = t("customer").join(F.broadcast(t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))), F.col("c_nationkey") == F.col("n_nationkey"))
    return stats.prefix_totals(rows, F.concat_ws(".", "r_name", "n_name"), F.count("*"))


@query("SELECT count(DISTINCT l_partkey // 4) * 4 AS line, count(DISTINCT l_partkey // 64) * 64 AS page FROM lineitem")
def trace_footprint(t):
    return trace.footprint(t("lineitem"), F.col("l_partkey"), {"line": 4, "page": 64})


@query("WITH f AS (SELECT user_id, min(event_id) AS event_id FROM events GROUP BY 1) SELECT event_id, count(*) OVER (ORDER BY event_id) AS lines FROM f")
def trace_footprint_running(t):
    return trace.running_footprint(t("events"), "user_id", "event_id")


def accesses(t: Tables) -> DataFrame:
    return t("events").select("event_id", "user_id", (F.col("user_id") % 16).alias("set"))


REUSE = """WITH e AS (SELECT event_id, user_id, user_id % 16 AS "set", lag(event_id) OVER w AS prev, lead(event_id) OVER w AS nxt FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
d AS (SELECT a."set", a.event_id, CASE WHEN a.prev IS NULL THEN NULL ELSE (SELECT count(*) FROM e q WHERE q."set" = a."set" AND q.event_id > a.prev AND q.event_id < a.event_id AND (q.nxt IS NULL OR q.nxt >= a.event_id)) END AS distance FROM e a)"""


@query(f"{REUSE} SELECT * FROM d")
def trace_reuse_distance(t):
    return reuse.reuse_distance(accesses(t), "user_id", "event_id", "set")


@query(f"{REUSE} SELECT CASE WHEN distance IS NULL THEN -1 WHEN distance = 0 THEN 1 ELSE length(bin(distance)) - 1 END AS bin, count(*) AS n FROM d GROUP BY 1")
def trace_reuse_hist(t):
    d = reuse.reuse_distance(accesses(t), "user_id", "event_id", "set")
    return d.groupBy(F.when(F.col("distance").isNull(), -1).when(F.col("distance") == 0, 1).otherwise(bits.floor_log2(F.col("distance"))).cast("long").alias("bin")).agg(F.count("*").alias("n"))


@query(f"{REUSE} SELECT \"set\", count(*) AS accesses, count(*) FILTER (distance < 4) AS hits FROM d GROUP BY 1")
def trace_lru_hits(t):
    """An access hits where fewer than 4 other keys of its set came since the last one to its key."""
    d = reuse.reuse_distance(accesses(t), "user_id", "event_id", "set")
    return d.groupBy("set").agg(F.count("*").alias("accesses"), F.count_if(F.col("distance") < 4).alias("hits"))


@query('WITH e AS (SELECT user_id % 16 AS queue, event_id, user_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS prev FROM events) SELECT a.queue, a.event_id, (SELECT count(DISTINCT q.user_id) FROM e q WHERE q.queue = a.queue AND q.event_id < a.event_id AND q.event_id > coalesce(a.prev, -1)) AS since FROM e a')
def queue_lrg(t):
    """How many others came since a key's last turn; at its first one all that were there."""
    rows = t("events").select((F.col("user_id") % 16).alias("queue"), "event_id", "user_id")
    return reuse.reuse_distance(rows, "user_id", "event_id", "queue", first=True).withColumnRenamed("distance", "since")


STRIDES = """WITH s AS (SELECT user_id, event_id, coalesce(event_id - lag(event_id) OVER w, 0) AS stride FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
c AS (SELECT *, CASE WHEN stride = lag(stride) OVER w THEN 0 ELSE 1 END AS fresh FROM s WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
r AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM c)"""


@query(f"{STRIDES} SELECT user_id, event_id, stride, row_number() OVER (PARTITION BY user_id, run ORDER BY event_id) AS times FROM r")
def trace_stride_runs(t):
    return trace.stride_runs(t("events"), "user_id", "event_id")


@query("SELECT user_id, count(*) AS total, count(*) FILTER (event_type = 'purchase') AS purchases, count(*) FILTER (event_type = 'error') AS errors FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def trace_hot_keys(t):
    return trace.hot_keys(t("events"), "user_id", {"purchases": F.col("event_type") == "purchase", "errors": F.col("event_type") == "error"}, 20)


@query("SELECT coalesce(l_returnflag, '*') AS flag, coalesce(l_linestatus, '*') AS status, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), (l_returnflag, l_linestatus), ())")
def trace_profile_grouping_sets(t):
    return t("lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n")).select(F.coalesce("l_returnflag", F.lit("*")).alias("flag"), F.coalesce("l_linestatus", F.lit("*")).alias("status"), "n")


@query("WITH g AS (SELECT event_type, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS gap FROM events) SELECT event_type, count(*) AS n, min(gap) AS least, max(gap) AS most FROM g WHERE gap IS NOT NULL GROUP BY 1")
def trace_inter_arrival(t):
    return trace.inter_arrival(t("events"), ["user_id"], "event_type", "ts", "event_id")


def requests(t: Tables) -> DataFrame:
    return t("lineitem").select("l_suppkey", (F.col("l_orderkey") * 7 + F.col("l_linenumber")).alias("start"), (F.col("l_orderkey") * 7 + F.col("l_linenumber") + F.col("l_quantity").cast("long")).alias("end"))


REQUESTS = 'SELECT l_suppkey, l_orderkey * 7 + l_linenumber AS "start", l_orderkey * 7 + l_linenumber + CAST(l_quantity AS BIGINT) AS "end" FROM lineitem'


@query(f'WITH r AS ({REQUESTS}), s AS (SELECT l_suppkey, "start" AS t, 1 AS d FROM r UNION ALL SELECT l_suppkey, "end", -1 FROM r), g AS (SELECT l_suppkey, t, sum(d) AS d FROM s GROUP BY 1, 2), o AS (SELECT l_suppkey, sum(d) OVER (PARTITION BY l_suppkey ORDER BY t) AS open FROM g) SELECT l_suppkey, CAST(max(open) AS BIGINT) AS most FROM o GROUP BY 1')
def trace_outstanding(t):
    return trace.outstanding(requests(t), ["l_suppkey"], F.col("start"), F.col("end"))


@query(f'WITH r AS ({REQUESTS}), n AS (SELECT *, CASE WHEN max("end") OVER (PARTITION BY l_suppkey ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= "start" THEN 0 ELSE 1 END AS fresh FROM r), i AS (SELECT *, sum(fresh) OVER (PARTITION BY l_suppkey ORDER BY "start", "end" ROWS UNBOUNDED PRECEDING) AS island FROM n), m AS (SELECT l_suppkey, island, max("end") - min("start") AS len FROM i GROUP BY 1, 2) SELECT l_suppkey, CAST(sum(len) AS BIGINT) AS busy, count(*) AS slots FROM m GROUP BY 1')
def busy_time_union(t):
    return trace.busy_time(requests(t), ["l_suppkey"], "start", "end")


@query("SELECT user_id, event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 7 PRECEDING AND CURRENT ROW), 6) AS mean FROM events")
def trace_rolling_mean(t):
    return trace.rolling_mean(t("events"), ["user_id"], ["event_id"], "value", 8)


@query("""WITH r AS (SELECT user_id, event_id, coalesce(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM events),
k AS (SELECT user_id, b, count(*) AS block_size FROM r GROUP BY 1, 2), c AS (SELECT *, row_number() OVER w AS n, sum(block_size) OVER w AS s FROM k WINDOW w AS (PARTITION BY user_id ORDER BY b)),
m AS (SELECT *, n + least(0, min(s // 8 - n) OVER (PARTITION BY user_id ORDER BY b)) AS closed FROM c), i AS (SELECT user_id, block_size, CAST(coalesce(lag(closed) OVER (PARTITION BY user_id ORDER BY b), 0) AS BIGINT) AS "interval" FROM m) SELECT user_id, "interval", block_size, count(*) AS blocks FROM i GROUP BY ALL""")
def trace_bbv_intervals(t):
    return trace.block_intervals(t("events"), ["user_id"], "event_id", F.col("event_type") == "purchase", 8)


@query("""WITH g AS (SELECT user_id, event_id, ts, epoch_us(ts) AS t, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) <= 1800000000 THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, CAST(sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS session FROM g) SELECT user_id, session, count(*) AS n, max(t) - min(t) AS length FROM s GROUP BY 1, 2""")
def trace_store_sessions(t):
    return trace.sessions(t("events"), ["user_id"], "ts", "event_id", 1800)


@query("WITH p AS (SELECT conv_id, list(role ORDER BY turn, role) AS p FROM conversations GROUP BY 1) SELECT path, count(*) AS calls FROM (SELECT unnest([array_to_string(p[1:n], '/') FOR n IN range(1, len(p) + 1)]) AS path FROM p) GROUP BY 1")
def trace_call_tree(t):
    return trace.call_tree(t("conversations"), "conv_id", "turn", F.col("role"))


@query(f"SELECT user_id, event_id, CAST(sum({CENTS.format('value')}) OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS \"at\" FROM events")
def trace_replay_elastic(t):
    return trace.replay(t("events"), ["user_id"], ["event_id"], cents("value"))


@query("SELECT event_id, CASE event_type WHEN 'click' THEN 'r' WHEN 'purchase' THEN 'w' ELSE 'u' END AS cmd, c_name AS master FROM events LEFT JOIN customer ON user_id = c_custkey")
def trace_decode_cmd(t):
    cmd = F.when(F.col("event_type") == "click", "r").when(F.col("event_type") == "purchase", "w").otherwise("u")
    return t("events").join(t("customer"), F.col("user_id") == F.col("c_custkey"), "left").select("event_id", cmd.alias("cmd"), F.col("c_name").alias("master"))


@query("WITH s AS (SELECT DISTINCT user_id, CAST(epoch_us(ts) // 60000000 AS BIGINT) AS second FROM events) SELECT *, count(*) OVER (PARTITION BY user_id ORDER BY second RANGE BETWEEN 59 PRECEDING AND CURRENT ROW) AS active FROM s")
def sliding_activity(t):
    return trace.activity(t("events"), ["user_id"], bits.div(F.unix_micros(F.col("ts").cast("timestamp")), 60_000_000), 60)


@query(f"WITH c AS ({CATALOG}) SELECT l_orderkey, l_linenumber, l_partkey, count(*) AS n, min(level) AS first_level FROM lineitem JOIN c ON l_partkey BETWEEN lo AND hi GROUP BY ALL")
def range_point_lookup(t):
    points = t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    keys = ranges.point_in_range(points.select("l_partkey").distinct(), catalog(t), "l_partkey", "lo", "hi", 64).groupBy("l_partkey").agg(F.count("*").alias("__n"), F.min("level").alias("first_level"))
    return points.groupBy("l_orderkey", "l_linenumber", "l_partkey").agg(F.count("*").alias("__r")).join(keys, "l_partkey").select("l_orderkey", "l_linenumber", "l_partkey", (F.col("__n") * F.col("__r")).alias("n"), "first_level")


@query(f"WITH c AS ({CATALOG}) SELECT a.file, b.file AS other FROM c a JOIN c b ON a.lo <= b.hi AND a.hi >= b.lo AND a.file < b.file")
def range_overlap_pairs(t):
    b = catalog(t).select(F.col("file").alias("other"), F.col("lo").alias("olo"), F.col("hi").alias("ohi"))
    return ranges.overlaps(catalog(t).select("file", "lo", "hi"), b, ("lo", "olo"), ("hi", "ohi"), 32).where("file < other").select("file", "other")


@query(f"WITH c AS ({CATALOG}) SELECT a.file AS parent, b.file AS child FROM c a JOIN c b ON a.lo <= b.hi AND a.hi >= b.lo AND b.level = a.level + 1")
def range_level_links(t):
    return ranges.level_links(catalog(t), 32)


RELATED = f"""WITH c AS ({CATALOG}), r AS (SELECT a.file, b.channel FROM c a JOIN c b ON a.lo <= b.hi AND a.hi >= b.lo AND a.level <> b.level
UNION ALL SELECT file, lag(channel) OVER (PARTITION BY level ORDER BY lo, hi, file) FROM c UNION ALL SELECT file, lead(channel) OVER (PARTITION BY level ORDER BY lo, hi, file) FROM c),
n AS (SELECT file, channel, count(*) AS n FROM r WHERE channel IS NOT NULL GROUP BY 1, 2)"""


@query(f"{RELATED} SELECT * FROM n")
def lsm_related_channels(t):
    return ranges.related_channels(catalog(t))


@query(f"{RELATED} SELECT file, CAST(arg_min(ch, (n, ch)) AS INT) AS channel FROM (SELECT c.file, g.ch, coalesce(n.n, 0) AS n FROM c CROSS JOIN (SELECT unnest(range(4)) AS ch) g LEFT JOIN n ON n.file = c.file AND n.channel = g.ch) GROUP BY 1")
def lsm_placement(t):
    return ranges.place(catalog(t), 4)


@query("SELECT l_partkey, max(l_orderkey) AS seq FROM lineitem GROUP BY 1 HAVING arg_max(l_returnflag, (l_orderkey, l_returnflag)) <> 'R'")
def lsm_latest_version(t):
    rows = t("lineitem").select("l_partkey", F.col("l_orderkey").alias("seq"), "l_returnflag")
    return ranges.latest_version(rows, ["l_partkey"], [F.col("seq").desc(), F.col("l_returnflag").desc()], F.col("l_returnflag") == "R").drop("l_returnflag")


@query("SELECT p_partkey, (row_number() OVER (ORDER BY p_partkey) - 1) // 255 AS page, (row_number() OVER (ORDER BY p_partkey) - 1) % 255 AS slot FROM part")
def lsm_catalog_pages(t):
    numbered = trace.running_sum(t("part").select("p_partkey"), "p_partkey", F.lit(1).cast("long"), "n", inclusive=False)
    return numbered.select("p_partkey", bits.div(F.col("n"), 255).alias("page"), (F.col("n") % 255).alias("slot"))


@query("SELECT DISTINCT l_partkey, (l_partkey >> 9) % 4 AS channel, (l_partkey >> 7) % 4 AS package, (l_partkey >> 6) % 2 AS die, (l_partkey >> 5) % 2 AS plane FROM lineitem")
def lsm_block_decompose(t):
    parts = bits.block_parts(F.col("l_partkey"), {"channel": (9, 4), "package": (7, 4), "die": (6, 2), "plane": (5, 2)})
    return t("lineitem").select("l_partkey").distinct().select("l_partkey", *(v.alias(k) for k, v in parts.items()))


@query("WITH s AS (SELECT user_id, event_id AS at, event_type FROM events WHERE event_type <> 'click') SELECT e.user_id, e.event_id, s.event_type AS symbol FROM events e ASOF LEFT JOIN s ON e.user_id = s.user_id AND e.event_id >= s.at")
def asof_nearest(t):
    left = t("events").select("user_id", "event_id")
    right = t("events").where("event_type <> 'click'").select("user_id", F.col("event_id").alias("at"), F.col("event_type").alias("symbol"))
    return ranges.as_of(left, right, "user_id", "event_id", "at", "symbol", "symbol")


@query("WITH p AS (SELECT substr(p_brand, 1, 6) AS pre, count(*) AS v FROM part GROUP BY 1 UNION ALL SELECT p_brand, count(*) FROM part WHERE p_brand LIKE '%1' OR length(p_brand) = 6 GROUP BY 1), k AS (SELECT DISTINCT p_brand FROM part) SELECT p_brand, arg_min(v, length(pre)) AS entry FROM k LEFT JOIN p ON starts_with(p_brand, pre) AND length(pre) BETWEEN 6 AND 8 AND pre LIKE '%1' GROUP BY 1")
def prefix_lookup(t):
    brands = t("part")
    entries = brands.groupBy(F.substring("p_brand", 1, 6).alias("pre")).agg(F.count("*").alias("v")).unionByName(brands.where(F.col("p_brand").endswith("1") | (F.length("p_brand") == 6)).groupBy(F.col("p_brand").alias("pre")).agg(F.count("*").alias("v")))
    return ranges.shortest_prefix(brands.select("p_brand").distinct(), entries.where(F.col("pre").endswith("1")), "p_brand", "pre", "v", [6, 7, 8]).withColumnRenamed("v", "entry")


@query("WITH r AS (SELECT p_partkey AS rank, p_partkey * 3 AS lo, p_partkey * 3 + 4 AS hi, p_partkey * 1000 AS \"to\" FROM part WHERE p_size > 25), a AS (SELECT DISTINCT l_orderkey AS addr FROM lineitem) SELECT addr, coalesce((SELECT arg_min(addr - lo + \"to\", rank) FROM r WHERE addr BETWEEN lo AND hi), addr) AS mapped FROM a")
def range_remap_first_match(t):
    rules = t("part").where("p_size > 25").select(F.col("p_partkey").alias("rank"), (F.col("p_partkey") * 3).alias("lo"), (F.col("p_partkey") * 3 + 4).alias("hi"), (F.col("p_partkey") * 1000).alias("to"))
    return ranges.remap(t("lineitem").select(F.col("l_orderkey").alias("addr")).distinct(), "addr", rules, 64)


@query("WITH r AS (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey AS a, CAST(l_quantity AS BIGINT) AS s FROM lineitem WHERE l_quantity >= 1), k AS (SELECT *, unnest(range(a // 16, (a + s - 1) // 16 + 1)) AS k FROM r) SELECT l_orderkey, l_linenumber, greatest(a, k * 16) AS \"start\", least(a + s, (k + 1) * 16) - greatest(a, k * 16) AS size FROM k")
def chunk_split(t):
    regions = t("lineitem").where("l_quantity >= 1").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").cast("long").alias("s")).distinct()
    return regions.select("l_orderkey", "l_linenumber", F.explode(bits.chunks(F.col("l_partkey"), F.col("s"), 16)).alias("c")).select("l_orderkey", "l_linenumber", "c.start", "c.size")


@query("SELECT coalesce(p.k, c.k) AS k, CASE WHEN c.k IS NOT NULL THEN c.v ELSE p.v END AS v FROM (SELECT c_custkey AS k, c_name AS v FROM customer) p FULL JOIN (SELECT s_suppkey AS k, s_name AS v, s_suppkey % 5 = 0 AS d FROM supplier) c ON p.k = c.k WHERE NOT coalesce(c.d, false)")
def overlay_dictionary(t):
    return ranges.overlay(t("customer").selectExpr("c_custkey AS k", "c_name AS v"), t("supplier").selectExpr("s_suppkey AS k", "s_name AS v", "s_suppkey % 5 = 0 AS d"), "k", "v", "d")


@query("WITH a AS (SELECT c_custkey AS k FROM customer), b AS (SELECT o_custkey AS k FROM orders) SELECT 'both' AS op, count(*) AS n FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'first', count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT 'any', count(*) FROM (SELECT * FROM a UNION SELECT * FROM b)")
def set_ops(t):
    a, b = t("customer").selectExpr("c_custkey AS k"), t("orders").selectExpr("o_custkey AS k")
    parts = {"both": a.intersect(b), "first": a.subtract(b), "any": a.union(b).distinct()}
    out = None
    for name, df in parts.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("op"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT l_suppkey, list_sort(list(DISTINCT l_returnflag)) = ['A', 'N', 'R'] AS has_all, CAST(len(list(DISTINCT l_returnflag)) AS BIGINT) AS kinds, list_contains(list(DISTINCT l_returnflag), 'R') AS has_r FROM lineitem GROUP BY 1")
def array_set_ops(t):
    flags = t("lineitem").groupBy("l_suppkey").agg(F.collect_set("l_returnflag").alias("f"))
    whole = F.array(*map(F.lit, "ANR"))
    return flags.select("l_suppkey", ((F.size(F.array_except(whole, "f")) == 0) & (F.size(F.array_except("f", whole)) == 0)).alias("has_all"), F.size("f").cast("long").alias("kinds"), F.array_contains("f", "R").alias("has_r"))


@query("SELECT l_linestatus, CAST(sum(CASE l_returnflag WHEN 'A' THEN 5 WHEN 'N' THEN 2 ELSE 0 END * CAST(l_quantity AS BIGINT)) AS BIGINT) AS power FROM lineitem GROUP BY 1")
def weighted_state_power(t):
    weight = F.when(F.col("l_returnflag") == "A", 5).when(F.col("l_returnflag") == "N", 2).otherwise(0)
    return t("lineitem").groupBy("l_linestatus").agg(F.sum(weight * F.col("l_quantity").cast("long")).alias("power"))


@query("SELECT l_partkey, CAST(max((l_partkey + (l_partkey + 63) // 64 * 24) * 125) AS BIGINT) AS delay FROM lineitem GROUP BY 1")
def link_delay(t):
    return t("lineitem").groupBy("l_partkey").agg(F.max(bits.link_delay(F.col("l_partkey"), 64, 24, 125)).alias("delay"))


@query("SELECT event_id % 10 AS cell, min(value) AS value FROM events GROUP BY 1")
def report_min_over_repeats(t):
    return stats.least_over_repeats(t("events"), F.col("event_id"), 10, F.col("value"))


@query("SELECT l_suppkey, bit_and(l_partkey) AS all_bits, bit_or(l_partkey) AS any_bits, bit_xor(l_partkey) AS odd_bits, min(l_partkey) AS least, max(l_partkey) AS most FROM lineitem GROUP BY 1")
def rmw_folds(t):
    return t("lineitem").groupBy("l_suppkey").agg(F.bit_and("l_partkey").alias("all_bits"), F.bit_or("l_partkey").alias("any_bits"), F.bit_xor("l_partkey").alias("odd_bits"), F.min("l_partkey").alias("least"), F.max("l_partkey").alias("most"))


@query("WITH c AS (SELECT CASE WHEN regexp_matches(text, '[{};]') THEN 'code' WHEN regexp_matches(text, '[0-9]') THEN 'digits' ELSE 'other' END AS category, count(*) AS n FROM documents GROUP BY 1) SELECT category, n, round(n * 100.0 / sum(n) OVER (), 6) AS share FROM c")
def report_category_share(t):
    return stats.categories(t("documents"), F.coalesce("text", F.lit("")), [("code", "[{};]"), ("digits", "[0-9]")])


@query("SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages")
def report_scrape_regex(t):
    return t("pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))


@query("SELECT o_orderkey, CAST(coalesce(sum(o_custkey) OVER (ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS base FROM orders")
def checkpoint_relocate(t):
    return trace.running_sum(t("orders").select("o_orderkey", "o_custkey"), "o_orderkey", F.col("o_custkey"), "base", inclusive=False).select("o_orderkey", "base")


@query("SELECT user_id, event_id, event_id + d AS prefetch FROM events, (SELECT unnest(range(1, 4)) AS d)")
def prefetch_next_line(t):
    return t("events").select("user_id", "event_id", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("d")).select("user_id", "event_id", (F.col("event_id") + F.col("d")).alias("prefetch"))






def stream_periodic_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours that the watermark has passed; the last one stays open."""
    from ravelin.streaming import jobs

    events = jobs.ordered_stream(spark, f"{sf_dir}/events.parquet", "ts").withColumn("cents", cents("value"))
    return jobs.drained(jobs.periodic_dump(events, "ts", "cents", "1 hour", "0 seconds"), "dump")


QUERIES |= {"stream_periodic_dump": stream_periodic_dump}
ORACLE_SQL["stream_periodic_dump"] = f"SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS dump, count(*) AS n, CAST(sum({CENTS.format('value')}) AS BIGINT) AS total FROM events GROUP BY 1 HAVING epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) + 3600000000 <= (SELECT epoch_us(max(ts)) FROM events)"


def _by(name: str, sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def bloom_semi_join(t):
    """The filter first, then the exact join on what it lets through."""
    keys = t("customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    orders = t("orders").select("o_orderkey", "o_custkey")
    return sets.bloom_semi_join(orders, "o_custkey", sets.bloom_words(keys, "o_custkey")).join(keys, "o_custkey", "left_semi").select("o_orderkey", "o_custkey")


@query('WITH d AS (SELECT DISTINCT event_id AS seq, unnest([event_id - user_id % 5, event_id - 2 - user_id % 40]) AS dep FROM events) SELECT seq, dep, seq - dep AS distance FROM d WHERE dep < seq AND seq - dep <= 32 AND dep IN (SELECT event_id FROM events)')
def trace_dependency_edges(t):
    rows = t("events").select(F.col("event_id").alias("seq"), F.array(F.col("event_id") - F.col("user_id") % 5, F.col("event_id") - 2 - F.col("user_id") % 40).alias("deps"))
    return sets.dependency_edges(rows, "seq", "deps", 32)


@query("SELECT l_suppkey, count(*) AS valid FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1 ORDER BY 2, 1 LIMIT 5")
def collection_victims(t):
    return sets.collection_victims(t("lineitem").where("l_returnflag <> 'R'").groupBy("l_suppkey").agg(F.count("*").alias("valid")), "valid", "l_suppkey", 5)


@query("WITH e AS (SELECT l_returnflag, l_suppkey, count(*) AS n FROM lineitem GROUP BY 1, 2) SELECT l_returnflag, round(pow(sum(n), 2) / (count(*) * sum(n * n)), 9) AS evenness FROM e GROUP BY 1")
def wear_evenness(t):
    return sets.wear_evenness(t("lineitem").groupBy("l_returnflag", "l_suppkey").agg(F.count("*").alias("n")), ["l_returnflag"], "n")


LINES = "SELECT l_orderkey, list(l_partkey * l_linenumber) AS w FROM lineitem GROUP BY 1"


@query(f"WITH s AS (SELECT l_orderkey, len(w) AS n, list_max(w) AS hi, list_min(w) AS lo FROM ({LINES})) SELECT l_orderkey, CAST(least(CASE WHEN hi = 0 AND lo = 0 THEN 1 ELSE n * 64 END, CASE WHEN hi = lo THEN 64 ELSE n * 64 END, CASE WHEN hi - lo < 128 THEN 64 + n * 8 ELSE n * 64 END, CASE WHEN hi - lo < 32768 THEN 64 + n * 16 ELSE n * 64 END, CASE WHEN hi - lo < 2147483648 THEN 64 + n * 32 ELSE n * 64 END, n * 64) AS BIGINT) AS bits FROM s")
def compressed_sizes(t):
    """Lines of 64-bit words: the words of an order."""
    lines = t("lineitem").groupBy("l_orderkey").agg(F.collect_list(F.col("l_partkey") * F.col("l_linenumber")).alias("w"))
    return sets.compressed_sizes(lines, F.col("w")).select("l_orderkey", "bits")


@query("WITH c AS (SELECT l_suppkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY 1, 2) SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY n DESC, l_returnflag) AS place FROM c")
def compressor_rank(t):
    counts = t("lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.count("*").alias("n"))
    return sets.ranked(counts, ["l_suppkey"], [F.col("n").desc(), F.col("l_returnflag")])


PATHS = "SELECT DISTINCT s_nationkey AS a, (s_nationkey * 7 + s_suppkey) % 25 AS b, s_suppkey % 9 + 1 AS w FROM supplier"


@_by("topology_shortest_paths", f"WITH RECURSIVE e AS (SELECT a, b, min(w) AS w FROM ({PATHS}) GROUP BY 1, 2), p(source, node, cost, hops) AS (SELECT CAST(n_nationkey AS BIGINT), CAST(n_nationkey AS BIGINT), 0::BIGINT, 0 FROM nation UNION SELECT p.source, CAST(e.b AS BIGINT), CAST(p.cost + e.w AS BIGINT), p.hops + 1 FROM p JOIN e ON p.node = e.a WHERE p.hops < 12) SELECT source, node, min(cost) AS cost FROM p GROUP BY 1, 2")
def topology_shortest_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ravelin.streaming.jobs import stream_folder

    folder = stream_folder(spark)

    def staged(df: DataFrame) -> DataFrame:
        path = f"{folder}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    suppliers, nations = spark.read.parquet(f"{sf_dir}/supplier.parquet"), spark.read.parquet(f"{sf_dir}/nation.parquet")
    edges = suppliers.select(F.col("s_nationkey").cast("long").alias("a"), ((F.col("s_nationkey") * 7 + F.col("s_suppkey")) % 25).cast("long").alias("b"), (F.col("s_suppkey") % 9 + 1).cast("long").alias("w"))
    return sets.shortest_paths(edges, nations.select(F.col("n_nationkey").cast("long").alias("source")), None, staged)

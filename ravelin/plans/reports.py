"""Queries on reports, samples, names, bit sets and parameter lists, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ravelin.functions.bits import div
from ravelin.operators import ranges, trace
from ravelin.plans.catalogue import query


@query("""WITH v AS (SELECT l_returnflag AS i, count(*) AS n FROM lineitem GROUP BY 1), m AS (SELECT round(avg(l_quantity), 2) AS mean FROM lineitem)
SELECT 'VECTOR items[' || i || '] ' || n AS line FROM v UNION ALL SELECT 'VTOTAL items ' || CAST(sum(n) AS BIGINT) FROM v UNION ALL SELECT 'SCALAR quantity ' || CASE WHEN mean = floor(mean) THEN CAST(CAST(mean AS BIGINT) AS VARCHAR) ELSE printf('%.6f', mean) END FROM m""")
def stat_flat_dump(t):
    """A line for each value: whole numbers as integers, others with six places."""
    items = t("lineitem").rollup("l_returnflag").agg(F.count("*").alias("n"), F.grouping("l_returnflag").alias("g"))
    lines = items.select(F.when(F.col("g") == 1, F.concat(F.lit("VTOTAL items "), "n")).otherwise(F.concat(F.lit("VECTOR items["), "l_returnflag", F.lit("] "), "n")).alias("line"))
    mean = t("lineitem").agg(F.round(F.avg("l_quantity"), 2).alias("m"))
    number = F.when(F.col("m") == F.floor("m"), F.col("m").cast("long").cast("string")).otherwise(F.format_string("%.6f", "m"))
    return lines.unionByName(mean.select(F.concat(F.lit("SCALAR quantity "), number).alias("line")))


@query("SELECT event_id, user_id FROM events WHERE event_type = 'click'")
def trace_read_filter(t):
    return t("events").where("event_type = 'click'").select("event_id", "user_id")


@query("SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events) WHERE n % 5 <> 0")
def trace_warmup_filter(t):
    """Every fifth sample of a key is warm-up and goes."""
    numbered = t("events").withColumn("n", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")))
    return numbered.where("n % 5 <> 0").select("user_id", "event_id", "value")


@query("WITH n AS (SELECT event_id, (row_number() OVER (ORDER BY event_id) - 1) // 1000 AS batch FROM events) SELECT batch, count(*) AS n, min(event_id) AS first_id, max(event_id) AS last_id FROM n GROUP BY 1")
def trace_count_batches(t):
    """Batches of 1000 rows of the trace, numbered in two phases."""
    numbered = trace.running_sum(t("events").select("event_id"), "event_id", F.lit(1).cast("long"), "before", inclusive=False)
    return numbered.groupBy(div(F.col("before"), 1000).alias("batch")).agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"))


@query("WITH f AS (SELECT user_id, min(event_id) AS first_id FROM events GROUP BY 1) SELECT user_id, row_number() OVER (ORDER BY first_id) - 1 AS dense_id FROM f")
def trace_first_seen_ids(t):
    """Keys numbered in order of their first use."""
    first = t("events").groupBy("user_id").agg(F.min("event_id").alias("first_id"))
    return trace.running_sum(first, "first_id", F.lit(1).cast("long"), "dense_id", inclusive=False).select("user_id", "dense_id")


@query("SELECT l_returnflag, round(count(*) / 1000.0, 6) AS per_thousand, round(count(*) * 1.0 / max(l_quantity), 6) AS per_quantity FROM lineitem GROUP BY 1")
def stat_vector_normalised(t):
    return t("lineitem").groupBy("l_returnflag").agg(F.round(F.count("*") / 1000.0, 6).alias("per_thousand"), F.round(F.count("*") / F.max("l_quantity"), 6).alias("per_quantity"))


@query("SELECT DISTINCT l_partkey, bit_count(l_partkey) AS ones, ((l_partkey & 255) << 24) | ((l_partkey & 65280) << 8) | ((l_partkey >> 8) & 65280) | ((l_partkey >> 24) & 255) AS swapped, l_linenumber * l_linenumber * l_linenumber AS cube, l_linenumber FROM lineitem")
def bits_count_swap_power(t):
    """Ones of a number, its four bytes in reverse order, and a power."""
    x = F.col("l_partkey")
    swapped = F.shiftleft(x.bitwiseAND(255), 24).bitwiseOR(F.shiftleft(x.bitwiseAND(65280), 8)).bitwiseOR(F.shiftright(x, 8).bitwiseAND(65280)).bitwiseOR(F.shiftright(x, 24).bitwiseAND(255))
    rows = t("lineitem").select("l_partkey", "l_linenumber").distinct()
    return rows.select("l_partkey", "l_linenumber", F.bit_count(x).alias("ones"), swapped.alias("swapped"), F.pow("l_linenumber", F.lit(3)).cast("long").alias("cube"))


@query("SELECT event_id, CAST(round(value * 1000000) AS BIGINT) AS ticks, CAST(round(value * 1000000) AS BIGINT) / 1000000.0 AS seconds FROM events")
def tick_conversion(t):
    ticks = F.round(F.col("value") * 1_000_000).cast("long")
    return t("events").select("event_id", ticks.alias("ticks"), (ticks / 1_000_000.0).alias("seconds"))


@query("SELECT p_partkey, p_brand FROM part WHERE p_partkey >= 50 AND p_partkey < 150")
def ordered_dict_range(t):
    """Entries of an ordered dictionary from a key on and before another: the bounds reach the scan."""
    return t("part").where("p_partkey >= 50 AND p_partkey < 150").select("p_partkey", "p_brand")


@query("WITH s AS (SELECT p_partkey * 7 AS addr, 'f' || p_partkey AS symbol FROM part), a AS (SELECT DISTINCT l_orderkey AS addr FROM lineitem) SELECT a.addr, s.symbol, b.addr AS back FROM a JOIN s USING (addr) JOIN s b USING (symbol)")
def symbol_both_ways(t):
    """Exact look-ups of a symbol table, by address and back by name."""
    symbols = t("part").select((F.col("p_partkey") * 7).alias("addr"), F.concat(F.lit("f"), "p_partkey").alias("symbol"))
    found = t("lineitem").select(F.col("l_orderkey").alias("addr")).distinct().join(symbols, "addr")
    return found.join(symbols.select("symbol", F.col("addr").alias("back")), "symbol").select("addr", "symbol", "back")


@query("WITH s AS (SELECT user_id, event_id AS at, event_type FROM events WHERE event_type <> 'click'), p AS (SELECT e.user_id, s.event_type AS symbol FROM events e ASOF LEFT JOIN s ON e.user_id = s.user_id AND e.event_id >= s.at) SELECT coalesce(symbol, 'unknown') AS symbol, count(*) AS samples, count(DISTINCT user_id) AS callers FROM p GROUP BY 1")
def trace_symbol_samples(t):
    """Samples counted by the nearest symbol at or before each."""
    right = t("events").where("event_type <> 'click'").select("user_id", F.col("event_id").alias("at"), F.col("event_type").alias("symbol"))
    told = ranges.as_of(t("events").select("user_id", "event_id"), right, "user_id", "event_id", "at", "symbol", "symbol")
    return told.groupBy(F.coalesce("symbol", F.lit("unknown")).alias("symbol")).agg(F.count("*").alias("samples"), F.count_distinct("user_id").alias("callers"))


@query("WITH p AS (SELECT page_id, unnest(string_split(regexp_extract(url, '[?]([^#]*)', 1), '&')) AS pair FROM pages WHERE url IS NOT NULL) SELECT page_id, split_part(pair, '=', 1) AS name, CASE WHEN contains(pair, '=') THEN substr(pair, instr(pair, '=') + 1) END AS value FROM p WHERE pair <> ''")
def parameter_list(t):
    """name=value lists, as rows; a name without = has no value."""
    pairs = t("pages").where("url is not null").select("page_id", F.explode(F.split(F.regexp_extract("url", "[?]([^#]*)", 1), "&")).alias("pair")).where("pair <> ''")
    at = F.locate("=", "pair")
    return pairs.select("page_id", F.substring_index("pair", "=", 1).alias("name"), F.when(at > 0, F.col("pair").substr(at + 1, F.length("pair"))).alias("value"))


@query("WITH g AS (SELECT l_suppkey % 5 AS row_no, l_linenumber, count(*) AS n, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS q FROM lineitem GROUP BY 1, 2) SELECT row_no, " + ", ".join(f"max(CASE WHEN l_linenumber = {k} THEN round(n * 1.0 / q, 6) END) AS e{k}" for k in (1, 2, 3)) + " FROM g GROUP BY 1")
def sweep_grid(t):
    """A sweep's runs as a grid, with a ratio derived in each cell."""
    cells = t("lineitem").groupBy((F.col("l_suppkey") % 5).alias("row_no")).pivot("l_linenumber", [1, 2, 3]).agg(F.round(F.try_divide(F.count(F.lit(1)), F.sum(F.col("l_quantity").cast("long"))), 6))
    return cells.select("row_no", *(F.col(str(k)).alias(f"e{k}") for k in (1, 2, 3)))


@query("SELECT p_type, row_number() OVER (ORDER BY string_split(p_type, ' ')[1], string_split(p_type, ' ')[2], string_split(p_type, ' ')[3]) AS place FROM (SELECT DISTINCT p_type FROM part)")
def stat_name_order(t):
    """Names in order of their parts, one after the other; a name for each row of a small vocabulary."""
    names = t("part").select("p_type").distinct()
    parts = F.split("p_type", " ")
    return names.withColumn("place", F.row_number().over(Window.orderBy(*(F.get(parts, F.lit(k)) for k in range(3)))).cast("long"))


@query("SELECT DISTINCT p_type, split_part(p_type, ' ', 1) AS first_part, array_to_string(string_split(p_type, ' ')[2:], ' ') AS rest, string_split(p_type, ' ')[-1] AS last_part FROM part WHERE p_type LIKE 'S%' OR p_type LIKE 'PROMO%'")
def name_prefix_and_parts(t):
    """Names with one of the prefixes, split at their first and last separator."""
    parts = F.split("p_type", " ")
    rows = t("part").where(F.col("p_type").startswith("S") | F.col("p_type").startswith("PROMO")).select("p_type").distinct()
    return rows.select("p_type", F.substring_index("p_type", " ", 1).alias("first_part"), F.array_join(F.slice(parts, 2, F.size(parts)), " ").alias("rest"), F.substring_index("p_type", " ", -1).alias("last_part"))


@query("WITH m AS (SELECT l_suppkey, bit_or(1 << CAST(l_linenumber AS INT)) AS a, bit_or(1 << CAST(l_partkey % 8 AS INT)) AS b FROM lineitem GROUP BY 1) SELECT l_suppkey, CAST(a & b AS BIGINT) AS both_bits, CAST(a | b AS BIGINT) AS any_bits, CAST(xor(a, b) AS BIGINT) AS odd_bits, CAST(255 & ~a AS BIGINT) AS flipped, bit_count(CAST(a & b AS BIGINT)) AS n, a = 254 AS is_all FROM m")
def bitset_ops(t):
    bit = lambda c: F.bit_or(F.expr(f"shiftleft(1L, cast({c} as int))"))
    m = t("lineitem").groupBy("l_suppkey").agg(bit("l_linenumber").alias("a"), bit("l_partkey % 8").alias("b"))
    a, b = F.col("a"), F.col("b")
    return m.select("l_suppkey", a.bitwiseAND(b).alias("both_bits"), a.bitwiseOR(b).alias("any_bits"), a.bitwiseXOR(b).alias("odd_bits"), F.bitwise_not(a).bitwiseAND(255).alias("flipped"), F.bit_count(a.bitwiseAND(b)).alias("n"), (a == 254).alias("is_all"))


@query("SELECT l_suppkey, min(l_partkey) AS smallest, arg_min(l_orderkey, (l_partkey, l_orderkey)) AS entry FROM lineitem GROUP BY 1")
def smallest_entry(t):
    """The entry that a sorted mapping gives out first."""
    return t("lineitem").groupBy("l_suppkey").agg(F.min("l_partkey").alias("smallest"), F.min_by("l_orderkey", F.struct("l_partkey", "l_orderkey")).alias("entry"))


@query("""WITH b AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2), d AS (SELECT *, dense_rank() OVER (ORDER BY event_type) AS id FROM b)
SELECT user_id, 'T' || string_agg(':' || id || ':' || n, ' ' ORDER BY id) AS line FROM d GROUP BY 1""")
def bbv_lines(t):
    """A line of :id:count entries for each interval; ids are those of a small vocabulary."""
    counts = t("events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    ids = t("events").select("event_type").distinct().withColumn("id", F.row_number().over(Window.orderBy("event_type")))
    entries = counts.join(ids, "event_type").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("id", "n"))).alias("e"))
    return entries.select("user_id", F.concat(F.lit("T"), F.array_join(F.transform("e", lambda x: F.concat(F.lit(":"), x["id"], F.lit(":"), x["n"])), " ")).alias("line"))

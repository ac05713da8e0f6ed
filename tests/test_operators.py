"""Operators on small fixtures, against straightforward code."""

import gzip
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ravelin.functions import bits
from ravelin.operators import lsm, ranges, reuse, sets, stats, trace
from ravelin.sources import packets


def test_integer_functions(spark):
    rows = [(x,) for x in (0, 1, 2, 3, 4, 5, 127, 128, 1 << 40, (1 << 62) + 1)]
    got = spark.createDataFrame(rows, "x long").select("x", bits.floor_log2(F.col("x")).alias("f"), bits.ceil_log2(F.col("x")).alias("c"), bits.is_power_of_two(F.col("x")).alias("p"), bits.round_up(F.col("x"), 64).alias("u"), bits.round_down(F.col("x"), 64).alias("d"), bits.div_ceil(F.col("x"), 7).alias("q"), bits.bits_between(F.col("x"), 1, 3).alias("b")).collect()
    for r in got:
        x = r.x
        assert r.f == (x.bit_length() - 1 if x else None) and r.c == ((x - 1).bit_length() if x else None)
        assert r.p == (x > 0 and x & (x - 1) == 0) and r.u == -(-x // 64) * 64 and r.d == x // 64 * 64 and r.q == -(-x // 7) and r.b == x >> 1 & 7


def test_chunks(spark):
    rng = random.Random(1)
    rows = [(rng.randint(0, 200), rng.randint(0, 100)) for _ in range(200)]
    got = spark.createDataFrame(rows, "a long, s long").select("a", "s", bits.chunks(F.col("a"), F.col("s"), 16).alias("c")).collect()
    for r in got:
        pieces = [(c.start, c.size) for c in r.c or []]
        assert sum(s for _, s in pieces) == r.s and all(a // 16 == (a + s - 1) // 16 for a, s in pieces)


@pytest.mark.parametrize("block", [7, 50, 65_536])
def test_reuse_distance_over_blocks(spark, block):
    rng = random.Random(2)
    rows = [(t * 3 + 1, t % 3, rng.randint(0, 12) if rng.random() < 0.9 else rng.randint(13, 400)) for t in range(900)]
    stacks, want, since = {}, {}, {}
    for t, s, line in rows:
        stack = stacks.setdefault(s, [])
        want[t] = stack.index(line) if line in stack else None
        since[t] = stack.index(line) if line in stack else len(stack)
        if line in stack:
            stack.remove(line)
        stack.insert(0, line)
    df = spark.createDataFrame(rows, "t long, s long, line long")
    assert {r.t: r.distance for r in reuse.reuse_distance(df, "line", "t", "s", block=block).collect()} == want
    assert {r.t: r.distance for r in reuse.reuse_distance(df, "line", "t", "s", first=True, block=block).collect()} == since
    assert reuse.reuse_distance(df.limit(0), "line", "t", "s").count() == 0


def test_earlier_above():
    rng = np.random.default_rng(1)
    for n in (0, 1, 63, 64, 65, 1000):
        v, m = rng.integers(0, 50, n), rng.integers(0, 50, n)
        assert reuse.earlier_above(v, m).tolist() == [int((v[:k] > m[k]).sum()) for k in range(n)]


def test_running_sum_over_blocks(spark):
    rows = [(k * 37 % 1009, k % 11) for k in range(1009)]
    got = trace.running_sum(spark.createDataFrame(rows, "t long, v long"), "t", F.col("v"), "s", block=64).collect()
    total, want = 0, {}
    for t, v in sorted(rows):
        total += v
        want[t] = total
    assert {r.t: r.s for r in got} == want


def test_overlaps_of_wide_and_narrow_ranges(spark):
    rng = random.Random(5)
    make = lambda n: [(k, a, a + rng.choice([0, 3, 50, 100_000, 10_000_000])) for k in range(n) for a in [rng.randint(0, 1_000_000)]]
    a, b = make(120), make(120)
    got = ranges.overlaps(spark.createDataFrame(a, "i long, alo long, ahi long"), spark.createDataFrame(b, "j long, blo long, bhi long"), ("alo", "blo"), ("ahi", "bhi"), 16).collect()
    assert sorted((r.i, r.j) for r in got) == sorted((i, j) for i, p, q in a for j, r, s in b if p <= s and q >= r)


def test_points_are_spread_over_buckets(spark):
    """Ranges of all widths: no key of the join holds more than a small share of the points."""
    points = spark.range(0, 1_000_000, 50).select(F.col("id").alias("k"))
    spread = ranges.bucketed_points(points, "k", list(range(ranges.LEVELS + 1)), 1024)
    most = spread.groupBy("__b").count().agg(F.max("count")).first()[0]
    assert most < 0.07 * points.count()
    wide = spark.createDataFrame([(0, 5, 9), (1, 0, 1 << 62), (2, 100, 90_000), (3, 7, 3)], "i long, lo long, hi long")
    got = ranges.point_in_range(points, wide, "k", "lo", "hi").groupBy("i").count().collect()
    assert {r.i: r["count"] for r in got} == {1: 20_000, 2: 1799}


def test_related_channels_by_ranks(spark):
    rng = random.Random(7)
    files = [(k, k % 3 + 1, k % 4, a, a + rng.choice([0, 5, 300, 20_000, -1])) for k in range(150) for a in [rng.randint(0, 30_000)]]
    got = {(r.file, r.channel): r.n for r in ranges.related_channels(spark.createDataFrame(files, "file long, level int, channel int, lo long, hi long")).collect()}
    want = {}
    for f, level, _, lo, hi in files:
        for _, other, c, olo, ohi in files:
            if level != other and lo <= hi and olo <= ohi and lo <= ohi and hi >= olo:
                want[f, c] = want.get((f, c), 0) + 1
    for level in (1, 2, 3):
        row = sorted((x for x in files if x[1] == level), key=lambda x: (x[3], x[4], x[0]))
        for a, b in zip(row, row[1:]):
            want[a[0], b[2]] = want.get((a[0], b[2]), 0) + 1
            want[b[0], a[2]] = want.get((b[0], a[2]), 0) + 1
    assert got == want


def test_shortest_prefix(spark):
    keys = spark.createDataFrame([("abcde",), ("abx",), ("q",)], "k string")
    prefixes = spark.createDataFrame([("ab", 2), ("abcd", 4)], "p string, v int")
    assert {r.k: r.v for r in ranges.shortest_prefix(keys, prefixes, "k", "p", "v", [2, 4]).collect()} == {"abcde": 2, "abx": 2, "q": None}


def test_catalog_contract(spark):
    named = lambda *x: spark.createDataFrame(x, "file string, lbn long")
    mapping = lsm.insert(named(("0001", 0)), named(("0002", 1), ("0001", 9)))
    assert {tuple(r) for r in mapping.collect()} == {("0001", 0), ("0002", 1)}
    mapping = lsm.remove(mapping, named(("0001", 0), ("none", 0)))
    assert [tuple(r) for r in lsm.lookup(mapping, named(("0001", 0), ("0002", 0))).collect()] == [("0002", 1)]
    turns = spark.createDataFrame([(f"f{k}", k) for k in range(6)], "file string, seq long")
    assert [r.channel for r in lsm.round_robin(turns).orderBy("file").collect()] == [0, 1, 2, 3, 0, 1]


def test_catalog_survives_a_restart(spark, tmp_path):
    mapping = spark.createDataFrame([("file1", 10), ("file2", 11), ("file3", 12)], "file string, lbn long")
    lsm.save(mapping, str(tmp_path / "m"))
    assert sorted(map(tuple, lsm.load(spark, str(tmp_path / "m")).collect())) == sorted(map(tuple, mapping.collect()))


def test_bloom_never_loses(spark):
    keys = spark.range(0, 2000, 7).select(F.col("id").alias("k"))
    kept = sets.bloom_semi_join(spark.range(2000).select(F.col("id").alias("k")), "k", sets.bloom_words(keys, "k", 1 << 14), 1 << 14)
    got = {r.k for r in kept.collect()}
    assert got >= set(range(0, 2000, 7)) and len(got) < 600


def test_names_are_matched_by_parts(spark):
    rows = [("this.is.a.match",), ("this.is.a.great.match",), ("this.is.a.bla.bla.match",), ("A.B.C.D",), ("B.C.D",)]
    got = stats.match_names(spark.createDataFrame(rows, "n string"), F.col("n"), ["this.is.a.*.match", "A.B.C.D"]).collect()
    assert {r.n for r in got} == {"this.is.a.great.match", "A.B.C.D"}


def test_traces_round_trip(spark, tmp_path):
    (tmp_path / "t.csv").write_text("r,128,64,4000\nw,232123,64,500000\nx,1,2,3\n")
    df = packets.read_text_trace(spark, str(tmp_path / "t.csv"))
    assert sorted(map(tuple, df.collect())) == [(3, 4, 1, 2), (4000, 1, 128, 64), (500000, 4, 232123, 64)]
    packets.write_text_trace(df, str(tmp_path / "out"))
    assert sorted(map(tuple, packets.read_text_trace(spark, str(tmp_path / "out")).collect())) == sorted(map(tuple, df.collect()))


def test_framed_records(spark, tmp_path):
    records = [b"a", b"x" * 300, b"yz"]
    size = lambda n: bytes([n]) if n < 128 else bytes([n & 127 | 128, n >> 7])
    data = b"".join(size(len(r)) + r for r in records)
    (tmp_path / "plain.bin").write_bytes(data)
    (tmp_path / "packed.bin").write_bytes(gzip.compress(data + b"\0after"))
    got = packets.read_framed(spark, str(tmp_path)).collect()
    assert sorted((r.record_no, bytes(r.record)) for r in got) == sorted([(k, r) for k, r in enumerate(records)] * 2)


def test_streams_of_many_unordered_files(spark, tmp_path):
    from ravelin.plans.catalogue import QUERIES

    rng = random.Random(11)
    rows = [(k, rng.randrange(40), 1_700_000_000 + 300 * k, 1.5) for k in range(600)]
    parts = [rows[at : at + 30] for at in range(0, 600, 30)]
    rng.shuffle(parts)
    for part in parts:  # 20 files, written out of order
        part = spark.createDataFrame(part, "event_id long, user_id long, s long, value double").selectExpr("event_id", "user_id", "timestamp_seconds(s) AS ts", "value")
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/events.parquet")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        before = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", "12")  # more files than a micro-batch takes
        hours = {r.dump: (r.n, r.total) for r in QUERIES["stream_periodic_dump"](spark, str(tmp_path)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want, last = {}, rows[-1][2]
    for _, _, s, _ in rows:
        n, total = want.get(s // 3600 * 3_600_000_000, (0, 0))
        want[s // 3600 * 3_600_000_000] = (n + 1, total + 150)
    assert hours == {h: x for h, x in want.items() if h + 3_600_000_000 <= last * 1_000_000}


def test_shortest_paths_of_many_edges(spark, tmp_path):
    count = iter(range(100))

    def staged(df):
        path = f"{tmp_path}/{next(count)}"
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    edges = spark.createDataFrame([(k, k + 1, 1) for k in range(24)] + [(0, 24, 90)], "a long, b long, w long")
    got = sets.shortest_paths(edges, spark.createDataFrame([(0,)], "source long"), None, staged)
    assert {r.node: r.cost for r in got.collect()} == {k: k for k in range(25)}


def test_encodings_of_lines(spark):
    def ways(words):
        got = spark.createDataFrame([(words,)], "w array<long>").select(sets.encodings(F.col("w")).alias("e")).first()["e"]
        return {e["pattern"]: e["bits"] for e in got}

    assert ways([0, 0])["zero"] == 1
    assert ways([7, 7])["repeated"] == 64 and "zero" not in ways([7, 7])
    assert ways([1000, 1001, 1002, 1003]) == {"raw": 256, "base8_delta1": 96, "base8_delta2": 128, "base8_delta4": 192, "base4_delta2": 160}
    assert ways([-(1 << 63), (1 << 63) - 1]) == {"raw": 128}
    assert ways([0x0001000100010001, 0x0002000200020002])["base2_delta1"] == 80


def test_busy_time_by_added_lengths(spark):
    rng = random.Random(5)
    rows = [(k % 3, a, a + rng.choice([0, 1, 5, 40])) for k in range(300) for a in [rng.randint(0, 900)]]
    df = trace.busy_time(spark.createDataFrame(rows, "k int, s long, e long"), ["k"], "s", "e")
    want = {}
    for key in range(3):
        islands = []
        for _, a, b in sorted(r for r in rows if r[0] == key):
            if islands and islands[-1][1] >= a:
                islands[-1][1] = max(islands[-1][1], b)
            else:
                islands.append([a, b])
        want[key] = (sum(b - a for a, b in islands), len(islands))
    assert {r.k: (r.busy, r.slots) for r in df.collect()} == want
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [") == 1 and plan.count("Aggregate [") == 1  # no map of islands beside the sort


def test_counts_upto_has_a_row_for_each_point(spark):
    rng = random.Random(6)
    keys = [(rng.randint(0, 20_000), rng.choice("ab"), rng.randint(1, 3)) for _ in range(400)] + [(5, None, 1)]
    points = [(k, rng.randint(-3, 21_000), rng.randint(1, 3)) for k in range(100)]
    among, at = spark.createDataFrame(keys, "key long, kind string, level int"), spark.createDataFrame(points, "id long, at long, level int")
    kinds = {c: F.col("kind") == c for c in "ab"}
    for own in ([], ["level"]):
        got = ranges.counts_upto(at, "at", among, "key", kinds, own).collect()
        assert len(got) == 100
        for r in got:
            assert [r.a, r.b] == [sum(x <= r.at and kind == c and (not own or level == r.level) for x, kind, level in keys) for c in "ab"]

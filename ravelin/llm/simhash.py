"""SimHash near-duplicates with a Gray-order hierarchical index.

Fingerprints are reduced to distinct values first, so copies cost nothing in the search. A fingerprint then goes to one
bucket for each of its distance + 1 segments: two fingerprints that differ in at most `distance` bits agree in one
segment at least, which makes that segment the shared masked pattern of the bucket's top node. Inside a bucket the
fingerprints are sorted by Gray rank and cut into leaves; every upper node keeps the bits on which its leaves agree, and
a pair of nodes is pruned as a whole once the differences in those bits exceed the distance. Buckets above
`bucket_limit` are dealt again by a segment of the bits left, which loses no link. A bucket returns a star for each of
its groups instead of all pairs; the stars are joined by ravelin.llm.connected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ravelin.llm.common import row_key, staged, utf8
from ravelin.llm.connected import components

LEAF = 32
PAIRS_AT_ONCE = 4096


def shingle_hashes(text: bytes, shingle: int) -> np.ndarray:
    """XXH64 of each run of `shingle` words, repeats included; a shorter text is one run, one without words has none."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - shingle + 1)
    digest = xxhash.xxh64_intdigest
    stops = ends[shingle - 1 :] if len(words) >= shingle else ends[-1:]
    return np.array([digest(line[a:b], 42) for a, b in zip(starts[:n].tolist(), stops.tolist(), strict=True)], np.uint64)


def fingerprint_of(hashes: np.ndarray) -> int:
    """The bits that are set in over half the hashes; zero for none."""
    n = len(hashes)
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 250 * 64):  # 250 rows at most in an 8-bit sum
        bits = np.unpackbits(hashes[at : at + 250 * 64].view(np.uint8), bitorder="little").reshape(-1, 64)
        full = len(bits) // 250 * 250
        if full:
            counts += np.add.reduce(bits[:full].reshape(-1, 250, 64), axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
        counts += np.add.reduce(bits[full:], axis=0, dtype=np.uint8)
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprint(text: bytes, shingle: int) -> int:
    return fingerprint_of(shingle_hashes(text, shingle))


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The place of each code in the reflected binary Gray order."""
    for shift in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> np.uint64(shift))
    return x


class GrayIndex:
    """Fingerprints in Gray order under a binary tree of nodes that hold the bits their members agree on."""

    def __init__(self, values: np.ndarray):
        values = values[np.argsort(gray_rank(values), kind="stable")]
        leaves = -(-len(values) // LEAF)
        width = 1 << (leaves - 1).bit_length()
        self.values, self.leaves = values, leaves
        padded = np.concatenate([values, np.repeat(values[-1:], width * LEAF - len(values))]).reshape(width, LEAF)
        self.blocks = padded
        ones, some = np.bitwise_and.reduce(padded, axis=1), np.bitwise_or.reduce(padded, axis=1)
        self.levels = [(ones, ~(ones ^ some))]
        while len(ones) > 1:
            ones, some = ones[0::2] & ones[1::2], some[0::2] | some[1::2]
            self.levels.append((ones, ~(ones ^ some)))

    def close_blocks(self, distance: int) -> Iterator[np.ndarray]:
        """Pairs of leaf blocks (i <= j) that no node of the tree rules out; depth first in slices, so memory stays bounded."""
        stack = [(len(self.levels) - 1, np.zeros((1, 2), np.int64))]
        while stack:
            level, pairs = stack.pop()
            if len(pairs) > PAIRS_AT_ONCE:
                stack += [(level, pairs[at : at + PAIRS_AT_ONCE]) for at in range(0, len(pairs), PAIRS_AT_ONCE)]
                continue
            if level == 0:
                yield pairs
                continue
            i, j = pairs[:, 0] * 2, pairs[:, 1] * 2
            down = np.concatenate([np.stack(x, 1) for x in ((i, j), (i, j + 1), (i + 1, j + 1), (i + 1, j))])
            down = down[(down[:, 0] <= down[:, 1]) & (down[:, 1] < -(-self.leaves // (1 << (level - 1))))]
            ones, same = self.levels[level - 1]
            a, b = down[:, 0], down[:, 1]
            off = np.bitwise_count((ones[a] ^ ones[b]) & same[a] & same[b])
            if (off <= distance).any():
                stack.append((level - 1, down[off <= distance]))

    def groups(self, distance: int) -> np.ndarray:
        """For each of self.values the position of its group's head."""
        parent = np.arange(len(self.values))

        def find(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        def flat() -> None:
            while True:
                up = parent[parent]
                if (up == parent).all():
                    return
                parent[:] = up

        for pairs in self.close_blocks(distance):
            for at in range(0, len(pairs), 256):
                a, b = pairs[at : at + 256, 0], pairs[at : at + 256, 1]
                close = np.bitwise_count(self.blocks[a][:, :, None] ^ self.blocks[b][:, None, :]) <= distance
                n, x, y = np.nonzero(close)
                left, right = a[n] * LEAF + x, b[n] * LEAF + y
                inside = (left < right) & (right < len(self.values))
                flat()
                heads = parent[np.stack([left[inside], right[inside]], 1)]
                heads = heads[heads[:, 0] != heads[:, 1]]
                for p, q in np.unique(heads, axis=0).tolist():
                    p, q = find(p), find(q)
                    parent[max(p, q)] = min(p, q)
        flat()
        return parent


def bucket_stars(buckets: np.ndarray, values: np.ndarray, distance: int) -> np.ndarray:
    """Links (member, head) of the groups in each bucket; buckets: non-decreasing numbers."""
    out = []
    cuts = np.flatnonzero(np.diff(buckets)) + 1
    starts, sizes = np.concatenate(([0], cuts)), np.diff(np.concatenate(([0], cuts, [len(buckets)])))
    pairs = np.flatnonzero(sizes == 2)  # the bulk at small scale: one leaf with one pair
    a, b = values[starts[pairs]], values[starts[pairs] + 1]
    near = np.bitwise_count(a ^ b) <= distance
    out.append(np.stack([a[near], b[near]], 1))
    for k in np.flatnonzero(sizes > 2):
        index = GrayIndex(values[starts[k] : starts[k] + sizes[k]])
        heads = index.groups(distance)
        moved = heads != np.arange(len(heads))
        if moved.any():
            out.append(np.stack([index.values[moved], index.values[heads[moved]]], 1))
    return np.concatenate(out)


def _fingerprints(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = np.array([fingerprint(t, shingle) for t in b.column("bytes").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in b.schema.names if c != "bytes"), pa.array(got)], names=[*(c for c in b.schema.names if c != "bytes"), "fp"])

    return run


def _search(distance: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the rows of a bucket can go on in the next batch
        for b in _with_end(batches):
            rows = None if b is None else np.stack([b.column("bucket").to_numpy(), b.column("fp").to_numpy()], 1)
            rows = held if rows is None else rows if held is None else np.concatenate([held, rows])
            if rows is None or not len(rows):
                continue
            cut = len(rows) if b is None else int(np.searchsorted(rows[:, 0], rows[-1, 0]))
            held = rows[cut:]
            if cut:
                links = bucket_stars(rows[:cut, 0], np.ascontiguousarray(rows[:cut, 1]).view(np.uint64), distance).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(links[:, k])) for k in (0, 1)], names=["u", "v"])

    return run


def _with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def _segments(distance: int, width: int) -> list[tuple[int, int]]:
    """The lowest `width` bits as distance + 1 runs (shift, width)."""
    parts = distance + 1
    edges = [width * k // parts for k in range(parts + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def links(fps: DataFrame, distance: int = 3, bucket_limit: int = 200_000) -> DataFrame:
    """fps(fp long, distinct) -> links (u, v) whose components are those of all pairs within the distance."""
    part = lambda s, w: F.shiftrightunsigned("fp", s).bitwiseAND((1 << w) - 1)
    runs = _segments(distance, 64)
    top = fps.select("fp", F.explode(F.array(*(F.struct(F.lit(k).alias("k"), part(s, w).alias("value")) for k, (s, w) in enumerate(runs)))).alias("x")).select("fp", "x.*")
    large = top.groupBy("k", "value").count().where(F.col("count") > bucket_limit).select("k", "value", F.lit(True).alias("large"))
    top = top.join(large, ["k", "value"], "left")
    # the bits outside segment k, turned to the low end, differ in `distance` bits at most too: deal by their parts
    again = []
    for k, (s, w) in enumerate(runs):
        rest = F.shiftleft(F.shiftrightunsigned("fp", s + w), s) if s + w < 64 else F.lit(0).cast("long")
        rest = rest.bitwiseOR(F.col("fp").bitwiseAND((1 << s) - 1)) if s else rest
        again.append(F.when(F.col("k") == k, F.array(*(F.xxhash64(F.lit(j), F.shiftrightunsigned(rest, a).bitwiseAND((1 << b) - 1)) for j, (a, b) in enumerate(_segments(distance, 64 - w))))))
    deeper = F.when(F.col("large"), F.coalesce(*again)).otherwise(F.array(F.lit(0).cast("long")))
    rows = top.withColumn("deeper", F.explode(deeper)).select(F.xxhash64("k", "value", "deeper").alias("bucket"), "fp")
    dealt = rows.repartition("bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(_search(distance), "u long, v long")


def near_duplicates(docs: DataFrame, shingle: int = 3, distance: int = 3, id_col: str = "doc_id", text_col: str = "text", bucket_limit: int = 200_000) -> DataFrame:
    """One row per row of docs: the id, fingerprint (16 hex digits), component_id (smallest id reachable) and row_key.

    Null and empty texts have fingerprint zero and are linked like any other; repeated rows come back as often as they
    were given; rows with a null id take part and get the smallest id of their component that is not null, or null.
    Other columns are ignored. An empty table gives an empty result.
    """
    keyed = docs.select(F.col(id_col).alias("id"), row_key(id_col, text_col).alias("row_key"), utf8(text_col).alias("bytes"))
    id_type = keyed.schema["id"].dataType.simpleString()
    marked = staged(keyed.mapInArrow(_fingerprints(shingle), f"id {id_type}, row_key long, fp long"), "fingerprints")
    distinct = marked.groupBy("fp").agg(F.min("id").alias("least"))
    heads = components(links(distinct.select("fp"), distance, bucket_limit))
    of_fp = distinct.join(heads.select(F.col("u").alias("fp"), F.col("v").alias("head")), "fp", "left").withColumn("head", F.coalesce("head", "fp"))
    # read from a file, so that both sides of the join are dealt for it alone and Spark can split a large component
    least = staged(of_fp.groupBy("head").agg(F.min("least").alias("component_id")), "heads")
    named = of_fp.select("fp", "head").join(least, "head").select("fp", "component_id")
    return marked.join(named, "fp").select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "row_key")

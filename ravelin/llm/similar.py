"""Near copies by the Jaccard similarity of their word shingles: SimHash and MinHash candidates, then an exact check.

Sets of shingles are reduced to distinct ones first, so copies cost nothing in the search. Candidates come from op7's
method, the stars of the Gray-order index over SimHash fingerprints of the same shingles, and for the pairs whose
fingerprints differ in more bits than that index can reach from the buckets of BANDS groups of ROWS minima. Two sets of
similarity 0.8 share a bucket with probability 0.9999; a pair of a bucket is a candidate if the share of equal minima (one
byte of each) isn't over DEVIATIONS standard deviations below the similarity.

All pairs of a bucket are looked at, but few are checked as texts: first a spanning forest of the likeliest candidates of
each bucket, then, once the links found are known, every other candidate between groups that are still apart. A link inside
a group changes nothing, so no pair of a bucket is left out. These last candidates can be as many as the square of a group of
sets that are nearly, but not quite, alike, so they never become rows: the sets that have one go to their bucket with their
shingles, are checked there, each pair in the first bucket that it shares, and only links that join groups come back.
Buckets of more than SLICE members or SHINGLES shingles are cut to slices: the forest is made in each, the rest in each pair
of slices, so a task holds two slices at most.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ravelin.llm.common import row_key, staged, unstaged, utf8
from ravelin.llm.connected import components
from ravelin.llm.simhash import fingerprint_of, links, shingle_hashes

BANDS, ROWS = 24, 5
DEVIATIONS = 4
DISTANCE = 3  # bits, as far as the Gray-order index goes
SLICE = 4_000  # members of a bucket that are compared in one task
SHINGLES = 2_000_000  # and distinct shingles of theirs
BROADCAST_ROWS = 1_000_000  # rows of three keys
CELL = 256  # sets that are checked against each other, or against as many others, in one go
ROWS_AT_ONCE = 100_000
_FACTORS = np.random.default_rng(1).integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: bytes, shingle: int) -> np.ndarray:
    """The distinct hashes of the runs of `shingle` words, sorted; a shorter text is one run, one without words has none."""
    return np.unique(shingle_hashes(text, shingle))


def minima(hashes: np.ndarray) -> np.ndarray:
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 4096):
        np.minimum(least, (_FACTORS[:, None] * hashes[None, at : at + 4096]).min(axis=1), out=least)
    return least


def buckets(least: np.ndarray) -> list[int]:
    return [xxhash.xxh64_intdigest(row.tobytes(), k) - (1 << 63) for k, row in enumerate(least.reshape(BANDS, ROWS))]


def least_equal(similarity: float) -> int:
    """Equal minima that a pair needs to be a candidate."""
    n = BANDS * ROWS
    return max(1, math.floor(n * similarity - DEVIATIONS * math.sqrt(n * similarity * (1 - similarity))))


def alike(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether two sets have the similarity."""
    if min(len(a), len(b)) < similarity * max(len(a), len(b)) - 1e-9:
        return False
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common >= similarity * (len(a) + len(b) - common) - 1e-9


def _signatures(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, bands, sketches, sizes, fps = [], [], [], [], []
            for t in b.column("bytes").to_pylist():
                hashes = shingle_hashes(t, shingle)
                found = np.unique(hashes)
                least = minima(found)
                ids.append(xxhash.xxh3_64_intdigest(found.tobytes()) - (1 << 63))
                bands.append(buckets(least) if len(found) else [])
                sketches.append(least.astype(np.uint8).tobytes())
                sizes.append(len(found))
                fps.append(fingerprint_of(hashes))
            columns = [pa.array(ids, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(sketches, pa.binary()), pa.array(sizes, pa.int64()), pa.array(np.array(fps, np.uint64).view(np.int64))]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("row_key"), *columns], names=["id", "row_key", "set", "bands", "sketch", "size", "fp"])

    return run


def _shingles(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hashes = [shingle_set(t, shingle).tobytes() for t in b.column("bytes").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("set"), pa.array(hashes, pa.binary())], names=["set", "hashes"])

    return run


class Members(NamedTuple):
    """Sets of one bucket, or of a part of it."""

    key: tuple[int, int, int]  # bucket, part, other
    slices: np.ndarray
    sets: np.ndarray
    heads: np.ndarray
    sizes: np.ndarray
    sketches: np.ndarray
    bands: np.ndarray | None
    hashes: list[np.ndarray] | None

    def equal(self, k: int, at: slice | np.ndarray, similarity: float) -> np.ndarray:
        """Equal minima of member k and others; -1 where the sizes alone rule out the similarity."""
        size, others = self.sizes[k], self.sizes[at]
        near = np.minimum(others, size) >= similarity * np.maximum(others, size) - 1e-9
        return np.where(near, (self.sketches[at] == self.sketches[k]).sum(axis=1), -1)

    def candidates(self, k: int, groups: np.ndarray, least: int, similarity: float) -> np.ndarray:
        """The members after k that are to be checked against it: of another group, with `least` equal minima and no earlier bucket in common; of two slices those of the other."""
        bucket, part, other = self.key
        others = groups[k + 1 :] != groups[k]
        if part != other:
            others &= self.slices[k + 1 :] != self.slices[k]
        at = np.flatnonzero(others) + k + 1
        at = at[self.equal(k, at, similarity) >= least]
        band = int(np.argmax(self.bands[k] == bucket))
        return at[~(self.bands[at, :band] == self.bands[k, :band]).any(axis=1)]


def forest(rows: Members, least: int, similarity: float) -> Iterator[tuple[int, int]]:
    """Edges (row, row) of a spanning forest of the pairs with `least` equal minima, the likeliest first (Prim)."""
    n = len(rows.sets)
    best, source = np.full(n, -2), np.zeros(n, np.int64)
    outside = np.ones(n, bool)
    at = 0
    for _ in range(n - 1):
        outside[at] = False
        equal = rows.equal(at, slice(None), similarity)
        nearer = outside & (equal > best)
        best[nearer], source[nearer] = equal[nearer], at
        at = int(np.argmax(np.where(outside, best, -3)))
        if best[at] >= least:
            yield int(source[at]), at


def _of_groups(work: Callable[[Members], Iterator[np.ndarray]], *names: str):
    """mapInArrow over rows (bucket, part, other, slice, set, head, size, sketch, maybe bands and hashes) sorted by the first three: work() of each group gives arrays of rows of the named columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, done, n = None, [], 0
        for b in _with_end(batches):
            parts = [x for x in (held, None if b is None else pa.Table.from_batches([b])) if x is not None]
            if not parts:
                continue
            rows = pa.concat_tables(parts).combine_chunks()
            if not len(rows):
                continue
            key = np.stack([rows.column(c).to_numpy() for c in ("bucket", "part", "other")], 1).astype(np.int64)
            cuts = np.concatenate([[0], np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1, [len(rows)] if b is None else []]).astype(np.int64)
            held = rows.slice(cuts[-1])
            if b is not None and len(cuts) < 2:
                continue
            columns = _columns(rows.slice(0, cuts[-1]))
            for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                for found in work(Members(tuple(key[x].tolist()), *(None if c is None else c[x:y] for c in columns))):
                    done.append(found)
                    n += len(found)
                    if n > ROWS_AT_ONCE:
                        yield _batch(done, names)
                        done, n = [], 0
        if n:
            yield _batch(done, names)

    return run


def _columns(rows: pa.Table) -> list:
    """What Members has beside the key."""
    has = set(rows.column_names)
    sketches = np.frombuffer(b"".join(rows.column("sketch").to_pylist()), np.uint8).reshape(-1, BANDS * ROWS)
    bands = rows.column("bands").combine_chunks().flatten().to_numpy().reshape(-1, BANDS) if "bands" in has else None
    hashes = [np.frombuffer(h, np.uint64) for h in rows.column("hashes").to_pylist()] if "hashes" in has else None
    return [*(rows.column(c).to_numpy() for c in ("slice", "set", "head", "size")), sketches, bands, hashes]


def _with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def _batch(parts: list[np.ndarray], names: tuple[str, ...]) -> pa.RecordBatch:
    rows = np.concatenate(parts)
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(rows[:, k])) for k in range(len(names))], names=list(names))


def _likeliest(least: int, similarity: float):
    def work(rows: Members) -> Iterator[np.ndarray]:
        edges = list(forest(rows, least, similarity))
        if edges:
            yield np.sort(rows.sets[np.array(edges)], axis=1)

    return _of_groups(work, "u", "v")


def _apart(least: int, similarity: float):
    """The members (bucket, part, other, slice, set, head) that have a candidate in another group."""

    def work(rows: Members) -> Iterator[np.ndarray]:
        asked = np.zeros(len(rows.sets), bool)
        for k in range(len(rows.sets)):
            at = rows.candidates(k, rows.heads, least, similarity)
            asked[at] = True
            asked[k] |= len(at) > 0
        n = int(asked.sum())
        if n:
            yield np.column_stack([np.tile(np.array(rows.key, np.int64), (n, 1)), rows.slices[asked], rows.sets[asked], rows.heads[asked]])

    return _of_groups(work, "bucket", "part", "other", "slice", "set", "head")


def joining(rows: Members, least: int, similarity: float) -> Iterator[tuple[int, int]]:
    """Links (row, row) that join the groups as all candidates with the similarity do."""
    groups = rows.heads.copy()
    distinct, flat = np.unique(np.concatenate(rows.hashes), return_inverse=True)
    numbered = np.split(flat, np.cumsum([len(h) for h in rows.hashes])[:-1])
    own = np.zeros(len(distinct), bool)
    for k in range(len(rows.sets)):
        at = rows.candidates(k, groups, least, similarity)
        if not len(at):
            continue
        own[numbered[k]] = True
        for j in at.tolist():
            if groups[j] != groups[k]:
                common = np.count_nonzero(own[numbered[j]])
                if common >= similarity * (rows.sizes[k] + rows.sizes[j] - common) - 1e-9:
                    groups[groups == groups[j]] = groups[k]
                    yield k, j
        own[numbered[k]] = False


def _joining(least: int, similarity: float):
    def work(rows: Members) -> Iterator[np.ndarray]:
        edges = list(joining(rows, least, similarity))
        if edges:
            yield np.sort(rows.sets[np.array(edges)], axis=1)

    return _of_groups(work, "u", "v")


def _checked(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, sets = None, {}  # a cell's sets come before its pairs
        for b in batches:
            found = []
            for *key, u, v, h in zip(*(b.column(c).to_pylist() for c in ("head", "part", "other", "u", "v", "hashes")), strict=True):
                if key != cell:
                    cell, sets = key, {}
                if h is not None:
                    sets[u] = np.frombuffer(h, np.uint64)
                elif alike(sets[u], sets[v], similarity):
                    found.append((u, v))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["u", "v"])

    return run


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _alike(pairs: DataFrame, shingles: DataFrame, similarity: float) -> DataFrame:
    """The pairs (u, v), distinct, whose sets have the similarity.

    Pairs that hang together are checked in one place, so that each set goes there once; of more than CELL sets they are
    dealt to cells, one for each two parts of the sets.
    """
    inner = components(pairs)
    nodes = inner.select(F.col("u").alias("set"), F.col("v").alias("head")).union(inner.select("v", "v").distinct())
    cells = nodes.groupBy("head").agg(F.ceil(F.count("*") / CELL).alias("cells"))
    placed = staged(nodes.join(cells, "head").select("set", "head", F.pmod(F.xxhash64("set"), F.col("cells")).alias("cell")), "placed")
    of = lambda key, cell: placed.select(F.col("set").alias(key), *(["head"] if key == "u" else []), F.col("cell").alias(cell))
    asked = pairs.join(of("u", "a"), "u").join(of("v", "b"), "v").select("head", F.least("a", "b").alias("part"), F.greatest("a", "b").alias("other"), "u", "v")
    asked = staged(asked, "asked")
    wanted = staged(asked.select("head", "part", "other", F.explode(F.array("u", "v")).alias("set")).distinct(), "wanted-sets")
    given = shingles.join(_small(wanted), "set").select("head", "part", "other", F.col("set").alias("u"), F.lit(None).cast("long").alias("v"), "hashes")
    rows = given.union(asked.withColumn("hashes", F.lit(None).cast("binary"))).repartition("head", "part", "other")
    found = rows.sortWithinPartitions("head", "part", "other", F.col("hashes").isNull()).mapInArrow(_checked(similarity), "u long, v long")
    found = staged(found, "alike")
    unstaged(placed, asked, wanted)
    return found


def _of_fingerprints(distinct: DataFrame) -> DataFrame:
    """Pairs (u, v) of sets: the first of a fingerprint with its others, and the stars of the Gray-order index between the first ones."""
    first = staged(distinct.groupBy("fp").agg(F.min("set").alias("first")), "fingerprints")
    same = distinct.select("set", "fp").join(first, "fp").where("set <> first").select(F.col("set").alias("u"), F.col("first").alias("v"))
    of = lambda fp, name: first.select(F.col("fp").alias(fp), F.col("first").alias(name))
    stars = staged(links(first.select("fp"), DISTANCE).select(F.col("u").alias("a"), F.col("v").alias("b")).distinct(), "stars-of-fingerprints")
    return same.union(stars.join(of("a", "u"), "a").join(of("b", "v"), "b").select("u", "v"))


def similar_groups(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(head, id, row_key): for each group of texts linked by the similarity the row with the least id (nulls last), then the least row key.

    Null and empty texts are one group. Groups are told apart by `head`, the least set of theirs, so null and repeated ids
    don't join groups; repeated rows share a row key. An empty table gives an empty result. Other columns are ignored.
    """
    least = least_equal(similarity)
    keyed = docs.select(F.col(id_col).alias("id"), row_key(id_col, text_col).alias("row_key"), utf8(text_col).alias("bytes"))
    kind = keyed.schema["id"].dataType.simpleString()
    marked = staged(keyed.mapInArrow(_signatures(shingle), f"id {kind}, row_key long, set long, bands array<long>, sketch binary, size long, fp long"), "signatures")
    first = F.min(F.struct(F.col("id").isNull().alias("unnamed"), "id", "row_key")).alias("first")
    distinct = staged(marked.groupBy("set").agg(first, *(F.first(c).alias(c) for c in ("bands", "sketch", "size", "fp"))), "distinct-sets")
    unstaged(marked)
    banded = distinct.select("set", "size", F.explode("bands").alias("bucket"))
    sizes = staged(banded.groupBy("bucket").agg(F.count("*").alias("n"), F.sum("size").alias("shingles")).where("n > 1"), "bucket-sizes")
    members = staged(banded.drop("size").join(sizes, "bucket"), "members")
    close = staged(_of_fingerprints(distinct), "close-fingerprints")
    known = members.select("set").union(close.select(F.col("u").alias("set"))).union(close.select(F.col("v").alias("set"))).distinct()
    known = staged(distinct.join(known, "set", "left_semi").select("set", F.col("first.row_key").alias("row_key"), "bands", "sketch", "size"), "known-sets")
    texts = keyed.join(_small(known.select("row_key", "set")), "row_key").select("set", "bytes").dropDuplicates(["set"])
    shingles = staged(texts.mapInArrow(_shingles(shingle), "set long, hashes binary"), "shingles")

    def dealt(rows: DataFrame, work: Callable, gives: str, *more: str) -> DataFrame:
        """What work gives for rows (bucket, part, other, slice, set, head), one group to a task at a time."""
        rows = rows.join(known.select("set", "size", "sketch", "bands"), "set")
        rows = rows.join(shingles, "set") if "hashes" in more else rows
        rows = rows.select("bucket", "part", "other", "slice", "set", "head", "size", "sketch", *more)
        return rows.repartition("bucket", "part", "other").sortWithinPartitions("bucket", "part", "other").mapInArrow(work(least, similarity), gives)

    slices = F.ceil(F.greatest(F.col("n") / SLICE, F.col("shingles") / SHINGLES))
    sliced = members.withColumn("slices", slices).withColumn("slice", F.pmod(F.xxhash64("set", "bucket"), F.col("slices")))
    alone = sliced.select("bucket", F.col("slice").alias("part"), F.lit(0).cast("long").alias("other"), "slice", "set", F.col("set").alias("head"))
    between = close.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    tried = staged(dealt(alone, _likeliest, "u long, v long").union(between).distinct(), "tried")
    found = _alike(tried, shingles, similarity)

    heads = components(found).select(F.col("u").alias("set"), F.col("v").alias("head"))
    grouped = staged(sliced.join(heads, "set", "left").withColumn("head", F.coalesce("head", "set")), "members-of-groups")
    open_ = grouped.groupBy("bucket").agg(F.min("head").alias("a"), F.max("head").alias("b")).where("a <> b").select("bucket")
    each = F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1)).alias("with")
    grid = grouped.join(staged(open_, "open-buckets"), "bucket", "left_semi").select("bucket", "slice", "set", "head", each)
    grid = grid.select("bucket", F.least("slice", "with").alias("part"), F.greatest("slice", "with").alias("other"), "slice", "set", "head")
    asked = staged(dealt(grid, _apart, "bucket long, part long, other long, slice long, set long, head long", "bands"), "asked-members")
    found = staged(found.union(dealt(asked, _joining, "u long, v long", "bands", "hashes")), "links")
    unstaged(shingles, members, grouped, asked)

    heads = components(found).select(F.col("u").alias("set"), F.col("v").alias("head"))
    grouped = distinct.select("set", "first").join(heads, "set", "left").groupBy(F.coalesce("head", "set").alias("head")).agg(F.min("first").alias("first"))
    return grouped.select("head", F.col("first.id").alias("id"), F.col("first.row_key").alias("row_key"))

"""Repeated substrings by common-prefix interval trees over a sampled suffix array.

A text is a row of symbols: its UTF-8 bytes, or its words (each as an 8-byte hash; words end at white space).

1. Sampling. In each window of `span` symbols the leftmost least hash of its strings of `anchor` symbols is an anchor.
   Equal windows have equal anchors at equal places, so comparing the suffixes (and the prefixes) around anchors finds
   every pair of equal windows; about 2 of (span - anchor + 2) positions are kept. An anchor owns the run of windows that
   chose it; the symbols of that run are its context. No window crosses a document.
2. Grouping. Anchors are counted by the hash of their string, then those that repeat by their whole context. Equal
   contexts collapse to one row with a count before any text moves; a context with a count over one repeats entirely.
3. Trees. The distinct contexts of an anchor string form an enhanced suffix array: suffixes sorted, with the common
   prefix of neighbours. A stack scan over it closes the common-prefix intervals from the deepest up. Each interval holds
   its members sorted by their reversed left sides; the smaller side of a merge is inserted into the larger one, and
   only where the left neighbours differ (left diversity) does a new maximal repeat of left + right symbols arise.
   `repeat_spans` notes it for the members that it brings new bytes to, which is all that their coverage needs;
   `repeat_groups` gives each such repeat with all its occurrences.
4. Groups of more than `group_limit` contexts do not go to one task: each of their windows is hashed to a row instead
   and rows are counted, which is exact too and is spread by content.

All joins are on hashed keys; the text of documents is shuffled once for contexts and once for the result.
"""

from __future__ import annotations

import bisect
import hashlib
import struct
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ravelin.llm.common import row_key, staged, unstaged, utf8

SPAN, ANCHOR = 400, 128
PASSAGE, PASSAGE_ANCHOR = 51, 8  # in words
BROADCAST_CONTEXTS = 200_000  # of 24 bytes each
SEGMENT = 1 << 20  # symbols that are handled at once
INDEX_BITS = np.uint64(22)
MULTIPLIER = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2 ** 64
BYTES, WORDS = 1, 8  # bytes of a symbol
Kind = tuple[int, int, int]  # bytes of a symbol, span and anchor in symbols


def symbols(text: bytes, unit: int) -> bytes:
    return text if unit == BYTES else b"".join(map(xxhash.xxh3_64_digest, text.split()))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (MULTIPLIER, pow(MULTIPLIER, -1, 1 << 64)):
        x = np.full(n, base, np.uint64)
        x[0] = 1
        out.append(np.multiply.accumulate(x))
    return out[0], out[1]


class Sampler:
    def __init__(self, span: int, anchor: int, unit: int = BYTES):
        self.span, self.anchor, self.unit = span, anchor, unit
        self.table = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
        self.up, self.down = _powers(SEGMENT + 2 * span + 2)

    def windows(self, text: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """text: symbols of whole documents one after the other, each ending at one of ends. Anchors as (position, first window start, last window start)."""
        n, width = len(text), self.span - self.anchor + 1
        if n < self.span:
            return (np.zeros(0, np.int64),) * 3
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((self.table[text] if self.unit == BYTES else text) * self.up[:n], out=sums[1:])
        h = (sums[self.anchor :] - sums[: -self.anchor]) * self.down[: n - self.anchor + 1]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
        mask = (np.uint64(1) << INDEX_BITS) - np.uint64(1)
        key = (h & ~mask) | np.arange(len(h), dtype=np.uint64)
        full = np.concatenate([key, np.full(-len(key) % width + width, ~np.uint64(0))]).reshape(-1, width)
        before = np.minimum.accumulate(full, axis=1).ravel()
        after = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].ravel()
        starts = n - self.span + 1
        least = (np.minimum(after[:starts], before[width - 1 : width - 1 + starts]) & mask).astype(np.int64)
        good = np.ones(starts, bool)
        for e in ends[:-1].tolist():
            good[max(0, e - self.span + 1) : e] = False
        at = np.flatnonzero(good)
        if not len(at):
            return (np.zeros(0, np.int64),) * 3
        chosen = least[at]
        cut = np.flatnonzero((np.diff(chosen) != 0) | (np.diff(at) != 1)) + 1
        first = np.concatenate(([0], cut))
        last = np.concatenate((cut, [len(at)])) - 1
        return chosen[first], at[first], at[last]

    def _symbols(self, text: bytes) -> np.ndarray:
        return np.frombuffer(text, np.uint8 if self.unit == BYTES else np.uint64)

    def anchors(self, texts: list[bytes]) -> Iterator[tuple[int, int, int, int, int, int]]:
        """texts: symbols. (number of the text, anchor position, symbols before and after it in its context, hash of its string, hash of its context)."""
        group: list[int] = []
        size = 0
        for k, t in enumerate(texts):
            n = len(t) // self.unit
            if n < self.span:
                continue
            if n > SEGMENT:
                yield from self._long(k, t)
                continue
            if size + n > SEGMENT:
                yield from self._joined(texts, group)
                group, size = [], 0
            group.append(k)
            size += n
        if group:
            yield from self._joined(texts, group)

    def _joined(self, texts: list[bytes], group: list[int]):
        text = b"".join(texts[k] for k in group)
        ends = np.cumsum([len(texts[k]) // self.unit for k in group])
        pos, lo, hi = self.windows(self._symbols(text), ends)
        owner = np.searchsorted(ends, pos, side="right")
        base = np.concatenate(([0], ends))
        for x, a, b, o in zip(pos.tolist(), lo.tolist(), hi.tolist(), owner.tolist(), strict=True):
            yield group[o], x - int(base[o]), x - a, b + self.span - x, *self._hashes(text, x, a, b + self.span)

    def _long(self, k: int, text: bytes):
        """Slices overlap by span - 1 bytes, so that each window lies in one; an anchor's run that goes on is joined."""
        open_run: tuple[int, int, int] | None = None
        whole = self._symbols(text)
        for at in range(0, len(whole) - self.span + 1, SEGMENT):
            piece = whole[at : at + SEGMENT + self.span - 1]
            for x, a, b in zip(*(v.tolist() for v in self.windows(piece, np.array([len(piece)]))), strict=True):
                x, a, b = x + at, a + at, b + at
                if open_run and open_run[0] == x:
                    open_run = (x, open_run[1], b)
                    continue
                if open_run:
                    y, c, d = open_run
                    yield k, y, y - c, d + self.span - y, *self._hashes(text, y, c, d + self.span)
                open_run = (x, a, b)
        if open_run:
            y, c, d = open_run
            yield k, y, y - c, d + self.span - y, *self._hashes(text, y, c, d + self.span)

    def _hashes(self, text: bytes, x: int, start: int, end: int) -> tuple[int, int]:
        u = self.unit
        return xxhash.xxh3_64_intdigest(text[x * u : (x + self.anchor) * u], seed=u), xxhash.xxh3_64_intdigest(text[start * u : end * u])


def _signed(values) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64))


def _anchor_rows(kinds: list[Kind]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        samplers = [Sampler(span, anchor, unit) for unit, span, anchor in kinds]
        for b in batches:
            keys, texts = b.column("row_key").to_pylist(), b.column("bytes").to_pylist()
            for sampler in samplers:
                rows = list(sampler.anchors([symbols(t, sampler.unit) for t in texts]))
                if rows:
                    k, x, left, right, string, context = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([sampler.unit] * len(k), pa.int32()), pa.array([keys[i] for i in k], pa.int64()), pa.array(x, pa.int32()), pa.array(left, pa.int32()), pa.array(right, pa.int32()), _signed(string), _signed(context)],
                        names=["unit", "row_key", "pos", "before", "after", "string", "context"],
                    )

    return run


ANCHORS = "unit int, row_key long, pos int, before int, after int, string long, context long"


def _context_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cuts the wanted contexts out of each text."""
    names = ("unit", "string", "context", "copies", "row_key", "pos", "many")
    for b in batches:
        out: dict[str, list] = {n: [] for n in (*names, "left", "right")}
        for text, wanted in zip(b.column("bytes").to_pylist(), b.column("wanted").to_pylist(), strict=True):
            by_unit: dict[int, bytes] = {}
            for w in wanted:
                u = w["unit"]
                if u not in by_unit:
                    by_unit[u] = symbols(text, u)
                for n in names:
                    out[n].append(w[n])
                out["left"].append(by_unit[u][(w["pos"] - w["before"]) * u : w["pos"] * u])
                out["right"].append(by_unit[u][w["pos"] * u : (w["pos"] + w["after"]) * u])
        kinds = {"unit": pa.int32(), "string": pa.int64(), "context": pa.int64(), "copies": pa.int64(), "row_key": pa.int64(), "pos": pa.int32(), "left": pa.binary(), "right": pa.binary(), "many": pa.bool_()}
        yield pa.RecordBatch.from_arrays([pa.array(out[n], kinds[n]) for n in kinds], names=list(kinds))


CONTEXT = "unit int, string long, context long, copies long, row_key long, pos int, left binary, right binary, many boolean"


def _common_prefix(a: bytes, b: bytes) -> int:
    lo, hi = 0, min(len(a), len(b))
    if a[:hi] == b[:hi]:
        return hi
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid - 1
    return lo


def repeats_of_group(lefts: list[bytes], rights: list[bytes], span: int, unit: int = BYTES, complete: bool = False) -> Iterator[tuple[int, int, list[int]]]:
    """Maximal repeats of one group as (symbols left of the anchor, symbols right of it, members), left + right >= span.

    Scans the sorted right sides with a stack of common-prefix intervals and merges members by their left sides. The
    repeats cover all that repeats; `members` are those it brings new bytes to or, if complete, all that hold it.
    """
    n = len(rights)
    order = sorted(range(n), key=rights.__getitem__)
    common = [_common_prefix(rights[a], rights[b]) // unit for a, b in zip(order, order[1:], strict=False)] + [-1]
    mirrored = [x[::-1] for x in lefts]
    by_left = sorted(range(n), key=mirrored.__getitem__)
    rank = [0] * n
    for r, i in enumerate(by_left):
        rank[i] = r
    reach = [-1] * n

    def merge(large: list[int], small: list[int], depth: int, new: list[tuple[int, int]]) -> list[int]:
        if len(large) < len(small):
            large, small = small, large
        for r in small:
            bisect.insort(large, r)
        for r in small:
            at, i = bisect.bisect_left(large, r), by_left[r]
            for near in (at - 1, at + 1):
                if 0 <= near < len(large):
                    j = by_left[large[near]]
                    left = _common_prefix(mirrored[i], mirrored[j]) // unit
                    for member in (i, j):
                        if left > reach[member]:
                            reach[member] = left
                            if left + depth >= span:
                                new.append((member, left))
        return large

    def closed(members: list[int], depth: int, new: list[tuple[int, int]]) -> Iterator[tuple[int, int, list[int]]]:
        told = set()
        for i, left in new:
            if not complete:
                yield left, depth, [i]
                continue
            begins = mirrored[i][: left * unit]
            key = lambda r: mirrored[by_left[r]][: len(begins)]  # noqa: E731, B023
            found = bisect.bisect_left(members, begins, key=key), bisect.bisect_right(members, begins, key=key)
            if (left, *found) not in told:
                told.add((left, *found))
                yield left, depth, [by_left[r] for r in members[slice(*found)]]

    stack: list[tuple[int, list[int], list[tuple[int, int]]]] = []
    for k, depth in enumerate(common):
        members = [rank[order[k]]]
        while stack and stack[-1][0] > depth:
            d, held, new = stack.pop()
            members = merge(held, members, d, new)
            yield from closed(members, d, new)
        if depth >= 0:
            if stack and stack[-1][0] == depth:
                _, held, new = stack.pop()
                stack.append((depth, merge(held, members, depth, new), new))
            else:
                stack.append((depth, members, []))


FOUND = "unit int, string long, context long, before int, after int, copies long, row_key long, pos int, left int, right int, shift int, repeat_id long"  # shift: what is told lies so far before the anchor


def _trees(spans: dict[int, int], complete: bool):
    """Rows of contexts, those of a string together -> a row of FOUND for each repeat and each context that holds it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for b in batches:
            for row in zip(*(b.column(n).to_pylist() for n in ("unit", "string", "context", "copies", "row_key", "pos", "left", "right")), strict=True):
                if held and held[-1][1] != row[1]:
                    yield from _found_batches(held, spans, complete)
                    held = []
                held.append(row)
        yield from _found_batches(held, spans, complete)

    return run


def _found_batches(rows: list[tuple], spans: dict[int, int], complete: bool, size: int = 50_000) -> Iterator[pa.RecordBatch]:
    out: list[tuple] = []
    for row in _group(rows, spans, complete):
        out.append(row)
        if len(out) >= size:
            yield _found_batch(out)
            out = []
    if out:
        yield _found_batch(out)


def _found_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    i32, i64 = pa.int32(), pa.int64()
    kinds = (i32, i64, i64, i32, i32, i64, i64, i32, i32, i32, i32)
    names = [f.split()[0] for f in FOUND.split(", ")]
    return pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(columns, kinds, strict=False)), _signed(list(columns[-1]))], names=names)


def _group(rows: list[tuple], spans: dict[int, int], complete: bool) -> Iterator[tuple]:
    rows = list({(r[4], r[5]): r for r in rows}.values())  # rows repeated in the table cut the same context again
    if len(rows) < 2:
        return
    unit = rows[0][0]
    if complete:  # a context with copies stands twice, so that it repeats as a whole
        rows += [r for r in rows if r[3] > 1]
    for a, d, members in repeats_of_group([r[6] for r in rows], [r[7] for r in rows], spans[unit], unit, complete):
        repeat: int | None = None
        for unit, string, context, copies, key, pos, left, right in {rows[i][2:6]: rows[i] for i in members}.values():
            if complete or copies == 1:  # the others are covered whole
                if repeat is None:
                    repeat = xxhash.xxh3_64_intdigest(left[len(left) - a * unit :] + right[: d * unit])
                yield unit, string, context, len(left) // unit, len(right) // unit, copies, key, pos, a, d, 0, repeat


def _windows(spans: dict[int, int]):
    """Each window of a context as a row, for the groups that are too large for one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for unit, string, context, key, pos, copies, left, right in zip(*(b.column(n).to_pylist() for n in ("unit", "string", "context", "row_key", "pos", "copies", "left", "right")), strict=True):
                whole, span, before, after = left + right, spans[unit] * unit, len(left) // unit, len(right) // unit
                starts = range(before + after - spans[unit] + 1)
                hashes = [xxhash.xxh3_128_digest(whole[i * unit : i * unit + span]) for i in starts]
                same = lambda v, t: pa.array([v] * len(starts), t)  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays(
                    [pa.array(hashes, pa.binary()), same(unit, pa.int32()), same(string, pa.int64()), same(context, pa.int64()), same(before, pa.int32()), same(after, pa.int32()), same(copies, pa.int64()), same(key, pa.int64()), same(pos, pa.int32()), pa.array([before - i for i in starts], pa.int32())],
                    names=["window", "unit", "string", "context", "before", "after", "copies", "row_key", "pos", "left"],
                )

    return run


WINDOWS = "window binary, unit int, string long, context long, before int, after int, copies long, row_key long, pos int, left int"
OWN = ["unit", "string", "context", "before", "after"]


def _repeats(docs: DataFrame, id_col: str, text_col: str, kinds: list[Kind], group_limit: int, complete: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(anchors that repeat, (OWN, copies) of the contexts that do, repeats inside contexts as FOUND)."""
    spans = {unit: span for unit, span, _ in kinds}
    keyed = docs.select(row_key(id_col, text_col).alias("row_key"), utf8(text_col).alias("bytes"))
    anchors = staged(keyed.mapInArrow(_anchor_rows(kinds), ANCHORS), "anchors")
    # strings that occur twice or more; one_context: all their contexts are equal
    strings = anchors.groupBy("string").agg(F.count("*").alias("n"), F.min("context").alias("c0"), F.max("context").alias("c1"), F.min("before").alias("b0"), F.max("before").alias("b1"))
    repeated = staged(strings.where("n > 1").select("string", ((F.col("c0") == F.col("c1")) & (F.col("b0") == F.col("b1"))).alias("one_context")), "strings")
    # read from files, so that both sides of a join are dealt for it alone and Spark can split a hot string
    kept = staged(anchors.join(repeated, "string"), "repeated")
    unstaged(anchors, repeated)
    contexts = staged(kept.where("not one_context").groupBy(*OWN).agg(F.count("*").alias("copies"), F.min("row_key").alias("row_key"), F.min_by("pos", "row_key").alias("pos")), "contexts")
    size = staged(contexts.groupBy("string").agg(F.count("*").alias("members")).where("members > 1"), "members")
    wanted = contexts.join(size, "string").withColumn("many", F.col("members") > group_limit)
    per_doc = wanted.groupBy("row_key").agg(F.collect_list(F.struct(*OWN, "copies", "row_key", "pos", "many")).alias("wanted"))
    pieces = staged(keyed.join(per_doc, "row_key").select("bytes", "wanted").mapInArrow(_context_bytes, CONTEXT), "pieces")
    unstaged(size)
    trees = pieces.where("not many").drop("many").repartition("string").sortWithinPartitions("string").mapInArrow(_trees(spans, complete), FOUND)
    spread = pieces.where("many").dropDuplicates(["string", "context", "row_key", "pos"]).mapInArrow(_windows(spans), WINDOWS)
    often = spread.groupBy("unit", "window").agg(F.sum("copies").alias("n")).where("n > 1").select("unit", "window")
    of_unit = reduce(lambda a, b: F.when(F.col("unit") == b[0], b[1]).otherwise(a), spans.items(), F.lit(0))
    hot = spread.join(often, ["unit", "window"]).withColumn("right", of_unit - F.col("left")).withColumn("shift", F.col("left")).withColumn("repeat_id", F.xxhash64("window"))
    if not complete:
        hot = hot.where("copies = 1")
    names = [f.split()[0] for f in FOUND.split(", ")]
    return kept, contexts.where("copies > 1").select(*OWN), trees.select(*names).unionByName(hot.select(*names))


def _span(left: str, right: str, repeat: str) -> list[Column]:
    return [F.col("row_key"), (F.col("pos") - F.col(left)).alias("lo"), (F.col("pos") + F.col(right)).alias("hi"), F.col(repeat).alias("repeat_id")]


def _limited_broadcast(df: DataFrame) -> DataFrame:
    """Beyond the limit a shuffle join, of which Spark splits hot keys."""
    return F.broadcast(df) if df.count() <= BROADCAST_CONTEXTS else df


def repeat_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN, anchor: int = ANCHOR, group_limit: int = 20_000, words: tuple[int, int] | None = None) -> DataFrame:
    """What the repeats of `span` bytes or more cover: (row_key, lo, hi, repeat_id, unit).

    Rows with one repeat_id hold the same bytes, but a repeat isn't told where a longer one covers it: see repeat_groups.
    row_key is ravelin.llm.common.row_key of the document; lo and hi are positions in bytes. The union of a document's
    spans is exactly the bytes that windows occurring elsewhere cover. With `words` (span and anchor in words) there are
    rows of unit 8 too, which say the same of words, in positions of words, whatever white space is between them.
    """
    kinds = [(BYTES, span, anchor), *([(WORDS, *words)] if words else [])]
    kept, copied, found = _repeats(docs, id_col, text_col, kinds, group_limit, complete=False)
    whole = kept.where("one_context").unionByName(kept.where("not one_context").join(_limited_broadcast(staged(copied, "copied")), OWN).select(*kept.columns))
    return whole.select(*_span("before", "after", "context"), "unit").unionByName(found.select(*_span("left", "right", "repeat_id"), "unit"))


def repeat_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN, anchor: int = ANCHOR, group_limit: int = 20_000) -> DataFrame:
    """Maximal repeats of `span` bytes or more with all their occurrences: (repeat_id, n, row_key, lo, hi).

    n is the number of occurrences. Every place that repeats lies in a repeat; one inside others is told too where a
    document holds it without a longer one. A repeat that runs over several anchors is joined to one as far as all its
    occurrences go on alike; where only some do, and in groups beyond `group_limit`, it is told in parts. Rows repeated in docs are one document here, and a repeat needs two places. The rows can be
    many more than the documents: nested repeats each tell all their occurrences.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).dropDuplicates()
    kept, _, found = _repeats(rows, "id", "text", [(BYTES, span, anchor)], group_limit, complete=True)
    alone, with_copies = found.where("copies = 1"), found.where("copies > 1").drop("row_key", "pos", "copies")
    expanded = with_copies.join(kept.where("not one_context").select(*OWN, "row_key", "pos"), OWN)
    parts = [kept.where("one_context").select(*_span("before", "after", "context"), "pos"), *(x.select(*_span("left", "right", "repeat_id"), (F.col("pos") - F.col("shift")).alias("pos")) for x in (alone, expanded))]
    spans = reduce(DataFrame.unionByName, parts).groupBy("repeat_id", "row_key", "lo", "hi").agg(F.min("pos").alias("pos"))
    return _joined_over_anchors(staged(spans, "spans"))


def _joined_over_anchors(spans: DataFrame) -> DataFrame:
    """Repeats whose every occurrence goes on with the same next repeat at the same distance become one."""
    counted = staged(spans.join(staged(spans.groupBy("repeat_id").agg(F.count("*").alias("n")).where("n > 1"), "counts"), "repeat_id"), "counted")
    placed = counted.withColumn("place", F.dense_rank().over(Window.partitionBy("row_key").orderBy("pos")))
    after = placed.select("row_key", (F.col("place") - 1).alias("place"), F.col("repeat_id").alias("next"), F.col("lo").alias("next_lo"), F.col("hi").alias("next_hi"), F.col("n").alias("next_n"))
    pairs = placed.join(after, ["row_key", "place"]).where("next_n = n and next_lo between lo and hi and next_hi >= hi").withColumn("step", F.col("next_lo") - F.col("lo"))
    firm = staged(pairs.groupBy("repeat_id", "next", "step", "n").agg(F.count("*").alias("m")).where("m = n").select("repeat_id", "next", "step"), "firm")
    rows = counted.join(firm, "repeat_id", "left").repartition("row_key").sortWithinPartitions("row_key", "pos", "lo", "hi")
    joined = rows.select("row_key", "lo", "hi", "repeat_id", "next", "step").mapInArrow(_chains, "repeat_id long, row_key long, lo int, hi int").dropDuplicates()
    joined = staged(joined, "groups")
    return joined.join(joined.groupBy("repeat_id").agg(F.count("*").alias("n")), "repeat_id").select("repeat_id", "n", "row_key", "lo", "hi")


def _chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a document in order of place -> one row for each chain of repeats. Holds the chains that are open only."""
    document: int | None = None
    waiting: dict[tuple[int, int], tuple[bytes, int]] = {}  # (repeat that comes, its lo) -> (ids and steps so far, lo of the first)
    for b in batches:
        out: list[tuple[int, int, int, int]] = []
        for key, lo, hi, repeat, following, step in zip(*(b.column(n).to_pylist() for n in ("row_key", "lo", "hi", "repeat_id", "next", "step")), strict=True):
            if key != document:
                document, waiting = key, {}
            path, first = waiting.pop((repeat, lo), (b"", lo))
            path += struct.pack("<q", repeat)
            if following is None:
                whole = repeat if len(path) == 8 else xxhash.xxh3_64_intdigest(path) - (1 << 63)
                out.append((whole, key, first, hi))
            else:
                other = waiting.get((following, lo + step))
                if other is None or other[1] > first:
                    waiting[(following, lo + step)] = (path + struct.pack("<q", step), first)
        columns = list(zip(*out, strict=True)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], names=["repeat_id", "row_key", "lo", "hi"])


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sizes, removed, runs, digests, repeated = [], [], [], [], []
        for text, spans in zip(b.column("bytes").to_pylist(), b.column("spans").to_pylist(), strict=True):
            merged = _merged(s for s in spans or () if s["unit"] == BYTES)
            at, parts = 0, []
            for lo, hi in merged:
                parts.append(text[at:lo])
                at = hi
            parts.append(text[at:])
            kept = b"".join(parts)
            sizes.append(len(text))
            removed.append(len(text) - len(kept))
            runs.append(len(merged))
            digests.append(hashlib.sha256(kept).hexdigest())
            repeated.append(sum(hi - lo for lo, hi in _merged(s for s in spans or () if s["unit"] == WORDS)))
        out = [b.column("id"), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(digests, pa.string()), pa.array(repeated, pa.int64())]
        yield pa.RecordBatch.from_arrays(out, names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passage_words"])


def _merged(spans: Iterator[dict]) -> list[list[int]]:
    merged: list[list[int]] = []
    for lo, hi in sorted((s["lo"], s["hi"]) for s in spans):
        if merged and lo <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], hi)
        else:
            merged.append([lo, hi])
    return merged


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN, anchor: int = ANCHOR, group_limit: int = 20_000, words: tuple[int, int] = (PASSAGE, PASSAGE_ANCHOR)) -> DataFrame:
    """One row per row of docs: id, n_bytes, n_removed, n_spans and kept_sha256 after taking out all repeated bytes, and
    n_passage_words: how many words lie in passages of `words[0]` words or more that occur elsewhere too (the same
    document included, white space aside), which can be shorter than `span` bytes and are left in then.

    A null text is an empty one. Rows repeated in docs are copies of each other, so they lose what they share. A null id
    is a document like any other. Texts shorter than `span` and an empty table lose nothing. Other columns are ignored.
    """
    spans = repeat_spans(docs, id_col, text_col, span, anchor, group_limit, words)
    per_doc = spans.groupBy("row_key").agg(F.collect_set(F.struct("unit", "lo", "hi")).alias("spans"))
    keyed = docs.select(F.col(id_col).alias("id"), row_key(id_col, text_col).alias("row_key"), utf8(text_col).alias("bytes"))
    id_type = keyed.schema["id"].dataType.simpleString()
    done = keyed.join(per_doc, "row_key", "left").select("id", "bytes", "spans").mapInArrow(_remove, f"id {id_type}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passage_words long")
    return done.withColumnRenamed("id", id_col)

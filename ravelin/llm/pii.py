"""Information-theoretic sanitisation of personal data.

1. Base. Patterns find the protected entities: e-mail addresses, IP numbers, payment cards and telephone numbers. All
   digit-based kinds lie in runs of digits and a few signs, so a text is scanned once for these runs.
2. Co-occurrence. A mention of an entity gives the distinct terms within `window` words around it. It counts for the
   entity c itself and for its classes c: its kind, and its domain (e-mail) or leading digits (others), so that entities
   mentioned once say something together. Mentions with equal surroundings (copies) count once, and so do equal texts.
   n(c), n(c, t) are numbers of mentions, n(t) and N numbers of words, all over the whole corpus.
3. Disclosure. With P(c) = n(c) / N and the smoothed P(c | t) = (n(c, t) + `smooth` P(c)) / (n(t) + `smooth`) a term t
   gives away PMI(c, t) = log(P(c | t) / P(c)) of the information IC(c) = -log P(c); disclosure is their quotient, near
   1 for a term that often stands beside c and nowhere else. Every term beside `min_support` mentions of c counts.
4. Sanitising. In documents that mention c (an entity, or one of the class), its terms are generalised from GENERALISE on and removed from REMOVE on.

Only terms that stand beside entities are counted over the corpus: their hashes are looked up in a bit table of fixed
size, so no vocabulary is shuffled or broadcast. An entity can have any number of terms: they are rows, and a document
gives out only those pairs of its entities and words that a second such table lets through.
"""

from __future__ import annotations

import bisect
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ravelin.llm.common import bit_table, bit_words, row_key, staged

KINDS = ("email", "ip", "card", "phone")
WINDOW, MIN_SUPPORT = 8, 3
SMOOTH = 1.0
PREFIX = {"ip": 2, "card": 6, "phone": 4}  # the class of an IP number: its first parts; of others: their first digits
MIN_SHARE = 0.0  # no share of the mentions is asked for
GENERALISE, REMOVE = 0.75, 0.9
TABLE_BITS = 24  # of a bit table: 2 MB
BROADCAST_DOCUMENTS = 1_000_000  # keys of 8 bytes
BROADCAST_PAIRS = 500_000  # of entity and term, 24 bytes; above, they are joined by a shuffle
SALT = 32  # parts of a pair in that shuffle

Span = tuple[str, int, int]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_NUMERIC = re.compile(r"[+0-9][0-9.() -]{2,}")
_IP = re.compile(r"[0-9]++(?:\.[0-9]++){3}")
_DIGITS = re.compile(r"[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_TERM = re.compile(r"[^\W_]{3,}")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """From each @ to both sides: no scan begins twice in one run of letters."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            end = m.end()
            at = text.find("@", end)
        else:
            at = text.find("@", at + 1)


def _ips(text: str, lo: int, hi: int) -> Iterator[tuple[int, int]]:
    """At each run of digits once; a run that begins no number of four parts begins none further on either."""
    at = lo
    while m := _DIGITS.search(text, at, hi):
        whole = _IP.match(text, m.start(), hi)
        at = whole.end() if whole else m.end()
        if whole and all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in whole.group().split(".")):
            yield whole.span()


def luhn(digits: str) -> bool:
    doubled = [2 * int(d) for d in digits[-2::-2]]
    return (sum(int(d) for d in digits[-1::-2]) + sum(d - 9 * (d > 9) for d in doubled)) % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Protected entities by kind as listed, then by start."""
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    if "@" in text:
        found["email"] = list(_emails(text))
    for m in _NUMERIC.finditer(text):
        run, (lo, hi) = m.group(), m.span()
        if len(run) < 7:
            continue
        if run.count(".") >= 3:
            found["ip"] += _ips(text, lo, hi)
        if len(run) >= 16:
            for c in _CARD.finditer(text, lo, hi):
                digits = c.group().replace(" ", "").replace("-", "")
                if 16 <= len(digits) <= 19 and luhn(digits):
                    found["card"].append(c.span())
        if run[0] == "+" and (p := _PHONE.match(text, lo, hi)) and 8 <= sum(map(str.isdigit, p.group())) <= 15:
            found["phone"].append(p.span())
    return [(k, a, b) for k in KINDS for a, b in found[k]]


def entity_of(kind: str, value: str) -> int:
    """An entity's number: the same for each way to write it."""
    plain = value.lower() if kind == "email" else value if kind == "ip" else "".join(filter(str.isdigit, value))
    return xxhash.xxh3_64_intdigest(f"{kind}:{plain}") - (1 << 63)


def classes_of(kind: str, value: str) -> list[str]:
    """Its kind, and a class within."""
    if kind == "email":
        return [kind, f"{kind}:@{value.lower().partition('@')[2]}"]
    if kind == "ip":
        return [kind, f"{kind}:{'.'.join(value.split('.')[: PREFIX[kind]])}.*"]
    return [kind, f"{kind}:{''.join(filter(str.isdigit, value))[: PREFIX[kind]]}*"]


def entities_of(kind: str, value: str) -> list[int]:
    """The numbers of an entity and of its classes."""
    return [entity_of(kind, value), *(xxhash.xxh3_64_intdigest(f"class:{c}") - (1 << 63) for c in classes_of(kind, value))]


def term_of(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word.lower()) - (1 << 63)


def surroundings(text: str, spans: list[Span], window: int) -> Iterator[tuple[list[int], list[int]]]:
    """(entity and its classes, distinct terms around it) of each mention; words inside any entity are no terms.

    A text is cut into words only around its entities, as far out as `window` words can reach in ordinary prose, and
    wider where they don't.
    """
    taken = sorted((a, b) for _, a, b in spans)
    starts, ends = [a for a, _ in taken], list(_running_max(b for _, b in taken))

    def free(m: re.Match) -> bool:
        k = bisect.bisect_left(starts, m.end()) - 1
        return k < 0 or ends[k] <= m.start()

    for kind, a, b in spans:
        before = _nearest(text, a, window, free, -1)
        after = _nearest(text, b, window, free, 1)
        yield entities_of(kind, text[a:b]), sorted({term_of(w) for w in (*before, *after)})


def _running_max(values: Iterator[int]) -> Iterator[int]:
    most = 0
    for v in values:
        most = max(most, v)
        yield most


def _nearest(text: str, at: int, window: int, free, side: int) -> list[str]:
    reach = 24 * window
    while True:
        lo, hi = (max(0, at - reach), at) if side < 0 else (at, min(len(text), at + reach))
        # a word that the slice cuts goes on outside: it is left to a wider slice
        words = [m for m in _TERM.finditer(text, lo, hi) if free(m) and (side > 0 or lo == 0 or m.start() > lo) and (side < 0 or hi == len(text) or m.end() < hi)]
        if len(words) >= window or (lo == 0 if side < 0 else hi == len(text)):
            return [m.group() for m in (words[-window:] if side < 0 else words[:window])]
        reach *= 4


def _base_rows(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mention = pa.struct([("entities", pa.list_(pa.int64())), ("around", pa.int64()), ("terms", pa.list_(pa.int64()))])
        for b in batches:
            spans, mentions = [], []
            for text in b.column("text").to_pylist():
                got = base_spans(text)
                spans.append([{"kind": k, "start": x, "end": y} for k, x, y in got])
                mentions.append([{"entities": e, "around": xxhash.xxh3_64_intdigest(np.array(t, np.int64).tobytes()) - (1 << 63), "terms": t} for e, t in surroundings(text, got, window)] if got else [])
            kinds = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("row_key"), pa.array(spans, kinds), pa.array(mentions, pa.list_(mention))], names=["id", "row_key", "spans", "mentions"])

    return run


SPANS = "array<struct<kind:string,start:bigint,end:bigint>>"
MENTIONS = "array<struct<entities:array<bigint>,around:bigint,terms:array<bigint>>>"


def _word_counts(bits: int, table: bytes):
    """Counts of the words whose hash is in the bit table; (null, n) is the number of all words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.frombuffer(table, np.uint8)
        total, seen, memory = 0, Counter(), {}

        def rows() -> pa.RecordBatch:
            nonlocal total
            batch = pa.RecordBatch.from_arrays([pa.array([None, *seen], pa.int64()), pa.array([total, *seen.values()], pa.int64())], names=["term", "n"])
            total = 0
            seen.clear()
            return batch

        for b in batches:
            counts: Counter = Counter()
            for text in b.column("text").to_pylist():
                counts.update(_TERM.findall(text) if len(text) < 1 << 22 else (m.group() for m in _TERM.finditer(text)))
            total += counts.total()
            for w, n in counts.items():
                h = memory.get(w)
                if h is None:
                    if len(memory) > 400_000:
                        memory.clear()
                    h = term_of(w)
                    slot = (h + (1 << 63)) >> (64 - bits)
                    h = memory[w] = h if known[slot >> 3] >> (slot & 7) & 1 else 0
                if h:
                    seen[h] += n
            if len(seen) > 300_000:
                yield rows()
        yield rows()

    return run


def _bit_table(hashes: Column, rows: DataFrame, bits: int = TABLE_BITS) -> bytes:
    """A bit for each hash, at its upper bits."""
    return bit_table(bit_words(rows, F.shiftrightunsigned(hashes.bitwiseXOR(F.lit(-(1 << 63))), 64 - bits)), bits)


def _in_table(table: np.ndarray, hashes: np.ndarray, bits: int = TABLE_BITS) -> np.ndarray:
    slot = (hashes.view(np.uint64) ^ np.uint64(1 << 63)) >> np.uint64(64 - bits)
    return (table[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 > 0


def _term_places(term_table: bytes, pair_table: bytes):
    """(row_key, entity, term, places) of the document's entities and of its words outside base spans, where both tables know the pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, pairs = np.frombuffer(term_table, np.uint8), np.frombuffer(pair_table, np.uint8)
        for b in batches:
            rows: list[tuple[int, int, int, list]] = []
            for key, text in zip(b.column("row_key").to_pylist(), b.column("text").to_pylist(), strict=True):
                spans = base_spans(text)
                taken = sorted((x, y) for _, x, y in spans)
                starts, ends = [x for x, _ in taken], list(_running_max(y for _, y in taken))
                places: dict[int, list] = {}
                hashes: dict[str, int] = {}
                for m in _TERM.finditer(text):
                    k = bisect.bisect_left(starts, m.end()) - 1
                    if k < 0 or ends[k] <= m.start():
                        h = hashes.get(m.group())
                        if h is None:
                            h = hashes[m.group()] = term_of(m.group())
                        places.setdefault(h, []).append({"start": m.start(), "end": m.end()})
                words = np.array(list(places), np.int64)
                words = words[_in_table(terms, words)] if len(words) else words
                if not len(words):
                    continue
                for e in sorted({e for k, x, y in spans for e in entities_of(k, text[x:y])}):
                    rows += [(key, e, w, places[w]) for w in words[_in_table(pairs, words ^ np.int64(e))].tolist()]
                    if len(rows) > 100_000:
                        yield _place_batch(rows)
                        rows = []
            yield _place_batch(rows)

    return run


def _place_batch(rows: list[tuple[int, int, int, list]]) -> pa.RecordBatch:
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    return pa.RecordBatch.from_arrays([*(pa.array([r[k] for r in rows], pa.int64()) for k in range(3)), pa.array([r[3] for r in rows], kind)], names=["row_key", "entity", "term", "places"])


def _distinct_texts(texts: DataFrame) -> DataFrame:
    """texts(text) without repetitions; only texts that are repeated are shuffled."""
    keyed = texts.select(F.xxhash64("text").alias("key"), "text")
    copied = staged(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "copied-texts")
    mark = F.broadcast(copied) if copied.count() <= BROADCAST_DOCUMENTS else copied
    one_each = keyed.join(mark, "key", "left_semi").groupBy("key").agg(F.first("text").alias("text"))
    return keyed.join(mark, "key", "left_anti").select("text").union(one_each.select("text"))


def disclosing_terms(mentions: DataFrame, texts: DataFrame, window: int = WINDOW, min_support: int = MIN_SUPPORT, threshold: float = GENERALISE, table_bits: int = TABLE_BITS, smooth: float = SMOOTH) -> DataFrame:
    """mentions(entity, around, terms), texts(text) -> (entity, term, disclosure) from the threshold on."""
    distinct = staged(mentions.groupBy("entity", "around").agg(F.first("terms").alias("terms")), "mentions")
    often = distinct.groupBy("entity").agg(F.count("*").alias("n_c")).where(F.col("n_c") >= min_support)
    pairs = distinct.select("entity", F.explode("terms").alias("term")).groupBy("entity", "term").agg(F.count("*").alias("n_ct")).where(F.col("n_ct") >= min_support)
    pairs = staged(staged(pairs, "supported").join(staged(often, "entities"), "entity"), "pairs")  # from files: Spark can split a hot class
    table = _bit_table(F.col("term"), pairs, table_bits)
    counts = _distinct_texts(texts).mapInArrow(_word_counts(table_bits, table), "term long, n long").groupBy("term").agg(F.sum("n").alias("n_t"))
    counts = staged(counts, "word-counts")
    total = counts.where("term is null").agg(F.coalesce(F.sum("n_t"), F.lit(0))).first()[0]
    p = F.col("n_c") / F.lit(float(max(total, 1)))
    ic = -F.log(p)
    pmi = F.log((F.col("n_ct") + smooth * p) / ((F.greatest("n_t", "n_ct") + smooth) * p))
    return pairs.join(counts, "term").withColumn("disclosure", F.when(ic > 0, F.least(F.lit(1.0), pmi / ic)).otherwise(0.0)).where(F.col("disclosure") >= threshold).select("entity", "term", "disclosure")


def protected_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, min_support: int = MIN_SUPPORT, threshold: float = GENERALISE) -> DataFrame:
    """One row per row of docs: id, row_key, spans (base entities by kind, then start) and terms (start, end, disclosure).

    A null text is empty; rows repeated in docs are copies, so their mentions count once, and each gets its spans; null
    ids are documents of their own. An empty table gives an empty result. Other columns are ignored.
    """
    given = docs.select(F.col(id_col).alias("id"), row_key(id_col, text_col).alias("row_key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = given.schema["id"].dataType.simpleString()
    base = staged(given.mapInArrow(_base_rows(window), f"id {kind}, row_key long, spans {SPANS}, mentions {MENTIONS}"), "base-spans")
    mentions = base.select(F.explode("mentions").alias("m")).select(F.explode("m.entities").alias("entity"), "m.around", "m.terms")
    found = staged(disclosing_terms(mentions, given.select("text"), window, min_support, threshold), "disclosing")
    entities = found.select("entity").distinct()
    few = found.count() <= BROADCAST_PAIRS
    mentioned = base.where(F.size("mentions") > 0).select("row_key", F.explode(F.array_distinct(F.flatten(F.transform("mentions", lambda m: m["entities"])))).alias("entity"))
    wanted = staged(mentioned.join(F.broadcast(entities) if few else entities, "entity", "left_semi").select("row_key").distinct(), "wanted")
    given = given.select("row_key", "text").join(F.broadcast(wanted) if wanted.count() <= BROADCAST_DOCUMENTS else wanted, "row_key", "left_semi")
    tables = _bit_table(F.col("term"), found), _bit_table(F.col("entity").bitwiseXOR(F.col("term")), found)
    places = given.mapInArrow(_term_places(*tables), "row_key long, entity long, term long, places array<struct<start:bigint,end:bigint>>")
    if few:
        sure = places.join(F.broadcast(found), ["entity", "term"])
    else:  # a pair can be in very many documents
        salted = found.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        sure = places.withColumn("salt", F.pmod("row_key", F.lit(SALT)).cast("int")).join(salted, ["entity", "term", "salt"])
    each = sure.select("row_key", F.explode("places").alias("p"), "disclosure").groupBy("row_key", "p").agg(F.max("disclosure").alias("disclosure"))
    placed = each.groupBy("row_key").agg(F.array_sort(F.collect_list(F.struct("p.start", "p.end", "disclosure"))).alias("terms"))  # a document's words at most
    return base.select("id", "row_key", "spans").join(placed, "row_key", "left").select(F.col("id").alias(id_col), "row_key", "spans", F.coalesce("terms", F.array().cast("array<struct<start:bigint,end:bigint,disclosure:double>>")).alias("terms"))


def span_list(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _rewritten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for text, spans, terms in zip(b.column("text").to_pylist(), b.column("spans").to_pylist(), b.column("terms").to_pylist(), strict=True):
            if text is None or not (spans or terms):
                out.append(text)
                continue
            marks = [(s["start"], s["end"], f"[{s['kind'].upper()}]") for s in spans or ()]
            for t in terms or ():
                general = "[NUMBER]" if any(map(str.isdigit, text[t["start"] : t["end"]])) else "[WORD]"
                marks.append((t["start"], t["end"], general if t["disclosure"] < REMOVE else ""))
            at, parts = 0, []
            for lo, hi, mark in sorted(marks):
                if lo >= at:
                    parts += [text[at:lo], mark]
                at = max(at, hi)
            out.append("".join([*parts, text[at:]]))
        rest = [n for n in b.schema.names if n not in ("text", "spans", "terms")]
        yield pa.RecordBatch.from_arrays([*(b.column(n) for n in rest), pa.array(out, pa.string())], names=[*rest, "text"])


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(id, text): entities replaced by their kind, disclosing terms generalised to [WORD] or [NUMBER], or removed. Edge cases as in protected_spans."""
    given = docs.select(F.col(id_col).alias("id"), row_key(id_col, text_col).alias("row_key"), F.col(text_col).alias("text"))
    kind = given.schema["id"].dataType.simpleString()
    found = protected_spans(docs, id_col, text_col, **options).dropDuplicates(["row_key"]).select("row_key", "spans", "terms")
    return given.join(found, "row_key", "left").select("id", "text", "spans", "terms").mapInArrow(_rewritten, f"id {kind}, text string").withColumnRenamed("id", id_col)


def digest_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """protected_spans as counts and digests: id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_terms."""
    found = protected_spans(docs, id_col, text_col)
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    terms = F.transform("terms", lambda t: F.struct(F.lit("term").alias("kind"), t["start"].alias("start"), t["end"].alias("end")))
    return found.select(id_col, *(count(k) for k in KINDS), F.sha2(span_list(F.col("spans")).cast("binary"), 256).alias("base_sha256"), span_list(F.concat("spans", terms)).alias("spans"), F.size("terms").cast("long").alias("n_terms"))

"""Cost-balanced packing of token ids into sequences.

A document is its ids and an end id. What fills whole sequences is cut off first. The rest of a chunk of documents goes
to just as many sequences as its ids need: documents in descending length, each to the sequence of least estimated
training cost (linear * n + quadratic * n * n for each piece of n ids) that still has room. A document that fits
nowhere is cut and fills the sequences with most room. The capacities of a chunk add up to its ids exactly: whole
sequences of `capacity`, and for the remainder sequences of powers of two, which need no padding.

A chunk is at most `chunk_tokens` ids of one input partition, so there is no shuffle, no group that grows with the
input, and a lost task is computed again alone. A sequence_id holds the partition above its number in the partition.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ravelin.llm.common import utf8

CAPACITY, END_ID = 2048, 1
CHUNK_TOKENS = 2_000_000
LINEAR, QUADRATIC = 1.0, 1.0 / CAPACITY
PIECES_AT_ONCE = 20_000


class Ids:
    """Ids by a byte-level BPE file of the tokenizers library.

    In such a file the ids follow the order of the merges, so tiktoken gets the same ids from the file's vocabulary in a
    fraction of the time. A text that has one of the file's added strings, a very long white space, or a character outside
    Latin and common punctuation (where libraries can differ in what counts as a letter), is encoded by tokenizers itself;
    so is every text if the file's merges have another order.
    """

    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = [re.escape(x.content) for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.odd = re.compile("|".join([r"[^\x00-\x1B\x20-\x84\x86-ɏ‐-‧€]", r"\s{4000}", *added])).search
        self.fast = self._tiktoken(path)

    def _tiktoken(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]  # the others are written as letters from 256 on
        byte_of = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(shown))}
        whole = {w: k for w, k in model["vocab"].items() if all(c in byte_of for c in w)}
        ranks = {bytes(byte_of[c] for c in w): k for w, k in whole.items()}
        pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        order = [model["vocab"]["".join(m)] for m in pairs]
        if order != sorted(order) or len(ranks) != 256 + len(order) or len(set(ranks) & {bytes([b]) for b in range(256)}) < 256:
            return None
        return tiktoken.Encoding("file", pat_str=self.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> np.ndarray:
        if self.fast is None or self.odd(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.asarray(self.fast.encode_to_numpy(text, disallowed_special=()), np.uint32)


def capacities(total: int, capacity: int) -> list[int]:
    """Sizes of sequences that hold `total` ids without padding."""
    rest = total % capacity
    return [capacity] * (total // capacity) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def pack(lengths: list[int], capacity: int = CAPACITY, linear: float = LINEAR, quadratic: float = QUADRATIC) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of one chunk; sequences are numbered from 0."""
    pieces, number = [], 0
    rests = []
    for d, n in enumerate(lengths):
        for start in range(0, n - n % capacity, capacity):
            pieces.append((d, start, capacity, number, 0))
            number += 1
        if n % capacity:
            rests.append((n % capacity, d))
    room = np.array(capacities(sum(n for n, _ in rests), capacity), np.int64)
    used, cost = np.zeros(len(room), np.int64), np.zeros(len(room))
    rests.sort(key=lambda x: (-x[0], x[1]))

    def put(d: int, start: int, n: int, s: int) -> None:
        pieces.append((d, start, n, number + s, int(used[s])))
        used[s] += n
        room[s] -= n
        cost[s] += linear * n + quadratic * n * n

    for n, d in rests:
        start = lengths[d] - n
        s = int(np.argmin(np.where(room >= n, cost, np.inf)))
        while room[s] < n:  # it fits nowhere as a whole
            widest = int(np.argmax(room))
            part = int(min(n, room[widest]))
            put(d, start, part, widest)
            start, n = start + part, n - part
            s = int(np.argmin(np.where(room >= n, cost, np.inf)))
        if n:
            put(d, start, n, s)
    return pieces


def _packed(path: str, capacity: int, end_id: int, linear: float, quadratic: float, chunk_tokens: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, part = Ids(path), TaskContext.get().partitionId()
        done, held, size = 0, [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal done
            pieces = pack([len(x) for _, x in held], capacity, linear, quadratic)
            for at in range(0, len(pieces), PIECES_AT_ONCE):
                rows: dict[str, list] = {k: [] for k in ("id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")}
                tokens = []
                for d, start, n, sequence, offset in pieces[at : at + PIECES_AT_ONCE]:
                    own, ids = held[d]
                    cut = ids[start : start + n]
                    for k, v in zip(rows, (own, start, n, zlib.crc32(cut.tobytes()), len(ids), (part << 36) + done + sequence, offset), strict=True):
                        rows[k].append(v)
                    tokens.append(cut.astype(np.int32))
                out = [pa.array(v, kind if k == "id" else pa.int64()) for k, v in rows.items()]
                yield pa.RecordBatch.from_arrays([*out, pa.array(tokens, pa.list_(pa.int32()))] if with_ids else out, names=[*rows, "ids"] if with_ids else list(rows))
            done += 1 + max((p[3] for p in pieces), default=-1)

        kind = pa.int64()
        for b in batches:
            kind = b.schema.field("id").type
            for own, text in zip(b.column("id").to_pylist(), b.column("bytes").to_pylist(), strict=True):
                held.append((own, np.concatenate([ids_of(text.decode("utf-8", "replace")), np.array([end_id], "<u4")])))
                size += len(held[-1][1])
                if size >= chunk_tokens:
                    yield from flush()
                    held, size = [], 0
        yield from flush()

    return run


def pack_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, linear: float = LINEAR, quadratic: float = QUADRATIC, chunk_tokens: int = CHUNK_TOKENS, with_ids: bool = False) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids, if asked for).

    tokenizer: path of a byte-level vocabulary file for the tokenizers library. A null or empty text is the end id alone.
    Repeated rows and rows with a null id are documents of their own. An empty table gives an empty result; other
    columns are ignored.
    """
    given = docs.select(F.col(id_col).alias("id"), utf8(text_col).alias("bytes"))
    id_type = given.schema["id"].dataType.simpleString()
    schema = f"id {id_type}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids
    return given.mapInArrow(_packed(tokenizer, capacity, end_id, linear, quadratic, chunk_tokens, with_ids), schema).withColumnRenamed("id", id_col)

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ravelin.llm.packing import Ids, pack, pack_documents

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string"


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 300), max_size=40))
def test_pieces_fill_their_sequences(lengths):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for d, start, n, s, offset in pack(lengths, capacity=64):
        assert n > 0
        by_doc[d].append((start, n))
        by_sequence[s].append((offset, n))
    for groups, total in ((by_doc, dict(enumerate(lengths))), (by_sequence, None)):
        for k, pieces in groups.items():
            at = 0
            for start, n in sorted(pieces):
                assert start == at
                at += n
            assert at == total[k] if total else at <= 64 and at & (at - 1) == 0
    assert set(by_doc) == set(range(len(lengths)))
    assert sorted(by_sequence) == list(range(len(by_sequence)))


def test_descending_documents_go_to_the_cheapest_sequence():
    lengths = [40, 30, 20, 20, 10, 8]  # 128 ids: two sequences of 64
    where = {d: s for d, _, n, s, _ in pack(lengths, 64)}
    assert where[0] != where[1]
    assert where[2] == where[1]  # 30 + 30 * 30 costs less than 40 + 40 * 40
    cost = lambda s: sum(n + n * n / 2048 for d, _, n, t, _ in pack(lengths, 64) if t == s)
    assert abs(cost(0) - cost(1)) < 2


def texts():
    rng = random.Random(9)
    odd = ["", " ", "\n\n  x", "it's we'll 's ''s !'s", "a  b   c    ", "año  naïve   über 12 345abc", "日本語 text", "<|endoftext|> here", "x\x1cy z\x85w", "\t\ttabs\r\nline", "₁ ½ ² º", "a b  c", "👍🏽 ok"]
    return [*odd, *("".join(rng.choices("abc 'é\n12.,!-\t", k=rng.randint(1, 300))) for _ in range(150)), "word " * 20000, None]


def test_ids_are_those_of_the_tokenizer():
    tokenizer, ids = Tokenizer.from_file(PATH), Ids(PATH)
    for t in texts()[:-1]:
        assert ids(t).tolist() == tokenizer.encode(t, add_special_tokens=False).ids, t[:50]
    ids.WORDS = 50  # a full memory is emptied
    for t in texts()[:-1]:
        assert ids(t).tolist() == tokenizer.encode(t, add_special_tokens=False).ids


def test_documents_can_be_put_together_again(spark):
    given_texts = texts()
    tokenizer = Tokenizer.from_file(PATH)
    docs = spark.createDataFrame([*enumerate(given_texts), (None, "no id"), (3, given_texts[3])], SCHEMA).withColumn("id", F.lit("x")).withColumn("start", F.lit(0))
    rows = pack_documents(docs.repartition(3), PATH, with_ids=True, chunk_tokens=9000).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(int)
    for r in rows:
        assert r.length == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id] += r.length
    assert max(by_sequence.values()) == 2048 and all(n & (n - 1) == 0 for n in by_sequence.values())
    for d, t in enumerate(given_texts):
        if d != 3:
            whole = [i for r in sorted(by_doc[d], key=lambda r: r.start) for i in r.ids]
            assert whole == [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
            assert {r.doc_tokens for r in by_doc[d]} == {len(whole)}
    assert len([r for r in by_doc[3] if r.start == 0]) == 2 and by_doc[None]
    assert pack_documents(spark.createDataFrame([], SCHEMA), PATH).count() == 0

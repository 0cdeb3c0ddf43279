import random
import zlib

import numpy as np
import pytest
from helpers import SF, empty, hard, table

from veridoc.llm import packing as P
from veridoc.llm.queries import queries


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(P.default_vocabulary())


def test_ids_are_the_librarys(spark, library):
    encode = P.coder(P.default_vocabulary())
    texts = ["", " ", "a <|endoftext|> b", "  hi\n\n x", "é😀 日本\t\x00 a", "don't I'LL  ", "x" * 5000, "\u00a0\u2003", "1234567 ½ ²"] + [r["text"] for r in table(spark, "documents").collect()]
    for t in texts:
        assert encode(t).tolist() == library.encode(t, add_special_tokens=False).ids, t[:50]


def test_other_vocabularies_are_run_by_the_library(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library, encode = Tokenizer.from_file(path), P.coder(path)
    for r in table(spark, "documents").limit(20).collect():
        assert encode(r["text"]).tolist() == library.encode(r["text"], add_special_tokens=False).ids


def _check(pieces, docs, library, capacity=2048):
    """Every document's ids are there once, cut as asked, and sequences are gapless."""
    want = []
    for i, text in docs:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        first = len(ids) % capacity or capacity
        at = [0, *range(first, len(ids), capacity)]
        want += [(i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(at, [*at[1:], len(ids)]))]
    key = lambda x: tuple((v is None, v or 0) for v in x)
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in pieces), key=key) == sorted(want, key=key)
    by = {}
    for r in pieces:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for placed in by.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_query(spark, library):
    pieces = queries()["op10_packing"](spark, SF).collect()
    n = _check(pieces, [(r["doc_id"], r["text"]) for r in table(spark, "documents").collect()], library)
    assert n <= -(-sum(r["length"] for r in pieces) // 2048) + 6


def test_hard_rows(spark, library):
    docs = hard(spark)
    _check(P.pack(docs, P.default_vocabulary()).collect(), [(r["doc_id"], r["text"]) for r in docs.collect()], library)
    assert P.pack(empty(spark), P.default_vocabulary()).collect() == []


@pytest.mark.parametrize("seed", range(12))
def test_plans_place_every_piece(seed):
    draw = random.Random(seed)
    capacity = draw.choice([7, 20, 64, 200])
    counts = {draw.randint(1, capacity): draw.randint(1, 50) for _ in range(draw.randint(1, 40))}
    intervals, n = P.plan(counts, capacity)
    seen, fill = {}, {}
    for length, first, count, sequence, offset in intervals:
        for i in range(count):
            assert (length, first + i) not in seen
            seen[length, first + i] = True
            fill.setdefault(sequence + i, []).append((offset, length))
    assert len(seen) == sum(counts.values()) and all(r < counts[x] for x, r in seen)
    assert set(fill) == set(range(n))
    for placed in fill.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= capacity
    least = max(-(-sum(k * v for k, v in counts.items()) // capacity), sum(v for k, v in counts.items() if 2 * k > capacity))
    assert n <= 1.25 * least + 1


def test_exact_complements_are_used():
    intervals, n = P.plan({6: 10, 4: 10, 5: 4, 3: 3, 2: 3}, 10)
    assert n == 14  # ten of 6 + 4, two of 5 + 5, then 3 + 3 + 2 + 2 and 3 + 2
    assert P.plan({}, 10) == ([], 0)

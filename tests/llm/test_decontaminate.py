import random
import time

import numpy as np
from helpers import SF, empty, hard, rows, table

from veridoc.llm import decontaminate as D
from veridoc.llm.queries import queries


def plain_overlap(item, doc, similarity=D.SIMILARITY, min_tokens=D.MIN_TOKENS):
    """Whether some diagonal has a stretch that is long and equal enough: every diagonal, every stretch."""
    least = min(min_tokens, len(item))
    for start in range(-len(item) + 1, len(doc)):
        a, b = max(0, -start), min(len(item), len(doc) - start)
        equal = [int(item[i] == doc[start + i]) for i in range(a, b)]
        sums = np.concatenate([[0], np.cumsum(equal)])
        for i in range(len(equal)):
            for j in range(i + least, len(equal) + 1):
                if sums[j] - sums[i] >= similarity * (j - i) - 1e-9:
                    return True
    return False


def test_query_finds_every_exact_passage(spark):
    got = {(r["doc_id"], r["item_id"]) for r in queries()["op7_decontamination"](spark, SF).collect()}
    docs = {r["doc_id"]: D.tokens(r["text"]).tolist() for r in table(spark, "documents").collect()}
    items = {r["item_id"]: D.tokens(r["text"]).tolist() for r in table(spark, "benchmark").collect()}
    spelled = lambda t: "," + ",".join(map(str, t)) + ","
    want = {(d, i) for d, t in docs.items() for i, x in items.items() if spelled(x) in spelled(t)}
    assert want <= got
    assert {d for d, _ in got} == {d for d, _ in want}


def test_substitutions(spark):
    draw = random.Random(1)
    words = [f"w{i}" for i in range(5000)]
    items = [(i, " ".join(draw.choices(words, k=draw.randint(14, 60)))) for i in range(30)]
    docs = []
    for i in range(60):
        item = items[i % 30][1].split()
        for k in draw.sample(range(len(item)), len(item) * (i // 15) // 10):
            item[k] = draw.choice(words)
        docs.append((i, " ".join([*draw.choices(words, k=80), *item, *draw.choices(words, k=80)])))
    frame = lambda x: spark.createDataFrame(x, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = rows(D.find_overlaps(frame(docs), bench))
    got = {(r[0], r[1]) for r in found}
    want = {(d, i) for d, text in docs for i, t in items if plain_overlap(D.tokens(t).tolist(), D.tokens(text).tolist())}
    assert got <= want and len(want - got) <= 1
    for d, i, start, n, equal in found:
        t, item = D.tokens(docs[d][1]), D.tokens(items[i][1])
        assert n >= D.MIN_TOKENS and equal >= 0.8 * n - 1e-9
        assert max(int((t[start : start + n] == item[o : o + n]).sum()) for o in range(len(item) - n + 1)) >= equal
    left = {r["doc_id"] for r in D.decontaminate(frame(docs), bench).collect()}
    assert left == {i for i, _ in docs} - {r[0] for r in found}
    assert left == {r["doc_id"] for r in D.decontaminate(frame(docs), bench, few=0).collect()}


def test_every_hit_is_verified():
    """On short alphabets, where seeds repeat, the longest overlap is that of all diagonals with a hit."""
    draw = np.random.default_rng(2)
    for _ in range(150):
        t, item = (draw.integers(0, draw.integers(1, 5), n).astype(np.uint64) for n in draw.integers(8, 60, 2))
        best = (0, 0)
        for start in range(-len(item) + 1, len(t)):
            a, b = max(0, -start), min(len(item), len(t) - start)
            equal = item[a:b] == t[start + a : start + b]
            if not any(all(equal[i + k] for k, c in enumerate(m) if c == "1") for m in D.MASKS for i in range(len(equal) - len(m) + 1)):
                continue
            for i in range(len(equal)):
                for j in range(i + min(D.MIN_TOKENS, len(item)), len(equal) + 1):
                    if equal[i:j].sum() >= 0.8 * (j - i) - 1e-9:
                        best = max(best, (j - i, -(start + a + i)))
        got = D.overlap(t, item)
        assert (got[1], -got[0]) == best if best[0] else got is None


def test_repeated_tokens_take_no_square_of_time():
    for text, item in ((["a"] * 20_000, ["a"] * 20_000), (["a"] * 20_000, ["a"] * 2_000), (["a", "b"] * 10_000, ["a", "b", "c"] * 4_000)):
        t, own = D.tokens(" ".join(text)), D.tokens(" ".join(item))
        start = time.time()
        found = D.overlap(t, own)
        assert time.time() - start < 20
        assert (found == (0, len(item), len(item))) if "c" not in item else found is None or found[2] >= 0.8 * found[1]


def test_longest_stretch():
    draw = np.random.default_rng(0)
    for _ in range(300):
        equal = draw.random(draw.integers(1, 30)) < 0.7
        best = max(((j - i) for i in range(len(equal)) for j in range(i + 1, len(equal) + 1) if equal[i:j].mean() >= 0.8 - 1e-9), default=0)
        got = D.longest_stretch(equal, 0.8)
        assert (got[1] if got else 0) == best


def test_hard_rows(spark):
    bench = spark.createDataFrame([(1, None), (2, ""), (3, "one"), (4, "quick brown fox"), (None, "a row"), (5, "QUICK, brown fox jumps over the lazy dog again!"), (5, "word " * 50)], "item_id long, text string").withColumn("doc_id", D.F.lit(0))
    got = {(r["doc_id"], r["item_id"]) for r in D.find_overlaps(hard(spark), bench).collect()}
    assert got == {(4, 3), (5, 4), (6, 4), (5, 5), (6, 5), (8, 5), (None, None)}
    kept = D.decontaminate(hard(spark), bench)
    assert kept.columns == hard(spark).columns and sorted((r["doc_id"] or 0) for r in kept.collect()) == [1, 2, 3, 7, 9]
    assert rows(D.find_overlaps(empty(spark), bench)) == [] == rows(D.find_overlaps(hard(spark), bench.limit(0)))
    assert D.decontaminate(hard(spark), bench.limit(0)).count() == 11

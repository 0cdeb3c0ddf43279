import zlib
from collections import Counter

import numpy as np
from helpers import empty, hard, rows

from veridoc.llm import pitman_yor as P
from veridoc.llm.queries import queries


def plain(docs):
    """The base of every document, in plain Python."""
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    words = [(i, [*(t or "").encode("utf-8", "surrogatepass").lower().split(), b""]) for i, t in docs]
    counts = Counter(w for i, ws in words if not held(i) for w in ws)
    n, v = sum(counts.values()), len(counts)
    return [(i, held(i), len(ws), sum(counts[w] > 0 for w in ws), n, sum(np.log10((counts[w] + 1) / (n + v + 1)) for w in ws)) for i, ws in words]


def _close(got, want):
    key = lambda r: (r[0] is None, r[0] or 0, r[2])
    assert len(got) == len(want)
    for a, b in zip(sorted(got, key=key), sorted(want, key=key)):
        assert a[:5] == b[:5] and abs(a[5] - b[5]) < 1e-6 * max(1, abs(b[5]))


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    got = rows(queries()["op9_language_model"](spark, sf))
    _close(got, plain(rows(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"))))
    held = [r for r in got if r[1]]
    per_token = [sum(r[k] for r in held) / sum(r[2] for r in held) for k in (5, 6)]
    assert per_token[1] > per_token[0] + 0.3


def test_hard_rows(spark):
    got = rows(P.score_documents(hard(spark)))
    _close(got, plain(rows(hard(spark).select("doc_id", "text"))))
    assert all(np.isfinite(r[6]) and r[6] <= 1e-9 for r in got)
    assert rows(P.score_documents(empty(spark))) == []
    untrained = [i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2][:3]
    got = rows(P.score_documents(spark.createDataFrame([(i, "some words") for i in untrained], "doc_id long, text string")))
    assert [(r[4], r[5], r[6]) for r in got] == [(0, 0.0, 0.0)] * 3


def test_words_and_the_unknown_sum_to_one(spark):
    """Over the known words and one unknown, the model's probabilities are a distribution."""
    train = [i for i in range(2000) if zlib.crc32(str(i).encode()) % 7 != 2][:300]
    draw = np.random.default_rng(0)
    texts = [" ".join(f"w{int(x)}" for x in draw.zipf(1.4, 40) if x < 3000) for _ in train]
    known = sorted({w for t in texts for w in t.split()})
    probes = [i for i in range(100_000) if zlib.crc32(str(i).encode()) % 7 == 2][: len(known) + 1]
    docs = list(zip(train, texts)) + list(zip(probes, [*known, "never-seen"])) + [(10_000_001, "")]
    held_empty = next(i for i in range(200_000, 300_000) if zlib.crc32(str(i).encode()) % 7 == 2)
    docs[-1] = (held_empty, "")
    got = {r[0]: r[6] for r in rows(P.score_documents(spark.createDataFrame(docs, "doc_id long, text string")))}
    end = got[held_empty]
    total = 10**end + sum(10 ** (got[i] - end) for i in probes)
    assert abs(total - 1) < 1e-3


def test_seating_keeps_to_the_restaurant_process():
    """The mean number of tables of a dish is that of one-by-one seating."""
    draw = np.random.default_rng(3)
    for customers, weight in ((30, 0.5), (400, 2.0), (3000, 0.2)):
        got = P.seat(np.full(3000, customers), np.full(3000, weight), 0.5, draw).mean()
        t = np.ones(3000)
        for k in range(1, customers):
            t += draw.random(3000) < weight / (k - 0.5 * t + weight)
        assert abs(got - t.mean()) < 0.05 * t.mean() + 0.05


def test_spelling_is_a_distribution():
    keys, counts = P._added(*(lambda k: (k, np.ones(len(k), np.int64)))(P.grams([P.spell(w) for w in (b"abc", b"abd", b"b")])[0]))
    trees = P.Subtrees(keys, counts)
    p1 = np.full(65_536, 1 / P.SYMBOLS)
    for _ in range(5):
        trees.sweep(p1, np.random.default_rng(1))
    for level, p in zip(trees.levels, trees.predictions(p1)):
        assert (np.bincount(level.of, p) <= 1 + 1e-9).all() and (level.tables <= level.customers).all()


def test_word_order_counts(spark):
    """A document in the order of the training texts is likelier than the same words in another."""
    ids = [i for i in range(2000) if zlib.crc32(str(i).encode()) % 7 != 2]
    held = [i for i in range(2000) if zlib.crc32(str(i).encode()) % 7 == 2]
    words = [f"w{i}" for i in range(12)]
    draw = np.random.default_rng(4)
    starts = draw.integers(0, 12, len(ids))
    docs = [(i, " ".join(words[(s + j) % 12] for j in range(20))) for i, s in zip(ids, starts)]
    order = " ".join(words)
    docs += [(held[0], order), (held[1], " ".join(words[::-1]))]
    got = {r[0]: r for r in rows(P.score_documents(spark.createDataFrame(docs, "doc_id long, text string")))}
    assert abs(got[held[0]][5] - got[held[1]][5]) < 1e-9
    assert got[held[0]][6] > got[held[1]][6] + 10


def test_words_after_a_word_sum_to_one(spark):
    """Over the known words, one unknown and the end, what follows a word is a distribution."""
    train = [i for i in range(2000) if zlib.crc32(str(i).encode()) % 7 != 2][:300]
    draw = np.random.default_rng(6)
    texts = [" ".join(f"w{int(x)}" for x in draw.zipf(1.4, 40) if x < 3000) for _ in train]
    known = sorted({w for t in texts for w in t.split()})
    probes = [i for i in range(100_000) if zlib.crc32(str(i).encode()) % 7 == 2][: len(known) + 3]
    docs = list(zip(train, texts)) + list(zip(probes, ["", "w1", *(f"w1 {w}" for w in [*known, "never-seen"])]))
    got = {r[0]: r[6] for r in rows(P.score_documents(spark.createDataFrame(docs, "doc_id long, text string")))}
    end, alone = (got[i] for i in probes[:2])
    assert abs(10**end + sum(10 ** (got[i] - alone) for i in probes[2:]) - 1) < 1e-3


def test_restaurants_of_words_against_a_plain_sampler():
    """What the seatings after a word predict, on average, is what one-by-one Gibbs sampling predicts."""
    counts = {0: {0: 9, 1: 1, 2: 3}, 1: {1: 40, 3: 2}, 2: {0: 1}}
    base, discount, strength = np.array([0.4, 0.1, 0.3, 0.2]), 0.4, P.PAIR_STRENGTH
    draw = np.random.default_rng(9)
    want = {}
    for first, dishes in counts.items():
        tables = {w: [c] for w, c in dishes.items()}
        total, sweeps = {w: 0.0 for w in range(4)}, 600
        for s in range(sweeps + 100):
            for w, c in dishes.items():
                for _ in range(c):
                    seats = tables[w]
                    k = int(draw.choice(len(seats), p=np.array(seats) / sum(seats)))  # a customer of this dish gets up
                    seats[k] -= 1
                    if not seats[k]:
                        seats.pop(k)
                    n = sum(map(len, tables.values()))
                    weight = np.array([x - discount for x in seats] + [(strength + discount * n) * base[w]])
                    k = int(draw.choice(len(weight), p=weight / weight.sum()))
                    if k == len(seats):
                        seats.append(1)
                    else:
                        seats[k] += 1
            if s >= 100:
                n, customers = sum(map(len, tables.values())), sum(dishes.values())
                for w in range(4):
                    own = dishes.get(w, 0) - discount * len(tables.get(w, ()))
                    total[w] += (own + (strength + discount * n) * base[w]) / (strength + customers) / sweeps
        want[first] = total
    keys = np.array([f << 32 | w for f, d in counts.items() for w in d], np.uint64)
    n = np.array([c for d in counts.values() for c in d.values()])
    start = P._pair_row(0, 3, keys, n, np.arange(4, dtype=np.uint64), np.minimum(n, 1), np.zeros(0), np.zeros(0))
    answers = P.pa.table({"dest": [0], "p": [P._pack(base.astype(np.float32))]})
    runs = 400
    gains, shares = np.zeros(len(keys)), np.zeros(3)
    for number in range(runs):
        row = P._pairs_seated(1, discount, number, True)(start, answers)
        gains += P._unpack(row.column("gains")[0].as_py(), np.float32) / runs
        shares += P._unpack(row.column("shares")[0].as_py(), np.float32) / runs
    for first, total in want.items():
        got = {w: shares[first] * base[w] for w in range(4)}
        for key, g in zip(keys.tolist(), gains):
            if key >> 32 == first:
                got[key & 0xFFFFFFFF] += g
        assert abs(sum(got.values()) - 1) < 1e-5
        assert all(abs(got[w] - total[w]) < 0.02 for w in range(4)), (first, got, total)

import math

import numpy as np
from helpers import SF, rows, table

from veridoc.llm import neighbours as N
from veridoc.llm.queries import queries


def _brute(vectors, every, k):
    good = [(i, np.array(v, float)) for i, v in vectors if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    ids = np.array([i for i, _ in good])
    x = np.array([v for _, v in good])
    norm = np.sqrt((x * x).sum(1))
    out = {}
    for j in np.flatnonzero(ids % every == 0):
        s = x @ x[j] / norm / norm[j]
        out[int(ids[j])] = sorted(((-round(c, 12), int(i)) for c, i in zip(s, ids) if i != ids[j]))[:k]
    return out


def _recall(got, want):
    found = total = 0
    for q, best in want.items():
        own = [(-round(s, 12), v) for v, s in sorted(((r[2], r[3]) for r in got if r[0] == q), key=lambda x: (-x[1], x[0]))]
        total += len(best)
        found += sum(1 for s, _ in own if s <= best[-1][0] + 1e-9)
    return found / total


def test_recall_on_the_supplied_table(spark):
    vectors = rows(table(spark, "embeddings").select("vec_id", "embedding"))
    got = rows(queries()["op3_neighbours"](spark, SF))
    want = _brute(vectors, 50, 5)
    assert {r[0] for r in got} == set(want) and all(sorted(r[1] for r in got if r[0] == q) == [1, 2, 3, 4, 5] for q in want)
    assert _recall(got, want) >= 0.9


def test_copies_and_odd_vectors(spark):
    draw = np.random.default_rng(5)
    rows_in = [(i, draw.normal(size=8).tolist()) for i in range(120)] + [(i, [1.0] * 8) for i in range(120, 220)]
    rows_in += [(300, None), (301, []), (302, [0.0] * 8), (303, [1.0, None] + [0.0] * 6), (304, [float("nan")] * 8), (305, [float("inf")] * 8), (306, [1.0, 2.0]), (None, [1.0] * 8), (0, rows_in[0][1])]
    df = spark.createDataFrame(rows_in, "vec_id long, embedding array<double>").withColumn("node", N.F.lit(1)).repartition(3)
    got = rows(N.nearest(df, 10))
    want = _brute([r for r in dict.fromkeys((i, tuple(v) if v else None) for i, v in rows_in) if r[1] is None or len(r[1]) != 2], 10, 5)
    assert {r[0] for r in got} == set(want)
    assert _recall(got, want) == 1.0
    assert [(r[1], r[2]) for r in sorted(got) if r[0] == 150] == [(1, 120), (2, 121), (3, 122), (4, 123), (5, 124)]
    assert [(r[1], r[2]) for r in sorted(got) if r[0] == 120] == [(1, 121), (2, 122), (3, 123), (4, 124), (5, 125)]


def test_small_tables(spark):
    kind = "vec_id long, embedding array<double>"
    assert rows(N.nearest(spark.createDataFrame([], kind), 1)) == []
    two = sorted(rows(N.nearest(spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0])], kind), 1)))
    assert [(q, r, v) for q, r, v, _ in two] == [(0, 1, 1), (1, 1, 0)] and abs(two[0][3] - 0.5**0.5) < 1e-15


def test_short_units_keep_directions():
    draw = np.random.default_rng(0)
    unit = draw.normal(size=(50, 64))
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    again = N._unit(N.pa.array(N._short(unit), N.pa.binary()))
    assert np.abs(again @ again.T - unit @ unit.T).max() < 0.01


def test_recall_among_near_equal_vectors(spark):
    """A large group of jittered copies of one vector, rescaled, beside random vectors."""
    draw = np.random.default_rng(8)
    centre = draw.normal(size=64)
    x = np.concatenate([centre / np.linalg.norm(centre) + 1e-3 * draw.normal(size=(1200, 64)), draw.normal(size=(300, 64))])
    x *= draw.uniform(0.5, 2, size=(len(x), 1))
    vectors = [(i, v.tolist()) for i, v in enumerate(x)]
    got = rows(N.nearest(spark.createDataFrame(vectors, "vec_id long, embedding array<double>"), 25))
    assert _recall(got, _brute(vectors, 25, 5)) >= 0.9


def test_scaled_copies_are_ties(spark):
    """Vectors of one direction have one cosine; the smaller ids come first."""
    vectors = [(i, [float(np.float32(0.1 + i / 7))] * 4) for i in range(300)] + [(300 + i, [1.0, 2.0, float(i), 0.5]) for i in range(20)]
    got = {q: [r[2] for r in sorted(rows(N.nearest(spark.createDataFrame(vectors, "vec_id long, embedding array<double>"), 50))) if r[0] == q] for q in (0, 200)}
    assert got == {0: [1, 2, 3, 4, 5], 200: [0, 1, 2, 3, 4]}


def test_a_stray_length_takes_no_part(spark):
    draw = np.random.default_rng(3)
    vectors = [(i, draw.normal(size=4).tolist()) for i in range(60)] + [(60, [1.0] * 5), (61, [1.0] * 3)]
    got = rows(N.nearest(spark.createDataFrame(vectors, "vec_id long, embedding array<double>"), 10))
    assert {r[0] for r in got} == {0, 10, 20, 30, 40, 50} and _recall(got, _brute(vectors[:60], 10, 5)) == 1.0


def test_the_start_depends_on_the_data_alone(spark):
    """However the table and its shuffles are partitioned, the same blocks are compared."""
    draw = np.random.default_rng(4)
    vectors = spark.createDataFrame([(i, draw.normal(size=16).tolist()) for i in range(600)], "vec_id long, embedding array<double>")
    before, found = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for n in ("3", "23"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            graph = N.build_graph(N.materialize(N.nodes_of(vectors.repartition(int(n)))), degree=8, block=100, rounds=0)
            found.append({r["u"]: [e["v"] for e in r["near"]] for r in graph.collect()})
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found[0] == found[1] and len(found[0]) == 600


def test_recall_of_many_random_vectors(spark):
    """Vectors without any structure are the hardest; blocks hold a twentieth of them."""
    n = 20_000
    x = np.random.default_rng(6).normal(size=(n, 48)).astype(np.float32).astype(float)
    df = spark.createDataFrame(N.pa.table({"vec_id": list(range(n)), "embedding": list(x)}))
    got = rows(N.nearest(df, 200))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    found = 0
    for q in range(0, n, 200):
        s = unit @ unit[q]
        s[q] = -9
        fifth = np.sort(s)[-5]
        found += sum(1 for r in got if r[0] == q and r[3] >= fifth - 1e-9)
    assert found >= 0.9 * 5 * (n // 200)

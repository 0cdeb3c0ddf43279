import numpy as np
from helpers import empty, hard, rows

from veridoc.llm import toxicity as T


def _read(spark, sf, name):
    return spark.read.parquet(f"/root/testdata/{sf}/{name}.parquet")


def test_held_out_documents(spark):
    """Fitted on three quarters of the labels, the chain finds the toxic ones of the last quarter."""
    docs, labels = _read(spark, "sf0.1", "documents"), _read(spark, "sf0.1", "labels")
    chain = T.fit(docs, labels.where("doc_id % 4 <> 0"))
    held = docs.join(labels.where("doc_id % 4 = 0"), "doc_id")
    y = {r["doc_id"]: r["toxic"] for r in held.select("doc_id", labels["toxic"]).collect()}
    found = {r["doc_id"] for r in T.score(held, chain).collect() if r["toxic"] > T.CUT}
    toxic = {i for i, t in y.items() if t}
    assert len(found & toxic) >= 0.8 * len(toxic)
    assert len(found - toxic) <= 0.02 * (len(y) - len(toxic))


def test_chain_uses_earlier_categories():
    """A category that only the earlier one tells is learned through its out-of-fold log odds."""
    draw = np.random.default_rng(0)
    a = draw.integers(0, 2, 400)
    x = np.stack([a, 1 - a, draw.integers(0, 2, 400)], axis=1).astype(float)
    chain = T.fit_categories(np.array([7, 9, 100]), x, np.stack([a, a, a], axis=1))
    found = [np.array([7, 9, 100])[r > 0] for r in x]
    assert ((chain.score(found) > 0.5) == a[:, None]).all()
    assert [len(w) - len(chain.kept) for w in chain.weights] == [1, 2, 3]


def test_chain_against_plain_models():
    """Weights, out-of-fold log odds and scores are those of plain gradient descent, one category after another."""
    draw = np.random.default_rng(1)
    x = draw.integers(0, 2, (120, 4)).astype(float)
    y = np.stack([(x[:, 0] + draw.normal(size=120) > 0.6), (x[:, 1] * x[:, 0] + 0.5 * draw.normal(size=120) > 0.4)], axis=1).astype(int)

    def plain(a, t):
        a, w = np.column_stack([a, np.ones(len(a))]), np.zeros(a.shape[1] + 1)
        penalty = np.r_[np.ones(len(w) - 1), 1e-3]
        step = 1 / (0.25 * np.linalg.norm(a, 2) ** 2 + 1)
        for _ in range(60_000):
            w -= step * (a.T @ (1 / (1 + np.exp(-a @ w)) - t) + penalty * w)
        return w

    chain = T.fit_categories(np.arange(4), x, y, folds=3)
    first = plain(x, y[:, 0])
    assert np.abs(chain.weights[0] - first).max() < 1e-3
    apart = np.zeros(120)
    for k in range(3):
        own = np.arange(120) % 3 == k
        apart[own] = np.column_stack([x, np.ones(120)])[own] @ plain(x[~own], y[~own, 0])
    second = plain(np.column_stack([x, apart]), y[:, 1])
    assert np.abs(chain.weights[1] - second).max() < 1e-2
    z = np.column_stack([x, np.ones(120)]) @ first
    want = 1 / (1 + np.exp(-np.column_stack([x, z, np.ones(120)]) @ second))
    assert np.abs(chain.score([np.flatnonzero(r) for r in x])[:, 1] - want).max() < 1e-2


def test_clusters_find_planted_kinds():
    draw = np.random.default_rng(2)
    kind = draw.integers(0, 2, 200)
    x = np.zeros((200, 20))
    for i, k in enumerate(kind):
        x[i, 10 * k + draw.choice(10, 4, replace=False)] = 1
    of = T.clusters(x)
    assert len(set(zip(of.tolist(), kind.tolist()))) == 2
    y = T.categories(np.vstack([x, x]), np.r_[np.ones(200), np.zeros(200)].astype(int))
    assert (y[:200].sum(1) == 2).all() and not y[200:].any()
    assert T.clusters(np.zeros((3, 2))).tolist() == [0, 0, 0] and T.clusters(np.zeros((0, 2))).tolist() == []


def test_hard_rows(spark):
    labels = spark.createDataFrame([(i, int(i % 2)) for i in range(1, 9)] + [(9, None), (None, 1), (1, 1)], "doc_id long, toxic int")
    scored = rows(T.score(hard(spark), T.fit(hard(spark), labels)))
    assert len(scored) == 11 and all(0 <= p <= 1 for r in scored for p in r[1:])
    none = T.fit(hard(spark), labels.limit(0))
    assert {r[1:] for r in rows(T.score(hard(spark), none))} == {(0.5, 0.5, 0.5)}
    assert rows(T.score(empty(spark), T.fit(empty(spark), labels))) == []

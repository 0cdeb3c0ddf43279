import zlib

import numpy as np
from helpers import SF, empty, hard, rows, table

from veridoc.llm import quality as Q
from veridoc.llm.queries import queries


def test_held_out_accuracy(spark):
    got = {r["doc_id"]: r for r in queries()["op4_quality"](spark, "/root/testdata/sf0.01").collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    assert len(got) == 1000
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and r["predicted"] == (r["score"] >= 0.3) and 0 <= r["score"] <= 1 for i, r in got.items())
    held = [(labels[i], r["predicted"]) for i, r in got.items() if r["held_out"] and i in labels]
    assert np.mean([a == b for a, b in held]) >= 0.95


def test_model_is_the_textbook_one(spark):
    docs = table(spark, "documents")
    labels = table(spark, "labels")
    featured = Q.features(docs)
    model = Q.fit(featured, labels)
    y = {r["doc_id"]: r["quality"] for r in labels.collect()}
    x = {r["doc_id"]: Q.statistics(r["text"]) for r in docs.collect()}
    train = [i for i in x if i in y and zlib.crc32(str(i).encode()) % 5 != 0]
    own = [np.array([x[i] for i in train if y[i] == c]) for c in (0, 1)]
    cov = [np.cov(o.T, bias=True) for o in own]
    pooled = sum(len(o) * c for o, c in zip(own, cov)) / len(train)
    log = []
    for o, c in zip(own, cov):
        s = (1 - Q.TO_DIAGONAL) * ((1 - Q.TO_POOLED) * c + Q.TO_POOLED * pooled) + Q.TO_DIAGONAL * np.diag(np.diag(pooled)) + 1e-4 * np.eye(Q.N_FEATURES)
        d = np.array(list(x.values())) - o.mean(0)
        log.append(-0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(s), d) - 0.5 * np.linalg.slogdet(s)[1] + np.log(len(o)))
    want = 1 / (1 + np.exp(-np.clip(log[1] - log[0], -500, 500)))
    assert np.allclose(model.score(np.array(list(x.values()))), want, atol=1e-6)


def test_hard_rows(spark):
    docs = hard(spark)
    labels = spark.createDataFrame([(1, 0), (2, 0), (5, 1), (6, 1), (7, 1), (8, 0), (3, 0), (4, 1), (9, None), (None, 1), (5, 1)], "doc_id long, quality int").withColumn("text", Q.F.lit("clash"))
    scored = rows(Q.score(Q.features(docs), Q.fit(Q.features(docs), labels)))
    assert len(scored) == 11 and all(0 <= r[2] <= 1 for r in scored)
    none = labels.limit(0)
    assert {r[2] for r in rows(Q.score(Q.features(docs), Q.fit(Q.features(docs), none)))} == {0.5}
    assert rows(Q.score(Q.features(empty(spark)), Q.fit(Q.features(empty(spark)), labels))) == []
    kept = Q.keep_good(docs, none)
    assert kept.columns == docs.columns and kept.count() == 11

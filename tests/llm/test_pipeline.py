import re

import corpus_pipeline
from helpers import HARD, SF, table
from pyspark.sql import functions as F
from test_secrets import plain as plain_secrets
from test_simhash import plain_classes

from veridoc.llm import quality


def spelled(text):
    """The tokens of a text between commas, for a search of whole token sequences."""
    return "," + ",".join(re.findall(r"[^\s!-/:-@\[-`{-~]+", (text or "").lower())) + ","


def redacted(text):
    """Overlapping secrets as one, each replaced by the kind of its first."""
    out, at, spans = "", 0, sorted(plain_secrets(text), key=lambda x: (x[1], -x[2]))
    while spans:
        kind, a, b = spans.pop(0)
        while spans and spans[0][1] < b:
            b = max(b, spans.pop(0)[2])
        out += text[at:a] + f"[{kind}]"
        at = b
    return out + text[at:]


def test_stages_against_plain_python(spark, tmp_path):
    docs = table(spark, "documents")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_classifier", "near_dedup", "benchmark_decontamination", "secret_scan", "best_fit_packing"]
    items = [spelled(r["text"]) for r in table(spark, "benchmark").collect()]
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        before = {r["doc_id"]: r.asDict() for r in docs.collect()}
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        after = {r["doc_id"]: r.asDict() for r in docs.collect()}
        if name == "quality_classifier":
            every = spark.createDataFrame([(i, r["text"]) for i, r in before.items()], "doc_id long, text string")
            featured = quality.features(every)
            want = {r["doc_id"] for r in quality.score(featured, quality.fit(featured, table(spark, "labels"))).collect() if r["predicted"]}
        elif name == "near_dedup":
            want = {min(c) for c in plain_classes([(i, r["text"]) for i, r in before.items()])}
        elif name == "benchmark_decontamination":
            want = {i for i, r in before.items() if not any(x in spelled(r["text"]) for x in items)}
        else:
            want = set(before)
            assert all(after[i]["text"] == redacted(r["text"]) and after[i]["n_chars"] == len(after[i]["text"]) for i, r in before.items())
        assert set(after) == want, name
        if name != "secret_scan":
            assert all(after[i] == before[i] for i in after)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r["doc_id"] for r in packed.collect()} == set(after)
    assert corpus_pipeline.run(spark, SF).count() == packed.count()


def test_stages_on_empty_documents(spark):
    docs = table(spark, "documents").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0, name


def test_stages_on_hard_rows(spark):
    """Null ids and texts, copies, long texts and clashing columns go through every stage."""
    docs = spark.createDataFrame([*HARD, (None, None), (None, "")], "doc_id long, text string")
    docs = docs.select("doc_id", "text", F.lit("en").alias("lang"), F.lit(None).cast("string").alias("source"), F.length("text").cast("long").alias("n_chars"), *(F.lit("clash").alias(c) for c in ("fp", "node", "k1", "first", "hash", "score", "u", "v", "item_id"))).repartition(3)
    left = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        left[name] = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in out.collect())
        assert set(left[name]) <= {(r["doc_id"] is None, r["doc_id"] or 0) for r in docs.collect()}
    assert left["near_dedup"] == [(False, i) for i in (1, 4, 5, 7, 8, 9)] + [(True, 0)]
    assert len(left["benchmark_decontamination"]) == len(left["secret_scan"]) == len(HARD) + 2
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert packed.where("start = 0").count() == len(HARD) + 2

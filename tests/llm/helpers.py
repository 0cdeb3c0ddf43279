"""Fixtures: the supplied documents, and rows that are hard."""

from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
HARD = [
    (1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "The quick brown fox jumps over the lazy dog again and again"), (5, "The quick brown fox jumps over the lazy dog again and again"),
    (6, "The quick brown fox jumps over the lazy dog again and again"), (7, "ÉÀ ß 😀 \u00a0 x" * 40), (8, "word " * 20_000), (None, "a row without an id, of some length"), (9, "a\x00b \ud7ff\uffff c"),
]


def table(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


def hard(spark, rows=HARD):
    """Hard rows, with columns beside them that clash with names the operators use."""
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for name in ("fp", "score", "x", "u", "v", "block", "dest", "salt", "rank", "length", "n"):
        df = df.withColumn(name, F.lit("clash"))
    return df.repartition(3)


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def rows(df):
    return [tuple(r) for r in df.collect()]

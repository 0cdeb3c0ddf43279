"""Quality classifier: regularised quadratic discriminant analysis of document statistics.

Each text gives a vector of transformed statistics (log lengths, log odds of character classes, of
repeated words, pairs and lines). Per class, count, sum and sum of products are added up over all
labelled training rows, in tasks and then by key, so training has no sample and the driver gets a
fixed number of sums. Class covariances are shrunk towards the pooled one and its diagonal. A score
is the logistic of the difference of the two log-densities (squared Mahalanobis distances by cached
inverse Cholesky factors) and of the class frequencies.

Cases: null and empty texts have the statistics of an empty text and get a score; rows without a
label are scored, not learned from; a null id counts as the empty id in the fold; repeated rows
count each; labels that are null are ignored, and of several labels of a document the mean decides;
if a class has fewer than two training rows, every score is the share of label 1 (0.5 without
labels); texts of any length are read whole; scores of equal texts are equal, and nothing is ranked, so there are
no ties to break; an empty table gives no rows; other columns are not read, and clashing names do no harm.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veridoc.llm.common import crc_mod, materialize, table, work_tables

FOLDS = 5
FEW = 500_000
CUT = 0.3
#: Shrinkage of a class covariance towards the pooled one, then of that towards its diagonal.
TO_POOLED, TO_DIAGONAL = 0.15, 0.1

_CLASSES = {
    "upper": bytes(range(65, 91)),
    "lower": bytes(range(97, 123)),
    "digit": b"0123456789",
    "line": b"\n",
    "space": b" \t\r\x0b\x0c",
    "stop": b".,;:?",
    "bang": b"!",
    "bar": b"|",
    "symbol": b"#$%&*@^~<>=+_\\{}[]/",
    "beyond": bytes(range(128, 256)),
}
_MEMBER = np.zeros((256, len(_CLASSES)))
for _i, _of in enumerate(_CLASSES.values()):
    _MEMBER[list(_of), _i] = 1
_NAMES = list(_CLASSES)
N_FEATURES = 17


def statistics(text: str | None) -> np.ndarray:
    """The transformed statistics of one whole text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    counts = dict(zip(_NAMES, np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ _MEMBER))
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    n, size = len(words), len(raw)
    seen = Counter(words)
    pairs = set(zip(words, words[1:]))
    odds = lambda k, of: float(np.log((k + 0.5) / (max(of - k, 0) + 0.5)))
    short = sum(c for w, c in seen.items() if len(w) <= 3)
    letters = counts["upper"] + counts["lower"] + counts["beyond"]
    return np.array(
        [
            np.log1p(n),
            np.log((size + 1) / (n + 1)),
            odds(counts["upper"], letters),
            odds(counts["digit"], size),
            odds(counts["stop"], n + counts["stop"]),
            odds(counts["bang"], n + counts["bang"]),
            odds(counts["bar"], n + counts["bar"]),
            odds(counts["symbol"], n + counts["symbol"]),
            odds(counts["beyond"], size),
            odds(counts["line"], n + counts["line"]),
            odds(len(seen), n),
            odds(len(pairs), max(n - 1, 0)),
            odds(max(seen.values(), default=0), n),
            odds(short, n),
            odds(len(set(lines)), len(lines)),
            odds(counts["space"], size),
            np.log((n + 1) / (len(lines) + 1)),
        ]
    )


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = np.array([statistics(t.as_py()) for t in batch.column(1)]).reshape(-1, N_FEATURES)
        x = pa.ListArray.from_arrays(np.arange(0, rows.size + 1, N_FEATURES, dtype=np.int32), rows.ravel())
        yield pa.RecordBatch.from_arrays([batch.column(0), x], names=["doc_id", "x"])


def _vectors(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, N_FEATURES)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each class in a partition: count, sums and sums of products, one number a row."""
    total = np.zeros((2, 1 + N_FEATURES + N_FEATURES**2))
    for batch in batches:
        x, y = _vectors(batch.column(0)), batch.column(1).to_numpy(zero_copy_only=False).astype(int)
        for c in (0, 1):
            own = x[y == c]
            total[c] += np.concatenate([[len(own)], own.sum(0), (own.T @ own).ravel()])
    c, k = np.indices(total.shape)
    yield pa.RecordBatch.from_arrays([pa.array(c.ravel(), pa.int32()), pa.array(k.ravel(), pa.int32()), pa.array(total.ravel())], names=["c", "k", "v"])


@dataclass(frozen=True)
class Discriminant:
    """Class means, inverse Cholesky factors and log determinants; without them, one score for all."""

    share: float
    means: tuple[np.ndarray, ...] = ()
    factors: tuple[np.ndarray, ...] = ()
    log_dets: tuple[float, ...] = ()
    log_prior: float = 0.0

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.means:
            return np.full(len(x), self.share)
        density = [-0.5 * (((x - m) @ f.T) ** 2).sum(1) - 0.5 * d for m, f, d in zip(self.means, self.factors, self.log_dets)]
        return 1 / (1 + np.exp(-np.clip(density[1] - density[0] + self.log_prior, -500, 500)))


def fit_sums(total: np.ndarray, to_pooled: float = TO_POOLED, to_diagonal: float = TO_DIAGONAL) -> Discriminant:
    """The discriminant of the sums of ``_sums``, a row for each class."""
    n = total[:, 0]
    share = float(n[1] / n.sum()) if n.sum() else 0.5
    if n.min() < 2:
        return Discriminant(share)
    means = total[:, 1 : 1 + N_FEATURES] / n[:, None]
    products = total[:, 1 + N_FEATURES :].reshape(2, N_FEATURES, N_FEATURES)
    own = [products[c] / n[c] - np.outer(means[c], means[c]) for c in (0, 1)]
    pooled = (n[0] * own[0] + n[1] * own[1]) / n.sum()
    factors, log_dets = [], []
    for c in (0, 1):
        mixed = (1 - to_pooled) * own[c] + to_pooled * pooled
        shrunk = (1 - to_diagonal) * mixed + to_diagonal * np.diag(np.diag(pooled)) + 1e-4 * np.eye(N_FEATURES)
        lower = np.linalg.cholesky(shrunk)
        factors.append(np.linalg.inv(lower))
        log_dets.append(float(2 * np.log(np.diag(lower)).sum()))
    return Discriminant(share, tuple(means), tuple(factors), tuple(log_dets), float(np.log(n[1] / n[0])))


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and x, the statistics of every text."""
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(_featured, "doc_id long, x array<double>")


def fit(featured: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id") -> Discriminant:
    """Learns from the labelled rows of featured (doc_id, x) whose id isn't held out."""
    of = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("double").alias("y")).where("y is not null and doc_id is not null")
    of = of.groupBy("doc_id").agg((F.avg("y") >= 0.5).cast("int").alias("y"))
    rows = featured.where(crc_mod("doc_id", FOLDS) != 0).join(of, "doc_id").select("x", "y")
    total = np.zeros((2, 1 + N_FEATURES + N_FEATURES**2))
    for r in rows.mapInArrow(_sums, "c int, k int, v double").groupBy("c", "k").agg(F.sum("v").alias("v")).collect():  # a fixed number of sums
        total[r["c"], r["k"]] = r["v"]
    return fit_sums(total)


def score(featured: DataFrame, model: Discriminant, cut: float = CUT) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of featured."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(_vectors(batch.column(1))))], names=["doc_id", "score"])

    scored = featured.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", (crc_mod("doc_id", FOLDS) == 0).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", cut: float = CUT) -> DataFrame:
    """The rows of docs, columns unchanged, whose text scores at least cut.

    The fit needs the statistics of labelled documents only, found by a broadcast of up to ``FEW`` ids; where more are
    labelled, it takes those of all documents, and texts are not shuffled either way.
    """
    labelled = labels.select(F.col(id_col).cast("long").alias("veridoc_id")).where("veridoc_id is not null").distinct()
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    if labelled.count() <= FEW:
        own = own.join(F.broadcast(labelled), F.col("doc_id") == F.col("veridoc_id"), "left_semi")
    with work_tables():
        model = fit(materialize(features(own, "doc_id", "text")), labels.withColumnRenamed(id_col, "doc_id"))
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([statistics(t.as_py()) for t in batch.column(at)]).reshape(-1, N_FEATURES)
            yield batch.filter(pa.array(model.score(x) >= cut))

    return docs.mapInArrow(run, docs.schema)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    with work_tables() as work:
        featured = materialize(features(table(spark, sf_dir, "documents")))
        return work.keep(materialize(score(featured, fit(featured, table(spark, sf_dir, "labels")))))

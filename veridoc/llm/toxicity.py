"""Toxicity by a classifier chain.

Categories are predicted one after another by logistic models over hashed words and word beginnings.
Each model also gets the log odds that the chain gives the earlier categories. For training, those come
from models fitted on the other folds of the training rows (out of fold), so a later model sees earlier
predictions as good or bad as they are on new texts.

The labels tell toxic documents only. Their categories are found in them: the features of toxic training
rows are clustered (spherical k-means, started from the rows farthest apart, so without chance), and each
of the ``KINDS`` clusters is a category; ``toxic`` itself is the last. No list of words is given.

Training takes at most ``sample`` labelled documents (of those that exist, the ones whose ids hash lowest);
which features it uses (the ``keep`` with the largest standardised difference between toxic rows and others, of
at least ``LEAST_GAP``) and all weights come from those. Scoring reads every whole text.

Cases: null and empty texts have no features and get a low, defined score, texts of any length are read whole;
rows without a label or with a null one aren't learned from, and of several labels of a document the mean decides,
a tie being toxic; of documents with one id that differ, training takes any; without any label, every score is 0.5 of
each category and nothing is flagged; repeated rows are scored each; an empty table gives no rows; other columns are
not read, and clashing names do no harm.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veridoc.llm.common import discard, materialize, table

SAMPLE = 10_000
BUCKETS = 1 << 18
KEEP = 300
#: Standard deviations that a feature's count among a category must be from what chance gives.
LEAST_GAP = 5.0
BEGINNINGS = (4, 5, 6)
FOLDS = 5
#: Rows whose features are held at a time.
PART = 256
CUT = 0.4
#: Clusters of toxic documents, each a category of its own.
KINDS = 2
CATEGORIES = (*(f"kind_{i + 1}" for i in range(KINDS)), "toxic")
_GAPS = bytes(b if chr(b).isalnum() or b > 127 else 32 for b in range(128)) + bytes(range(128, 256))


def features(text: str | None) -> np.ndarray:
    """The sorted distinct hashed words, and first four to six bytes of words, of a whole text."""
    words = set((text or "").lower().encode("utf-8", "surrogatepass").translate(_GAPS).split())
    parts = words.union(*({b"^%d" % n + w[:n] for w in words} for n in BEGINNINGS))
    return np.unique(np.fromiter(map(zlib.crc32, parts), np.int64, len(parts)) % BUCKETS)


def clusters(x: np.ndarray, kinds: int = KINDS, steps: int = 20) -> np.ndarray:
    """The cluster of each row of 0 and 1, by the cosines with the clusters' centres; rows without features join the first."""
    if not len(x):
        return np.zeros(0, np.int64)
    unit = x / np.maximum(np.sqrt(x.sum(1, keepdims=True)), 1)
    chosen = [int((unit @ unit.mean(0)).argmax())]
    while len(chosen) < min(kinds, len(x)):
        chosen.append(int((unit @ unit[chosen].T).max(1).argmin()))
    centres, of = unit[chosen], np.full(len(x), -1)
    for _ in range(steps):
        found = (unit @ centres.T).argmax(1)
        if (found == of).all():
            break
        of = found
        sums = np.stack([unit[of == k].sum(0) for k in range(len(centres))])
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norms > 0, sums / np.maximum(norms, 1e-12), centres)
    return of


def categories(x: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """A column for each cluster of the toxic rows, and the label."""
    out = np.zeros((len(x), KINDS + 1), np.int64)
    out[:, KINDS] = toxic
    rows = np.flatnonzero(toxic)
    out[rows, clusters(x[rows])] = 1
    return out


def _logit(p: np.ndarray) -> np.ndarray:
    return np.log(p + 1e-6) - np.log(1 - p + 1e-6)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 10) -> np.ndarray:
    """Weights (the bias last) of a ridge logistic regression, by Newton steps with conjugate gradients."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-3
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + penalty * w
        curve = p * (1 - p) + 1e-6
        step, r = np.zeros_like(w), -gradient
        d, rr = r.copy(), r @ r
        for _ in range(15):
            if rr < 1e-8:
                break
            hd = x.T @ (curve * (x @ d)) + penalty * d
            a = rr / (d @ hd)
            step += a * d
            r -= a * hd
            d, rr = r + (r @ r) / rr * d, r @ r
        w += step
        if np.abs(step).max() < 1e-4:
            break
    return w


def _predict(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))


@dataclass(frozen=True)
class Chain:
    """The kept features' buckets, and the weights of each category's model (features, earlier log odds, bias)."""

    kept: np.ndarray
    weights: tuple[np.ndarray, ...]

    def score(self, found: Sequence[np.ndarray]) -> np.ndarray:
        """The probabilities of the categories for texts with these features."""
        if not self.weights:
            return np.full((len(found), len(CATEGORIES)), 0.5)
        out = np.zeros((len(found), len(self.weights)))
        n = len(self.kept)
        rows = [np.flatnonzero(np.isin(self.kept, f, assume_unique=True)) for f in found]
        for c, w in enumerate(self.weights):
            z = np.array([w[r].sum() for r in rows]) + w[-1] + _logit(out[:, :c]) @ w[n : n + c]
            out[:, c] = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        return out


def bucket_counts(found: Sequence[np.ndarray], y: np.ndarray) -> np.ndarray:
    """Of each bucket: the rows that have it, and those of each column of y."""
    flat = np.concatenate([*found, np.zeros(0, np.int64)]).astype(np.int64)
    owner = np.repeat(np.arange(len(found)), [len(f) for f in found])
    own = [np.bincount(flat[y[owner, c] == 1], minlength=BUCKETS) for c in range(y.shape[1])]
    return np.stack([np.bincount(flat, minlength=BUCKETS), *own])


def choose(counts: np.ndarray, n: int, own: np.ndarray, keep: int = KEEP) -> np.ndarray:
    """The buckets to keep, sorted; n rows, own[c] of category c."""
    scores, share = np.zeros(counts.shape[1]), counts[0] / max(n, 1)
    for c, k in enumerate(own):
        if 0 < k < n:
            scores = np.maximum(scores, np.abs(counts[1 + c] - k * share) / np.sqrt(k * share * (1 - share) + 1.0))
    kept = np.argsort(-scores, kind="stable")[:keep]
    return np.sort(kept[scores[kept] >= LEAST_GAP])


def fit_weights(kept: np.ndarray, places: Sequence[np.ndarray], toxic: np.ndarray, folds: int = FOLDS) -> Chain:
    """Fits the chain; places has the numbers of the kept buckets that each row has."""
    x = np.zeros((len(places), len(kept)))
    for i, p in enumerate(places):
        x[i, p] = 1
    return fit_categories(kept, x, categories(x, toxic), folds)


def fit_categories(kept: np.ndarray, x: np.ndarray, y: np.ndarray, folds: int = FOLDS) -> Chain:
    """Fits the chain to given categories, in the order of y's columns."""
    fold = np.arange(len(x)) % folds
    weights, earlier = [], np.zeros((len(x), 0))
    for c in range(y.shape[1]):
        whole = np.concatenate([x, earlier], axis=1)
        apart = np.zeros(len(x))
        for k in range(folds):
            if (fold == k).any():
                apart[fold == k] = _predict(whole[fold == k], _logistic(whole[fold != k], y[fold != k, c]))
        weights.append(_logistic(whole, y[:, c]))
        earlier = np.column_stack([earlier, _logit(apart)])
    return Chain(kept, tuple(weights))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> Chain:
    """Learns from at most sample labelled documents; the driver gets their kept features, and BUCKETS counts at most."""
    of = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("double").alias("y")).where("y is not null and doc_id is not null")
    there = docs.select(F.col(id_col).cast("long").alias("doc_id")).distinct()
    of = of.groupBy("doc_id").agg((F.avg("y") >= 0.5).cast("int").alias("y")).join(there, "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    ints = pa.list_(pa.int32())

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            found = [features(t.as_py()).astype(np.int32) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, ints), batch.column(2)], names=["doc_id", "f", "y"])

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return (batch.slice(at, PART) for batch in batches for at in range(0, batch.num_rows, PART))

    def rows_of(batch: pa.RecordBatch | pa.Table, name: str) -> list[np.ndarray]:
        return [np.array(x.as_py(), np.int64) for x in batch.column(name)]

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, BUCKETS), np.int64)
        for batch in parts(batches):
            if batch.num_rows:
                total += bucket_counts(rows_of(batch, "f"), batch.column("y").to_numpy()[:, None])
        at = np.flatnonzero(total[0])
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), *(pa.array(t[at]) for t in total)], names=["bucket", *(f"n{i}" for i in range(len(total)))])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    one = source.join(F.broadcast(of), "doc_id").select("doc_id", "text", "y")  # sample rows at most
    rows = materialize(one.mapInArrow(featured, "doc_id long, f array<int>, y int").dropDuplicates(["doc_id"]))
    names = ["n0", "n1"]
    sums = rows.mapInArrow(counted, ", ".join(["bucket int", *(f"{n} long" for n in names)])).groupBy("bucket").agg(*(F.sum(n).alias(n) for n in names)).toArrow()
    counts = np.zeros((len(names), BUCKETS), np.int64)
    counts[:, sums.column("bucket").to_numpy()] = np.stack([sums.column(n).to_numpy() for n in names])
    size = rows.agg(F.count("*"), F.sum("y")).first()
    if not size[0]:
        return Chain(np.zeros(0, np.int64), ())
    kept = choose(counts, size[0], np.array(size[1:]))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            places = [np.flatnonzero(np.isin(kept, f, assume_unique=True)).astype(np.int32) for f in rows_of(batch, "f")]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(places, ints), batch.column(2)], names=["doc_id", "f", "y"])

    few = rows.mapInArrow(placed, "doc_id long, f array<int>, y int").toArrow().sort_by("doc_id")
    discard(rows)
    return fit_weights(kept, rows_of(few, "f"), few.column("y").to_numpy())


def score(docs: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the probability of each category for every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, PART) for b in batches for at in range(0, b.num_rows, PART)):
            p = chain.score([features(t.as_py()) for t in batch.column(1)])
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(p[:, c]) for c in range(len(CATEGORIES)))], names=["doc_id", *CATEGORIES])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, ", ".join(["doc_id long", *(f"{c} double" for c in CATEGORIES)]))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that the chain finds toxic, with the probabilities of their categories."""
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.where(F.col("toxic") > CUT)

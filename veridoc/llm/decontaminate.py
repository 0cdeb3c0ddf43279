"""Benchmark decontamination by spaced seeds.

A seed is a fixed mask over token positions; its hash leaves out the positions that the mask ignores, so a substituted
token there doesn't hide a match. The seed hashes of the benchmark are joined with those of every position of every
document. A pair of a document and an item that share a hash is verified: every diagonal that a hit names is taken
(each once, however often a token repeats), and the longest stretch on it with at least ``similarity`` equal tokens
counts if it is ``min_tokens`` long (or as long as a shorter item).

Tokens are lower-cased runs of characters other than white space and ASCII punctuation.

How it runs: a bitmap of fixed size (``SIEVE`` bits, whatever the benchmark's size) tells which hashes may be there;
only texts with such a hash go on, each text once however many copies it has. Their hashes are joined with the
benchmark's, dealt by hash and salt, so that one frequent seed is spread over ``SALTS`` tasks. Nothing of either side
is collected. ``decontaminate`` drops the texts found by a join on a 128-bit hash of the text, which is a broadcast
only where the hashes found are ``FEW`` at most.

Cases: null and empty texts hold nothing and match nothing; texts of any length are read whole; items shorter than the
shortest mask are matched by their whole token sequence; items without an id, or with one id twice, count each as an
item; repeated rows of documents are judged each on its own; ties between stretches go to the earlier one; an empty
table on either side gives no rows (or all documents stay); other columns are not read, and clashing names do no harm.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veridoc.llm.common import discard, materialize, table

#: Masks of weight six, spans of eight to ten tokens.
MASKS = ("11101011", "110110101", "1101001011", "1011001101")
SHORTEST = min(map(len, MASKS))
MIN_TOKENS = 13
SIMILARITY = 0.8
SIEVE = 24  # binary logarithm of the bitmap's size
SALTS = 8
FEW = 500_000
_SPREAD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3], np.uint64)
_LOWER_GAPS = bytes(32 if chr(b) in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~" else b for b in range(256))


def tokens(text: str | None) -> np.ndarray:
    """32-bit hashes of the tokens of a whole text."""
    raw = (text or "").lower().encode("utf-8", "surrogatepass").translate(_LOWER_GAPS)
    return np.fromiter(map(zlib.crc32, raw.split()), np.uint64)


def seed_hashes(t: np.ndarray, mask: str) -> np.ndarray:
    """The hash of the mask at every position where it fits."""
    n = len(t) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, zlib.crc32(mask.encode()) * 0x2545F4914F6CDD1D & 0xFFFFFFFFFFFFFFFF, np.uint64)
    for k, i in enumerate(i for i, c in enumerate(mask) if c == "1"):
        x = (t[i : i + n] + np.uint64(k + 1)) * _SPREAD[k]
        out += x ^ (x >> np.uint64(29))
    return out ^ (out >> np.uint64(32))


def _masks_of(item: np.ndarray) -> tuple[str, ...]:
    """The masks an item is found by; a short one by all its tokens."""
    return MASKS if len(item) >= SHORTEST else ("1" * len(item),)


def _hashes(t: np.ndarray, masks: tuple[str, ...]) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.uint64), *(seed_hashes(t, m) for m in masks)])


def longest_stretch(equal: np.ndarray, similarity: float) -> tuple[int, int] | None:
    """(start, length) of the longest stretch with at least this share of True; of several, the first."""
    if not equal.any():
        return None
    gain = np.concatenate([[0.0], np.cumsum(np.where(equal, 1 - similarity, -similarity))])
    # From each new minimum to the last place whose later maximum reaches it.
    later = np.maximum.accumulate(gain[::-1])[::-1]
    lows = np.flatnonzero(np.concatenate([[True], gain[1:] < np.minimum.accumulate(gain)[:-1]]))
    lengths = np.searchsorted(-later, -gain[lows] + 1e-9, "right") - 1 - lows
    at = int(lengths.argmax())
    return (int(lows[at]), int(lengths[at])) if lengths[at] > 0 else None


def _diagonals(t: np.ndarray, item: np.ndarray) -> np.ndarray:
    """Where the item would start in t by each hit, each once."""
    found = np.zeros(len(t) + len(item) + 1, bool)
    for mask in MASKS:
        h, own = seed_hashes(t, mask), seed_hashes(item, mask)
        shared = np.intersect1d(h, own)
        for value in shared[:, None]:
            here, there = np.flatnonzero(h == value), np.flatnonzero(own == value)
            if len(here) * len(there) <= 1 << 16:
                found[(here[:, None] - there[None, :] + len(item)).ravel()] = True
                continue
            fits = h == value
            for o in there.tolist():
                found[len(item) - o : len(item) - o + len(fits)] |= fits
    return np.flatnonzero(found) - len(item)


def overlap(t: np.ndarray, item: np.ndarray, min_tokens: int = MIN_TOKENS, similarity: float = SIMILARITY) -> tuple[int, int, int] | None:
    """(start, length, equal) of the longest overlap of an item that the tokens t hold, if it counts."""
    n = len(item)
    if n < SHORTEST:
        if not n or len(t) < n:
            return None
        hit = np.flatnonzero((np.lib.stride_tricks.sliding_window_view(t, n) == item).all(1))
        return (int(hit[0]), n, n) if len(hit) else None
    starts = _diagonals(t, item)
    first, last = np.maximum(0, -starts), np.minimum(n, len(t) - starts)
    best, least = (0, 0, 0), min(min_tokens, n)
    for k in np.lexsort((starts + first, first - last)).tolist():  # the longest diagonals first
        start, a, b = int(starts[k]), int(first[k]), int(last[k])
        if b - a < least or (b - a, -(start + a)) <= best[:2]:
            continue
        equal = item[a:b] == t[start + a : start + b]
        if equal.sum() < similarity * least - 1e-9 or not (found := longest_stretch(equal, similarity)) or found[1] < least:
            continue
        at, length = found
        best = max(best, (length, -(start + a + at), int(equal[at : at + length].sum())))
    return (-best[1], best[0], best[2]) if best[0] else None


def _key(text: str) -> list:
    """Two 64-bit hashes that stand for a text."""
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(7), text).alias("k2")]


def _item_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(i1, i2, text) to a row for each distinct seed hash of the item; short: the length, if it is a short one."""
    for batch in batches:
        for i1, i2, text in zip(*(c.to_pylist() for c in batch.columns)):
            t = tokens(text)
            h = np.unique(_hashes(t, _masks_of(t))) if len(t) else np.zeros(0, np.uint64)
            n = len(h)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array([i1] * n, pa.int64()), pa.array([i2] * n, pa.int64()), pa.array([len(t) if len(t) < SHORTEST else 0] * n, pa.int32())], names=["hash", "i1", "i2", "short"])


def _sieve(seeds: DataFrame) -> np.ndarray:
    """The bitmap of the seed hashes, by their low and their high bits: 513 rows of 4 KB at most."""
    low, high = F.col("hash").bitwiseAND((1 << SIEVE) - 1), F.shiftrightunsigned("hash", 64 - SIEVE)
    slots = seeds.select(F.explode(F.array(low, high)).alias("slot")).select((F.col("slot") + 1).alias("slot"))
    rows = slots.groupBy(F.bitmap_bucket_number("slot").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits")).collect()
    out = np.zeros((1 << SIEVE) // 8, np.uint8)
    for r in rows:
        at = (r["part"] - 1) * 4096
        out[at : at + 4096] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return out


def _may(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which hashes the bitmap lets through."""
    low, high = (x.astype(np.int64) for x in (h & np.uint64((1 << SIEVE) - 1), h >> np.uint64(64 - SIEVE)))
    return (bits[low >> 3] >> (low & 7).astype(np.uint8) & bits[high >> 3] >> (high & 7).astype(np.uint8) & 1).astype(bool)


def _marked(sieve, masks: tuple[str, ...]):
    """(doc_id, text, k1, k2) to the texts with hashes that the sieve lets through: doc_id, k1, k2, tokens, hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(sieve.value, np.uint8)
        for batch in batches:
            ids, ts, hs = [], [], []
            for i, text in enumerate(batch.column(1)):
                t = tokens(text.as_py())
                h = _hashes(t, masks)
                if (own := _may(bits, h)).any():
                    ids.append(i)
                    ts.append(t.astype(np.uint32).tobytes())
                    hs.append(np.unique(h[own]).view(np.int64))
            of = batch.take(pa.array(ids, pa.int64()))
            yield pa.RecordBatch.from_arrays([of.column(0), of.column(2), of.column(3), pa.array(ts, pa.binary()), pa.array(hs, pa.list_(pa.int64()))], names=["doc_id", "k1", "k2", "tokens", "hashes"])

    return run


def _verified(min_tokens: int, similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, seen = [], {}
            for k1, k2, i1, i2, t, item in zip(*batch.columns):
                key = item.as_py()
                if key not in seen:
                    seen[key] = tokens(key)
                if found := overlap(np.frombuffer(t.as_py(), np.uint32).astype(np.uint64), seen[key], min_tokens, similarity):
                    rows.append((k1.as_py(), k2.as_py(), i1.as_py(), i2.as_py(), *found))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in list(zip(*rows)) or [()] * 7], names=["k1", "k2", "i1", "i2", "start", "n_tokens", "n_equal"])

    return run


def _overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, item_col: str, item_text: str, min_tokens: int, similarity: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The marked documents (doc_id, k1, k2), the items (item_id, i1, i2), and the overlaps of texts with item texts; the first and the last are materialized."""
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).select("doc_id", "text", *_key("text"))
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text).cast("string").alias("text")).where("text is not null")
    items = items.select("item_id", "text", *(k.alias(n) for k, n in zip(_key("text"), ("i1", "i2"))))
    texts = items.select("i1", "i2", "text").dropDuplicates(["i1", "i2"])
    seeds = materialize(texts.mapInArrow(_item_seeds, "hash long, i1 long, i2 long, short int"))
    short = [r["short"] for r in seeds.where("short > 0").select("short").distinct().collect()]  # lengths under SHORTEST
    sieve = spark.sparkContext.broadcast(_sieve(seeds).tobytes())
    masks = (*MASKS, *("1" * n for n in sorted(short)))
    marked = materialize(source.mapInArrow(_marked(sieve, masks), "doc_id long, k1 long, k2 long, tokens binary, hashes array<long>"))
    of = marked.select("k1", "k2", F.explode("hashes").alias("hash")).distinct().withColumn("salt", F.pmod("k1", F.lit(SALTS)))
    spread = seeds.select("hash", "i1", "i2", F.explode(F.array(*(F.lit(s).cast("long") for s in range(SALTS)))).alias("salt"))
    pairs = of.join(spread, ["hash", "salt"]).select("k1", "k2", "i1", "i2").distinct()
    whole = pairs.join(marked.select("k1", "k2", "tokens").dropDuplicates(["k1", "k2"]), ["k1", "k2"]).join(texts, ["i1", "i2"])
    found = materialize(whole.select("k1", "k2", "i1", "i2", "tokens", "text").mapInArrow(_verified(min_tokens, similarity), "k1 long, k2 long, i1 long, i2 long, start long, n_tokens long, n_equal long"))
    discard(seeds)
    return marked, items.drop("text"), found


def find_overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", min_tokens: int = MIN_TOKENS, similarity: float = SIMILARITY) -> DataFrame:
    """A row for each document and benchmark item that overlap: doc_id, item_id, start, n_tokens and n_equal of the longest overlap."""
    marked, items, found = _overlaps(docs, benchmark, id_col, text_col, item_col, "text", min_tokens, similarity)
    named = found.join(items, ["i1", "i2"])
    out = materialize(marked.select("doc_id", "k1", "k2").join(named, ["k1", "k2"]).select("doc_id", "item_id", "start", "n_tokens", "n_equal"))
    discard(marked)
    discard(found)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", min_tokens: int = MIN_TOKENS, similarity: float = SIMILARITY, few: int = FEW) -> DataFrame:
    """The rows of docs, columns unchanged, whose text overlaps no benchmark item."""
    rows = docs.select(F.lit(None).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    marked, _, found = _overlaps(rows, benchmark, "doc_id", "text", item_col, "text", min_tokens, similarity)
    discard(marked)
    keys = found.select(F.col("k1").alias("veridoc_k1"), F.col("k2").alias("veridoc_k2")).distinct()
    if keys.count() <= few:
        keys = F.broadcast(keys)
    k1, k2 = _key("veridoc_text")
    own = docs.withColumn("veridoc_text", F.col(text_col).cast("string")).select("*", k1.alias("veridoc_1"), k2.alias("veridoc_2")).drop("veridoc_text")
    same = (F.col("veridoc_1") == F.col("veridoc_k1")) & (F.col("veridoc_2") == F.col("veridoc_k2"))
    return own.join(keys, same, "left_anti").select(*docs.columns)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.withColumn("similarity", F.col("n_equal") / F.col("n_tokens"))

"""Best-fit packing by exact-complement hashing.

Documents become token pieces of at most ``capacity`` tokens; only their lengths matter for packing,
so the plan is made from a histogram of at most ``capacity`` lengths, whatever the number of pieces.
A gap is looked up in three hash indexes of the lengths still available: single lengths, sums of two
and sums of three. A combination found is consumed as often as the availability counts allow. What
has no exact complement goes to the fullest open sequence with room (best fit, longest first).

The plan is a short list of intervals (length, ranks, first sequence, offset); every piece finds its
place from its rank among the pieces of its length. Ranks come from counts by (length, salt), so one
length that holds a third of all pieces is dealt out over many tasks.

Cases: null text counts as empty (the end token alone); texts of any length are encoded whole and cut; repeated
rows are packed each on its own; of equally good fits the plan takes the longest length, and equal pieces are
interchangeable; an empty table gives no rows; other columns are not read, and clashing names do no harm.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veridoc.llm.common import materialize, table, work_tables

CAPACITY = 2048
END_ID = 0
#: Rows that share a rank counter, on average, when one length holds all of them.
ROWS_PER_SALT = 5_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_CODERS: dict[str, Callable] = {}


def _plain_byte_level(spec: dict) -> bool:
    """Whether a tokenizer is what tiktoken runs alike: byte-level BPE by the usual pattern, its ids in the order of the merges."""
    model, before = spec["model"], spec.get("pre_tokenizer") or {}
    options = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")
    if model.get("type") != "BPE" or spec.get("normalizer") or any(model.get(k) for k in options):
        return False
    if before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True):
        return False
    if any(x.get(k) for x in spec.get("added_tokens", []) for k in ("single_word", "lstrip", "rstrip", "normalized")):
        return False
    made = [model["vocab"].get("".join(m.split(" ") if isinstance(m, str) else m), -1) for m in model["merges"]]
    return all(a < b for a, b in zip([255, *made], made))


def coder(vocabulary: str) -> Callable[[str], np.ndarray]:
    """Text to ids of a vocabulary file of the tokenizers library, kept once a worker.

    Where the file describes plain byte-level BPE, tiktoken runs its merges, some four times faster; the tests
    hold its ids against the library's own. Any other file is run by the library itself.
    """
    if vocabulary not in _CODERS:
        import json

        with open(vocabulary, encoding="utf-8") as f:
            spec = json.load(f)
        if _plain_byte_level(spec):
            import tiktoken

            special = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
            # The byte-level alphabet: printable bytes stand for themselves, the others for 256 and up.
            plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
            byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
            ranks = {bytes(byte_of[c] for c in word): i for word, i in spec["model"]["vocab"].items() if word not in special}
            pattern = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
            encoding = tiktoken.Encoding("veridoc", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
            _CODERS[vocabulary] = lambda text: encoding.encode_to_numpy(text, allowed_special="all")
        else:
            from tokenizers import Tokenizer

            library = Tokenizer.from_file(vocabulary)
            _CODERS[vocabulary] = lambda text: np.array(library.encode(text, add_special_tokens=False).ids, np.uint32)
    return _CODERS[vocabulary]


def cut_pieces(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of each piece: the first takes what doesn't fill whole ones."""
    first = n % capacity or capacity
    return [(0, first), *((at, capacity) for at in range(first, n, capacity))]


def _pieces(vocabulary: str, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = coder(vocabulary)
        for batch in batches:
            rows: list[tuple] = []
            for doc, text in zip(batch.column(0), batch.column(1)):
                ids = np.append(encode(text.as_py() or ""), np.uint32(END_ID)).astype("<u4")
                doc = doc.as_py()
                rows += [(doc, i, at, n, zlib.crc32(ids[at : at + n].tobytes())) for i, (at, n) in enumerate(cut_pieces(len(ids), capacity))]
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            columns = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


class _Lengths:
    """Availability counts, with hash indexes of single, pair and triple sums."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.n = np.zeros(capacity + 1, np.int64)
        for length, count in counts.items():
            self.n[length] = count
        self.pairs: dict[int, list[tuple[int, int]]] = defaultdict(list)
        there = [int(x) for x in np.flatnonzero(self.n)][::-1]
        for i, a in enumerate(there):
            for b in there[i:]:
                if a + b <= capacity:
                    self.pairs[a + b].append((a, b))
        self.capacity = capacity

    def often(self, lengths: tuple[int, ...]) -> int:
        """How often the lengths can be taken together."""
        return min(int(self.n[x]) // lengths.count(x) for x in lengths)

    def pair(self, total: int, most: int) -> tuple[int, int] | None:
        """Two available lengths of this sum, none above most; pairs that ran out leave the index."""
        known = self.pairs.get(total)
        if not known:
            return None
        alive = [p for p in known if self.often(p)]
        self.pairs[total] = alive
        return next((p for p in alive if p[0] <= most), None)

    def complement(self, gap: int, most: int) -> tuple[int, ...] | None:
        """One, two or three available lengths that fill the gap exactly."""
        if gap <= 0:
            return None
        if gap <= most and self.n[gap]:
            return (gap,)
        if found := self.pair(gap, most):
            return found
        for a in np.flatnonzero(self.n[: min(gap, most + 1)])[::-1]:
            if (found := self.pair(gap - int(a), int(a))) and self.often(whole := (int(a), *found)):
                return whole
        return None


def plan(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Intervals (length, first rank, count, first sequence, offset), and the number of sequences.

    Interval k places its count pieces at the same offset of as many sequences with ascending numbers.
    """
    left = _Lengths({k: v for k, v in counts.items() if v > 0}, capacity)
    rank: dict[int, int] = defaultdict(int)
    out: list[tuple[int, int, int, int, int]] = []
    sequences = 0

    def place(length: int, count: int, sequence: int, offset: int) -> None:
        out.append((length, rank[length], count, sequence, offset))
        rank[length] += count
        left.n[length] -= count

    waiting: list[tuple[int, int]] = []
    for length in range(capacity, 0, -1):
        while left.n[length]:
            if length == capacity:
                found: tuple[int, ...] | None = ()
            else:
                left.n[length] -= 1
                found = left.complement(capacity - length, length)
                left.n[length] += 1
            if found is None:
                break
            whole = (length, *found)
            times = left.often(whole)
            if not times:
                break
            at = 0
            for x in whole:
                place(x, times, sequences, at)
                at += x
            sequences += times
        if left.n[length]:
            waiting.append((length, int(left.n[length])))
            left.n[length] = 0
    # Best fit over the residuals: open[gap] holds runs (first sequence, count) of sequences with that gap.
    opened: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for length, count in waiting:
        left.n[length] = count
    for length, _ in waiting:
        while left.n[length]:
            gap = next((g for g in range(length, capacity) if opened[g]), None)
            if gap is None:
                # As many new sequences as hold all that is left, each filled as far as it goes.
                each = capacity // length
                n = int(left.n[length])
                whole_n, rest = divmod(n, each)
                for k, size in ((whole_n, each), (1, rest)):
                    if k and size:
                        for i in range(size):
                            place(length, k, sequences, i * length)
                        if size * length < capacity:
                            opened[capacity - size * length].append((sequences, k))
                        sequences += k
                break
            first, k = opened[gap].pop()
            used = min(k, int(left.n[length]))
            place(length, used, first, capacity - gap)
            if used < k:
                opened[gap].append((first + used, k - used))
            if gap > length:
                opened[gap - length].append((first, used))
    return out, sequences


def _placed(intervals: list[tuple[int, int, int, int, int]]):
    by: dict[int, np.ndarray] = {}
    for length in {x[0] for x in intervals}:
        by[length] = np.array(sorted(x[1:] for x in intervals if x[0] == length), np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(name).to_numpy(zero_copy_only=False) for name in ("length", "rank"))
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for x in np.unique(length):
                rows = np.flatnonzero(length == x)
                plan = by[int(x)]
                k = np.searchsorted(plan[:, 0], rank[rows], "right") - 1
                sequence[rows] = plan[k, 2] + rank[rows] - plan[k, 0]
                offset[rows] = plan[k, 3]
            kept = [batch.column(name) for name in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Packs whole documents (ids, then the end token) into sequences of at most capacity tokens.

    A row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.
    """
    with work_tables() as work:
        source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
        pieces = materialize(source.mapInArrow(_pieces(vocabulary, capacity), PIECES))
        counts = {int(r["length"]): int(r["n"]) for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
        intervals, _ = plan(counts, capacity)
        salts = max(32, sum(counts.values()) // ROWS_PER_SALT)
        salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)))
        sizes = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
        before = sizes.select("length", "salt", (F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).alias("before"))
        order = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32")
        ranked = salted.withColumn("row", F.row_number().over(order)).join(before, ["length", "salt"]).withColumn("rank", F.col("before") + F.col("row") - 1)
        schema = f"{PIECES}, sequence_id long, offset long"
        return work.keep(materialize(ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(_placed(intervals), schema)))


def default_vocabulary() -> str:
    """The public byte-level vocabulary that the box offers."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), default_vocabulary())

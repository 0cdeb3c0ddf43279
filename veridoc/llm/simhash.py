"""SimHash near-duplicates by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into three segments of 22, 21 and 21 bits. Two fingerprints within two
bits agree in one segment at least (pigeonhole) and differ by two bits at most in the segment after
it. That segment, padded to 23 bits, is decoded by the perfect binary Golay code: the codeword
indices of the word and of its 23 neighbours, one to six different ones, are its keys. Two words
within two bits have a neighbour in common, hence an index in common, so the keys (segment, its
value, an index of the next segment) miss no link. They are joined and verified.

Only distinct fingerprints are hashed; copies meet in a partial aggregate. A bucket with up to
``bucket`` fingerprints is compared in one piece and gives a spanning forest, not its pairs. The
fingerprints of larger buckets are linked through points of the Hamming space: those within one bit
of the same point lie within two bits of each other, and two within two bits share such a point. A
point has 65 fingerprints around it at most, so no group grows with the data, and no link is lost.

Cases: null and empty texts have fingerprint zero and are linked like others; texts of any length are read whole;
a bit that exactly half of the shingles set is 0; a null id is kept, with the component of its fingerprint; repeated
rows each have their row; of ids that tie for a component's name the least is it; an empty table gives no rows; other
columns are not read, and clashing names do no harm.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veridoc.llm.common import components, discard, materialize, table, work_tables

SHINGLE = 3
SEED = 42
MAX_BITS = 2
SEGMENTS = ((42, 22), (21, 21), (0, 21))
BUCKET = 64
#: Near-duplicates of whole texts: shingles of so many words, similarity, fingerprints of 64 bits of the distinct words,
#: and the bits of those in which candidates may differ.
NEAR_SHINGLE, NEAR = 5, 0.8
PRINTS = 6
NEAR_BITS = 64 * PRINTS * 16 // 100
NEAREST = 2
BLOCK = 512
FEW = 250_000
#: The order of shingles, which decides the time only: texts that are counted at least and at most, if there are so many,
#: the share of them (one in SHARE) between, and the frequent shingles that are known.
LEAST_COUNTED, MOST_COUNTED, SHARE = 10_000, 100_000, 16
FREQUENT = 500_000
#: Columns with the parities of a set's hashes by residue.
_QS = [f"q{i}" for i in range(8)]
_PS = [f"p{i}" for i in range(PRINTS)]
_MIX = np.uint64(0xD6E8FEB86659FD93)
_SALTS = np.arange(1, PRINTS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The majority bits of the XXH64 values of all word shingles, repeats included."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(s, SEED) for s in shingles), np.uint64)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65_536):
        counts += np.unpackbits(hashes[at : at + 65_536].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes)).view(">u8")[0])


def _fingerprints(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(t.as_py(), shingle) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    return run


@lru_cache(maxsize=1)
def golay_indices() -> np.ndarray:
    """For each 23-bit word, the 12-bit message of the Golay codeword within three bits."""
    generator = 0b101011100011  # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1
    words = np.arange(4096, dtype=np.uint32) << 11
    rest = words.copy()
    for bit in range(22, 10, -1):
        rest = np.where(rest >> bit & 1, rest ^ np.uint32(generator << (bit - 11)), rest)
    codewords = words | rest
    one = np.uint32(1) << np.arange(23, dtype=np.uint32)
    errors = [np.zeros(1, np.uint32), one]
    errors += [np.array([one[i] | one[j] for i in range(23) for j in range(i)], np.uint32)]
    errors += [np.array([one[i] | one[j] | one[k] for i in range(23) for j in range(i) for k in range(j)], np.uint32)]
    out = np.empty(1 << 23, np.uint16)
    for e in np.concatenate(errors):
        out[codewords ^ e] = codewords >> 11
    return out


def golay_keys(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, index) of all different codeword indices within one bit of each 23-bit word."""
    flips = np.concatenate([[0], 1 << np.arange(23)]).astype(np.uint32)
    near = np.sort(golay_indices()[words.astype(np.uint32)[:, None] ^ flips[None, :]], axis=1)
    new = np.ones(near.shape, bool)
    new[:, 1:] = near[:, 1:] != near[:, :-1]
    return np.nonzero(new)[0], near[new]


def bucket_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of the bucket keys of uint64 fingerprints."""
    parts = [(fps >> np.uint64(shift)) & np.uint64((1 << bits) - 1) for shift, bits in SEGMENTS]
    rows, keys = [], []
    for i in range(3):
        row, index = golay_keys(parts[(i + 1) % 3])
        rows.append(row)
        keys.append((np.int64(i) << 34) | (parts[i][row].astype(np.int64) << 12) | index.astype(np.int64))
    return np.concatenate(rows), np.concatenate(keys)


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        for at in range(0, len(fps), 20_000):
            part = fps[at : at + 20_000]
            rows, keys = bucket_keys(part.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(part[rows])], names=["key", "fp"])


def _verified(max_bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            us, vs = [], []
            for members in batch.column(0):
                fps = np.array(members.as_py(), np.int64)
                fps.sort()
                bits = np.bitwise_count(fps.view(np.uint64)[:, None] ^ fps.view(np.uint64)[None, :])
                todo, near = set(range(len(fps))), bits <= max_bits
                while todo:  # breadth first: a link to each newly reached fingerprint
                    front = [min(todo)]
                    todo.discard(front[0])
                    while front:
                        x = front.pop()
                        for y in np.flatnonzero(near[x]):
                            if (y := int(y)) in todo:
                                todo.discard(y)
                                front.append(y)
                                us.append(int(fps[y]))
                                vs.append(int(fps[x]))
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])

    return run


def fingerprint_links(fps: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Links (u, v) that connect the distinct fingerprints of column fp as all pairs within two bits do."""
    keyed = fps.select("fp").mapInArrow(_keyed, "key long, fp long")
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared = materialize(keyed.join(sizes, "key"))
    small = shared.where(F.col("n") <= bucket).groupBy("key").agg(F.collect_list("fp").alias("fps"))
    links = small.select("fps").mapInArrow(_verified(MAX_BITS), "u long, v long")
    crowded = shared.where(F.col("n") > bucket).select("fp").distinct()
    flips = F.array(F.lit(0).cast("long"), *(F.lit(1 << b if b < 63 else -(1 << 63)).cast("long") for b in range(64)))
    around = crowded.select("fp", F.explode(F.transform(flips, lambda x: x.bitwiseXOR(F.col("fp")))).alias("point"))
    hubs = around.groupBy("point").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)  # 65 at most
    stars = hubs.select(F.explode("fps").alias("u"), F.array_min("fps").alias("v")).where("u != v")
    return links.union(stars)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """A row per document: doc_id, fp (signed 64 bits), fingerprint (hex), component_id (least id that can be reached)."""
    with work_tables() as work:
        source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
        marked = materialize(source.mapInArrow(_fingerprints(shingle), "doc_id long, fp long"))
        firsts = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("first")))
        roots = components(fingerprint_links(firsts)).withColumnsRenamed({"u": "fp", "v": "root"})
        rooted = firsts.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
        least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
        # Fingerprints of one document alone and its component are few beside the documents; a hot
        # fingerprint's documents are split between tasks by the skew-join rule.
        of = rooted.join(least, "root").select("fp", "component_id")
        return work.keep(materialize(marked.join(of, "fp").select("doc_id", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")))


def word_prints(text: str | None) -> np.ndarray:
    """The ``PRINTS`` fingerprints of a text's distinct words: majority bits of as many hashes of each."""
    words = set((text or "").encode("utf-8", "surrogatepass").lower().split())
    hashes = np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in words), np.uint64, len(words))
    counts = np.zeros(64 * PRINTS, np.int64)
    for at in range(0, len(hashes), 16_384):
        mixed = (hashes[at : at + 16_384, None] ^ _SALTS) * _MIX
        mixed = (mixed ^ (mixed >> np.uint64(32))) * _MIX
        mixed ^= mixed >> np.uint64(29)
        counts += np.unpackbits(mixed.astype(">u8").view(np.uint8), axis=1).sum(0, dtype=np.int64)
    return np.packbits(2 * counts > len(hashes)).view(">u8").astype(np.uint64)


def shingle_set(text: str | None, shingle: int = NEAR_SHINGLE) -> np.ndarray:
    """The sorted 32-bit hashes of a text's distinct shingles; a shorter text is one, a text without words the empty one."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    found = {b" ".join(words)} if len(words) < shingle else set(map(b" ".join, zip(*(words[i:] for i in range(shingle)))))
    return np.unique(np.fromiter(map(xxhash.xxh32_intdigest, found), np.uint32, len(found)))


def _printed(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            prints = np.array([word_prints(t) for t in texts], np.uint64).reshape(-1, PRINTS).view(np.int64)
            found = [shingle_set(t, shingle) for t in texts]
            columns = [batch.column(0), batch.column(2), batch.column(3), *(pa.array(np.ascontiguousarray(prints[:, i])) for i in range(PRINTS))]
            columns += [pa.array([len(x) for x in found], pa.int32()), pa.array([x.tobytes() for x in found], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "t1", "t2", *_PS, "n", "shingles"])

    return run


def _print_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The Golay bucket keys of each of a text's fingerprints."""
    for batch in batches:
        for at in range(0, batch.num_rows, 5_000):
            part = batch.slice(at, 5_000)
            node = part.column(0).to_numpy()
            for i in range(PRINTS):
                rows, keys = bucket_keys(part.column(1 + i).to_numpy().view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(keys | np.int64(i << 40)), pa.array(node[rows])], names=["key", "node"])


def _nearest_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each two blocks of a crowded bucket: a spanning forest of the least distances, and each member's nearest."""
    for batch in batches:
        us, vs = [], []
        for members in batch.column(0):
            rows = members.values
            node = rows.field(0).to_numpy()
            prints = np.stack([rows.field(1 + i).to_numpy() for i in range(PRINTS)], axis=1).view(np.uint64)
            apart = sum(np.bitwise_count(prints[:, None, i] ^ prints[None, :, i]).astype(np.int16) for i in range(PRINTS))
            np.fill_diagonal(apart, 64 * PRINTS)
            n = len(node)
            for k in np.argpartition(apart, min(NEAREST, n - 1), axis=1)[:, :NEAREST].T:
                good = apart[np.arange(n), k] <= NEAR_BITS
                us.append(node[good])
                vs.append(node[k[good]])
            best, by, left = apart[0].copy(), np.zeros(n, np.int64), np.ones(n, bool)
            left[0] = False
            for _ in range(n - 1):
                x = int(np.where(left, best, 64 * PRINTS + 1).argmin())
                left[x] = False
                if best[x] <= NEAR_BITS:
                    us.append(node[[x]])
                    vs.append(node[[by[x]]])
                closer = apart[x] < best
                best[closer], by[closer] = apart[x][closer], x
        u, v = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (us, vs))
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v))], names=["u", "v"])


def _similar(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for a, b in zip(batch.column(2), batch.column(3)):
                x, y = (np.frombuffer(s.as_py(), np.uint32) for s in (a, b))
                shared = len(np.intersect1d(x, y, assume_unique=True))
                good.append(shared >= similarity * (len(x) + len(y) - shared) - 1e-9)
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    return run


def _near(pairs: DataFrame, prints: DataFrame) -> DataFrame:
    """The different pairs (u, v) that are near by their fingerprints."""
    left, right = (prints.select(F.col("node").alias(x), *(F.col(p).alias(f"{x}{p}") for p in _PS)) for x in ("u", "v"))
    bits = [F.bit_count(F.col(f"u{p}").bitwiseXOR(F.col(f"v{p}"))) for p in _PS]
    return pairs.distinct().join(left, "u").join(right, "v").where(sum(bits[1:], bits[0]) <= NEAR_BITS).select("u", "v")


def _closest(shared: DataFrame, prints: DataFrame, block: int) -> DataFrame:
    """Pairs of each node in its largest bucket: with the bucket's first, and the closest in every two blocks of it."""
    own = shared.groupBy("node").agg(F.max(F.struct("n", "key")).alias("most")).select("node", F.col("most.key").alias("key"))
    sizes = materialize(own.groupBy("key").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"), F.min("node").alias("u")))
    placed = own.join(sizes, "key").withColumn("b", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    stars = placed.select("u", F.col("node").alias("v")).where("u != v")
    met = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select("key", F.least("b", "other").alias("low"), F.greatest("b", "other").alias("high"), "node").join(prints, "node")
    met = met.groupBy("key", "low", "high").agg(F.collect_list(F.struct("node", *_PS)).alias("members"))  # two blocks
    return stars.union(met.where(F.size("members") > 1).select("members").mapInArrow(_nearest_pairs, "u long, v long"))


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            values = b"".join(x.as_py() for x in batch.column(0).slice(at, 500))
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(values, np.int32))], names=["key"])


def _frequent(sets: DataFrame, n_sets: int, bucket: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles expected in over ``bucket`` sets, sorted, and their places in the order of frequency, from a share of the sets."""
    step = max(1, n_sets // min(max(LEAST_COUNTED, n_sets // SHARE), MOST_COUNTED))
    counted = sets.where(F.pmod(F.xxhash64("node"), F.lit(step)) == 0).select("shingles").mapInArrow(_hashes, "key int")
    often = counted.groupBy("key").count().where((F.col("count") > 1) & (F.col("count") * step > bucket))
    often = often.orderBy(F.desc("count"), "key").limit(FREQUENT).select("key").toArrow()
    keys = often.column(0).to_numpy().view(np.uint32)[::-1]
    order = np.argsort(keys)
    return keys[order], order


def _first_shingles(similarity: float, frequent: np.ndarray, place: np.ndarray):
    """Of each set, those first in the order: so many that two similar sets have one of them in common."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for x in batch.column(2):
                own = np.frombuffer(x.as_py(), np.uint32)
                if len(frequent):
                    at = np.minimum(np.searchsorted(frequent, own), len(frequent) - 1)
                    hit = frequent[at] == own
                    own = np.concatenate([own[~hit], own[hit][np.argsort(place[at[hit]])]])
                found.append(own[: len(own) - int(np.ceil(similarity * len(own) - 1e-6)) + 1])
            ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
            values = np.concatenate([np.zeros(0, np.uint32), *found]).view(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(ends), pa.array(values))], names=["node", "n", "keys"])

    return run


def _parities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each residue of the hashes, whether an odd number of a set's has it: two sets differ in as many shingles at least."""
    for batch in batches:
        odd = [np.bincount(np.frombuffer(x.as_py(), np.uint32) % (64 * len(_QS)), minlength=64 * len(_QS)) & 1 for x in batch.column(1)]
        bits = np.packbits(np.array(odd, np.uint8).reshape(-1, 64 * len(_QS)), axis=1).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(np.ascontiguousarray(bits[:, i])) for i in range(len(_QS)))], names=["node", *_QS])


def _meetings(spark: SparkSession, sets: DataFrame, rooted: DataFrame, n_sets: int, bucket: int, similarity: float, few: int) -> DataFrame:
    """Nodes by the shingles (key) at which any two of them with different roots can be found to be similar.

    rooted has each node once, and its root. All sets are in one order of shingles, the frequent ones last. Similar sets
    of n and m shingles have similarity * n of them in common at least, so one is among the first n - similarity * n + 1
    of both. left is how many shingles a set has from the key on.
    """
    firsts = sets.select("node", "n", "shingles").mapInArrow(_first_shingles(similarity, *_frequent(sets, n_sets, bucket)), "node long, n int, keys array<int>")
    each = firsts.join(rooted, "node").select("node", "root", "n", F.posexplode("keys").alias("at", "key"))
    met = materialize(_several(each.select("key", "node", "root", "n", (F.col("n") - F.col("at")).alias("left"))))
    odd = materialize(sets.select("node", "shingles").mapInArrow(_parities, f"node long, {', '.join(f'{q} long' for q in _QS)}"))
    out = materialize(met.join(_checked(spark, odd, few), "node"))
    discard(met)
    discard(odd)
    return out


def _several(meetings: DataFrame) -> DataFrame:
    """The meetings at keys whose nodes have several roots."""
    own = Window.partitionBy("key")
    return meetings.withColumns({"least": F.min("root").over(own), "most": F.max("root").over(own)}).where("least != most").drop("least", "most")


def _meeting_pairs(a: DataFrame, b: DataFrame, similarity: float) -> DataFrame:
    """The different pairs (u, v) of a node of a and one of b that meet with different roots and can be similar.

    The sizes must do for it; where the first shingle that two sets share is, what is left from there on; and the parities.
    """
    same = a is b
    a, b = (x.select("key", *(F.col(c).alias(f"{name}_{c}") for c in ("node", "root", "n", "left", *_QS))) for name, x in (("u", a), ("v", b)))
    sizes = F.least("u_n", "v_n") >= similarity * F.greatest("u_n", "v_n") - 1e-6
    enough = (1 + similarity) * F.least("u_left", "v_left") >= similarity * (F.col("u_n") + F.col("v_n")) - 1e-6
    bits = [F.bit_count(F.col(f"u_{q}").bitwiseXOR(F.col(f"v_{q}"))) for q in _QS]
    close = (1 + similarity) * sum(bits[1:], bits[0]) <= (1 - similarity) * (F.col("u_n") + F.col("v_n")) + 1e-6
    once = F.col("u_node") < F.col("v_node") if same else F.lit(True)
    met = a.join(b, "key").where(once & (F.col("u_root") != F.col("v_root")) & sizes & enough & close)
    return met.select(F.least("u_node", "v_node").alias("u"), F.greatest("u_node", "v_node").alias("v")).distinct()


def _checked(spark: SparkSession, df: DataFrame, few: int) -> DataFrame:
    """df, broadcast only if it has few rows."""
    return F.broadcast(df) if df.count() <= few else df


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = NEAR_SHINGLE, similarity: float = NEAR, bucket: int = BUCKET, block: int = BLOCK, few: int = FEW) -> DataFrame:
    """One row of each class of near-duplicates, columns unchanged: that with the least id (a null one last).

    Texts are near-duplicates if their sets of five-word shingles have a Jaccard similarity of 0.8 or more, or through
    others that are. Such sets leave too many bits of a SimHash of shingles apart; a SimHash of the distinct words keeps
    them within a few, so candidates are found by ``PRINTS`` of those, each with the Golay keys above, and every
    candidate is verified on the whole sets. Equal texts are one text. First each text is compared, in its largest bucket,
    with the bucket's first and with the closest in every two blocks of the bucket's texts, which connects copies of one
    text however many there are. Then every two texts that are not yet connected and can be similar are compared: those
    that share one of their first shingles in a common order, in which shingles expected in over ``bucket`` texts come
    last. That leaves out no pair (of 32-bit hashes of shingles), so the classes are those of comparing all pairs. Before
    all of them, those with the first text of each such shingle are, which leaves fewer where groups are large.
    """
    with work_tables() as work:
        spark = docs.sparkSession
        t1, t2 = F.xxhash64("veridoc_text").alias("t1"), F.xxhash64(F.lit(7), "veridoc_text").alias("t2")
        text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
        source = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("veridoc_text")).select("doc_id", "veridoc_text", t1, t2)
        marked = source.mapInArrow(_printed(shingle), f"doc_id long, t1 long, t2 long, {', '.join(f'{p} long' for p in _PS)}, n int, shingles binary")
        marked = materialize(marked.withColumn("row", F.monotonically_increasing_id()))
        firsts = materialize(marked.groupBy("t1", "t2").agg(F.min("doc_id").alias("first"), F.min("row").alias("node"), *(F.first(p).alias(p) for p in _PS)))
        prints = firsts.select("node", *_PS)
        keyed = prints.mapInArrow(_print_keys, "key long, node long")
        shared = materialize(keyed.join(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "key"))
        sets = marked.select(F.col("row").alias("node"), "n", "shingles")  # of all rows, those that are nodes and others

        def verified(pairs: DataFrame) -> DataFrame:
            left, right = (sets.select(F.col("node").alias(x), F.col("n").alias(f"{x}_n")) for x in ("u", "v"))
            sized = materialize(pairs.join(left, "u").join(right, "v").where(F.least("u_n", "v_n") >= similarity * F.greatest("u_n", "v_n") - 1e-9).select("u", "v"))
            needed = sized.select(F.explode(F.array("u", "v")).alias("node")).distinct()
            own = sets.join(_checked(spark, needed, few), "node", "left_semi")  # only these are sent
            left, right = (own.select(F.col("node").alias(x), F.col("shingles").alias(f"{x}_set")) for x in ("u", "v"))
            whole = sized.join(left, "u").join(right, "v")
            return materialize(whole.select("u", "v", "u_set", "v_set").mapInArrow(_similar(similarity), "u long, v long"))

        rooted = lambda links: components(links).withColumnsRenamed({"u": "node", "v": "root"})
        first_links = verified(_near(_closest(shared, prints, block), prints))
        discard(shared)
        links, found = first_links, rooted(first_links)
        of_each = lambda nodes: nodes.join(found, "node", "left").withColumn("root", F.coalesce(found["root"], "node"))
        met = _meetings(spark, sets, _checked(spark, materialize(of_each(firsts.select("node"))), few), firsts.count(), bucket, similarity, few)
        for last in (False, True):
            hubs = met if last else met.join(met.groupBy("key").agg(F.min(F.struct("root", "node")).alias("hub")), "key").where("node = hub.node")
            links = links.union(verified(_meeting_pairs(hubs, met, similarity)))
            found, before = rooted(links), met
            if not last:
                met = materialize(_several(of_each(met.drop("root")).select(met.columns)))
            discard(before)
        roots = found
        classes = firsts.join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("root"))
        least = classes.agg(F.min(F.struct(F.col("first").isNull().alias("no_id"), "first", "node", "t1", "t2")).alias("of"))
        kept = work.keep(materialize(least.select(F.col("of.first").alias("kept_id"), F.col("of.t1").alias("kept_1"), F.col("of.t2").alias("kept_2"))))
        same = lambda i, x, y: F.col(i).cast("long").eqNullSafe(F.col("kept_id")) & (F.col(x) == F.col("kept_1")) & (F.col(y) == F.col("kept_2"))
        repeated = work.keep(materialize(marked.join(kept, same("doc_id", "t1", "t2"), "left_semi").groupBy("doc_id", "t1", "t2").count().where("count > 1").select(F.col("doc_id").alias("kept_id"), F.col("t1").alias("kept_1"), F.col("t2").alias("kept_2"))))
        own = docs.select("*", text.alias("veridoc_text")).withColumns({"veridoc_1": t1, "veridoc_2": t2}).drop("veridoc_text")
        here = same(id_col, "veridoc_1", "veridoc_2")
        rows = own.join(_checked(spark, kept, few), here, "left_semi")
        if repeated.limit(1).count():
            again = _checked(spark, repeated, few)
            rows = rows.join(again, here, "left_anti").union(rows.join(again, here, "left_semi").dropDuplicates([id_col, "veridoc_1", "veridoc_2"]))
        return rows.select(*docs.columns)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")

"""Language-model scores from a hierarchical Pitman-Yor model.

A text is its words (A-Z lower-cased) and an end; a word that no training document has is one symbol,
the unknown word, as in the add-one base. A text ends after a word with one probability for all words.
If it goes on, the next word is a customer of the restaurant of the word before it (of the end, for the
first word), whose parent is the word restaurant: a pair's tables are the word's customers. The word
restaurant's base measure gives the unknown word a share that makes a new word as likely as words seen once say (Good-Turing), and
the rest to the known words by a spelling model, scaled to them: a word's bytes, closed by a space, are
predicted one by one from the up to four before them. Every spelling context is a restaurant whose parent is the context without its
farthest byte, down to the empty context over a uniform base. Seating is sampled by Gibbs: the customers
of each dish sit down anew, given the other tables and the parent's predictions, and the tables are the
parent's customers (a word's tables are spelled once each). Predictive probabilities are averaged over
the last samples.

How it runs: documents are dealt to blocks of bounded text. A block asks for its distinct words and
pairs; requests are packed by (block, word destination), where their counts are added up. A pair is at the
destination of its first word, so that a restaurant is in one place; its second word is known there by its
64-bit hash. Destinations of pairs and of words exchange tables and probabilities after the first round
and after the last. Word destinations ask gram destinations, which hold whole subtrees of contexts (those that end in the same two bytes), for
the probabilities of their words' byte 5-grams, in rounds; the restaurants of one and no byte, 256 x 257
dishes at most, are sampled on the driver. The probabilities of words and pairs go back packed, and each
block scores its documents. Every word and pair of every training document is counted; nothing grows on the driver.

Cases: a null text counts as empty (the end alone); a null id counts as the empty id in the fold; texts of any
length are read whole; equal texts score alike, and nothing is ranked, so there are no ties to break;
repeated rows are scored each, in one block if id and text are the same; without training documents the base is that of zero counts and every
token is the unknown word, with certainty; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veridoc.llm.common import crc_mod, discard, materialize, table, work_tables

FOLDS, HELD = 7, 2
END = b""  # as a word
PAD = b"\n"
CONTEXT = 4
SYMBOLS = 252  # bytes but white space, and the two closers
DISCOUNTS = (0.2, 0.35, 0.5, 0.6, 0.7)
STRENGTHS = (1.0, 1.0, 1.0, 1.0, 0.5)
ROUNDS, SWEEPS, SAMPLES = 3, 4, 3
WORD_STRENGTH = 1.0
PAIR_STRENGTH = 1.0
BLOCK_BYTES = 6_000_000
CHUNK_WORDS = 100_000
#: Blocks whose requests one word destination takes, and word destinations for one gram destination.
BLOCKS_A_DEST, DESTS_A_GRAM_DEST = 4, 3
#: Parts in which the pairs' probabilities go back.
ANSWER_PARTS = 4
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _pack(x: np.ndarray) -> bytes:
    return zstandard.compress(x.tobytes(), 1)


def _unpack(data: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(data), kind)


def _deltas(keys: np.ndarray) -> bytes:
    return _pack(np.diff(keys, prepend=np.uint64(0)))


def _keys(data: bytes) -> np.ndarray:
    return np.cumsum(_unpack(data, np.uint64), dtype=np.uint64)


def words_of(text: str | None) -> list[bytes]:
    """The words of a text, A-Z lower-cased, and the end."""
    return [*(text or "").encode("utf-8", "surrogatepass").lower().split(), END]


def spell(word: bytes) -> bytes:
    """The bytes that the spelling model predicts, after an empty context."""
    return PAD * CONTEXT + (word + b" " if word else PAD)


def grams(spelled: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The 5-gram of every predicted byte as a number, and the row it belongs to."""
    sizes = np.array([len(s) for s in spelled])
    a = np.frombuffer(b"".join(spelled), np.uint8).astype(np.uint64)
    n = len(a) - CONTEXT
    keys = np.zeros(n, np.uint64)
    for j in range(CONTEXT + 1):
        keys <<= np.uint64(8)
        keys |= a[j : j + n]
    inside = np.ones(len(a), bool)
    inside[(np.cumsum(sizes)[:, None] - np.arange(1, CONTEXT + 1)).ravel()] = False
    return keys[inside[:n]], np.repeat(np.arange(len(spelled)), sizes - CONTEXT)


def _added(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and the sums of their counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts, first)


def _hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def _word_dest(hashes: np.ndarray, n: int) -> np.ndarray:
    return (hashes % np.uint64(n)).astype(np.int64)


def _planes(x: np.ndarray) -> bytes:
    """Packed by the place of the bytes, for numbers whose high bytes are much alike."""
    return zstandard.compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes(), 1)


def _unplaned(data: bytes, kind) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(data), np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _rising(x: np.ndarray) -> bytes:
    return _planes(np.diff(x, prepend=x.dtype.type(0)))


def _risen(data: bytes, kind) -> np.ndarray:
    return np.cumsum(_unplaned(data, kind), dtype=kind)


def _gram_dest(keys: np.ndarray, n: int) -> np.ndarray:
    """By the two bytes before the predicted one."""
    pair = (keys >> np.uint64(8)) & np.uint64(0xFFFF)
    return (((pair + np.uint64(1)) * _MIX >> np.uint64(33)) % np.uint64(n)).astype(np.int64)


def _join(words: list[bytes]) -> bytes:
    return zstandard.compress(b"\n".join(words), 1)


def _split(data: bytes) -> list[bytes]:
    return zstandard.decompress(data).split(b"\n")


REQUESTS = "block int, dest int, words binary, counts binary, seconds binary, first binary, second binary, n binary"


def _block_words(texts: pa.ChunkedArray) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The sorted distinct words, each token's place among them (0 is the end), and the tokens of each text."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.combine_chunks()))
    flat, owner = lists.flatten(), np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
    full = pc.greater(pc.binary_length(flat), 0)  # what precedes or follows all white space is empty
    coded, owner = flat.filter(full).dictionary_encode(), owner[full.to_numpy(zero_copy_only=False)]
    spelled = coded.dictionary.cast(pa.binary())
    order = pc.array_sort_indices(spelled)
    rank = np.zeros(len(spelled), np.int64)
    rank[order.to_numpy()] = np.arange(1, len(spelled) + 1)
    tokens = np.zeros(len(owner) + len(lists), np.int64)
    tokens[np.arange(len(owner)) + owner] = rank[coded.indices.to_numpy()]
    return [END, *spelled.take(order).to_pylist()], tokens, np.bincount(owner, minlength=len(lists)) + 1


def _block_pairs(tokens: np.ndarray, n_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct pairs' words, and the pair of each token that isn't an end; what precedes a first word is an end."""
    before = np.concatenate([[0], tokens[:-1]])
    keys, of = np.unique((before * n_words + tokens)[tokens > 0], return_inverse=True)
    return keys // n_words, keys % n_words, of


def _by_dest(hashes: np.ndarray, first: np.ndarray, dests: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """The words and the pairs, by their first words, that go to each destination."""
    of = _word_dest(hashes, dests)
    split = []
    for x in (of, of[first]):
        order = np.argsort(x.astype(np.uint16) if dests < 1 << 16 else x, kind="stable")
        edges = np.searchsorted(x[order], np.arange(dests + 1))
        split.append([order[edges[d] : edges[d + 1]] for d in range(dests)])
    return [(d, at, pairs) for d, (at, pairs) in enumerate(zip(*split)) if len(at)]


def _requests(dests: int):
    def run(rows: pa.Table) -> pa.Table:
        words, tokens, sizes = _block_words(rows.column("text"))
        train = np.repeat(rows.column("train").to_numpy(), sizes)
        n = np.bincount(tokens[train], minlength=len(words))
        first, second, of = _block_pairs(tokens, len(words))
        pair_n = np.bincount(of[train[tokens > 0]], minlength=len(first)).astype(np.int32)
        hashes = _hashes(words)
        by_hash = np.argsort(hashes)
        place, rank = np.zeros(len(words), np.int32), np.zeros(len(words), np.int32)
        rank[by_hash] = np.arange(len(words))
        block = rows.column("block")[0].as_py()
        out = []
        for d, at, pairs in _by_dest(hashes, first, dests):
            place[at] = np.arange(len(at))
            seconds, own = np.unique(rank[second[pairs]], return_inverse=True)
            out.append((block, d, _join([words[i] for i in at.tolist()]), _pack(n[at]), _rising(hashes[by_hash[seconds]]), _rising(place[first[pairs]]), _planes(own.astype(np.int32)), _planes(pair_n[pairs])))
        return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.int32(), pa.int32(), *[pa.binary()] * 6))], names=["block", "dest", "words", "counts", "seconds", "first", "second", "n"])

    return run


PAIRS = "dest int, n_words long, keys binary, counts binary, seconds binary, tables binary, gains binary, shares binary, once long, twice long"
_PAIR_KINDS = (pa.int32(), pa.int64(), *[pa.binary()] * 6, pa.int64(), pa.int64())
_PAIR_NAMES = [x.split()[0] for x in PAIRS.split(", ")]


def _pair_row(dest: int, n_words: int, keys: np.ndarray, counts: np.ndarray, seconds: np.ndarray, tables: np.ndarray, gains: np.ndarray, shares: np.ndarray) -> pa.Table:
    """A pair destination's state. keys: first word's place << 32 | second's; gains and shares are empty until the last seating."""
    row = (dest, n_words, _rising(keys), _planes(counts.astype(np.int32)), _rising(seconds), _planes(tables.astype(np.int32)), _pack(gains.astype(np.float32)), _pack(shares.astype(np.float32)), int((counts == 1).sum()), int((counts == 2).sum()))
    return pa.Table.from_arrays([pa.array([x], t) for x, t in zip(row, _PAIR_KINDS)], names=_PAIR_NAMES)


def _request_words(rows: pa.Table) -> tuple[list[bytes], list[np.ndarray]]:
    """The sorted distinct words of a destination's requests, and the places of each request's words among them."""
    lists = [pc.split_pattern(pa.array([zstandard.decompress(x)], pa.binary()), b"\n").flatten() for x in rows.column("words").to_pylist()]
    coded = pa.concat_arrays(lists).dictionary_encode()
    order = pc.array_sort_indices(coded.dictionary)
    rank = np.zeros(len(order), np.int64)
    rank[order.to_numpy()] = np.arange(len(order))
    ends = np.cumsum([len(x) for x in lists])
    return coded.dictionary.take(order).to_pylist(), np.split(rank[coded.indices.to_numpy()], ends[:-1])


PAIRED = f"{PAIRS}, words binary, word_counts binary, block int, at binary, place binary"


def _paired(rows: pa.Table) -> pa.Table:
    """The distinct pairs of a destination with their training counts, a table each, and its words with theirs; and a row
    for each request, which says where its words and its pairs are (a pair that no training document has: after all others)."""
    words, places = _request_words(rows)
    hashes = [_risen(x, np.uint64) for x in rows.column("seconds").to_pylist()]
    seconds = np.unique(np.concatenate(hashes))
    keys, counts = [], []
    for at, h, c, w, n in zip(places, hashes, *(rows.column(x).to_pylist() for x in ("first", "second", "n"))):
        keys.append((at[_risen(c, np.int32)].astype(np.uint64) << np.uint64(32)) | np.searchsorted(seconds, h)[_unplaned(w, np.int32)].astype(np.uint64))
        counts.append(_unplaned(n, np.int32))
    sizes, keys, counts = [len(x) for x in keys], np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(keys)
    keys = keys[order]
    new = np.concatenate([np.ones(min(len(keys), 1), bool), keys[1:] != keys[:-1]])
    first, number = np.flatnonzero(new), np.cumsum(new) - 1
    total = np.add.reduceat(counts[order], first, dtype=np.int64) if len(keys) else np.zeros(0, np.int64)
    seen = total > 0
    kept = np.where(seen, np.cumsum(seen) - 1, seen.sum()).astype(np.int32)
    place = np.empty(len(keys), np.int32)
    place[order] = kept[number]
    keys, total = keys[first][seen], total[seen]
    used, second = np.unique(keys & np.uint64(0xFFFFFFFF), return_inverse=True)  # those that only held-out documents have go
    keys = (keys >> np.uint64(32) << np.uint64(32)) | second.astype(np.uint64)
    none, dest = np.zeros(0), rows.column("dest")[0].as_py()
    state = _pair_row(dest, len(words), keys, total, seconds[used.astype(np.int64)], np.minimum(total, 1), none, none)
    word_counts = np.zeros(len(words), np.int64)
    for at, n in zip(places, rows.column("counts").to_pylist()):
        word_counts[at] += _unpack(n, np.int64)
    ends = np.cumsum(sizes)
    found = [(block, _rising(at.astype(np.int32)), _rising(place[end - n : end])) for block, at, n, end in zip(rows.column("block").to_pylist(), places, sizes, ends.tolist())]
    extra = [pa.array([None, *x], t) for x, t in zip(zip(*found), (pa.int32(), pa.binary(), pa.binary()))]
    own = [*(c.combine_chunks() for c in state.columns[1:]), *(pa.array([x], pa.binary()) for x in (_join(words), _pack(word_counts)))]
    columns = [pa.array([dest] * (len(found) + 1), pa.int32()), *(pa.concat_arrays([c, pa.nulls(len(found), c.type)]) for c in own), *extra]
    return pa.Table.from_arrays(columns, names=[*_PAIR_NAMES, "words", "word_counts", "block", "at", "place"])


TABLES = "pair_dest int, dest int, seconds binary, tables binary"


def _pair_tables(dests: int):
    """The second words of a pair destination, for their word destinations, with the tables of their pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dest, keys, seconds, tables in zip(*(batch.column(x).to_pylist() for x in ("dest", "keys", "seconds", "tables"))):
                seconds = _risen(seconds, np.uint64)
                sums = np.bincount((_risen(keys, np.uint64) & np.uint64(0xFFFFFFFF)).astype(np.int64), _unplaned(tables, np.int32), len(seconds)).astype(np.int64)
                of = _word_dest(seconds, dests)
                out = [(dest, d, _rising(seconds[of == d]), _planes(sums[of == d])) for d in np.unique(of).tolist()]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.int32(), pa.int32(), pa.binary(), pa.binary()))], names=["pair_dest", "dest", "seconds", "tables"])

    return run


def _customers(state: pa.Table, sent: pa.Table) -> pa.Table:
    """A word destination whose words have the tables of their pairs as customers."""
    packed = state.column("words")[0].as_py()
    hashes = _hashes(_split(packed))
    order = np.argsort(hashes)
    customers = np.zeros(len(hashes), np.int64)
    for h, t in zip(sent.column("seconds").to_pylist(), sent.column("tables").to_pylist()):
        customers[order[np.searchsorted(hashes[order], _risen(h, np.uint64))]] += _unplaned(t, np.int64)
    spelled = _unpack(state.column("spelled")[0].as_py(), np.float32)
    tables = np.minimum(np.maximum(_unpack(state.column("tables")[0].as_py(), np.int64).reshape(-1, len(hashes)), 1), customers)
    return _word_row(state.column("dest")[0].as_py(), packed, _unpack(state.column("counts")[0].as_py(), np.int64), customers, spelled, tables)


def _parents(discount: float, seats: int, n_tables: list[int], unknown: float, mass: float):
    """The word restaurant's predictions for the second words that each pair destination asks for."""

    def run(sent: pa.Table, state: pa.Table) -> pa.Table:
        words, p = _predicted(state, discount, seats, n_tables, unknown, mass)
        hashes = _hashes(words)
        order = np.argsort(hashes)
        found = [_pack(p[order[np.searchsorted(hashes[order], _risen(h, np.uint64))]].astype(np.float32)) for h in sent.column("seconds").to_pylist()]
        return pa.Table.from_arrays([sent.column("pair_dest").combine_chunks(), sent.column("dest").combine_chunks(), pa.array(found, pa.binary())], names=["pair_dest", "dest", "p"])

    return run


def _pairs_seated(dests: int, discount: float, number: int, last: bool):
    """Seats the customers of a destination's pairs; after the last time, averages what the seatings predict."""

    def run(pairs: pa.Table, answers: pa.Table) -> pa.Table:
        dest, n_words = pairs.column("dest")[0].as_py(), pairs.column("n_words")[0].as_py()
        keys, seconds = (_risen(pairs.column(x)[0].as_py(), np.uint64) for x in ("keys", "seconds"))
        counts, tables = (_unplaned(pairs.column(x)[0].as_py(), np.int32).astype(np.int64) for x in ("counts", "tables"))
        parent, of = np.zeros(len(seconds)), _word_dest(seconds, dests)
        for d, p in zip(answers.column("dest").to_pylist(), answers.column("p").to_pylist()):
            parent[of == d] = _unpack(p, np.float32)
        first, parent = (keys >> np.uint64(32)).astype(np.int64), parent[(keys & np.uint64(0xFFFFFFFF)).astype(np.int64)]
        customers = np.bincount(first, counts, n_words)
        gains, shares = np.zeros(len(keys) if last else 0), np.zeros(n_words if last else 0)
        draw = _seed(dest, 2_000 + number)
        for s in range(SWEEPS + (SAMPLES if last else 0)):
            total = np.bincount(first, tables, n_words)
            tables = np.minimum(seat(counts, (PAIR_STRENGTH + discount * (total[first] - tables)) * parent, discount, draw), counts)
            if s >= SWEEPS:
                gains += (counts - discount * tables) / (PAIR_STRENGTH + customers[first]) / SAMPLES
                shares += (PAIR_STRENGTH + discount * np.bincount(first, tables, n_words)) / (PAIR_STRENGTH + customers) / SAMPLES
        return _pair_row(dest, n_words, keys, counts, seconds, tables, gains, shares)

    return run


ANSWERS = "block int, dest int, counts binary, p binary, shares binary, gains binary"


def _pair_answers(asked: pa.Table, pairs: pa.Table) -> pa.Table:
    """What each block's pairs have of their own, and what share of each first word's predictions is its parent's."""
    gains, shares = (np.append(_unpack(pairs.column(x)[0].as_py(), np.float32), np.float32(0)) for x in ("gains", "shares"))
    out = [(None, None, _pack(shares[_risen(at, np.int32)]), _pack(gains[_risen(place, np.int32)])) for at, place in zip(asked.column("at").to_pylist(), asked.column("place").to_pylist())]
    arrays = [asked.column("block").combine_chunks(), asked.column("dest").combine_chunks(), *(pa.array(x, pa.binary()) for x in zip(*out))]
    return pa.Table.from_arrays(arrays, names=["block", "dest", "counts", "p", "shares", "gains"])


WORDS = "dest int, words binary, counts binary, customers binary, spelled binary, tables binary, tokens long, types long, ends long, seats long, dishes long, once long, twice long, n_tables array<long>, mass double"
_WORD_KINDS = (pa.int32(), *[pa.binary()] * 5, *[pa.int64()] * 7, pa.list_(pa.int64()), pa.float64())
_WORD_NAMES = [x.split()[0] for x in WORDS.split(", ")]


def _word_row(dest: int, words: bytes, counts: np.ndarray, customers: np.ndarray, spelled: np.ndarray, tables: np.ndarray) -> pa.Table:
    """A word destination's state; tables has a row for each sample."""
    seated = [int(x.sum()) for x in (customers, customers > 0, customers == 1, customers == 2)]
    ends = int(counts[0]) if _split(words)[0] == END else 0
    row = (dest, words, _pack(counts), _pack(customers), _pack(spelled), _pack(tables.astype(np.int64)), int(counts.sum()), int((counts > 0).sum()), ends, *seated, tables.sum(1).astype(int).tolist(), float((10 ** spelled[customers > 0].astype(np.float64)).sum()))
    return pa.Table.from_arrays([pa.array([x], t) for x, t in zip(row, _WORD_KINDS)], names=_WORD_NAMES)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct words of word destinations with their training counts."""
    for batch in batches:
        for dest, words, counts in zip(*(batch.column(x).to_pylist() for x in ("dest", "words", "word_counts"))):
            counts = _unpack(counts, np.int64)
            none = np.zeros(len(counts))
            yield from _word_row(dest, words, counts, none.astype(np.int64), none.astype(np.float32), none.astype(np.int64)[None]).to_batches()


def _word_grams(words: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """In parts: the first word's number, the sorted distinct 5-grams, and of each predicted byte its 5-gram's place and its word's number in the part."""
    for at in range(0, len(words), CHUNK_WORDS):
        keys, row = grams([spell(w) for w in words[at : at + CHUNK_WORDS]])
        distinct, place = np.unique(keys, return_inverse=True)
        yield at, distinct, place.astype(np.int32), row.astype(np.int32)


def _distinct_grams(words: list[bytes], weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct 5-grams of the words, and the sums of their words' weights."""
    keys, sums = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    for at, own, place, row in _word_grams(words):
        n = np.bincount(place, weights[at + row], len(own)).astype(np.int64)
        keys, sums = _added(np.concatenate([keys, own]), np.concatenate([sums, n])) if at else (own, n)
    return keys, sums


GRAMS = "block int, dest int, grams binary, counts binary"


def _gram_requests(dests: int):
    """What a word destination asks each gram destination for, with its words' tables as customers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, words, tables in zip(*(batch.column(x).to_pylist() for x in ("dest", "words", "tables"))):
                words = _split(words)
                keys, sums = _distinct_grams(words, _unpack(tables, np.int64).reshape(-1, len(words))[-1])
                of = _gram_dest(keys, dests)
                out = [(block, d, _deltas(keys[of == d]), _pack(sums[of == d])) for d in np.unique(of).tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.int32(), pa.int32(), pa.binary(), pa.binary()))], names=["block", "dest", "grams", "counts"])

    return run


def seat(customers: np.ndarray, weight: np.ndarray, discount: float, draw: np.random.Generator) -> np.ndarray:
    """Tables of each dish after its customers have sat down one after another.

    weight is what a new table gets: (strength + discount * the restaurant's tables) * the parent's
    probability. After 48 customers they come in groups of a tenth of those seated.
    """
    tables = np.minimum(customers, 1).astype(np.float64)
    live = np.flatnonzero(customers > 1)
    k = 1
    while len(live):
        group = max(1, k // 10) if k >= 48 else 1
        size = np.minimum(group, customers[live] - k)
        p = weight[live] / (k + (group - 1) / 2 - discount * tables[live] + weight[live])
        p = np.clip(p, 0, 1)
        tables[live] += draw.random(len(live)) < p if group == 1 else draw.binomial(size, p)
        k += group
        live = live[customers[live] > k]
    return tables


class Restaurants:
    """The restaurants of one context length: dishes (context, byte) with customers and tables."""

    def __init__(self, dishes: np.ndarray, level: int):
        self.level, self.d, self.theta = level, DISCOUNTS[level], STRENGTHS[level]
        self.dishes = dishes
        self.contexts, self.of = np.unique(dishes >> np.uint64(8), return_inverse=True)
        self.customers = np.zeros(len(dishes), np.int64)
        self.tables = np.zeros(len(dishes))

    def totals(self) -> tuple[np.ndarray, np.ndarray]:
        n = len(self.contexts)
        return np.bincount(self.of, self.customers, n), np.bincount(self.of, self.tables, n)

    def predict(self, parent: np.ndarray) -> np.ndarray:
        """Of each dish, given what its parent predicts for it."""
        c, t = self.totals()
        c, t = c[self.of], t[self.of]
        own = np.maximum(self.customers - self.d * self.tables, 0)
        return np.where(c > 0, (own + (self.theta + self.d * t) * parent) / (self.theta + c), parent)

    def sample(self, parent: np.ndarray, draw: np.random.Generator) -> None:
        if not self.tables.any():
            self.tables = np.minimum(self.customers, 1).astype(np.float64)
        _, t = self.totals()
        others = np.maximum(t[self.of] - self.tables, 0)
        self.tables = seat(self.customers, (self.theta + self.d * others) * parent, self.d, draw)


class Subtrees:
    """All restaurants of two bytes and more whose 5-grams are given."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        top = Restaurants(keys, CONTEXT)
        top.customers = counts
        self.levels, self.up = [top], []
        for level in range(CONTEXT - 1, 1, -1):
            dishes, up = np.unique(self.levels[-1].dishes & np.uint64((1 << (8 * (level + 1))) - 1), return_inverse=True)
            self.up.append(up)
            self.levels.append(Restaurants(dishes, level))
        self.base = (self.levels[-1].dishes & np.uint64(0xFFFF)).astype(np.int64)  # (context byte, byte)

    def predictions(self, p1: np.ndarray) -> list[np.ndarray]:
        """Of each level's dishes, longest contexts first; p1 has those of the one-byte contexts by (byte, byte)."""
        out = [self.levels[-1].predict(p1[self.base])]
        for level, up in zip(self.levels[-2::-1], self.up[::-1]):
            out.insert(0, level.predict(out[0][up]))
        return out

    def sweep(self, p1: np.ndarray, draw: np.random.Generator) -> None:
        """One Gibbs sweep, from the longest contexts to the shortest."""
        p = self.predictions(p1)
        for i, level in enumerate(self.levels):
            level.sample(p[i + 1][self.up[i]] if i < len(self.up) else p1[self.base], draw)
            if i < len(self.up):
                self.levels[i + 1].customers = np.bincount(self.up[i], level.tables, len(self.levels[i + 1].dishes)).astype(np.int64)
                self.levels[i + 1].tables = np.minimum(np.maximum(self.levels[i + 1].tables, self.levels[i + 1].customers > 0), self.levels[i + 1].customers)

    def customers_below(self) -> np.ndarray:
        """The customers of the one-byte contexts' dishes, by (byte, byte)."""
        return np.bincount(self.base, self.levels[-1].tables, 65_536)


def _seed(dest: int, number: int) -> np.random.Generator:
    return np.random.default_rng([17, dest, number])


MODEL = "dest int, grams binary, logs binary, dish array<int>, n array<long>"


def _round(p1: np.ndarray, number: int):
    """Sums a gram destination's requests, samples its restaurants, and averages their predictions."""

    def run(rows: pa.Table) -> pa.Table:
        dest = rows.column("dest")[0].as_py()
        parts = [(_keys(k.as_py()), _unpack(n.as_py(), np.int64)) for k, n in zip(rows.column("grams"), rows.column("counts"))]
        keys, counts = _added(np.concatenate([x[0] for x in parts]), np.concatenate([x[1] for x in parts]))
        trees, draw = Subtrees(keys, counts), _seed(dest, number)
        mean = np.zeros(len(keys))
        for s in range(SWEEPS + SAMPLES):
            trees.sweep(p1, draw)
            if s >= SWEEPS:
                mean += trees.predictions(p1)[0] / SAMPLES
        below = trees.customers_below()
        at = np.flatnonzero(below)
        row = ([dest], [_deltas(keys)], [np.log10(mean).astype(np.float32).tobytes()], [at.tolist()], [below[at].astype(int).tolist()])
        kinds = (pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int64()))
        return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(row, kinds)], names=["dest", "grams", "logs", "dish", "n"])

    return run


def short_contexts(customers: np.ndarray, draw: np.random.Generator) -> np.ndarray:
    """Samples the restaurants of one and no byte; predictions of the former for all (byte, byte), averaged."""
    one = Restaurants(np.arange(65_536, dtype=np.uint64), 1)
    one.customers = customers.astype(np.int64)
    none = Restaurants(np.arange(256, dtype=np.uint64), 0)
    byte = np.arange(65_536) & 0xFF
    total = np.zeros(65_536)
    for s in range(SWEEPS + SAMPLES):
        p0 = none.predict(np.full(256, 1 / SYMBOLS))
        one.sample(p0[byte], draw)
        none.customers = np.bincount(byte, one.tables, 256).astype(np.int64)
        none.tables = np.minimum(none.customers, 1).astype(np.float64)
        none.sample(np.full(256, 1 / SYMBOLS), draw)
        if s >= SWEEPS:
            total += one.predict(none.predict(np.full(256, 1 / SYMBOLS))[byte]) / SAMPLES
    return total


def _answered(requests: pa.Table, model: pa.Table) -> pa.Table:
    """The log-probabilities of the 5-grams that each word destination asks a gram destination for."""
    keys = _keys(model.column("grams")[0].as_py())
    logs = np.frombuffer(model.column("logs")[0].as_py(), np.float32)
    found = [logs[np.searchsorted(keys, _keys(x))].tobytes() for x in requests.column("grams").to_pylist()]
    return pa.Table.from_arrays([requests.column("block").combine_chunks(), requests.column("dest").combine_chunks(), pa.array(found, pa.binary())], names=["block", "dest", "logs"])


def _seated(gram_dests: int, discount: float, n_tables: int, known: float, number: int, samples: int):
    """Spells a word destination's words by the answers, and seats their customers anew."""

    def run(state: pa.Table, answers: pa.Table) -> pa.Table:
        dest, packed = state.column("dest")[0].as_py(), state.column("words")[0].as_py()
        words, counts, customers = _split(packed), *(_unpack(state.column(x)[0].as_py(), np.int64) for x in ("counts", "customers"))
        parts = list(_word_grams(words))
        keys = np.unique(np.concatenate([np.zeros(0, np.uint64), *(x[1] for x in parts)]))
        of, logs = _gram_dest(keys, gram_dests), np.zeros(len(keys))
        for d, a in zip(answers.column("dest").to_pylist(), answers.column("logs").to_pylist()):
            logs[of == d] = np.frombuffer(a, np.float32)
        spelled = np.zeros(len(words))
        for at, own, place, row in parts:
            spelled[at : at + CHUNK_WORDS] = np.bincount(row, logs[np.searchsorted(keys, own)][place])
        weight = (WORD_STRENGTH + discount * n_tables) * known * 10**spelled
        draw = _seed(dest, 1_000 + number)
        tables = np.stack([np.minimum(seat(customers, weight, discount, draw), customers) for _ in range(samples)])
        return _word_row(dest, packed, counts, customers, spelled.astype(np.float32), tables)

    return run


def _predicted(state: pa.Table, discount: float, seats: int, n_tables: list[int], unknown: float, mass: float) -> tuple[list[bytes], np.ndarray]:
    """A word destination's words, and what the word restaurant predicts for them, averaged."""
    words, customers = _split(state.column("words")[0].as_py()), _unpack(state.column("customers")[0].as_py(), np.int64)
    spelled = 10 ** _unpack(state.column("spelled")[0].as_py(), np.float32).astype(np.float64)
    tables = _unpack(state.column("tables")[0].as_py(), np.int64).reshape(len(n_tables), -1)
    first = np.where(customers > 0, (1 - unknown) * spelled / mass, unknown)
    return words, np.mean([(customers - discount * t + (WORD_STRENGTH + discount * n) * first) / (WORD_STRENGTH + seats) for t, n in zip(tables, n_tables)], axis=0)


def _word_answers(discount: float, seats: int, n_tables: list[int], unknown: float, mass: float):
    """Count and probability of the words that each block asks a word destination for."""

    def run(requests: pa.Table, state: pa.Table) -> pa.Table:
        _, p = _predicted(state, discount, seats, n_tables, unknown, mass)
        counts = _unpack(state.column("counts")[0].as_py(), np.int64)
        rows = [_risen(x, np.int32) for x in requests.column("at").to_pylist()]
        none = pa.nulls(len(rows), pa.binary())
        arrays = [requests.column("block").combine_chunks(), requests.column("dest").combine_chunks(), pa.array([_pack(counts[r]) for r in rows], pa.binary()), pa.array([_pack(p[r].astype(np.float32)) for r in rows], pa.binary()), none, none]
        return pa.Table.from_arrays(arrays, names=["block", "dest", "counts", "p", "shares", "gains"])

    return run


def _scores(dests: int, tokens: int, types: int, ends: int):
    floor = float(np.log10(tokens + types + 1))
    # Untrained, the end is the unknown word too.
    end, on = (np.log10(ends / (tokens + 1)), np.log10(1 - ends / (tokens + 1))) if tokens else (0.0, 0.0)

    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        words, at, sizes = _block_words(docs.column("text"))
        first, second, of = _block_pairs(at, len(words))
        where = {d: x for d, *x in _by_dest(_hashes(words), first, dests)}
        counts, p, shares, gains = np.zeros(len(words), np.int64), np.zeros(len(words)), np.ones(len(words)), np.zeros(len(first))
        for dest, n, own, share, gain in zip(*(answers.column(x).to_pylist() for x in ("dest", "counts", "p", "shares", "gains"))):
            mine, pairs = where[dest]
            if n is not None:
                counts[mine], p[mine] = _unpack(n, np.int64), _unpack(own, np.float32)
            else:
                shares[mine], gains[pairs] = _unpack(share, np.float32), _unpack(gain, np.float32)
        logs = np.full(len(at), end)
        logs[at > 0] = (on + np.log10(gains + shares[first] * p[second]))[of]
        edges = np.cumsum(sizes) - sizes
        known, base, score = (np.add.reduceat(x, edges) for x in ((counts > 0).astype(np.int64)[at], (np.log10(counts + 1.0) - floor)[at], logs))
        arrays = [docs.column("doc_id").combine_chunks(), docs.column("held_out").combine_chunks(), pa.array(sizes.astype(np.int64)), pa.array(known), pa.array(np.full(len(sizes), tokens, np.int64)), pa.array(base), pa.array(score)]
        return pa.Table.from_arrays(arrays, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return run


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _discount(once: int, twice: int) -> float:
    return min(max(once / (once + 2 * twice), 0.05), 0.95) if once + twice else 0.5


def _totals(state: DataFrame) -> tuple[list[int], float]:
    """The word restaurant's tables in each sample, and what its known words' spellings add up to."""
    n = [r["n"] for r in state.select(F.posexplode("n_tables").alias("at", "n")).groupBy("at").agg(F.sum("n").alias("n")).orderBy("at").collect()]  # a row a sample
    return n or [0], state.agg(F.sum("mass")).first()[0] or 1.0


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """A row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10)."""
    with work_tables() as work:
        source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
        size = source.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
        blocks = max(1, -(-size // BLOCK_BYTES))
        dests = max(4, -(-blocks // BLOCKS_A_DEST))
        gram_dests = max(2, dests // DESTS_A_GRAM_DEST)
        held = crc_mod("doc_id", FOLDS) == HELD
        dealt = source.select("doc_id", "text", held.alias("held_out"), (~held).alias("train"), F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int").alias("block"))
        requests = dealt.groupBy("block").applyInArrow(_requests(dests), REQUESTS)  # read once
        paired = materialize(requests.groupBy("dest").applyInArrow(_paired, PAIRED))
        pairs, places = paired.where("block is null").select(*_PAIR_NAMES), paired.where("block is not null").select("block", "dest", "at", "place")
        once, twice = pairs.agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("once", "twice"))).first()
        pair_discount = _discount(once, twice)
        summed = materialize(paired.where("block is null").select("dest", "words", "word_counts").mapInArrow(_counted, WORDS))
        sent = materialize(pairs.select("dest", "keys", "seconds", "tables").mapInArrow(_pair_tables(dests), TABLES))
        state = materialize(summed.groupBy("dest").cogroup(sent.groupBy("dest")).applyInArrow(_customers, WORDS))
        discard(summed)
        tokens, types, ends = state.agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("tokens", "types", "ends"))).first()
        mass, n_tables = 1.0, []
        p1 = np.full(65_536, 1 / SYMBOLS)
        for number in range(rounds):
            last = number == rounds - 1
            seats, dishes, once, twice = state.agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("seats", "dishes", "once", "twice"))).first()
            discount, n_tables = _discount(once, twice), n_tables or [dishes]
            # Of the customers that open a table, so many order the unknown word; all, if nothing has been learned.
            unknown = min(max((once + 1) / (WORD_STRENGTH + discount * dishes + 1), 1 / (dishes + 1)), 0.95) if dishes else 1.0
            asked = materialize(state.select("dest", "words", "tables").mapInArrow(_gram_requests(gram_dests), GRAMS))
            model = materialize(asked.groupBy("dest").applyInArrow(_round(p1, number), MODEL))
            below = np.zeros(65_536)
            for r in model.select(F.explode(F.arrays_zip("dish", "n")).alias("x")).groupBy("x.dish").agg(F.sum("x.n").alias("n")).collect():  # 65,536 rows at most
                below[r["dish"]] = r["n"]
            p1 = short_contexts(below, _seed(2**31, number))
            answers = asked.select("block", "dest", "grams").groupBy("dest").cogroup(model.select("dest", "grams", "logs").groupBy("dest")).applyInArrow(_answered, "block int, dest int, logs binary")
            seated = _seated(gram_dests, discount, n_tables[-1], (1 - unknown) / mass, number, SAMPLES if last else 1)
            following = materialize(state.select("dest", "words", "counts", "customers").groupBy("dest").cogroup(answers.groupBy("block")).applyInArrow(seated, WORDS))
            for old in (asked, model, state):
                discard(old)
            state = following
            n_tables, mass = _totals(state)
            if number and not last:
                continue
            learned = (discount, seats, n_tables, unknown, mass)
            parents = sent.select("pair_dest", "dest", "seconds").groupBy("dest").cogroup(state.groupBy("dest")).applyInArrow(_parents(*learned), "pair_dest int, dest int, p binary")
            reseated = materialize(pairs.groupBy("dest").cogroup(parents.groupBy("pair_dest")).applyInArrow(_pairs_seated(dests, pair_discount, number, last), PAIRS))
            discard(pairs)
            discard(sent)
            pairs = reseated
            if not last:
                sent = materialize(pairs.select("dest", "keys", "seconds", "tables").mapInArrow(_pair_tables(dests), TABLES))
                following = materialize(state.groupBy("dest").cogroup(sent.groupBy("dest")).applyInArrow(_customers, WORDS))
                discard(state)
                state = following
                n_tables, mass = _totals(state)
        back = [materialize(places.select("block", "dest", "at").groupBy("dest").cogroup(state.groupBy("dest")).applyInArrow(_word_answers(*learned), ANSWERS))]
        discard(state)
        for k in range(ANSWER_PARTS):  # one after another, so that only a part is in shuffle files
            own = lambda x: x.where(F.col("dest") % ANSWER_PARTS == k)  # noqa: B023, E731
            asking = own(places).groupBy("dest")
            back.append(materialize(asking.cogroup(own(pairs).select("dest", "gains", "shares").groupBy("dest")).applyInArrow(_pair_answers, ANSWERS)))
        discard(paired)
        discard(pairs)
        back = reduce(DataFrame.union, back)
        return work.keep(materialize(dealt.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(_scores(dests, tokens, types, ends), SCORES)))


def op9_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))

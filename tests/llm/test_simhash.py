import re

import numpy as np
import pytest
import xxhash
from helpers import SF, empty, hard, rows, table

from veridoc.llm import simhash as S
from veridoc.llm.queries import queries


def plain_fingerprint(text):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64(s.encode("utf-8", "surrogatepass"), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps):
    """Of each (id, fingerprint): the least id reachable; ids that are null count as none."""
    distinct = sorted({f for _, f in fps})
    parent = {f: f for f in distinct}

    def find(f):
        while parent[f] != f:
            f = parent[f]
        return f

    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if (a ^ b).bit_count() <= 2:
                parent[find(a)] = find(b)
    least = {}
    for i, f in fps:
        if i is not None:
            least[find(f)] = min(i, least.get(find(f), i))
    return [(i, least.get(find(f))) for i, f in fps]


def _check(docs, got):
    fps = [(r["doc_id"], plain_fingerprint(r["text"])) for r in docs.collect()]
    key = lambda x: tuple((v is None, v or 0) for v in x)
    assert sorted(((r["doc_id"], int(r["fingerprint"], 16)) for r in got), key=key) == sorted(fps, key=key)
    assert sorted(((r["doc_id"], r["component_id"]) for r in got), key=key) == sorted(plain_components(fps), key=key)


def test_query_is_brute_force(spark):
    _check(table(spark, "documents"), queries()["op5_simhash"](spark, SF).collect())


def test_hard_rows(spark):
    _check(hard(spark), S.near_duplicates(hard(spark)).collect())
    assert rows(S.near_duplicates(empty(spark))) == []


def test_golay_keys_meet_within_two_bits():
    draw = np.random.default_rng(1)
    a = draw.integers(0, 1 << 64, 3000, dtype=np.uint64)
    b = a.copy()
    for i in range(len(b)):
        for bit in draw.integers(0, 64, 2):
            b[i] ^= np.uint64(1) << np.uint64(bit)
    keys = [[set() for _ in a], [set() for _ in a]]
    for side, x in enumerate((a, b)):
        for row, key in zip(*S.bucket_keys(x)):
            keys[side][row].add(key)
    assert all(p & q for p, q in zip(*keys))
    counts = np.bincount(S.golay_keys(np.arange(1 << 12, dtype=np.uint32))[0])
    assert set(counts) == {1, 6}


@pytest.mark.parametrize("bucket", [64, 4])
def test_links_connect_what_brute_force_does(spark, bucket):
    """With small buckets the crowded way through points of the space must give the same components."""
    draw = np.random.default_rng(2)
    centres = draw.integers(0, 1 << 64, 6, dtype=np.uint64)
    fps = {int(c) for c in centres}
    for c in centres:
        for _ in range(60):
            x = c
            for bit in draw.integers(0, 64, draw.integers(1, 5)):
                x = x ^ (np.uint64(1) << np.uint64(bit))
            fps.add(int(x))
    signed = [int(np.uint64(f).astype(np.int64)) for f in fps]
    links = rows(S.fingerprint_links(spark.createDataFrame([(f,) for f in signed], "fp long").repartition(3), bucket))
    assert all(((u ^ v) & (2**64 - 1)).bit_count() <= 2 for u, v in links)
    got = {r["u"]: r["v"] for r in S.components(spark.createDataFrame(links, "u long, v long")).collect()}
    plain = dict(plain_components([(f, f & (2**64 - 1)) for f in signed]))
    classes = lambda of: {frozenset(g for g in signed if of(g) == of(f)) for f in signed}
    assert classes(lambda f: got.get(f, f)) == classes(lambda f: plain[f])


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, i) for i in range(1001, 1400)] + [(5, 5), (None, 3)]
    got = {r["u"]: r["v"] for r in S.components(spark.createDataFrame(edges, "u long, v long").repartition(7)).collect()}
    assert got == {i: 0 for i in range(1, 301)} | {i: 1000 for i in range(1001, 1400)}
    assert rows(S.components(spark.createDataFrame([], "u long, v long"))) == []


def plain_classes(docs, least=0.8):
    """Classes of ids whose texts' sets of five-word shingles have this Jaccard similarity, or are linked through others."""
    def shingles(text):
        words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) or frozenset([tuple(words)])

    ids, classes = {}, []
    for i, text in docs:
        ids.setdefault(shingles(text), set()).add(i)
    for own in ids:
        near = [c for c in classes if any(min(len(own), len(x)) >= least * max(len(own), len(x)) and len(own & x) >= least * len(own | x) - 1e-9 for x in c)]
        classes = [c for c in classes if c not in near] + [[own, *(x for c in near for x in c)]]
    return [set().union(*(ids[x] for x in c)) for c in classes]


def _near_copies(draw, n_groups, size, words=120, edits=2):
    """Texts of invented words, each group an original with copies that differ in a few places."""
    out = []
    for g in range(n_groups):
        original = [f"w{int(x)}" for x in draw.integers(0, 4000, words)]
        for _ in range(size):
            copy = list(original)
            for k in draw.choice(words, int(draw.integers(0, edits + 1)), replace=False):
                copy[int(k)] = f"e{int(draw.integers(0, 10**9))}"
            out.append(" ".join(copy))
    return list(enumerate(out))


def test_deduplicate(spark):
    docs = hard(spark)
    kept = S.deduplicate(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] or 0 for r in kept.collect())) == [0, 1, 4, 5, 7, 8, 9]
    assert S.deduplicate(empty(spark)).count() == 0


@pytest.mark.parametrize("settings", [{}, {"bucket": 4, "block": 16, "few": 0}])
def test_near_copies_against_brute_force(spark, settings):
    """Small buckets take the way of crowded ones; few=0 joins without broadcasts."""
    docs = _near_copies(np.random.default_rng(5), 12, 25) + [(1000 + i, " ".join(f"u{i}x{j}" for j in range(60))) for i in range(60)]
    got = {r["doc_id"] for r in S.deduplicate(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), **settings).collect()}
    want = {min(c) for c in plain_classes(docs)}
    assert want <= got and len(got - want) <= 0.02 * (len(docs) - len(want))


def test_near_copies_of_the_supplied_documents(spark):
    """Of the supplied near copies at least 97 in 100 are found, and nothing else goes."""
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    got = {r["doc_id"] for r in S.deduplicate(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect()}
    want = {min(c) for c in plain_classes(docs)}
    gone = {i for i, _ in docs} - want
    assert want <= got and len(got - want) <= 0.03 * len(gone)


@pytest.mark.parametrize("settings", [{}, {"bucket": 4, "block": 16, "few": 0}])
def test_no_near_copy_is_lost(spark, settings):
    """Short texts around common lines, whose fingerprints are far apart and whose buckets are crowded: the classes of brute force."""
    draw = np.random.default_rng(11)
    lines = [[f"l{i}x{j}" for j in range(int(draw.integers(8, 40)))] for i in range(6)]
    docs = []
    for i in range(500):
        line = lines[int(draw.integers(0, 6))]
        own = [f"o{int(x)}" for x in draw.integers(0, 300, int(draw.integers(0, 9)))]
        docs.append((i, " ".join(line + own if i % 3 else own + line)))
    docs += [(1000 + i, " ".join(f"c{j}" for j in range(i, i + 40))) for i in range(30)]
    got = sorted(r["doc_id"] for r in S.deduplicate(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), **settings).collect())
    assert got == sorted(min(c) for c in plain_classes(docs))


def test_near_copies_of_the_supplied_documents_are_those_of_brute_force(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    got = {r["doc_id"] for r in S.deduplicate(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect()}
    assert got == {min(c) for c in plain_classes(docs)}

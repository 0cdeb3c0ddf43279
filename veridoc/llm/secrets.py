"""Secret scans: fixed patterns, and formats learned by grammar inference.

The patterns (kinds assign, access and hex) are exact. Beside them, every run of 16 or more token characters is a
candidate, and so is every such part of it between slashes and equals signs. For each kind of labelled credential a
probabilistic automaton is inferred: a prefix tree of the examples, whose states are merged where their continuations
agree within a Hoeffding bound (red states kept, blue ones tried in order of weight). A last automaton is inferred
from ordinary long tokens. A candidate is reported under the kind whose automaton gives it the highest likelihood, if
that exceeds the ordinary one's by ``threshold`` nats and the pattern spans don't hold it already; of candidates that
overlap, the one with the greatest excess. All candidates of a batch walk through the automata together, as numpy arrays.

The labelled credentials are those that the patterns find in the documents themselves (values assigned to a keyword,
access keys, hexadecimal strings), and the ordinary tokens are the other candidates there: of each kind the ``EXAMPLES``
different ones whose hashes are lowest, of at most ``LONGEST`` characters. Formats that are published, but may not occur
in the documents at hand, are added as made-up examples with a fixed seed.

Cases: null text counts as empty; repeated rows are scanned each on its own; of spans that begin together, the kind
listed first comes first, and candidates that score alike go by place; an empty table gives no rows; other columns are
not read, and clashing names do no harm; texts are scanned whole whatever their length. Positions are code points, ends
exclusive.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veridoc.llm.common import table

BASE_KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
MIN_ASSIGN, MIN_ACCESS, MIN_HEX, MIN_CANDIDATE = 12, 18, 16, 16
THRESHOLD = 20.0
ALPHA = 0.05
#: Weight of symbols that a state hasn't seen, in a credential's automaton and in the ordinary one.
SMOOTHING, PLAIN_SMOOTHING = 1e-4, 1e-2
EXAMPLES = 150
#: Ordinary tokens of the documents, and the greatest length of an example.
ORDINARY, LONGEST = 600, 128

LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
SYMBOLS = LOWER + UPPER + DIGITS + "+/_=-"
#: Published credential formats as (kind, prefix, alphabet, length after the prefix).
FORMATS = (
    ("code_host_token", "ghp_", LOWER + UPPER + DIGITS, 36),
    ("chat_token", "xoxb-", DIGITS + "-" + LOWER + UPPER, 40),
    ("payment_key", "sk_live_", LOWER + UPPER + DIGITS, 24),
    ("maps_key", "AIza", LOWER + UPPER + DIGITS + "-_", 35),
    ("web_token", "eyJ", LOWER + UPPER + DIGITS + "-_", 60),
    ("cloud_secret", "", LOWER + UPPER + DIGITS + "+/", 40),
    ("upper_hex", "", DIGITS + "ABCDEF", 40),
)
#: Common syllables of ordinary words.
SYLLABLES = "the er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve ent ing tion ment ung heit keit sch ich eux ai ou cion ado mente que los con par tre elle eau ble ly sh wh".split()


def labelled_examples(seed: int = 7) -> dict[str, list[str]]:
    """Labelled credentials made from the published formats, and ordinary long tokens under the label "plain"."""
    draw = random.Random(seed)
    out = {kind: [prefix + "".join(draw.choices(alphabet, k=length)) for _ in range(EXAMPLES)] for kind, prefix, alphabet, length in FORMATS}
    word = lambda n: "".join(draw.choices(SYLLABLES, k=n))
    plain = [word(draw.randint(6, 12)) for _ in range(4 * EXAMPLES)]
    plain += [word(draw.randint(6, 12)).upper() for _ in range(2 * EXAMPLES)]
    plain += [word(draw.randint(6, 10)).capitalize() for _ in range(EXAMPLES)]
    plain += [draw.choice("-_/").join(word(draw.randint(1, 4)) for _ in range(draw.randint(3, 8))) for _ in range(2 * EXAMPLES)]
    plain += [draw.choice("=-_") * draw.randint(16, 60) for _ in range(EXAMPLES)]
    plain += ["".join(draw.choices(DIGITS, k=draw.randint(16, 20))) for _ in range(EXAMPLES)]
    out["plain"] = plain
    return out


class Automaton:
    """A probabilistic automaton over SYMBOLS as tables: next state, log-probability, log-probability of the end."""

    def __init__(self, strings: list[str], alpha: float = ALPHA, smoothing: float = SMOOTHING):
        code = {c: i for i, c in enumerate(SYMBOLS)}
        after: list[dict[int, int]] = [{}]
        visits, ends = [0], [0]
        for s in strings:
            at = 0
            visits[0] += 1
            for c in s:
                if code[c] not in after[at]:
                    after[at][code[c]] = len(after)
                    after.append({})
                    visits.append(0)
                    ends.append(0)
                at = after[at][code[c]]
                visits[at] += 1
            ends[at] += 1
        weight: list[dict[int, int]] = [{c: visits[x] for c, x in out.items()} for out in after]
        bound = math.sqrt(0.5 * math.log(2 / alpha))

        def differ(fa: int, na: int, fb: int, nb: int) -> bool:
            return abs(fa / na - fb / nb) > bound * (na**-0.5 + nb**-0.5)

        def compatible(a: int, b: int) -> bool:
            todo = [(a, b)]
            while todo:
                x, y = todo.pop()
                if differ(ends[x], visits[x], ends[y], visits[y]):
                    return False
                for c in {*weight[x], *weight[y]}:
                    if differ(weight[x].get(c, 0), visits[x], weight[y].get(c, 0), visits[y]):
                        return False
                    if c in after[x] and c in after[y]:
                        todo.append((after[x][c], after[y][c]))
            return True

        def fold(a: int, b: int) -> None:
            """Adds the tree at b to the state a."""
            todo = [(a, b)]
            while todo:
                x, y = todo.pop()
                visits[x] += visits[y]
                ends[x] += ends[y]
                for c, target in after[y].items():
                    weight[x][c] = weight[x].get(c, 0) + weight[y][c]
                    if c in after[x]:
                        todo.append((after[x][c], target))
                    else:
                        after[x][c] = target

        red = [0]
        while True:
            blue = [(visits[t], x, c, t) for x in red for c, t in after[x].items() if t not in red]
            if not blue:
                break
            _, x, c, t = max(blue, key=lambda b: (b[0], -b[3]))
            for r in red:
                if compatible(r, t):
                    after[x][c] = r
                    fold(r, t)
                    break
            else:
                red.append(t)
        place = {x: i for i, x in enumerate(red)}
        n = len(SYMBOLS)
        self.next = np.zeros((len(red), n), np.int32)  # an unseen symbol leads to the first state
        p = np.full((len(red), n + 1), smoothing / (n + 1))
        for x, i in place.items():
            for c, t in after[x].items():
                self.next[i, c] = place[t]
                p[i, c] += (1 - smoothing) * weight[x][c] / visits[x]
            p[i, n] += (1 - smoothing) * ends[x] / visits[x]
        self.log_p, self.log_end = np.log(p[:, :n]), np.log(p[:, n])

    def score(self, codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Log-likelihoods of the strings codes[start : start + length], longest first."""
        state, total = np.zeros(len(starts), np.int32), np.zeros(len(starts))
        alive = len(starts)
        for i in range(int(lengths[0]) if len(lengths) else 0):
            while lengths[alive - 1] <= i:
                alive -= 1
            c = codes[starts[:alive] + i]
            total[:alive] += self.log_p[state[:alive], c]
            state[:alive] = self.next[state[:alive], c]
        return total + self.log_end[state]


#: Kinds learned from the documents, by the pattern that labels them.
FOUND_KINDS = {"assign": "assigned_value", "access": "access_key", "hex": "hex_string"}
KINDS = (*FOUND_KINDS.values(), *(f[0] for f in FORMATS))


def infer(found: dict[str, list[str]] | None = None, seed: int = 7) -> dict[str, Automaton]:
    """The automata of labelled strings found, and of the made-up ones; ``plain`` is that of ordinary tokens."""
    examples = labelled_examples(seed)
    for kind, strings in (found or {}).items():
        examples[kind] = examples.get(kind, []) + strings
    return {kind: Automaton(examples[kind], smoothing=PLAIN_SMOOTHING if kind == "plain" else SMOOTHING) for kind in (*KINDS, "plain") if examples.get(kind)}


def _labelled(texts: list[str]) -> Iterator[tuple[str, str]]:
    """(kind, string) of the credentials that the patterns find, and of the ordinary candidates."""
    for text in texts:
        spans = base_spans(text)
        for kind, a, b in spans:
            value = ASSIGN.match(text, a)[2] if kind == "assign" else text[a:b]
            if len(value) <= LONGEST and not set(value) - set(SYMBOLS):
                yield FOUND_KINDS[kind], value
        _, overlaps = _held(spans)
        for a, b in _runs(_CODE[_points(text)] >= 0, MIN_CANDIDATE):
            if b - a <= LONGEST and not overlaps(a, b):
                yield "plain", text[a:b]


def _lowest(strings: dict[str, int], n: int) -> dict[str, int]:
    return dict(sorted(strings.items(), key=lambda x: (x[1], x[0]))[:n])


def credentials(docs: DataFrame, text_col: str = "text", held: bool = False) -> dict[str, list[str]]:
    """Labelled strings of the documents by kind, at most ``EXAMPLES`` (of plain ones ``ORDINARY``); held: those of the fifth of all strings that isn't learned from."""
    bound = lambda kind: ORDINARY if kind == "plain" else EXAMPLES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least: dict[str, dict[str, int]] = {k: {} for k in (*FOUND_KINDS.values(), "plain")}
        for batch in batches:
            for _, texts in _chunks(batch.column(0)):
                for kind, value in _labelled(texts):
                    number = xxhash.xxh64_intdigest(value) >> 1
                    if (number % 5 == 0) == held:
                        least[kind][value] = number
                        if len(least[kind]) > 4 * bound(kind):
                            least[kind] = _lowest(least[kind], bound(kind))
        rows = [(k, v, n) for k, own in least.items() for v, n in _lowest(own, bound(k)).items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64()))], names=["kind", "value", "number"])

    each = docs.select(F.col(text_col).cast("string")).mapInArrow(run, "kind string, value string, number long").distinct()
    best = each.withColumn("r", F.row_number().over(Window.partitionBy("kind").orderBy("number", "value"))).where(F.col("r") <= F.when(F.col("kind") == "plain", ORDINARY).otherwise(EXAMPLES))
    out: dict[str, list[str]] = {}
    for r in best.orderBy("kind", "r").collect():  # a bounded number of short strings
        out.setdefault(r["kind"], []).append(r["value"])
    return out


def _runs(mask: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Maximal runs of True of at least this length."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]])))
    starts, ends = edges[::2], edges[1::2]
    kept = ends - starts >= least
    return list(zip(starts[kept].tolist(), ends[kept].tolist()))


_IS_HEX, _PARTS, _CODE = np.zeros(129, bool), np.zeros(129, bool), np.full(129, -1, np.int16)
_PARTS[[ord(c) for c in "/="]] = True
_IS_HEX[[ord(c) for c in "0123456789abcdef"]] = True
_CODE[[ord(c) for c in SYMBOLS]] = np.arange(len(SYMBOLS))


def base_spans(text: str, points: np.ndarray | None = None) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the fixed patterns, by start, then kind as listed."""
    lower = text.lower()
    found = []
    if any(k in lower for k in KEYWORDS):
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_ASSIGN]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    if points is None:
        points = _points(text)
    found += [("hex", a, b) for a, b in _runs(_IS_HEX[points], MIN_HEX)]
    return sorted(found, key=lambda x: (x[1], BASE_KINDS.index(x[0]), x[2]))


def _points(text: str) -> np.ndarray:
    """Code points, those beyond ASCII as 128."""
    return np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), 128)


def _held(spans: list[tuple[str, int, int]]):
    """Of spans sorted by start: whether one holds a place whole, and whether one overlaps it."""
    starts = [x for _, x, _ in spans]
    reach = list(accumulate((y for _, _, y in spans), max))
    inside = lambda a, b: (i := bisect_right(starts, a)) > 0 and reach[i - 1] >= b
    overlaps = lambda a, b: (i := bisect_left(starts, b)) > 0 and reach[i - 1] > a
    return inside, overlaps


def _spelled(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def scan_texts(texts: list[str], models: dict[str, Automaton] | None = None, threshold: float = THRESHOLD) -> list[tuple[list, list]]:
    """For each text its pattern spans, and the spans that the automata add."""
    models = models or infer()
    kinds = [k for k in models if k != "plain"]
    bases, where, codes, at = [], [], [], 0
    for i, text in enumerate(texts):
        points = _points(text)
        bases.append(base_spans(text, points))
        code = _CODE[points]
        whole = _runs(code >= 0, MIN_CANDIDATE)
        for a, b in dict.fromkeys([*whole, *(_runs((code >= 0) & ~_PARTS[points], MIN_CANDIDATE) if whole else [])]):
            where.append((i, a, b, at))
            codes.append(code[a:b])
            at += b - a
    added: list[list] = [[] for _ in texts]
    if where:
        where.sort(key=lambda x: x[1] - x[2])
        flat = np.concatenate(codes)
        starts, lengths = np.array([w[3] for w in where]), np.array([w[2] - w[1] for w in where])
        plain = models["plain"].score(flat, starts, lengths)
        scores = np.stack([models[k].score(flat, starts, lengths) for k in kinds])
        best = scores.argmax(0)
        gain = scores.max(0) - plain
        good = np.flatnonzero(gain >= threshold)
        inside = {i: _held(bases[i])[0] for i in {where[j][0] for j in good}}
        for j in sorted(good.tolist(), key=lambda j: (-gain[j], where[j][:2])):
            i, a, b, _ = where[j]
            if not inside[i](a, b) and not any(a < y and x < b for _, x, y in added[i]):
                added[i].append((kinds[best[j]], a, b))
        for found in added:
            found.sort(key=lambda x: (x[1], kinds.index(x[0]), x[2]))
    return list(zip(bases, added))


def _chunks(texts: pa.Array, size: int = 4_000_000) -> Iterator[tuple[int, list[str]]]:
    """The texts in parts of about size characters, so a batch's working memory is bounded by its longest text."""
    at, part, total = 0, [], 0
    for i in range(len(texts)):
        part.append(texts[i].as_py() or "")
        total += len(part[-1])
        if total >= size:
            yield at, part
            at, part, total = i + 1, [], 0
    if part:
        yield at, part


SPANS = "array<struct<kind:string,start:long,end:long>>"
_SPAN_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def _scanned(models: dict[str, Automaton], threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in _chunks(batch.column(1)):
                found = scan_texts(texts, models, threshold)
                as_dicts = lambda spans: [{"kind": k, "start": a, "end": b} for k, a, b in spans]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(texts)), pa.array([as_dicts(b) for b, _ in found], _SPAN_TYPE), pa.array([as_dicts(m) for _, m in found], _SPAN_TYPE)],
                    names=["doc_id", "base", "learned"],
                )

    return run


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """A row per document: doc_id, base and learned (arrays of kind, start, end)."""
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(_scanned(infer(credentials(docs, text_col)), threshold), f"doc_id long, base {SPANS}, learned {SPANS}")


def redact_text(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span replaced by its kind in brackets; overlapping spans become one."""
    merged: list[list] = []
    for kind, a, b in sorted(spans, key=lambda x: (x[1], -x[2])):
        if merged and a < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], b)
        else:
            merged.append([kind, a, b])
    out, at = [], 0
    for kind, a, b in merged:
        out += [text[at:a], f"[{kind}]"]
        at = b
    return "".join([*out, text[at:]])


def _redacted(text_at: int, models: dict[str, Automaton], threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(text_at)
            new: list[str | None] = []
            for _, part in _chunks(texts):
                new += [redact_text(t, base + learned) for t, (base, learned) in zip(part, scan_texts(part, models, threshold))]
            kept = [None if not texts[i].is_valid else t for i, t in enumerate(new)]
            yield batch.set_column(text_at, batch.schema.field(text_at), pa.array(kept, batch.schema.field(text_at).type))

    return run


def redact(docs: DataFrame, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The same rows and columns, with every secret in the text replaced by its kind; null texts stay null."""
    return docs.mapInArrow(_redacted(docs.columns.index(text_col), infer(credentials(docs, text_col)), threshold), docs.schema)


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"))
    spell = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    n = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    # By start, then kind as listed: the three fixed kinds, then the learned ones in their order.
    listed = F.array(*(F.lit(k) for k in (*BASE_KINDS, *KINDS)))
    every = F.transform(F.concat("base", "learned"), lambda x: F.struct(x["start"].alias("start"), F.array_position(listed, x["kind"]).alias("at"), x["end"].alias("end"), x["kind"].alias("kind")))
    return found.select("doc_id", *(n(k) for k in BASE_KINDS), F.sha2(spell(F.col("base")), 256).alias("base_sha256"), spell(F.array_sort(every)).alias("spans"))

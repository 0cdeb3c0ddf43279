"""Approximate nearest neighbours: a graph built by NN-descent, searched greedily.

Vectors of one direction (equal but for a positive factor, to twelve decimals) are one node of the graph, with its
least ids, so a vector that fills a third of the table is as cheap as any other. The graph starts from blocks: in
each of ``starts`` orders, by the nearest of ``pivots`` sampled nodes (the only sample; it fixes an order, every node
is indexed) and then along a random direction, nodes are numbered through the whole table and cut into blocks of about
``block`` rows, whose members are compared with each other. How the table or a shuffle is partitioned doesn't matter.
Each round of NN-descent joins every node's neighbours, forward and backward, around it, compares them with each other
(they are neighbours of neighbours) where one of the two is new to it, and keeps each node's ``degree`` best. It ends
when hardly any neighbour is new, however many rounds that takes.

A search starts at the query's own node and expands the best nodes not yet expanded along links in either direction,
round by round in joins, until the whole beam is expanded. The beam grows with the logarithm of the number of nodes.
Nodes are ranked by the distance of unit vectors kept in single precision, computed in double: near-equal vectors
keep their order, which products of rounded vectors lose. The whole beam is then ranked by the cosines of the original
vectors in double precision.

Cases: vectors that are null, zero, or hold null or non-finite components take no part, nor do rows without an id;
cosines are of vectors of one length, so those of another length than the commonest (of two, the longer) take no part;
ties go to the smaller id, of nodes found; a repeated id is one row; an empty table gives no rows; other columns,
texts of any length included, are not read. A query is a row of the table.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veridoc.llm.common import discard, materialize, table

DEGREE = 32
BLOCK = 1024
PIVOTS = 128
STARTS = 3
SETTLED = 0.02
#: Centres compared in one group, at most; each has 2 * DEGREE + 1 members at most.
CENTRES = 4096
#: Nodes in a beam, times the binary logarithm of the number of nodes.
BEAM = 10
_IDS = 8
_HELD = 50_000


def _matrix(column: pa.Array) -> np.ndarray:
    """Lists of one length as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _exact(column: pa.Array) -> np.ndarray:
    """Equally long binaries of doubles as a matrix."""
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _short(unit: np.ndarray) -> list[bytes]:
    """Unit vectors in single precision."""
    return [x.tobytes() for x in unit.astype(np.float32)]


def _unit(column: pa.Array) -> np.ndarray:
    """What ``_short`` spelled, as a matrix of doubles."""
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(len(column), -1).astype(np.float64) if len(column) else np.zeros((0, 0))


def _nearness(x: np.ndarray) -> np.ndarray:
    """Of each two rows, less half their squared distance: for unit vectors, the cosine less one."""
    half = np.einsum("ij,ij->i", x, x) / 2
    return x @ x.T - half[:, None] - half[None, :]


def _directions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds to (id, v) the bytes of the direction: components over the greatest one, to twelve decimals."""
    for batch in batches:
        x = _matrix(batch.column(1))
        way = np.round(x / np.abs(x).max(1, keepdims=True), 12) + 0.0 if len(x) else x
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in way], pa.binary()), pa.array([r.tobytes() for r in x], pa.binary())], names=["id", "way", "exact"])


def _gathered(keep: int):
    """Of each direction in a partition: its least ids, and the vector of the least. Those of many are told in parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least: dict[bytes, dict[int, bytes]] = defaultdict(dict)

        def told() -> Iterator[pa.RecordBatch]:
            keys = list(least)
            for at in range(0, len(keys), 5_000):
                part = keys[at : at + 5_000]
                ids = [sorted(least[k])[:keep] for k in part]
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.binary()), pa.array([least[k][i[0]] for k, i in zip(part, ids)], pa.binary()), pa.array(ids, pa.list_(pa.int64()))], names=["way", "exact", "ids"])
            least.clear()

        for batch in _directions(batches):
            for i, way, exact in zip(*(c.to_pylist() for c in batch.columns)):
                own = least[way]
                own[i] = min(exact, own.get(i, exact))
                if len(own) > 4 * keep:
                    least[way] = {j: own[j] for j in sorted(own)[:keep]}
            if len(least) > _HELD:
                yield from told()
        yield from told()

    return run


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        exact = _exact(batch.column(0))
        unit = (exact / np.abs(exact).max(1, keepdims=True)) if len(exact) else exact
        unit = unit / np.linalg.norm(unit, axis=1, keepdims=True) if len(exact) else unit
        ids = batch.column(1)
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in ids.to_pylist()], pa.int64()), batch.column(0), pa.array(_short(unit) if len(unit) else [], pa.binary()), ids], names=["node", "exact", "unit", "ids"])


def _rows(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id and v (doubles) of the rows that take part."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where("id is not null and v is not null")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = rows.where(F.forall("v", finite) & F.exists("v", lambda x: x != 0))
    commonest = rows.groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    return rows.where(F.size("v") == (commonest["size"] if commonest else 0))


def nodes_of(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", keep: int = _IDS) -> DataFrame:
    """A row per direction: node (its least id), exact (that one's doubles), unit (bytes), ids (its keep least)."""
    least = _rows(vectors, id_col, vector_col).mapInArrow(_gathered(keep), "way binary, exact binary, ids array<long>")
    first = F.min_by("exact", F.element_at("ids", 1)).alias("exact")
    merged = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, keep).alias("ids")
    salted = least.groupBy("way", F.pmod(F.xxhash64("ids"), F.lit(16)).alias("salt")).agg(first, merged)  # a row a task and direction at most, but for those told in parts
    return salted.groupBy("way").agg(first, merged).select("exact", "ids").mapInArrow(_units, "node long, exact binary, unit binary, ids array<long>")


def _best(near: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k greatest of each row."""
    k = min(k, near.shape[1])
    columns = np.argpartition(-near, k - 1, axis=1)[:, :k]
    return np.repeat(np.arange(len(near)), k), columns.ravel()


EDGES = "u long, v long, s double"
GRAPH = "u long, near array<struct<s:double,v:long,old:boolean>>"


def _block(k: int):
    """Compares a block's members with each other; the k nearest of each are its first neighbours."""

    def run(rows: pa.Table) -> pa.Table:
        nodes, near = rows.column("node").to_numpy(), _nearness(_unit(rows.column("unit").combine_chunks()))
        np.fill_diagonal(near, -9)
        if len(nodes) < 2:
            return pa.table({"u": pa.array([], pa.int64()), "v": pa.array([], pa.int64()), "s": pa.array([], pa.float64())})
        at, columns = _best(near, min(k, len(nodes) - 1))
        return pa.table({"u": nodes[at], "v": nodes[columns], "s": near[at, columns]})

    return run


def _ordered(pivots: np.ndarray, ways: np.ndarray):
    """A row for each start: the nearest of the start's pivots and, as a fraction, the place along its direction."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unit = _unit(batch.column("unit"))
            for i, way in enumerate(ways):
                key = (unit @ pivots[i % len(pivots) :: len(ways)].T).argmax(1) + (unit @ way + 1) / 2.0001 if len(unit) else np.zeros(0)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), i), pa.int32()), pa.array(key, pa.float64()), batch.column("node"), batch.column("unit")], names=["start", "key", "node", "unit"])

    return run


def _numbered(sorted_rows: DataFrame) -> DataFrame:
    """Adds number, each row's place in a range-partitioned and sorted table. The driver gets a count a partition."""
    placed = materialize(sorted_rows.withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", 33).cast("int").alias("part")
    counts = placed.groupBy(part).count().orderBy("part").collect()  # a row a partition
    before, offsets = 0, []
    for r in counts:
        offsets.append((r["part"], before))
        before += r["count"]
    of = placed.sparkSession.createDataFrame(offsets, "part int, before long")
    out = placed.withColumn("part", part).join(F.broadcast(of), "part").withColumn("number", F.col("before") + F.col("at").bitwiseAND((1 << 33) - 1)).drop("part", "before", "at")
    out.veridoc_path = placed.veridoc_path
    return out


def _compared(links: pa.Table, about: pa.Table) -> pa.Table:
    """Compares the members around each centre of a group with each other where one is new; those nearer than a member's worst are proposed."""
    us, vs, ss = ([np.zeros(0, k)] for k in (np.int64, np.int64, np.float64))
    if links.num_rows and about.num_rows:
        member = about.column("name").to_numpy()
        order = np.argsort(member)
        names, worst = member[order], about.column("worst").to_numpy()[order]
        unit = np.frombuffer(b"".join(about.column("unit").to_pylist()), np.float32).reshape(len(order), -1)[order]
        centre, at, old = links.column("centre").to_numpy(), np.searchsorted(names, links.column("member").to_numpy()), links.column("old").to_numpy()
        order = np.lexsort((at, centre))
        centre, at, old = centre[order], at[order], old[order]
        edges = np.flatnonzero(np.concatenate([[True], centre[1:] != centre[:-1], [True]]))
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
            if old[a:b].all():
                continue
            own, of = np.unique(at[a:b], return_inverse=True)
            new = np.bincount(of, old[a:b]) == 0
            near = _nearness(unit[own].astype(np.float64))
            good = (new[:, None] | new[None, :]) & (near > worst[own][:, None])
            np.fill_diagonal(good, False)
            i, j = np.nonzero(good)
            us.append(own[i])
            vs.append(own[j])
            ss.append(near[i, j])
        u, v, s = map(np.concatenate, (us, vs, ss))
        _, first = np.unique(u * len(names) + v, return_index=True)
        us, vs, ss = [names[u[first]]], [names[v[first]]], [s[first]]
    return pa.table({"u": us[0], "v": vs[0], "s": ss[0]})


def _top(edges: DataFrame, k: int) -> DataFrame:
    """Of edges (u, v, s, old), which may repeat, each node's k best, best first. All of it after one shuffle by u."""
    once = edges.repartition("u").groupBy("u", "v").agg(F.max("s").alias("s"), F.max("old").alias("old"))
    ranked = once.withColumn("r", F.row_number().over(Window.partitionBy("u").orderBy(F.desc("s"), "v"))).where(F.col("r") <= k)
    return ranked.groupBy("u").agg(F.sort_array(F.collect_list(F.struct("s", "v", "old")), asc=False).alias("near"))


def _links(graph: DataFrame, degree: int) -> DataFrame:
    """Both directions of the graph's links, backward ones the degree best of a node: centre, member, old."""
    flat = graph.select("u", F.explode("near").alias("e")).select("u", F.col("e.v").alias("v"), F.col("e.s").alias("s"), F.col("e.old").alias("old"))
    back = flat.withColumn("r", F.row_number().over(Window.partitionBy("v").orderBy(F.desc("s"), "u"))).where(F.col("r") <= degree)
    return flat.select(F.col("u").alias("centre"), F.col("v").alias("member"), "old").union(back.select("v", "u", "old"))


def build_graph(nodes: DataFrame, degree: int = DEGREE, block: int = BLOCK, pivots: int = PIVOTS, starts: int = STARTS, rounds: int | None = None, seed: int = 11) -> DataFrame:
    """The neighbour graph of a materialized nodes table: u, near (array of s, v, old; best first). rounds: as many as it takes, or at most so many."""
    many = nodes.count()
    if many < 2:
        return materialize(nodes.sparkSession.createDataFrame([], GRAPH))
    sampled = nodes.select("unit").orderBy(F.xxhash64("node", F.lit(seed))).limit(pivots * starts).collect()  # pivots * starts rows
    points = _unit(pa.array([bytes(r["unit"]) for r in sampled], pa.binary()))
    ways = np.random.default_rng(seed).normal(size=(starts, points.shape[1]))
    keyed = nodes.select("node", "unit").mapInArrow(_ordered(points, ways / np.linalg.norm(ways, axis=1, keepdims=True)), "start int, key double, node long, unit binary")
    rows = _numbered(keyed.repartitionByRange("start", "key", "node").sortWithinPartitions("start", "key", "node"))
    blocks = -(-many // block)
    place = F.floor((F.col("number") - F.col("start") * many) * blocks / F.lit(many)).alias("block")
    first = rows.select("start", place, "node", "unit").groupBy("start", "block").applyInArrow(_block(degree), EDGES)
    graph = materialize(_top(first.withColumn("old", F.lit(False)), degree))
    size = min(CENTRES, max(CENTRES // 16, many // 32))
    groups = materialize(rows.where("start = 0").select(F.col("node").alias("centre"), F.floor(F.col("number") / size).cast("int").alias("group")))
    discard(rows)
    while rounds is None or rounds > 0:
        rounds = None if rounds is None else rounds - 1
        # A node's members: itself, its neighbours, and the nearest of those whose neighbour it is. They are compared in groups
        # of centres that lie together, to each of which a vector goes once.
        around = _links(graph, degree).union(graph.select("u", "u", F.lit(True))).join(groups, "centre")
        worst = graph.select(F.col("u").alias("node"), F.when(F.size("near") < degree, F.lit(-9.0)).otherwise(F.element_at("near", -1)["s"]).cast("double").alias("worst"))
        about = nodes.select("node", "unit").join(worst, "node")
        sent = around.select(F.col("group").alias("of"), F.col("member").alias("name")).distinct().join(about, F.col("name") == F.col("node")).select("of", "name", "unit", "worst")
        proposed = around.groupBy("group").cogroup(sent.groupBy("of")).applyInArrow(_compared, EDGES)
        known = graph.select("u", F.explode("near").alias("e")).select("u", F.col("e.v").alias("v"), F.col("e.s").alias("s"), F.lit(True).alias("old"))
        better = materialize(_top(known.union(proposed.withColumn("old", F.lit(False))), degree))
        discard(graph)
        graph = better
        if (graph.agg(F.sum(F.size(F.filter("near", lambda e: ~e["old"])))).first()[0] or 0) <= SETTLED * degree * many:
            break
    discard(groups)
    return graph


STATE = "q long, unit binary, vs array<long>, ss array<double>, done array<boolean>"


def _advanced(beam: int):
    """A query's beam after what its nodes led to has been ranked into it."""

    def run(state: pa.Table, reached: pa.Table) -> pa.Table:
        if not state.num_rows:
            return state
        vs, ss, done = (np.array(state.column(c)[0].as_py()) for c in ("vs", "ss", "done"))
        done[:] = True  # all of a beam are expanded at once
        v, unit = reached.column("v").combine_chunks().to_numpy(), _unit(reached.column("b").combine_chunks())
        fresh = ~np.isin(v, vs)
        if fresh.any():
            own = np.frombuffer(state.column("unit")[0].as_py(), np.float32).astype(np.float64)
            s = np.square(unit[fresh] - own).sum(1) / -2
            vs, ss, done = np.concatenate([vs, v[fresh]]), np.concatenate([ss, s]), np.concatenate([done, np.zeros(len(s), bool)])
            best = np.lexsort((vs, -ss))[:beam]
            vs, ss, done = vs[best], ss[best], done[best]
        row = [state.column("q").combine_chunks(), state.column("unit").combine_chunks(), *(pa.array([x.tolist()], k) for x, k in ((vs, pa.list_(pa.int64())), (ss, pa.list_(pa.float64())), (done, pa.list_(pa.bool_()))))]
        return pa.Table.from_arrays(row, names=["q", "unit", "vs", "ss", "done"])

    return run


def _cosines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """q, v and the cosine of the exact vectors a and b."""
    for batch in batches:
        for at in range(0, batch.num_rows, 4_096):
            part = batch.slice(at, 4_096)
            a, b = (_exact(part.column(name)) for name in ("a", "b"))
            s = np.einsum("ij,ij->i", a, b) / np.sqrt(np.einsum("ij,ij->i", a, a)) / np.sqrt(np.einsum("ij,ij->i", b, b))
            yield pa.RecordBatch.from_arrays([part.column("q"), part.column("v"), pa.array(s.astype(np.float64))], names=["q", "v", "s"])


def search(nodes: DataFrame, graph: DataFrame, queries: DataFrame, beam: int, degree: int = DEGREE) -> DataFrame:
    """The nodes found for each query node of column q: q, v, s (exact cosine), a beam of each, q itself among them."""
    asked = materialize(nodes.join(queries.select(F.col("q").alias("node")).distinct(), "node", "left_semi").select(F.col("node").alias("q"), "unit", "exact"))
    around = materialize(_links(graph, degree).groupBy("centre").agg(F.collect_set("member").alias("members")))  # 2 * degree at most
    state = materialize(asked.select("q", "unit", F.array("q").alias("vs"), F.array(F.lit(0.0)).alias("ss"), F.array(F.lit(False)).alias("done")))
    at = nodes.select(F.col("node").alias("v"), F.col("unit").alias("b"))
    while True:
        go = state.select("q", F.explode(F.arrays_zip("vs", "done")).alias("e")).where("not e.done").select(F.col("q").alias("asker"), F.col("e.vs").alias("centre"))
        reached = go.join(around, "centre").select("asker", F.explode("members").alias("v")).distinct().join(at, "v")
        moved = materialize(state.groupBy("q").cogroup(reached.groupBy("asker")).applyInArrow(_advanced(beam), STATE))
        discard(state)
        state = moved
        if state.where(F.exists("done", lambda x: ~x)).limit(1).count() == 0:
            break
    discard(around)
    chosen = state.select("q", F.explode("vs").alias("v"))
    pairs = chosen.join(nodes.select(F.col("node").alias("v"), F.col("exact").alias("b")), "v").join(asked.select("q", F.col("exact").alias("a")), "q")
    return pairs.select("q", "v", "a", "b").mapInArrow(_cosines, "q long, v long, s double")


def nearest(vectors: DataFrame, every: int, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k nearest found of every query, the rows whose id is divisible by every: query_id, rank, vec_id, score."""
    nodes = materialize(nodes_of(vectors, id_col, vector_col, max(_IDS, k + 1)))
    graph = build_graph(nodes)

    def ways(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _directions(batches):
            yield batch.select(["id", "way"])

    def way_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _exact(batch.column(1))
            way = np.round(x / np.abs(x).max(1, keepdims=True), 12) + 0.0 if len(x) else x
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in way], pa.binary())], names=["node", "way"])

    keys = _rows(vectors, id_col, vector_col).where(F.col("id") % every == 0).mapInArrow(ways, "id long, way binary")
    asked = materialize(keys.join(nodes.select("node", "exact").mapInArrow(way_of, "node long, way binary"), "way").select(F.col("id").alias("query_id"), F.col("node").alias("q")).distinct())
    found = search(nodes, graph, asked, BEAM * max(2, math.ceil(math.log2(nodes.count() + 1))))
    # Each node's ids stand for all of them: a tie goes to the smaller id, so no more than k + 1 are ever needed.
    ids = found.join(nodes.select(F.col("node").alias("v"), "ids"), "v").select("q", "s", F.explode("ids").alias("vec_id"))
    ranked = ids.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("s"), "vec_id"))).where(F.col("r") <= k + 1)
    lists = ranked.groupBy("q").agg(F.sort_array(F.collect_list(F.struct("r", "vec_id", "s"))).alias("list"))  # k + 1 at most
    own = asked.join(lists, "q").select("query_id", F.slice(F.filter("list", lambda x: x["vec_id"] != F.col("query_id")), 1, k).alias("list"))
    out = materialize(own.select("query_id", F.posexplode("list").alias("at", "e")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("e.vec_id").alias("vec_id"), F.col("e.s").alias("score")))
    for done in (nodes, graph, asked):
        discard(done)
    return out


def op3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), every=50)

"""Helpers that several operators share: tables, checkpoints, connected components."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_LOCK = threading.Lock()
#: By session: how many writes are under way, and what the setting was before the first.
_WRITES: dict[str, tuple[int, str]] = {}
_SCOPES = threading.local()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the supplied tables, by a path that only Spark has to understand."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share (spark.checkpoint.dir); where it is unset, a temporary one, in local mode only."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not given:
        given = context.getCheckpointDir()
    if not given:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        given = f"file://{tempfile.mkdtemp(prefix='veridoc-checkpoints-')}"
        context.setCheckpointDir(given)
    return given.rstrip("/")


@contextmanager
def _shuffles_cleaned(spark: SparkSession) -> Iterator[None]:
    """Shuffle files go as soon as a query ends, while any thread of the session is in here; then the setting is as before."""
    key = str(spark._jsparkSession.sessionUUID())
    with _LOCK:
        n, before = _WRITES.get(key) or (0, spark.conf.get(_CLEANUP, "false"))
        _WRITES[key] = n + 1, before
        spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        with _LOCK:
            n, before = _WRITES.pop(key)
            if n > 1:
                _WRITES[key] = n - 1, before
            else:
                spark.conf.set(_CLEANUP, before)


def materialize(df: DataFrame) -> DataFrame:
    """df written as Parquet to the shared folder and read again: cuts the lineage, survives lost executors.

    Its shuffle files go as soon as it is written. The folder's path is kept on the result for ``discard``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/veridoc-{uuid.uuid4().hex}"
    with _shuffles_cleaned(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.veridoc_path = path
    for scope in getattr(_SCOPES, "open", [])[-1:]:
        scope.tables.append(out)
    return out


def discard(df: DataFrame) -> None:
    """Deletes what ``materialize`` wrote, once nothing reads it any more."""
    path = getattr(df, "veridoc_path", None)
    if path:
        spark = df.sparkSession
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


class WorkTables:
    """The tables written since it began; at its end all go but those to keep, which an outer one takes over."""

    def __init__(self) -> None:
        self.tables: list[DataFrame] = []
        self.kept: list[DataFrame] = []

    def keep(self, df: DataFrame) -> DataFrame:
        self.kept.append(df)
        return df


@contextmanager
def work_tables() -> Iterator[WorkTables]:
    """A scope for tables that an operator needs while it runs."""
    scopes = _SCOPES.open = getattr(_SCOPES, "open", [])
    own = WorkTables()
    scopes.append(own)
    try:
        yield own
    finally:
        scopes.pop()
        left = {id(x) for x in own.kept}
        for x in own.tables:
            if id(x) not in left:
                discard(x)
            elif scopes:
                scopes[-1].tables.append(x)


def crc_mod(id_col: str, modulus: int):
    """crc32 of the id's decimal text, modulo modulus; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % modulus


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over the links of one partition; each node is linked to the least of its part."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while (up := parent.get(root, root)) != root:
            root = up
        while (up := parent.get(x, x)) != root:
            parent[x] = root
            x = up
        return root

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            ra, rb = find(a), find(b)
            parent.setdefault(a, ra)
            parent.setdefault(b, rb)
            if ra < rb:
                parent[rb] = ra
            elif rb < ra:
                parent[ra] = rb
    nodes = [x for x in parent if find(x) != x]
    for i in range(0, len(nodes), 50_000):
        part = nodes[i : i + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([find(x) for x in part], pa.int64())], names=["u", "v"])


def _rehung(edges: DataFrame, strict: bool) -> DataFrame:
    """One star step: every neighbour of u (those above u only, if strict) is linked to the least one around u."""
    if strict:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    hung = both.join(least, "u")
    if strict:
        out = hung.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = hung.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.where("u != v").distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of links (u, v) of longs: rows (u, v), v the least node reachable from u, for every u that isn't itself the least.

    Alternates large-star and small-star steps; each round first contracts what each partition
    knows by union-find, and is written to the shared folder. No links reach the driver. Loops and
    repeated links are allowed; rows with nulls are ignored; no links give no rows.
    """
    current = materialize(edges.where("u is not null and v is not null and u != v").mapInArrow(_forest, "u long, v long").distinct())
    for _ in range(max_rounds):
        stepped = materialize(_rehung(_rehung(current.mapInArrow(_forest, "u long, v long").distinct(), True), False))
        discard(current)
        current = stepped
        several = current.groupBy("u").count().where("count > 1").select(F.col("u").alias("x"))
        chained = current.join(current.select(F.col("u").alias("x")), F.col("v") == F.col("x"), "left_semi").select(F.col("u").alias("x"))
        if several.union(chained).limit(1).count() == 0:
            return current
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")

"""Plumbing shared by the operators: tables in the shared folder, Arrow batches, connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute  # pa.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH, BYTES = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
TEXT_ROWS, SMALL_ROWS, BATCH_BYTES = 1000, 20_000, 4 << 20
WHOLE = 1 << 20  # links that one task connects: 16 MB
_own: dict[str, str] = {}
_tables: dict[str, list[str]] = {}  # of each application, the paths of what materialise has written


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset: a temporary folder in local mode, else one beside the warehouse."""
    if at := spark.conf.get("spark.checkpoint.dir", None):
        return at
    if (at := spark.sparkContext._jsc.sc().getCheckpointDir()).isDefined():
        return at.get()
    app = spark.sparkContext.applicationId
    if app not in _own:
        local = spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local"
        _own[app] = tempfile.mkdtemp(prefix="llm-") if local else f"{spark.conf.get('spark.sql.warehouse.dir')}/_llm"
    return _own[app]


def materialise(df: DataFrame, label: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage, and outlives any executor.

    The write's shuffle files go as soon as it ends: nothing reads them again, and else they stay until the driver happens to collect its garbage.
    """
    spark, path = df.sparkSession, f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    _tables.setdefault(spark.sparkContext.applicationId, []).append(path)
    with settings(spark, {CLEANUP: "true"}):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._llm_path = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes the table of a result of materialise that nothing reads any more."""
    _delete(df.sparkSession, df._llm_path)


def release(spark: SparkSession) -> None:
    """Deletes all tables of this session; results that were not written elsewhere can't be read any more."""
    for path in list(_tables.get(spark.sparkContext.applicationId, [])):
        _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    _tables[spark.sparkContext.applicationId].remove(path)


def batches(spark: SparkSession, rows: int, size: int = BATCH_BYTES):
    """For the actions inside: Arrow batches of at most so many rows and bytes."""
    return settings(spark, {BATCH: str(rows), BYTES: f"{size}b"})


@contextmanager
def settings(spark: SparkSession, new: dict[str, str]) -> Iterator[None]:
    """For the actions inside: these settings. The session's own come back after."""
    before = {k: spark.conf.get(k) for k in new}
    try:
        for k, v in new.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have in any case."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def by_bytes(batch: pa.RecordBatch, column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices whose text column has about `most` bytes, or one row."""
    sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column(column).cast(pa.binary())), 0), dtype=np.int64)
    ends, at = np.cumsum(sizes), 0
    while at < len(sizes):
        before = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield batch.slice(at, stop - at)
        at = stop


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text; null: empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def mapped(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow with a function of one batch."""

    def run(batches):
        for b in batches:
            if b.num_rows:
                yield from fn(b)

    return df.mapInArrow(run, schema)


def rooted(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the nodes that links a-b connect, each that is not the smallest of its component, and that smallest node."""
    node, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    root, (x, y) = np.arange(len(node)), at.reshape(2, -1)
    while True:
        p, q = root[x], root[y]
        apart = p != q
        if not apart.any():
            moved = root != np.arange(len(node))
            return node[moved], node[root[moved]]
        x, y, p, q = x[apart], y[apart], p[apart], q[apart]
        np.minimum.at(root, np.maximum(p, q), np.minimum(p, q))
        while (root[root] != root).any():
            root = root[root]


def stars(edges: DataFrame) -> DataFrame:
    """Links (u, v) that connect what edges (u, v) connect, v the smaller: each task makes its own into stars, WHOLE at a time."""
    most = WHOLE

    def made(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(parts)
        return pa.record_batch([pa.array(c) for c in rooted(t["u"].to_numpy(), t["v"].to_numpy())], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            if held and n + b.num_rows > most:
                yield made(held)
                held, n = [], 0
            held.append(b)
            n += b.num_rows
        if held:
            yield made(held)

    return edges.mapInArrow(run, "u long, v long")


def components(edges: DataFrame) -> DataFrame:
    """Rows (a, b) of longs are links; returns (node, root), root the smallest node of its component, for each node but roots.

    Tasks first make their own links into stars. What is left is connected in one task if it is WHOLE links at most, else in
    alternating large-star and small-star rounds: what a round makes is no more than its input, hubs are only aggregated and joined.
    """
    e = materialise(stars(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).filter("u != v")), "edges")
    if e.count() <= WHOLE:
        old, e = e, materialise(stars(e.coalesce(1)), "edges")
        discard(old)
        return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    before = None
    while True:
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        e2 = large.join(low, "u")
        small = e2.filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).distinct()
        old, e = e, materialise(small, "edges")
        discard(old)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x9FB21C651E98DF25)
    return x ^ (x >> np.uint64(32))

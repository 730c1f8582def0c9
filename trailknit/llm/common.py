"""Shared pieces of the corpus operators: table reading, scratch tables, and vectorised word kernels.

The kernels work on whole Arrow batches: the UTF-8 bytes of many texts lie in one NumPy array, so tokenising and
hashing cost a few passes over bytes and no Python code per word. Batches are cut into chunks of bounded bytes, so
memory does not depend on the number of rows in a batch; a single longer text is a chunk of its own.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_BYTES = 2 << 20
U64 = np.uint64
ROUNDS = 200
RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_own: dict[str, str] = {}


# ---------------------------------------------------------------- tables


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares for checkpoints; a temporary one only where none is set and all runs in one machine."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None) or _own.get(spark.sparkContext.applicationId)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = _own[spark.sparkContext.applicationId] = "file://" + tempfile.mkdtemp(prefix="corpus-scratch-")
    return base.rstrip("/")


@contextmanager
def shuffles_released(spark: SparkSession) -> Iterator[None]:
    """Spark deletes the shuffle files of the queries that run within as soon as each has ended (here: has written its table)."""
    before = spark.conf.get(RELEASE, None)
    spark.conf.set(RELEASE, "true")
    try:
        yield
    finally:
        spark.conf.unset(RELEASE) if before is None else spark.conf.set(RELEASE, before)


def _folder(spark: SparkSession, path: str) -> tuple:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def cut(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet to the shared scratch folder and reads it back: lost executors then cost no recomputation.

    The folder is removed by discard() or else when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    where, fs = _folder(spark, path)
    fs.deleteOnExit(where)
    with shuffles_released(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Deletes tables that cut() wrote and that nothing reads any more."""
    for df in tables:
        if df is not None:
            where, fs = _folder(df.sparkSession, df._scratch)
            fs.delete(where, True)


def partitions(spark: SparkSession, least: int = 1) -> int:
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def text_key() -> F.Column:
    """Tells apart rows that share a doc_id but not the text."""
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


# ---------------------------------------------------------------- Arrow batches


def chunks(batch: pa.RecordBatch, column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of the batch with about `limit` bytes of text each (a longer text alone)."""
    n = batch.num_rows
    if not n:
        return
    lengths = np.nan_to_num(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False).astype(float))
    group = (np.cumsum(lengths) // limit).astype(np.int64)
    edges = np.concatenate([[0], np.flatnonzero(np.diff(group)) + 1, [n]])
    yield from zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, offsets of len + 1); null is empty."""
    if column.null_count:
        column = column.fill_null("")
    if pa.types.is_large_string(column.type) or pa.types.is_string_view(column.type):
        column = column.cast(pa.string())
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.empty(0, np.uint8)
    return raw, off - off[0]


# ---------------------------------------------------------------- hashing


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit words."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def stream(seed: int, n: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit words."""
    with np.errstate(over="ignore"):
        return mix((np.arange(1, n + 1, dtype=U64) + U64(seed) * U64(1 << 32)) * U64(0x9E3779B97F4A7C15))


BYTE = stream(1, 256)
BASE = U64(0xD1342543DE82EF95)
TURN = stream(2, 16) | U64(1)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_powers = np.ones(1, U64)


def powers(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        full = np.full(max(n, 1024), BASE, U64)
        full[0] = 1
        _powers = np.cumprod(full, dtype=U64)
    return _powers


def words(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first word of each text) of the words, maximal runs of other than ASCII white space."""
    solid = ~SPACE[raw]
    first = np.zeros(len(raw) + 1, bool)
    first[off] = True
    before = np.concatenate([[False], solid])[:-1] if len(raw) else solid
    start = np.flatnonzero(solid & (~before | first[:-1]))
    after = np.concatenate([solid[1:], [False]]) if len(raw) else solid
    end = np.flatnonzero(solid & (~after | first[1:])) + 1
    return start, end, np.searchsorted(start, off)


def span_hash(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of disjoint, ascending, non-empty spans of bytes."""
    if not len(start):
        return np.empty(0, U64)
    size = end - start
    total = int(size.sum())
    at = np.concatenate([[0], np.cumsum(size)[:-1]])
    rel = np.arange(total) - np.repeat(at, size)
    value = BYTE[raw[rel + np.repeat(start, size)]]
    value *= powers(int(size.max()))[rel]
    return mix(np.add.reduceat(value, at) + size.astype(U64))


def shingles(h: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first shingle of each text) of the k-word shingles; a text of fewer words has all of them as one."""
    n = np.diff(first)
    count = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    begin = np.concatenate([[0], np.cumsum(count)])
    padded = np.concatenate([h, np.zeros(k, U64)])
    at = np.arange(begin[-1]) - np.repeat(begin[:-1], count) + np.repeat(first[:-1], count)
    out = np.zeros(len(at), U64)
    for i in range(k):
        out += padded[at + i] * TURN[i]
    for t in np.flatnonzero((n > 0) & (n < k)):
        out[begin[t]] = sum((int(h[first[t] + i]) * int(TURN[i]) for i in range(n[t])), 0x5BD1 * int(n[t])) % (1 << 64)
    return mix(out), begin


# ---------------------------------------------------------------- groups of sorted rows


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of the rows with equal keys, from batches sorted by them; one group is held at a time."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        edges = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for a, z in zip(edges[:-1], edges[1:], strict=True):
            key = tuple(c[a] for c in columns)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, z - a))
            last = key
    if held:
        yield pa.Table.from_batches(held)


# ---------------------------------------------------------------- connected components


def components(edges: DataFrame, name: str) -> DataFrame:
    """(v, root) for each vertex of the edges (a, b): root is the smallest vertex reachable.

    Every round points each vertex at the least of itself and its neighbours, and contracts the edges along these
    pointers. A star, however large, is gone after one round, and every other component loses half of its vertices at
    least, so the tables shrink from round to round. Each round is a table in the shared folder; the driver sees only whether
    edges are left.
    """
    left = cut(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{name}-edges")
    labels = spent = None
    for step in range(ROUNDS):
        both = left.select(F.col("a").alias("v"), F.col("b").alias("w")).union(left.select(F.col("b").alias("v"), F.col("a").alias("w")))
        least = cut(both.groupBy("v").agg(F.least(F.col("v"), F.min("w")).alias("up")), f"{name}-{step}")
        old = labels
        labels = least.withColumnRenamed("up", "root") if labels is None else labels.join(least, F.col("root") == least["v"], "left").select(labels["v"], F.coalesce("up", "root").alias("root"))
        if step:
            labels = cut(labels, f"{name}-{step}-labels")
            discard(spent, *([old] if step > 1 else []))
        spent = least
        ends = left.join(least.select(F.col("v").alias("a"), F.col("up").alias("c")), "a").join(least.select(F.col("v").alias("b"), F.col("up").alias("d")), "b")
        before, left = left, cut(ends.where("c <> d").select(F.least("c", "d").alias("a"), F.greatest("c", "d").alias("b")).distinct(), f"{name}-{step}-edges")
        discard(before)
        if left.isEmpty():
            return labels
    raise RuntimeError(f"{name}: edges are left after {ROUNDS} rounds")

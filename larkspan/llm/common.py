"""Shared pieces of the training-data operators: written tables, text as numpy arrays, word hashes."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that one numpy pass works on; a longer document is a chunk by itself.
CHUNK_BYTES = 500_000


# --- written tables -----------------------------------------------------------------------------
def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where that is unset, a temporary one in local mode only."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    own = getattr(spark.sparkContext, "_larkspan_dir", None)
    if own is None:
        own = "file://" + tempfile.mkdtemp(prefix="larkspan-")
        spark.sparkContext._larkspan_dir = own
    return own


_scopes: list[list[DataFrame]] = []


@contextlib.contextmanager
def written() -> Iterator[list[DataFrame]]:
    """The tables that :func:`materialize` writes meanwhile, to be released when nothing reads them any more."""
    tables: list[DataFrame] = []
    _scopes.append(tables)
    try:
        yield tables
    finally:
        _scopes.remove(tables)


def materialize(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back: its lineage ends there, on storage that
    outlives executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/larkspan/{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._larkspan_path = path
    for tables in _scopes:
        tables.append(back)
    return back


def release(*frames: DataFrame) -> None:
    """Delete tables of :func:`materialize` that nothing reads any more."""
    for df in frames:
        path = getattr(df, "_larkspan_path", None)
        if path:
            jvm = df.sparkSession._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def free_name(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have, in any case."""
    taken = {c.lower() for c in df.columns}
    name = f"__{name}"
    while name in taken:
        name += "_"
    return name


# --- text as arrays -----------------------------------------------------------------------------
def text_arrays(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows end to end, and the offset of each row (one more than rows); null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    _, offsets, data = col.buffers()
    off = np.frombuffer(offsets, np.int64)[col.offset : col.offset + len(col) + 1]
    if data is None or not len(off) or off[-1] == off[0]:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[off[0] : off[-1]], off - off[0]


def give_back() -> None:
    """Return what a task has freed to the system, as workers stay for later tasks beside others."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about ``limit`` bytes of text each; every row is in exactly one."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, off = text_arrays(batch.column(text))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(off, off[at] + limit, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to
    give_back()


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = np.random.Generator(np.random.PCG64(20240501)).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of the base, and of its inverse, modulo 2**64."""
    if len(_POWERS["up"]) <= n:
        size = max(n + 1, CHUNK_BYTES + 2)
        for k, b in (("up", _BASE), ("down", pow(_BASE, -1, 2**64))):
            a = np.full(size, b, np.uint64)
            a[0] = 1
            _POWERS[k] = np.multiply.accumulate(a)
    return _POWERS["up"], _POWERS["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit numbers that spreads every bit (in place of ``x`` a new array)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def words(data: np.ndarray, off: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of each row: row, start, end (bytes) and 64-bit hash of each word in order."""
    n = len(data)
    if not n:
        e = np.zeros(0, np.int64)
        return e, e, e, np.zeros(0, np.uint64)
    inside = ~_SPACE[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    filled = off[1:] > off[:-1]
    a, z = off[:-1][filled], off[1:][filled] - 1
    first[a] = inside[a]
    last[z] = inside[z]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    row = np.searchsorted(off, start, "right") - 1
    up, down = _powers(n)
    prefix = np.zeros(n + 1, np.uint64)
    table = _BYTE[_LOWER] if lower else _BYTE
    np.cumsum(table[data] * up[:n], out=prefix[1:])
    h = (prefix[end] - prefix[start]) * down[start]
    return row, start, end, mix(h + (end - start).astype(np.uint64))


def shingles(row: np.ndarray, word: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Index of the first word, and 64-bit hash, of each run of ``k`` words within a row; in order."""
    n = len(word) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.flatnonzero(row[:n] == row[k - 1 :])
    h = np.zeros(len(at), np.uint64)
    for i in range(k):
        h = mix(h + word[at + i])
    return at, h


def as_signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


# --- components ---------------------------------------------------------------------------------
def components(edges: DataFrame, known: DataFrame | None = None, max_rounds: int = 60) -> DataFrame:
    """``node``, ``component`` (the smallest node reachable) for each end of the long pairs ``a``, ``b``.

    Alternating large-star and small-star steps over edges, the first of two hops: every step is an aggregation and an
    equi-join, a round is one written table, and no neighbour list is gathered in one task. Each row tells whether its edge
    has moved; a round in which none has ends the work. With ``known``, components of earlier edges, only those components
    that the new edges touch are worked on, and the rows of ``known`` are named anew.
    """
    edges = edges.where("a is not null and b is not null")
    if known is not None:
        at = lambda c: known.select(F.col("node").alias(c), F.col("component").alias(f"of_{c}"))
        edges = edges.join(at("a"), "a", "left").join(at("b"), "b", "left").select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b"))
    now = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))
    for _ in range(max_rounds):
        # the least neighbour of each node that has a smaller one
        least = now.groupBy("a").agg(F.min("b").alias("m"))
        hop = least.select(F.col("a").alias("b"), F.col("m").alias("m1"))
        hop2 = least.select(F.col("a").alias("m1"), F.col("m").alias("m2"))
        large = now.join(hop, "b", "left").join(hop2, "m1", "left").select("a", F.coalesce("m2", "m1", "b").alias("b"), F.col("m1").isNotNull().alias("moved"))
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        own = F.struct("a", F.col("m").alias("b"), "moved")
        other = F.struct(F.col("b").alias("a"), F.col("m").alias("b"), (F.col("b") != F.col("m")).alias("moved"))
        met = large.join(lowest, "a").select(F.explode(F.array(own, other)).alias("e")).select("e.*")
        then = materialize(met.where("a <> b").groupBy("a", "b").agg(F.max("moved").alias("moved")))
        release(now)
        now = then
        if not now.agg(F.max("moved")).first()[0]:
            break
    else:
        raise RuntimeError("components did not settle")
    found = now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
    if known is None:
        return found
    again = known.join(found.select(F.col("node").alias("component"), F.col("component").alias("then")), "component", "left").select("node", F.coalesce("then", "component").alias("component"))
    return again.unionByName(found.join(known, "node", "left_anti"))

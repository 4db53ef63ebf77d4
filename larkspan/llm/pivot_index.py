"""Embedding near-dedup by a pivot-permutation index.

Reference points (pivots) are a bounded sample of the vectors, no two of them close. A vector is described by its ``NEAREST`` nearest pivots,
nearest first; each pivot has an inverted list of the vectors it is near to. Two vectors are candidates if their
descriptions share ``SHARED`` pivots at least: the lists are intersected by grouping vectors on each choice of
``SHARED`` of their pivots. Candidates are verified by cosine in double precision.

Equal vectors collapse to one with a weight first. Groups are dealt in blocks of ``BLOCK`` vectors and every pair of
blocks is one unit of work that returns, for each vector, the weight it links to and its component within the unit;
a pair that shares several choices is counted where the choice is that of its least shared pivots. So no pair is
written out, whatever the size of a group.

Vectors that are null, zero, empty, or hold null or non-finite components link with nothing; nor do vectors of different
lengths. Recall is that of the candidates: links are exact, some may be missing. A null id has a null component. Rows of
one id with different vectors are vectors of their own that share an id; rows alike in both count as copies of each other.
Cosines equal to the threshold link. Vectors of any length are worked on whole.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspan.llm.common import components, materialize, mix, release

NEAREST, SHARED = 6, 2
#: Pivots at least and at most; between, twice the square root of the vectors.
PIVOTS = (64, 4096)
BLOCK = 256
#: Classes of equal vectors up to which they are broadcast (about 40 MB).
BROADCAST_IDS = 1_000_000
#: Cosine that two pivots stay below.
APART = 0.7


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        col = b.column("embedding")
        n = b.num_rows
        if not n:
            continue
        off = col.offsets.to_numpy().astype(np.int64)
        flat = col.values.cast(pa.float64()).fill_null(np.nan).to_numpy()
        valid = np.asarray(col.is_valid())
        raw, ok, k1, k2, dim = [], [], [], [], []
        for i in range(n):
            v = flat[off[i] : off[i + 1]] + 0.0  # no negative zeros
            good = bool(valid[i] and len(v) and np.isfinite(v).all() and np.any(v))
            if good:
                v = v / np.abs(v).max()  # no overflow of squares
                good = bool(np.any(v)) and np.isfinite(v).all()
            bits = v.view(np.uint64) if good else np.zeros(0, np.uint64)
            place = mix(np.arange(len(bits), dtype=np.uint64))
            ok.append(good)
            k1.append(mix(bits + place).sum(dtype=np.uint64))
            k2.append(mix(bits ^ (place * np.uint64(3))).sum(dtype=np.uint64))
            raw.append((v / np.sqrt((v * v).sum())).tobytes() if good else None)
            dim.append(len(v))
        sign = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
        yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(ok), sign(k1), sign(k2), pa.array(dim, pa.int32()), pa.array(raw, pa.binary())], ["vec_id", "ok", "k1", "k2", "dim", "vec"])


def _keys(pivots: np.ndarray):
    """(key, id, weight, dim, description, vector) of each choice of shared pivots."""
    m = min(NEAREST, len(pivots))
    s = min(SHARED, m)
    choices = np.array(list(itertools.combinations(range(m), s)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in range(0, b.num_rows, 2000):
                some = b.slice(part, 2000)
                x = np.zeros((some.num_rows, pivots.shape[1]))
                for i, v in enumerate(some.column("vec").to_pylist()):
                    v = np.frombuffer(v)
                    x[i, : len(v)] = v
                near = np.argsort(-(x @ pivots.T), axis=1, kind="stable")[:, :m]
                key = np.zeros((len(near), len(choices)), np.uint64)
                ordered = np.sort(near, axis=1)
                for j in range(s):
                    key = mix(key + ordered[:, choices[:, j]].astype(np.uint64))
                yield pa.RecordBatch.from_arrays([some.column("uid"), pa.array([x.astype("<i2").tobytes() for x in near], pa.binary()), pa.array(list(key.view(np.int64)), pa.list_(pa.int64()))], ["uid", "near", "keys"])

    return run


def _units(threshold: float):
    """From rows in order of (key, i, j): id, weight linked to, and component within each unit."""

    def unit(rows: list[dict], first: int, second: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ids = np.array([r["uid"] for r in rows], np.int64)
        weight = np.array([r["weight"] for r in rows], np.int64)
        own = np.array([r["own"] for r in rows], np.int64)
        dim = np.array([r["dim"] for r in rows], np.int64)
        x = np.zeros((len(rows), dim.max()))
        for i, r in enumerate(rows):
            x[i, : dim[i]] = np.frombuffer(r["vec"])
        near = np.array([np.frombuffer(r["near"], "<i2") for r in rows]).astype(np.int64)
        link = (x @ x.T >= threshold) & (dim[:, None] == dim[None])
        link &= own[:, None] != own[None] if first != second else ~np.eye(len(rows), dtype=bool)
        if link.any():
            choice = rows[0]["choice"]
            top = max(choice)
            # a shared pivot below the choice's largest, not in it: the pair belongs to another choice
            spare = np.where((near < top) & ~np.isin(near, choice), near, -1)
            for a in range(spare.shape[1]):
                for c in range(spare.shape[1]):
                    link &= ~((spare[:, a][:, None] == spare[:, c][None]) & (spare[:, a] >= 0)[:, None])
        some = link.any(axis=1)
        if not some.any():
            return ids[:0], ids[:0], ids[:0]
        label = ids.copy()
        while True:
            least = np.minimum(label, np.where(link, label[None], np.iinfo(np.int64).max).min(axis=1))
            if (least == label).all():
                break
            label = least
        return ids[some], (link @ weight)[some], label[some]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        out: list[tuple] = []
        at = None

        def finish() -> None:
            if len(rows) > 1:
                out.append(unit(rows, at[1], at[2]))

        def table() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[k] for x in out])) for k in range(3)], ["id", "links", "label"])

        for b in batches:
            for r in b.to_pylist():
                now = (r["key"], r["i"], r["j"])
                if now != at:
                    finish()
                    rows, at = [], now
                    if len(out) > 1000:
                        yield table()
                        out = []
                rows.append(r)
        finish()
        if out:
            yield table()

    return run


def spread(drawn: np.ndarray, count: int) -> np.ndarray:
    """Up to ``count`` rows with cosines below ``APART`` among them; a group of near copies gives one pivot."""
    taken = [0]
    for i in range(1, len(drawn)):
        if len(taken) == count:
            break
        if (drawn[taken] @ drawn[i]).max() < APART:
            taken.append(i)
    return drawn[taken]


def near_duplicates(vectors: DataFrame, threshold: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row a vector: ``vec_id``, ``n_links``, ``component_id``, ``kept``."""
    source = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("embedding"))
    rows = materialize(source.mapInArrow(_vectors, "vec_id long, ok boolean, k1 long, k2 long, dim int, vec binary"))
    good = rows.where("ok and vec_id is not null")
    classes = materialize(good.groupBy("k1", "k2", "dim").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("weight"), F.first("vec").alias("vec")).withColumn("uid", F.monotonically_increasing_id()))
    n = classes.count()
    alone = lambda df: df.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
    if not n:
        return alone(rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    width = classes.agg(F.max("dim")).first()[0]
    count = int(min(PIVOTS[1], max(PIVOTS[0], 2 * n**0.5)))
    # twice as many are drawn, the same for any layout; of those close to each other only the first serves
    sample = classes.orderBy(F.xxhash64("k1", "k2"), "rep").limit(2 * count).select("vec").collect()
    drawn = np.zeros((len(sample), width))
    for i, r in enumerate(sample):
        v = np.frombuffer(r[0])
        drawn[i, : len(v)] = v
    pivots = spread(drawn, count)
    described = materialize(classes.select("uid", "vec").mapInArrow(_keys(pivots), "uid long, near binary, keys array<long>"))
    listed = described.select("uid", F.posexplode("keys").alias("c", "key"))
    groups = listed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    m = min(NEAREST, len(pivots))
    choices = list(itertools.combinations(range(m), min(SHARED, m)))
    dealt = listed.join(groups, "key").withColumn("own", F.pmod(F.xxhash64("uid"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "c", "uid")
    dealt = dealt.join(classes.select("uid", "weight", "dim", "vec").join(described.select("uid", "near"), "uid"), "uid")

    def with_choice(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def marked() -> Iterator[pa.RecordBatch]:
            for b in batches:
                picks = [sorted(np.sort(np.frombuffer(x, "<i2"))[list(choices[c])].tolist()) for x, c in zip(b.column("near").to_pylist(), b.column("c").to_pylist(), strict=True)]
                yield b.append_column("choice", pa.array(picks, pa.list_(pa.int64())))

        yield from _units(threshold)(marked())

    found = dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(with_choice, "id long, links long, label long")
    found = materialize(found)
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    comp = materialize(components(found.select(F.col("id").alias("a"), F.col("label").alias("b"))))
    # the smallest id of each component, from one row for each of its vectors
    least = comp.join(classes.select(F.col("uid").alias("node"), "rep"), "node").groupBy("component").agg(F.min("rep").alias("component_id"))
    own = comp.join(least, "component").select("node", "component_id")
    by_class = classes.join(links, F.col("uid") == F.col("id"), "left").join(own, F.col("uid") == F.col("node"), "left").select("k1", "k2", "dim", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component_id", "rep").alias("component_id"))
    by_class = materialize(by_class)
    by_class = F.broadcast(by_class) if n <= BROADCAST_IDS else by_class
    release(found, described, comp)
    linked = good.select("vec_id", "k1", "k2", "dim").join(by_class, ["k1", "k2", "dim"]).select("vec_id", "n_links", "component_id")
    rest = rows.where("not ok or vec_id is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return alone(linked.unionByName(rest))

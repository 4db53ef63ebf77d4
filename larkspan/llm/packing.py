"""Best-fit packing with certified bin counts.

Documents become token ids and an end mark; those over the capacity are cut into pieces of the capacity, the first piece
taking the remainder. Full pieces are sequences of their own. The others are dealt by a hash to partitions of about
``PER_PART`` pieces, each packed by best-fit decreasing. Lower bounds from dual-feasible functions over the histogram of
lengths certify each partition: where bins equal the bound, nothing can be saved in it. Partitions with a gap give up
all pieces that are not in full bins; these are dealt anew, in partitions of the same size, and packed again. A last
exchange does the same with what is left open everywhere, as long as the total exceeds the bound of the total.

Only ids, lengths and checksums move; a partition's pieces are bounded by ``PER_PART`` in expectation, and the histogram
on the driver has one number per length. Null text is empty: its document is the end mark alone. Rows with equal or null
ids are documents of their own, dealt by a number of their own. Of pieces of one length the lesser id comes first.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspan.llm.common import chunks, materialize, release
from larkspan.llm.pair_bpe import byte_letters

CAPACITY = 1024
END = 2
#: Pieces that one task packs, about.
PER_PART = 40_000
EXCHANGES = 3


class Tokens:
    """Ids as the tokenizers library gives them for a byte-level file; a faster library of the same merges does the
    work where both are known to cut texts alike."""

    def __init__(self, path: str):
        import regex
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        back = {c: b for b, c in enumerate(byte_letters())}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(back[c] for c in k): v for k, v in spec["model"]["vocab"].items() if k not in self.special}
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.fast = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens=self.special)
        self.allowed = set(self.special)
        self.slow = Tokenizer.from_file(path)
        # scripts whose letters all Unicode versions agree on, and no run that recursion could choke on
        self.unsure = regex.compile("[^\\x00-\\u024f\\u2000-\\u206f\\u20a0-\\u20b5]|\\s{2000}|\\S{5000}")

    def ids(self, text: str) -> list[int]:
        if self.unsure.search(text):
            return self.slow.encode(text, add_special_tokens=False).ids
        if "<|" in text:
            return self.fast.encode(text, allowed_special=self.allowed, disallowed_special=())
        return self.fast.encode_ordinary(text)


def pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end: int = END, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``piece``, ``start``, ``length``, ``ids_crc32``, and ``ord`` that tells rows of equal ids apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens(vocabulary)
        for b in chunks(batches):
            out: tuple[list, ...] = ([], [], [], [], [])
            for i, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                ids = tokens.ids(t) if t else []
                ids.append(end)
                raw = memoryview(np.array(ids, "<u4").tobytes())
                n = len(ids)
                first = n % capacity or capacity
                edges = [0, *range(first, n + 1, capacity)]
                for k, (s, e) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
                    for col, x in zip(out, (i, k, s, e - s, zlib.crc32(raw[4 * s : 4 * e])), strict=True):
                        col.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), *(pa.array(x, pa.int64()) for x in out[2:])], ["doc_id", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def lower_bound(histogram: np.ndarray) -> int:
    """Bins that any packing needs: the best of two families of dual-feasible functions. ``histogram[s]``: items of size s."""
    cap = len(histogram) - 1
    size = np.arange(cap + 1)
    count, mass = np.cumsum(histogram), np.cumsum(histogram * size)
    total, volume = int(count[-1]), int(mass[-1])
    best = -(-volume // cap)
    half = cap // 2
    over_half = total - int(count[half])
    for k in range(1, half + 1):
        # over cap - k counts as a whole bin, below k as nothing
        large = total - int(count[cap - k])
        middle_n, middle = over_half - large, int(mass[cap - k] - mass[half])
        small = int(mass[half] - mass[k - 1])
        best = max(best, large + middle_n + max(0, -(-(small - (middle_n * cap - middle)) // cap)))
    for p in range(1, 41):
        # x where (p + 1) x is whole in units of the capacity, else rounded down to a multiple of 1 / p
        scaled = (p + 1) * size
        value = np.where(scaled % cap == 0, size * p, scaled // cap * cap)
        best = max(best, -(-int((value * histogram).sum()) // (p * cap)))
    return best


def best_fit_decreasing(length: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin of each item, its offset there, and the room left in each bin."""
    order = np.argsort(-length, kind="stable")
    where, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, room = 0, []
    for i, s in zip(order.tolist(), length[order].tolist(), strict=True):
        fits = mask >> s
        if fits:
            r = s + (fits & -fits).bit_length() - 1
            k = open_bins[r].pop()
            if not open_bins[r]:
                mask ^= 1 << r
        else:
            r, k = capacity, len(room)
            room.append(capacity)
        where[i], offset[i] = k, capacity - r
        left = r - s
        room[k] = left
        if left:
            open_bins[left].append(k)
            mask |= 1 << left
    return where, offset, np.array(room, np.int64)


_PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, item long, bin long, offset long, room long, gap long"


def _pack(capacity: int):
    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "doc_id", "piece", "start", "ids_crc32", "item"], kind="stable")
        length = group["length"].to_numpy()
        where, offset, room = best_fit_decreasing(length, capacity)
        bound = lower_bound(np.bincount(length, minlength=capacity + 1))
        # a bin is known by its first item
        first, item = np.zeros(len(room), np.int64), group["item"].to_numpy()
        first[where[offset == 0]] = item[offset == 0]
        return group.assign(bin=first[where], offset=offset, room=room[where], gap=len(room) - bound)

    return run


def pack(items: DataFrame, capacity: int = CAPACITY, per_part: int = PER_PART) -> DataFrame:
    """The rows of :func:`pieces` with ``sequence_id`` and ``offset``."""
    cols = ["doc_id", "piece", "start", "length", "ids_crc32"]
    # a number for each piece, so that neither equal rows nor null ids gather in one partition
    items = materialize(items.select(*cols).withColumn("item", F.monotonically_increasing_id()))
    full = items.where(F.col("length") == capacity)
    rest = items.where(F.col("length") < capacity)
    histogram = np.zeros(capacity + 1, np.int64)
    for r in rest.groupBy("length").count().collect():
        histogram[r[0]] = r[1]
    n, least = int(histogram.sum()), lower_bound(histogram)

    def dealt(rows: DataFrame, count: int, salt: int) -> DataFrame:
        parts = max(1, round(count / per_part))
        key = F.pmod(F.xxhash64("item", F.lit(salt)), F.lit(parts))
        return materialize(rows.groupBy(key.alias("part")).applyInPandas(_pack(capacity), _PACKED))

    bins = lambda rows: rows.where("offset = 0").count()
    moved = [*cols, "item"]
    # tables of packed rows, of which a filter names those that are still valid
    held: list[DataFrame] = [dealt(rest.select(*moved), n, 0)] if n else []
    for salt in range(1, EXCHANGES + 1):
        if not held or sum(bins(d) for d in held) <= least:
            break
        last = salt == EXCHANGES
        open_ = (F.col("room") > 0) & (F.lit(True) if last else F.col("gap") > 0)
        # at last also what certified partitions have left open
        sources = held if last else held[-1:]
        again = sources[0].where(open_).select(*moved)
        for d in sources[1:]:
            again = again.unionByName(d.where(open_).select(*moved))
        count = again.count()
        if not count:
            continue
        tried = dealt(again, count, salt)
        if bins(tried) < sum(bins(d.where(open_)) for d in sources):
            held = [*held[: len(held) - len(sources)], *(d.where(~open_) for d in sources), tried]
        else:
            release(tried)
    # full pieces have odd numbers, bins even ones, from the number of their first item
    whole = full.select(*cols, F.lit(0).cast("long").alias("offset"), (F.col("item") * 2 + 1).alias("sequence_id"))
    for d in held:
        whole = whole.unionByName(d.select(*cols, "offset", (F.col("bin") * 2).alias("sequence_id")))
    return whole.select(*cols, "sequence_id", "offset")


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end: int = END, per_part: int = PER_PART) -> DataFrame:
    return pack(pieces(docs, vocabulary, capacity, end), capacity, per_part)

"""Document fingerprints from prefix polynomial hashes.

For two primes below 2**31, the array of prefix sums of ``(code point + 1) * base**position`` answers the hash of any span
in constant time; divided by ``base**start`` it is the same wherever and in whichever text the span stands. Equality
of spans, and by binary search the longest common extension of two positions, follow from it. A fingerprint is the hash
of the whole text with the ``KEEP`` least (mixed) hashes of its spans of ``WINDOW`` code points, a bottom sketch, as a
hexadecimal string: equal texts have equal fingerprints, and likeness is twice the shared part of the spans over the
sum of both, estimated from two fingerprints alone.

:func:`edited` also pairs each document with the next by descending id, without gathering ids in one task: bounds are
quantiles of the ids, the document at each bound also goes to the piece before, and pieces are sorted one by one.

Null text counts as empty. Rows with a null id come after all others; if no id is known every row's next is the next
text of one piece, the last's is itself. Equal ids follow each other in order of text. In a table of one row it is its own
next. Only the two named columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspan.llm.common import chunks, mix

PRIMES = (2147483647, 2147483629)
BASES = (911382323, 972663749)
WINDOW = 12
KEEP = 64
#: Code points that are hashed together; a longer text by itself.
CHUNK_POINTS = 1_000_000
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of base ``k`` and of its inverse, 0..n, by doubling."""
    if k not in _POWERS or len(_POWERS[k][0]) <= n:
        p, size = PRIMES[k], max(n + 1, 1 << 20)
        both = []
        for b in (BASES[k], pow(BASES[k], -1, PRIMES[k])):
            a, m = np.ones(size, np.uint64), 1
            while m < size:
                to = min(m, size - m)
                a[m : m + to] = a[:to] * np.uint64(pow(b, m, p)) % np.uint64(p)
                m *= 2
            both.append(a)
        _POWERS[k] = tuple(both)
    return _POWERS[k]


class Prefixes:
    """Prefix arrays of code points."""

    def __init__(self, points: np.ndarray):
        self.n = len(points)
        self.sums = []
        for k, p in enumerate(PRIMES):
            up, _ = _powers(self.n, k)
            sums = np.zeros(self.n + 1, np.uint64)
            np.cumsum((points.astype(np.uint64) + np.uint64(1)) * up[: self.n] % np.uint64(p), out=sums[1:])
            self.sums.append(sums)  # below 2**32 terms don't overflow 64 bits

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A number below 2**62 for each span: the same for equal spans of any text."""
        out = []
        for k, p in enumerate(PRIMES):
            _, down = _powers(self.n, k)
            out.append((self.sums[k][end] - self.sums[k][start]) % np.uint64(p) * down[start] % np.uint64(p))
        return (out[0] << np.uint64(31)) | out[1]

    def windows(self, width: int) -> np.ndarray:
        """:meth:`spans` of every position that has ``width`` code points from it on."""
        m = max(0, self.n - width + 1)
        out = []
        for k, p in enumerate(PRIMES):
            _, down = _powers(self.n, k)
            out.append((self.sums[k][width : width + m] - self.sums[k][:m]) % np.uint64(p) * down[:m] % np.uint64(p))
        return (out[0] << np.uint64(31)) | out[1]


def common_extension(x: Prefixes, i: np.ndarray, x_end: np.ndarray, y: Prefixes, j: np.ndarray, y_end: np.ndarray) -> np.ndarray:
    """Length of the longest common extension of each pair of positions, within the ends, by binary search."""
    low = np.zeros(len(i), np.int64)
    high = np.minimum(x_end - i, y_end - j)
    while (low < high).any():
        mid = (low + high + 1) // 2
        same = x.spans(i, i + mid) == y.spans(j, j + mid)
        low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
    return low


def sketches(points: np.ndarray, off: np.ndarray, prefix: Prefixes) -> list[tuple[int, int, np.ndarray]]:
    """Of each text: its length, the hash of the whole, and its least distinct span hashes in order."""
    size = np.diff(off)
    whole = mix(prefix.spans(off[:-1], off[1:]) + size.astype(np.uint64))
    span = mix(prefix.windows(WINDOW))
    out = []
    for i, (a, n) in enumerate(zip(off[:-1].tolist(), size.tolist(), strict=True)):
        if n < WINDOW:
            least = whole[i : i + 1] if n else np.zeros(0, np.uint64)
        else:
            own = span[a : a + n - WINDOW + 1]
            some = own
            if len(own) > 8 * KEEP:
                some = own[own < np.uint64(int(2**64 * (3 * KEEP / len(own))))]
            least = np.unique(some)
            if len(least) < KEEP and len(some) < len(own):
                least = np.unique(own)
            least = least[:KEEP]
        out.append((n, int(whole[i]), least))
    return out


def text_of(sketch: tuple[int, int, np.ndarray]) -> str:
    n, whole, least = sketch
    return f"{n:x}:{whole:016x}:{least.astype('>u8').tobytes().hex()}"


def parse(fingerprint: str) -> tuple[int, int, np.ndarray]:
    n, whole, least = fingerprint.split(":")
    return int(n, 16), int(whole, 16), np.frombuffer(bytes.fromhex(least), ">u8").astype(np.uint64)


def likeness(a: tuple[int, int, np.ndarray], b: tuple[int, int, np.ndarray]) -> float:
    """0 to 1; of equal texts 1. Two texts without spans are alike only if both are empty."""
    if a[:2] == b[:2]:
        return 1.0
    x, y = a[2], b[2]
    if not len(x) or not len(y):
        return 0.0
    # a sketch that isn't full has all spans of its text
    size = KEEP if len(x) == KEEP or len(y) == KEEP else len(x) + len(y)
    union = np.union1d(x, y)[:size]
    shared = len(np.intersect1d(np.intersect1d(x, y, assume_unique=True), union, assume_unique=True))
    j = shared / len(union)
    return min(2 * j / (1 + j), 1 - 2**-20)


def _points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    off = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=off[1:])
    return np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32), off


def compare(texts: list[str]) -> dict[str, list]:
    """Of each text but the last, with the next: its fingerprint and that of its edited text, and how alike they are."""
    edits = []
    for t, following in zip(texts[:-1], texts[1:], strict=True):
        half = len(t) // 2
        edits.append(t[: len(t) - half] + following[:half])
    points, off = _points(texts)
    prefix = Prefixes(points)
    own = sketches(points, off, prefix)
    other, off2 = _points(edits)
    prefix2 = Prefixes(other)
    changed = sketches(other, off2, prefix2)
    out: dict[str, list] = {c: [] for c in ("n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")}
    for i, e in enumerate(edits):
        out["n_chars"].append(len(texts[i]))
        out["edited_sha256"].append(hashlib.sha256(e.encode()).hexdigest())
        out["fingerprint"].append(text_of(own[i]))
        out["edited_fingerprint"].append(text_of(changed[i]))
        out["near_edited"].append(likeness(own[i], changed[i]))
        out["near_next"].append(likeness(own[i], own[i + 1]))
    out["common_prefix"] = common_extension(prefix, off[:-2], off[1:-1], prefix2, off2[:-1], off2[1:]).tolist() if edits else []
    return out


_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, common_prefix long"


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``fingerprint`` of each row: a narrow plan without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, limit=CHUNK_POINTS):
            points, off = _points([x or "" for x in b.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([text_of(s) for s in sketches(points, off, Prefixes(points))], pa.string())], ["doc_id", "fingerprint"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, fingerprint string")


def edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", pieces: int | None = None) -> DataFrame:
    """Each row with its fingerprint, that of its edited text, and likeness to that and to the next document."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    pieces = pieces or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    at = [i / pieces for i in range(1, pieces)]
    top, quantiles = rows.agg(F.max("doc_id"), F.percentile_approx("doc_id", at, 100_000)).first() if pieces > 1 else (rows.agg(F.max("doc_id")).first()[0], [])
    # descending ids that begin a piece; the first is the largest of all
    bounds = sorted({top, *(quantiles or [])}, reverse=True) if top is not None else []
    upper = np.array(bounds[::-1], np.int64)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(upper)
        for b in batches:
            ids = b.column("doc_id").fill_null(-(2**63)).to_numpy()
            known = np.asarray(b.column("doc_id").is_valid())
            piece = np.where(known, n - 1 - np.searchsorted(upper, ids, "left"), max(0, n - 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(piece), pa.array(np.zeros(len(piece), bool)), b.column("doc_id"), b.column("text")], ["piece", "tail", "doc_id", "text"])
            first = np.flatnonzero(known & np.isin(ids, upper)) if n else np.zeros(0, np.int64)
            if len(first):
                some = b.take(pa.array(first))
                yield pa.RecordBatch.from_arrays([pa.array(((piece[first] - 1) % n).astype(np.int32)), pa.array(np.ones(len(first), bool)), some.column("doc_id"), some.column("text")], ["piece", "tail", "doc_id", "text"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(ids: list, texts: list[str]) -> pa.RecordBatch:
            found = {"doc_id": ids} | compare(texts)
            return pa.RecordBatch.from_arrays([pa.array(found[f], t) for f, t in (("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("common_prefix", pa.int64()))], names=[x.split()[0] for x in _SCHEMA.split(", ")])

        ids: list = []
        texts: list[str] = []
        of, done, size = None, False, 0
        for b in batches:
            for piece, tail, i, t in zip(b.column("piece").to_pylist(), b.column("tail").to_pylist(), b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                t = t or ""
                if piece != of:
                    if ids:  # no id is known: the last row is its own next
                        yield emit(ids, [*texts, texts[-1]])
                    ids, texts, of, done, size = [], [], piece, False, 0
                if done:
                    continue  # further rows with the id of a bound
                if tail:
                    done = True
                    if ids:
                        yield emit(ids, [*texts, t])
                    ids, texts = [], []
                    continue
                if ids and size + len(t) > CHUNK_POINTS:
                    yield emit(ids, [*texts, t])
                    ids, texts, size = [], [], 0
                ids.append(i)
                texts.append(t)
                size += len(t)
        if ids:
            yield emit(ids, [*texts, texts[-1]])

    dealt = rows.mapInArrow(deal, "piece int, tail boolean, doc_id long, text string")
    return dealt.repartition("piece").sortWithinPartitions("piece", "tail", F.desc_nulls_last("doc_id"), "text").mapInArrow(run, _SCHEMA)

"""Quality classifier by Bradley-Terry pairwise ranking.

Every text becomes a vector of dense statistics of its bytes, words and lines. Pairs of a preferred and a rejected
labelled document give feature differences; weights minimise the logistic loss on them plus a ridge term. The decision
point is a quantile of the scores of the fitted rows: the share of them that is rejected. Scores are mapped to (0, 1) by a
logistic curve that takes the decision point to ``cut`` exactly.

The model is fitted on all labelled rows that are not held out, and on all pairs of a preferred and a rejected one of them.
No pair is a row: the loss of a pair follows from its two scores, so each Newton step sums the vectors of either label by
fine cells of the score (:class:`Sums`), task by task, and the cells of one label meet those of the other
(:func:`newton`). Only such sums come to the driver, whose size does not depend on the number of rows. Quantiles are
narrowed by counts over all scores until they are settled to 1e-9. All rows are scored.

Null and empty texts have the vector of an empty text and a score like any other. Rows with a null id are scored, not
learned from. Without rows of both labels every score is 0.5.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspan.llm.common import chunks, materialize, release, text_arrays, words
from larkspan.llm.langid import held_out

#: Cells of the score in which vectors are summed, and their products; steps that a quantile is narrowed by at a time.
CELLS, WIDE, STEPS = 1024, 64, 4096
#: Parts in which sums of tasks are added up.
PARTS = 8
#: Labelled ids up to which they are broadcast (16 MB).
BROADCAST_IDS = 1_000_000
#: Where the decision point lies on the scale of scores.
CUT = 0.7
_RIDGE = 1e-3

_CLASS = np.zeros(256, np.uint8)  # 0: symbols and control characters
_CLASS[97:123] = 1  # a-z
_CLASS[65:91] = 2  # A-Z
_CLASS[48:58] = 3
_CLASS[[9, 11, 12, 13, 32]] = 4
_CLASS[10] = 5
_CLASS[[33, 63]] = 6  # ! ?
_CLASS[[46, 44, 59, 58, 39, 34, 45]] = 7  # . , ; : ' " -
_CLASS[128:192] = 8  # later bytes of a character
_CLASS[192:] = 9
_CLASS[[124]] = 10  # |
_CLASS[[35, 36, 37, 38, 42]] = 11  # # $ % & *
_CLASSES = 12


def features(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A row of statistics for each text."""
    rows = len(off) - 1
    size = np.diff(off)
    kind = _CLASS[data]
    row = np.repeat(np.arange(rows), size)
    counts = np.bincount(row * _CLASSES + kind, minlength=rows * _CLASSES).reshape(rows, _CLASSES).astype(float)
    chars = size - counts[:, 8]
    share = counts / np.maximum(chars, 1)[:, None]
    of, start, end, h = words(data, off, lower=False)
    n = np.bincount(of, minlength=rows).astype(float)
    some = np.maximum(n, 1)
    each = lambda x: np.bincount(of, weights=x, minlength=rows) / some
    length = (end - start).astype(float)
    caps = np.zeros(len(kind) + 1, np.int64)
    np.cumsum(kind == 2, out=caps[1:])
    alpha = np.zeros(len(kind) + 1, np.int64)
    np.cumsum((kind == 1) | (kind == 2) | (kind >= 8) & (kind <= 9), out=alpha[1:])
    upper = (caps[end] - caps[start] >= 2) & (alpha[end] - alpha[start] - caps[end] + caps[start] <= 0.3 * length)
    none = alpha[end] == alpha[start]
    last = kind[end - 1] if len(end) else np.zeros(0, np.uint8)
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (of[1:] == of[:-1])
    order = np.lexsort((h, of))
    new = np.ones(len(h), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (of[order][1:] != of[order][:-1])
    distinct = np.bincount(of[order][new], minlength=rows)
    # of texts of random words, the share of distinct words falls about as a power of their number
    variety = distinct / some * some**0.15
    lines = counts[:, 5] + 1
    return np.column_stack(
        [
            share[:, [0, 2, 3, 4, 5, 6, 7, 10, 11]],
            np.sqrt(share[:, [0, 2, 3, 6, 10, 11]]),
            each(length) / 10,
            np.sqrt(np.maximum(each(length**2) - each(length) ** 2, 0)) / 10,
            each(upper),
            each(none),
            each((last == 0) | (last == 11) | (last == 10)),
            each(last == 6),
            each(same),
            np.sqrt(each(same)),
            variety,
            np.minimum(variety, 0.5),
            np.log1p(n) / 10,
            (n < 5).astype(float),
            np.log1p(n / lines) / 10,
        ]
    )


class Ranker:
    """Weights of standardised features, and the decision point."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, weight: np.ndarray, point: float, cut: float = CUT):
        self.mean, self.scale, self.weight, self.point, self.cut = mean, scale, weight, point, cut

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8) @ self.weight

    def score(self, x: np.ndarray) -> np.ndarray:
        at = self.raw(x) - self.point + np.log(self.cut / (1 - self.cut))
        return 1 / (1 + np.exp(-np.clip(at, -500, 500)))


class Sums:
    """Of rows of either label, by cells of the score: their number and the sum of their vectors; by fewer, wider cells the sum
    of their products.

    Cells lie between -``reach`` and ``reach``, finest at 0. A row counts for the two edges next to its score, in proportion to
    its place between them. The products only steer the steps; the numbers and sums decide where they end.
    """

    def __init__(self, width: int, reach: float):
        self.edge = np.sinh(np.linspace(-np.arcsinh(reach), np.arcsinh(reach), CELLS + 1))
        self.n = np.zeros((2, CELLS + 1))
        self.x = np.zeros((2, CELLS + 1, width))
        self.xx = np.zeros((2, WIDE, width, width))

    def add(self, z: np.ndarray, good: np.ndarray, s: np.ndarray) -> None:
        low = np.clip(np.searchsorted(self.edge, s, "right") - 1, 0, CELLS - 1)
        part = np.clip((s - self.edge[low]) / (self.edge[low + 1] - self.edge[low]), 0, 1)
        order = np.lexsort((low, good))
        z, good, low, part = z[order], good[order], low[order], part[order]
        first = np.flatnonzero(np.append(True, (np.diff(low) != 0) | (np.diff(good) != 0))) if len(low) else low
        for beside, share in ((0, 1 - part), (1, part)) if len(low) else ():
            at = (good[first], low[first] + beside)
            self.n[at] += np.add.reduceat(share, first)
            self.x[at] += np.add.reduceat(z * share[:, None], first)
        wide = low * WIDE // CELLS + good * WIDE
        for rows in np.split(np.arange(len(z)), np.flatnonzero(np.diff(wide)) + 1) if len(z) else ():
            self.xx[divmod(wide[rows[0]], WIDE)] += z[rows].T @ z[rows]

    def values(self) -> np.ndarray:
        return np.concatenate([self.n.ravel(), self.x.ravel(), self.xx.ravel()])

    def take(self, values: np.ndarray) -> Sums:
        for a, v in zip((self.n, self.x, self.xx), np.split(values, np.cumsum([self.n.size, self.x.size])), strict=True):
            a[:] = v.reshape(a.shape)
        return self


def newton(sums: Sums, w: np.ndarray) -> np.ndarray:
    """The step of log(1 + exp(-w.(good - bad))) over all pairs, plus ridge, at the scores of the cells."""
    at = sums.edge
    p = 1 / (1 + np.exp(np.clip(at[:, None] - at[None, :], -500, 500)))  # preferred in rows, rejected in columns
    (bad, good), pairs = sums.n, sums.n[0].sum() * sums.n[1].sum()
    grad = -((p @ bad) @ sums.x[1] - (good @ p) @ sums.x[0]) / pairs + _RIDGE * w
    h = p * (1 - p)
    mid = (np.arange(WIDE) * CELLS + CELLS // 2) // WIDE
    cross = sums.x[1].T @ h @ sums.x[0]
    hess = np.tensordot((h @ bad)[mid], sums.xx[1], 1) + np.tensordot((good @ h)[mid], sums.xx[0], 1) - cross - cross.T
    return np.linalg.solve(hess / pairs + _RIDGE * np.eye(len(w)), grad)


def _vectors(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            x = features(*text_arrays(b.column("text")))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([v.tobytes() for v in x], pa.binary())], ["doc_id", "x"])

    return docs.mapInArrow(run, "doc_id long, x binary")


def _arrays(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of the rows, and whether their label is 1."""
    good = batch.column("good").to_numpy(zero_copy_only=False).astype(np.int64)
    return np.frombuffer(b"".join(batch.column("x").to_pylist())).reshape(len(good), -1), good


def _summed(rows: DataFrame, of: Callable[[Iterator[tuple[np.ndarray, np.ndarray]]], np.ndarray | None]) -> np.ndarray | None:
    """Arrays that ``of`` makes of the vectors and labels of each task, added up in parts."""

    def lots(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        held: list = []
        for b in batches:
            if b.num_rows:
                held.append(_arrays(b))
            if sum(len(g) for _, g in held) >= 8192:
                yield tuple(np.concatenate(c) for c in zip(*held, strict=True))
                held = []
        if held:
            yield tuple(np.concatenate(c) for c in zip(*held, strict=True))

    def table(parts: dict[int, np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(parts), pa.int32()), pa.array([v.tobytes() for v in parts.values()], pa.binary())], ["part", "sums"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = of(lots(batches))
        if found is not None:
            yield table(dict(enumerate(np.array_split(found, PARTS))))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for part, raw in zip(b.column("part").to_pylist(), b.column("sums").to_pylist(), strict=True):
                sums[part] = sums[part] + np.frombuffer(raw) if part in sums else np.frombuffer(raw)
        yield table(sums)

    schema = "part int, sums binary"
    found = rows.mapInArrow(run, schema).repartition(PARTS, "part").mapInArrow(add, schema).collect()
    return np.concatenate([np.frombuffer(bytes(r["sums"])) for r in sorted(found, key=lambda r: r["part"])]) if found else None


def _quantiles(rows: DataFrame, raw: Callable[[np.ndarray], np.ndarray], low: float, high: float, ranks: list[int]) -> list[float]:
    """The scores of these ranks, from counts in ever narrower spans."""
    spans = {k: (low, high, k) for k in ranks}  # the rank within the span
    while max(hi - lo for lo, hi, _ in spans.values()) > 1e-9:
        now = list(spans.values())

        def count(parts: Iterator[tuple[np.ndarray, np.ndarray]], now: list = now) -> np.ndarray:
            n = np.zeros((len(now), STEPS))
            for x, _ in parts:
                s = raw(x)
                for i, (lo, hi, _) in enumerate(now):
                    inside = s[(s >= lo) & (s < hi)]
                    if hi > lo:
                        n[i] += np.bincount(np.minimum(((inside - lo) / (hi - lo) * STEPS).astype(np.int64), STEPS - 1), minlength=STEPS)
            return n.ravel()

        counts = _summed(rows, count).reshape(len(now), STEPS)
        for i, k in enumerate(list(spans)):
            lo, hi, rank = spans[k]
            upto = np.cumsum(counts[i])
            cell = int(np.searchsorted(upto, rank, "right"))
            if cell >= STEPS:  # rounding at an edge
                spans[k] = (hi, hi, 0)
                continue
            step = (hi - lo) / STEPS
            spans[k] = (lo + cell * step, lo + (cell + 1) * step, rank - int(upto[cell - 1] if cell else 0))
    return [sum(spans[k][:2]) / 2 for k in ranks]


def fit_rows(rows: DataFrame, cut: float = CUT) -> Ranker | None:
    """The ranker of all rows (``x``, the bytes of a vector, and ``good``); None if they don't have both labels."""

    def moments(parts: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray | None:
        own = [np.array([len(x), good.sum(), *x.sum(axis=0)], float) for x, good in parts]
        return sum(own) if own else None

    found = _summed(rows, moments)
    if found is None:
        return None
    total, liked = int(found[0]), int(found[1])
    if not 0 < liked < total:
        return None
    mean = found[2:] / total

    def spread(parts: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        return sum((((x - mean) ** 2).sum(axis=0) for x, _ in parts), np.zeros(len(mean)))

    scale = np.sqrt(_summed(rows, spread) / total)
    scale = np.where(scale > 1e-9, scale, 1)
    w = np.zeros(len(mean))
    for _ in range(40):
        # scores of clipped vectors are within this
        most = 8 * np.abs(w).sum() + 1

        def cells(parts: Iterator[tuple[np.ndarray, np.ndarray]], w: np.ndarray = w, most: float = most) -> np.ndarray:
            own = Sums(len(w), most)
            for x, good in parts:
                z = np.clip((x - mean) / scale, -8, 8)
                own.add(z, good, z @ w)
            return own.values()

        step = newton(Sums(len(w), most).take(_summed(rows, cells)), w)
        w = w - step
        if np.abs(step).max() < 1e-4:
            break
    ranker = Ranker(mean, scale, w, 0.0, cut)
    most = 8 * np.abs(w).sum() + 1
    at = [share * (total - 1) for share in (max(0, 1 - liked / total - 0.002), min(1, 1 - liked / total + 0.002))]
    ranks = sorted({int(f(q)) for q in at for f in (np.floor, np.ceil)})
    score = dict(zip(ranks, _quantiles(rows, ranker.raw, -most, most, ranks), strict=True))
    between = [score[int(np.floor(q))] + (score[int(np.ceil(q))] - score[int(np.floor(q))]) * (q - np.floor(q)) for q in at]
    ranker.point = float(sum(between)) / 2
    return ranker


def fit(docs: DataFrame, labels: DataFrame, cut: float = CUT, hold: bool = True) -> Ranker | None:
    """From all labelled documents; with ``hold`` all that are not held out."""
    known = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.min("quality") == 1).alias("good"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")
    if hold:
        known, rows = known.where(~held_out("doc_id")), rows.where(~held_out("doc_id"))
    known = materialize(known)
    if known.count() <= BROADCAST_IDS:
        found = _vectors(rows.join(F.broadcast(known.select("doc_id")), "doc_id", "left_semi")).join(F.broadcast(known), "doc_id")
    else:  # vectors travel, not texts
        found = _vectors(rows).join(known, "doc_id")
    found = materialize(found.select("x", "good"))
    ranker = fit_rows(found, cut)
    release(known, found)
    return ranker


def scored(docs: DataFrame, ranker: Ranker | None, keep: list[str] | None = None, score: str = "score") -> DataFrame:
    """``doc_id`` and the score of each row; or the columns ``keep`` and the score."""
    keep = keep or ["doc_id"]
    rows = docs.select(*keep, *([] if "text" in keep else ["text"]))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in keep) + f", `{score}` double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            x = features(*text_arrays(b.column("text")))
            s = ranker.score(x) if ranker else np.full(b.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(s)], [*keep, score])

    return rows.mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, cut: float = CUT) -> DataFrame:
    """``doc_id``, ``held_out``, ``score``, ``predicted`` for each document."""
    out = scored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), fit(docs, labels, cut))
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))

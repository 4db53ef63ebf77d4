"""Language identification: multinomial naive Bayes over hashed character n-grams.

Letters are folded to lower case, every run of other characters is one boundary mark, and the n-grams of one to three
marks within a text are hashed to ``FEATURES`` buckets. Counts by language come from a sample of the labelled rows
(``fit_rows`` of them on average, drawn by a hash of the id, so the same rows whatever the layout); the log-probability
matrix is ``FEATURES`` by languages and is broadcast (a megabyte for four). A batch of texts is scored as a sparse
matrix in compressed rows whose entries are the n-gram occurrences: their matrix rows are gathered and summed by text.

A null text or one without a letter is ``und`` with score 0; so is every text if no row has a language. A null id counts
as not held out and is not learned from.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspan.llm.common import chunks, text_arrays

FEATURES = 1 << 16
#: Labelled rows that the model is fitted on, about.
FIT_ROWS = 20_000
_SMOOTH = 0.5
_KEYS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def _tables() -> np.ndarray:
    """For each code point below 65536 its lower case if that is one such letter, itself if a letter, else 0."""
    out = np.zeros(65536, np.uint32)
    for i in range(65536):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            out[i] = ord(low) if len(low) == 1 and ord(low) < 65536 else i
    return out


_FOLD: list[np.ndarray] = []


def code_points(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all rows end to end, and the offsets of the rows among them."""
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    lead = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=lead[1:])
    return points, lead[off]


def grams(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed n-grams: feature of each occurrence in order of row, offsets by row, and whether the row has a letter."""
    if not _FOLD:
        _FOLD.append(_tables())
    points, at = code_points(data, off)
    rows = len(off) - 1
    mark = _FOLD[0][np.minimum(points, 65535)]
    high = points > 65535
    if high.any():
        some, back = np.unique(points[high], return_inverse=True)
        mark[high] = np.where([chr(c).isalpha() for c in some], some, 0)[back]
    row = np.repeat(np.arange(rows), np.diff(at))
    keep = np.ones(len(mark), bool)
    keep[1:] = (mark[1:] != 0) | (mark[:-1] != 0) | (row[1:] != row[:-1])
    mark, row = mark[keep].astype(np.uint64), row[keep]
    letters = np.bincount(row[mark != 0], minlength=rows) > 0
    feats, of = [], []
    for n in (1, 2, 3):
        if len(mark) < n:
            break
        m = len(mark) - n + 1
        h = np.full(m, n, np.uint64)
        for i in range(n):
            h += mark[i : i + m] * _KEYS[i]
            h ^= h >> np.uint64(29)
            h *= np.uint64(0xBF58476D1CE4E5B9)
        ok = (row[:m] == row[n - 1 :]) & letters[row[:m]]
        if n == 1:
            ok &= mark != 0
        feats.append((h[ok] >> np.uint64(48)).astype(np.int32))
        of.append(row[:m][ok])
    if not feats:
        return np.zeros(0, np.int32), np.zeros(rows + 1, np.int64), letters
    offsets = np.zeros(rows + 1, np.int64)
    np.cumsum(sum(np.bincount(x, minlength=rows) for x in of), out=offsets[1:])
    out = np.empty(offsets[-1], np.int32)
    base = offsets[:-1].copy()
    for f, r in zip(feats, of, strict=True):
        count = np.bincount(r, minlength=rows)
        first = np.cumsum(count) - count
        out[np.arange(len(r)) - first[r] + base[r]] = f
        base += count
    return out, offsets, letters


def held_out(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, id_col: str, text_col: str, lang_col: str, fit_rows: int = FIT_ROWS) -> tuple[list[str], np.ndarray]:
    """Languages in order, and the matrix of log probabilities, its last row the log priors."""
    labelled = docs.where(f"`{id_col}` is not null and `{text_col}` is not null and `{lang_col}` is not null").where(~held_out(id_col))
    sizes = {r[0]: r[1] for r in labelled.groupBy(lang_col).count().collect()}
    langs, total = sorted(sizes), sum(sizes.values())
    if not langs:
        return [], np.zeros((FEATURES + 1, 0), np.float32)
    share = min(1.0, fit_rows / total)
    sample = labelled.where(F.pmod(F.xxhash64(F.col(id_col), F.lit("fit")), F.lit(1_000_000)) < F.lit(int(share * 1_000_000) + 1)).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(langs), FEATURES), np.int64)
        for b in chunks(batches):
            f, off, _ = grams(*text_arrays(b.column("text")))
            lang = np.array([langs.index(x) for x in b.column("lang").to_pylist()], np.int64)
            sums += np.bincount(np.repeat(lang, np.diff(off)) * FEATURES + f, minlength=sums.size).reshape(sums.shape)
        k, f = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(f, pa.int32()), pa.array(sums[k, f])], ["k", "f", "n"])

    counts = sample.mapInArrow(count, "k int, f int, n long").groupBy("k", "f").agg(F.sum("n").alias("n")).toPandas()
    matrix = np.full((FEATURES, len(langs)), _SMOOTH)
    matrix[counts["f"].to_numpy(), counts["k"].to_numpy()] += counts["n"].to_numpy()
    logs = np.log(matrix) - np.log(matrix.sum(axis=0))
    prior = np.log(np.array([sizes[x] for x in langs]) / total)
    return langs, np.vstack([logs, prior]).astype(np.float32)


def predict(docs: DataFrame, langs: list[str], matrix: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``held_out``, ``lang_pred``, ``score`` (the posterior probability) for each row."""
    shared = docs.sparkSession.sparkContext.broadcast(matrix)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logs = shared.value
        for b in chunks(batches):
            f, off, letters = grams(*text_arrays(b.column("text")))
            rows = b.num_rows
            total = np.zeros((rows, max(1, len(langs))))
            known = letters & (np.diff(off) > 0) & bool(langs)
            if known.any():
                # rows without entries have no start of their own, so sums between the starts of the others are exact
                total[known] = np.add.reduceat(logs[f], off[:-1][known], axis=0, dtype=np.float64) + logs[-1]
            best = total.argmax(axis=1)
            score = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
            names = np.array([*langs, "und"], object)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(names[np.where(known, best, len(langs))], pa.string()), pa.array(np.where(known, score, 0.0))], ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", fit_rows: int = FIT_ROWS) -> DataFrame:
    return predict(docs, *fit(docs, id_col, text_col, lang_col, fit_rows), id_col, text_col)

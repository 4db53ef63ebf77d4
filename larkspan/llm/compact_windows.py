"""Substring dedup by compact windows.

Tokens are shingles of ``SHINGLE`` words. For each of several hash functions, the Cartesian tree over a document's token
hashes has a node for every token that is the least of some stretch; nodes that span at least ``width`` tokens are the
compact windows (:func:`compact_windows`), and all subsequences of ``width`` tokens whose least hash is that node's form one
interval of start positions (:func:`intervals`). The intervals of the hash functions of a band are joined
(:func:`signature_runs`); every piece of that join stands for subsequences that share one signature, the tuple of least
hashes. Pieces of different
documents with equal signatures in any of the ``BANDS`` have met in enough hash functions, and become candidate passages, which are extended and
verified: the shared part of both, on distinct shingles, must have Jaccard similarity of ``similarity`` at least. An
exactly repeated passage of ``width`` tokens always shares every signature; a near copy shares one somewhere along its
length with a probability that grows with its length.

Documents whose word sequences are equal collapse to one text first, and come back as members of its class. Occurrences of
a signature meet one leader, the text of the least id: within a task before anything is shuffled, so that a very common
signature travels once a task and not once a document, then across tasks. So links grow with the rows. Where a leader and a
member are not alike, the stretches around all occurrences of signatures that more than one class has are compared again,
each with those of every other class, without a bound on classes or members: a prefix filter over their shingles
(:func:`_sharing`) leaves out only pairs that share too few shingles to be alike.

Documents with fewer words than a passage, null texts and null ids have no passages and no rows. Rows of one id and
different texts are texts of their own; what they share is listed with ``other_id`` equal to ``doc_id``. Rows alike in id
and text count once. Long texts are worked on whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspan.llm.common import CHUNK_BYTES, as_signed, chunks, components, give_back, materialize, mix, release, shingles, text_arrays, words

SHINGLE = 5
#: Bands of min-hashes, and hashes in each; one equal band makes a candidate. A single window of Jaccard similarity 0.8
#: has one with probability 1 - (1 - 0.8 ** 3) ** 4 = 0.94.
BANDS, HASHES = 4, 3
#: Words that a passage has at least.
PASSAGE = 50
#: Ids up to which they are broadcast (8 MB).
BROADCAST_IDS = 1_000_000
#: Pieces of texts left to compare that make a block (a power of two), and those that meet a block in one task.
BLOCK, LOT = 64, 250
#: Occurrences that a task looks at together for leaders, before the shuffle.
TOGETHER = 500_000
#: Occurrences that are looked at together for leaders after it.
GATHERED = 20_000


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` neighbours, from those of powers of two."""
    if len(x) < width:
        return x[:0]
    span = 1
    while 2 * span <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    rest = width - span
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def compact_windows(x: np.ndarray, of: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Left, centre and right, inclusive, of the nodes of each row's Cartesian tree that span ``width`` tokens or more.

    ``of`` has the row of each token. Equal tokens share their span. Ancestors of a wide node are wide, so its span ends next
    to wide nodes, which are found by jumps from one to the next smaller.
    """
    n = len(x)
    if n < width:
        none = np.zeros(0, np.int64)
        return none, none, none
    x = x | np.uint64(1)
    least = np.where(of[: n - width + 1] == of[width - 1 :], sliding_least(x, width), np.uint64(0))
    # the greatest of the least hashes around a token is its own where it is the least of some stretch
    pad = np.zeros(width - 1, np.uint64)
    top = ~sliding_least(~np.concatenate([pad, least, pad]), width)
    centre = np.flatnonzero(x == top)
    value, row = x[centre], of[centre]
    m = len(centre)
    sides = []
    for turn in (1, -1):
        v, r = value[::turn], row[::turn]
        before = np.arange(m) - 1
        live = np.arange(m)
        while len(live):
            at = before[live]
            live = live[(at >= 0) & (r[at] == r[live]) & (v[at] >= v[live])]
            before[live] = before[before[live]]
        inside = (before >= 0) & (r[before] == r)
        sides.append((before[::turn], inside[::turn]))
    first, last = np.searchsorted(of, row, "left"), np.searchsorted(of, row, "right") - 1
    (below, has), (after, has2) = sides
    left = np.where(has, centre[below] + 1, first)
    right = np.where(has2, centre[np.minimum(m - 1 - after, m - 1)] - 1, last)
    return left, centre, right


def intervals(x: np.ndarray, of: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First start, end (exclusive) and least hash of each interval of starts whose ``width`` tokens have one least token."""
    left, centre, right = compact_windows(x, of, width)
    start, end = np.maximum(left, centre - width + 1), np.minimum(centre, right - width + 1) + 1
    order = np.argsort(start, kind="stable")
    start, end, value, row = start[order], end[order], x[centre[order]], of[centre[order]]
    if not len(start):
        return start, end, value
    # equal tokens near each other are the least of the same starts
    new = np.ones(len(start), bool)
    new[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1]) | (start[1:] > end[:-1])
    at = np.flatnonzero(new)
    return start[at], np.maximum.reduceat(end, at), value[at]


def signature_runs(row: np.ndarray, token: np.ndarray, width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each band: signature, first token and number of starts of every piece on which the intervals of the band's hash
    functions meet."""
    for band in range(BANDS):
        found = [intervals(mix(token ^ mix(np.full(1, 1 + band * HASHES + h, np.uint64))), row, width) for h in range(HASHES)]
        start = np.unique(np.concatenate([f[0] for f in found]))
        end = np.append(start[1:], np.iinfo(np.int64).max)
        sig = np.full(len(start), band, np.uint64)
        for first, stop, value in found:
            at = np.searchsorted(first, start, "right") - 1
            sig = mix(sig + value[at])
            end = np.minimum(end, stop[at])
        yield sig, start, end - start


def _keyed(passage: int, text: bool):
    """``words``, ``key1``, ``key2`` of each text of a passage's words at least, and the text itself where asked for."""
    names = ["doc_id", "words", "key1", "key2", *(["text"] if text else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            row, _, _, w = words(*text_arrays(b.column("text")))
            n = np.bincount(row, minlength=b.num_rows)
            first = np.cumsum(n) - n
            place = np.arange(len(w)) - first[row]
            keys = []
            for salt in (1, 2):
                sums = np.zeros(len(w) + 1, np.uint64)
                np.cumsum(mix(w + mix(place.astype(np.uint64) * np.uint64(2) + np.uint64(salt << 40))), out=sums[1:])
                keys.append(as_signed(sums[first + n] - sums[first]))
            out = pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), *(pa.array(k) for k in keys), *([b.column("text")] if text else [])], names)
            yield out.filter(pa.array(n >= passage))

    return run


#: An occurrence has ``b`` null and its stretch in ``a_start``, ``a_end``; else a candidate pair with ``a`` below ``b``.
_CANDIDATE = "sig long, a long, b long, a_start int, a_end int, b_start int, b_end int"
_NAMES = [c.split()[0] for c in _CANDIDATE.split(", ")]


def _paired(sig, a, b, a_start, a_end, b_start, b_end) -> pa.RecordBatch:
    swap = a > b
    pick = lambda x, y: pa.array(np.where(swap, y, x).astype(x.dtype))
    return pa.RecordBatch.from_arrays([pa.array(sig), pick(a, b), pick(b, a), pick(a_start, b_start), pick(a_end, b_end), pick(b_start, a_start), pick(b_end, a_end)], _NAMES)


def _led(sig: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Of rows in order of ``sig``, the first row of the least text in each row's group."""
    new = np.ones(len(sig), bool)
    new[1:] = sig[1:] != sig[:-1]
    group, first = np.cumsum(new) - 1, np.flatnonzero(new)
    if not len(first):
        return first
    at = np.flatnonzero(doc == np.minimum.reduceat(doc, first)[group])
    return at[np.searchsorted(group[at], np.arange(len(first)))][group]


def _windows(shingle: int, passage: int):
    """Of each task: one occurrence of each signature, and candidate pairs of the others with it."""
    width = passage - shingle + 1

    def together(rows: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        sig, doc, start, end = (np.concatenate([r[k] for r in rows]) for k in range(4))
        order = np.argsort(sig, kind="stable")
        sig, doc, start, end = sig[order], doc[order], start[order], end[order]
        lead = _led(sig, doc)
        k = np.flatnonzero(lead == np.arange(len(sig)))
        none = pa.nulls(len(k), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(sig[k]), pa.array(doc[k]), pa.nulls(len(k), pa.int64()), pa.array(start[k]), pa.array(end[k]), none, none], _NAMES)
        k = np.flatnonzero(doc != doc[lead])
        if len(k):
            p = lead[k]
            yield _paired(sig[k], doc[p], doc[k], start[p], end[p], start[k], end[k])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[np.ndarray, ...]] = []
        for b in chunks(batches):
            row, _, _, w = words(*text_arrays(b.column("text")))
            first = np.searchsorted(row, np.arange(b.num_rows))
            at, token = shingles(row, w, shingle)
            of = row[at]
            ids = b.column("uid").to_numpy()
            for sig, start, size in signature_runs(of, token, width):
                r = of[start]
                begin = (at[start] - first[r]).astype(np.int32)
                rows.append((as_signed(sig), ids[r], begin, (begin + size - 1 + passage).astype(np.int32)))
            if sum(len(r[0]) for r in rows) > TOGETHER:
                yield from together(rows)
                rows = []
        if rows:
            yield from together(rows)
        del rows
        give_back()

    return run


def _leaders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows in order of signature, pairs among them (in any place): pairs as they are, and each occurrence against that of
    the least text of its signature. A signature has one occurrence a task of :func:`_windows`, or a few."""

    def led(sig: np.ndarray, doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> Iterator[pa.RecordBatch]:
        lead = _led(sig, doc)
        k = np.flatnonzero(doc != doc[lead])
        if len(k):
            p = lead[k]
            yield _paired(sig[k], doc[p], doc[k], start[p], end[p], start[k], end[k])

    held: list[tuple[np.ndarray, ...]] = []
    n, full = 0, GATHERED
    for b in batches:
        if b.column("b").null_count < b.num_rows:
            pair = b.column("b").is_valid()
            yield b.filter(pair)
            b = b.filter(pa.compute.invert(pair))
        held.append(tuple(b.column(c).to_numpy() for c in _NAMES if c in ("sig", "a", "a_start", "a_end")))
        n += b.num_rows
        if n >= full:
            rows = tuple(np.concatenate(c) for c in zip(*held, strict=True))
            # the last signature may go on
            cut = int(np.searchsorted(rows[0], rows[0][-1], "left"))
            yield from led(*(c[:cut] for c in rows))
            held, n = [tuple(c[cut:] for c in rows)], n - cut
            full = max(GATHERED, 2 * n)
    if n:
        yield from led(*(np.concatenate(c) for c in zip(*held, strict=True)))


def _slices(shingle: int, margin: int):
    """Word hashes of the wanted stretches of each document, a margin on both sides included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            row, _, _, w = words(*text_arrays(b.column("text")))
            cut = np.searchsorted(row, np.arange(b.num_rows + 1))
            out: tuple[list, ...] = ([], [], [], [])
            for i, wanted in enumerate(b.column("wanted").to_pylist()):
                own = w[cut[i] : cut[i + 1]]
                for x in wanted:
                    s, e = max(0, x["s"] - margin), min(len(own), x["e"] + margin)
                    for col, v in zip(out, (x["pair"], x["side"], s, own[s:e].tobytes()), strict=True):
                        col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int32()), pa.array(out[3], pa.binary())], ["pair", "side", "first", "raw"])

    return run


def _pieces(margin: int):
    """Word hashes of the wanted stretches of each text, a margin on both sides included; those that touch are one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            row, _, _, w = words(*text_arrays(b.column("text")))
            cut = np.searchsorted(row, np.arange(b.num_rows + 1))
            out: tuple[list, ...] = ([], [], [], [], [])
            for i, (uid, comp, wanted) in enumerate(zip(*(b.column(c).to_pylist() for c in ("uid", "comp", "wanted")), strict=True)):
                own = w[cut[i] : cut[i + 1]]
                spans: list[list[int]] = []
                for s, e in sorted((max(0, x["s"] - margin), min(len(own), x["e"] + margin)) for x in wanted):
                    if spans and s <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], e)
                    else:
                        spans.append([s, e])
                for s, e in spans:
                    for col, v in zip(out, (uid, comp, s, e, own[s:e].tobytes()), strict=True):
                        col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int32()), pa.array(out[3], pa.int32()), pa.array(out[4], pa.binary())], ["uid", "comp", "s", "e", "raw"])

    return run


def _contents(shingle: int):
    """Distinct shingles of each piece, and how often each stands there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, raw in enumerate(b.column("raw")):
                w = np.frombuffer(raw.as_buffer(), np.uint64)
                h, n = np.unique(shingles(np.zeros(len(w), np.int64), w, shingle)[1], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(as_signed(h)), *(pa.array(np.full(len(h), b.column(c)[i].as_py())) for c in ("piece", "uid", "comp")), pa.array(n)], ["h", "piece", "uid", "comp", "times"])

    return run


def _tokens(raw: list[np.ndarray], shingle: int) -> list[np.ndarray]:
    """Shingles of each text's words; short texts are worked on together."""
    out: list[np.ndarray] = []
    size = np.array([len(x) for x in raw], np.int64)
    till = np.cumsum(size)
    while len(out) < len(raw):
        i = len(out)
        j = max(i + 1, int(np.searchsorted(till, till[i] - size[i] + CHUNK_BYTES // 8, "right")))
        row = np.repeat(np.arange(j - i), size[i:j])
        at, h = shingles(row, np.concatenate(raw[i:j]), shingle)
        out += np.split(h, np.searchsorted(row[at], np.arange(1, j - i)))
    return out


def _met(shingle: int, passage: int, similarity: float):
    """Passages that pieces (``asks`` 1) have with those of later texts of other classes in a block."""
    width = passage - shingle + 1
    least = fewest(width, similarity)

    def run(table: pa.Table) -> pa.Table:
        uid, comp, first, asks = (table.column(c).to_numpy() for c in ("uid", "comp", "s", "asks"))
        tokens = _tokens([np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("raw")], shingle)
        block = np.flatnonzero(asks == 0)
        kinds = [np.unique(tokens[i], return_index=True) for i in block]
        h, owner = np.concatenate([*(k for k, _ in kinds), np.zeros(0, np.uint64)]), np.repeat(np.arange(len(block)), [len(k) for k, _ in kinds])
        size = np.array([len(tokens[i]) for i in block])
        plain = np.array([len(k) for k, _ in kinds]) == size
        kinds_least = np.array([least_distinct(tokens[i], width) for i in block])
        order = h.argsort(kind="stable")
        place = np.concatenate([*(at for _, at in kinds), np.zeros(0, np.int64)])[order]
        h, owner = h[order], owner[order]
        out: tuple[list, ...] = ([], [], [], [], [], [], [])
        for x in np.flatnonzero(asks == 1).tolist():
            t = tokens[x]
            if len(t) < width:
                continue
            low, high = np.searchsorted(h, t, "left"), np.searchsorted(h, t, "right")
            n = high - low
            at = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
            some = (np.bincount(owner[at], minlength=len(block)) >= least) & (uid[block] > uid[x]) & (comp[block] != comp[x])
            if not some.any():
                continue
            spot = np.repeat(np.arange(len(t)), n)
            one = np.unique(t, return_index=True)[1]
            once = np.zeros(len(t), bool)
            once[one] = True
            # alike stretches have no more distinct shingles than those that both texts have allow
            some &= np.bincount(owner[at[once[spot]]], minlength=len(block)) >= similarity * np.maximum(kinds_least, width if len(one) == len(t) else least_distinct(t, width)) - 1e-6
            if not some.any():
                continue
            k = some[owner[at]]
            at, spot = at[k], spot[k]
            if len(one) == len(t):
                # without repeats, the hits of an alike stretch stand on two neighbouring lanes
                lanes = (len(t) + int(size.max())) // (2 * _DRIFT + 1) + 3
                lane = (place[at] - spot + len(t)) // (2 * _DRIFT + 1) + 1
                count = np.bincount(owner[at] * lanes + lane, minlength=len(block) * lanes).reshape(-1, lanes)
                good = np.zeros(count.shape, bool)
                good[:, 1:] = count[:, 1:] + count[:, :-1] >= least
                good[:, :-1] |= good[:, 1:]
                k = good[owner[at], lane] | ~plain[owner[at]]
                at, spot = at[k], spot[k]
            # some neighbours are nearly all hits
            rows = np.flatnonzero(some)
            hits = np.zeros((len(rows), len(t)), bool)
            hits[(np.cumsum(some) - 1)[owner[at]], spot] = True
            rows = rows[alike_somewhere(hits, width, similarity)]
            for y in block[rows].tolist():
                for a0, a1, b0, b1, j in shared_stretches(t, tokens[y], shingle, passage, similarity):
                    for col, v in zip(out, (uid[x], uid[y], first[x] + a0, first[x] + a1, first[y] + b0, first[y] + b1, j), strict=True):
                        col.append(v)
        del h, owner, place, order, kinds, tokens
        give_back()
        return pa.table([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), *(pa.array(c, pa.int32()) for c in out[2:6]), pa.array(out[6], pa.float64())], ["a", "b", "a_start", "a_end", "b_start", "b_end", "similarity"])

    return run


def _sharing(pieces: DataFrame, shingle: int, passage: int, similarity: float) -> DataFrame:
    """Passages that pieces of different classes share, that of the lesser text as ``a``.

    Pieces, in order of class, are dealt in blocks of ``BLOCK``, and each comes once to every block that can have one alike, so
    that no row is a pair. A prefix filter tells which: shingles that stand in one class alone join nothing; of the others in
    a piece the most frequent are left out, up to one place fewer than an alike stretch shares, so that such a pair shares one
    of the rest.
    """
    least = fewest(passage - shingle + 1, similarity)
    block = F.shiftright("piece", BLOCK.bit_length() - 1)
    rows = materialize(pieces.mapInArrow(_contents(shingle), "h long, piece long, uid long, comp long, times long").withColumn("block", block))
    # of each shingle, the blocks that have it, with the classes and the last text there
    there = rows.groupBy("h", "block").agg(F.count(F.lit(1)).alias("n"), F.min("comp").alias("low"), F.max("comp").alias("high"), F.max("uid").alias("last"))
    kinds = there.groupBy("h").agg(F.sum("n").alias("n"), F.min("low").alias("least"), F.max("high").alias("most"), F.collect_list(F.struct("block", "low", "high", "last")).alias("blocks")).where("least <> most")
    kinds = materialize(kinds.select("h", "n", "blocks"))
    before = Window.partitionBy("piece").orderBy(F.desc("n"), "h").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = rows.join(_small(kinds.select("h", "n")), "h").withColumn("places", F.sum("times").over(before)).where(F.col("places") >= least)
    met = met.select("h", "piece", "uid", "comp").join(_small(kinds.select("h", "blocks")), "h")
    wanted = F.filter("blocks", lambda b: (b["last"] > F.col("uid")) & ((b["low"] != F.col("comp")) | (b["high"] != F.col("comp"))))
    met = met.select("piece", F.transform(wanted, lambda b: b["block"]).alias("blocks")).groupBy("piece").agg(F.array_distinct(F.flatten(F.collect_list("blocks"))).alias("blocks"))
    asks = materialize(met.select("piece", F.explode("blocks").alias("block")))
    # of a block that many pieces come to, each lot of them meets a copy
    lots = materialize(asks.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / LOT).cast("int").alias("lots")))
    known = _small(lots)
    own = pieces.withColumn("block", block).join(known, "block").select("block", F.explode(F.sequence(F.lit(0), F.col("lots") - 1)).alias("lot"), "uid", "comp", "s", "raw", F.lit(0).alias("asks"))
    come = asks.join(known, "block").select("block", F.pmod(F.xxhash64("piece"), "lots").cast("int").alias("lot"), "piece").join(pieces, "piece").select("block", "lot", "uid", "comp", "s", "raw", F.lit(1).alias("asks"))
    out = materialize(own.unionByName(come).groupBy("block", "lot").applyInArrow(_met(shingle, passage, similarity), "a long, b long, a_start int, a_end int, b_start int, b_end int, similarity double"))
    release(rows, kinds, asks, lots)
    return out


def shared_passages(x: np.ndarray, y: np.ndarray, shingle: int, passage: int, similarity: float) -> list[tuple[int, int, int, int, float]]:
    """Stretches of words of x and y (start, end of each) that are alike, and the Jaccard similarity of their distinct
    shingles; stretches of one text on one diagonal don't overlap.

    Diagonals (place in y less place in x) are taken by the shared shingles on and near them, most first.
    """
    return shared_stretches(*_tokens([x, y], shingle), shingle, passage, similarity)


def shared_stretches(p: np.ndarray, q: np.ndarray, shingle: int, passage: int, similarity: float) -> list[tuple[int, int, int, int, float]]:
    """:func:`shared_passages` of texts with these shingles."""
    width = passage - shingle + 1
    if min(len(p), len(q)) < width:
        return []
    plain = _one_run(p, q)
    if plain is not None:
        lo, hi, shift = plain
        if hi - lo < fewest(width, similarity):
            return []
        if hi - lo >= width:
            return [(lo, hi + shingle - 1, lo + shift, hi + shift + shingle - 1, 1.0)]
    value, code = np.unique(np.concatenate([p, q]), return_inverse=True)
    cp, cq = code[: len(p)], code[len(p) :]
    if not alike_somewhere((np.bincount(cq, minlength=len(value))[cp] > 0)[None], width, similarity)[0]:
        return []
    stride = len(p) + len(q) + 64
    first_p, first_q = np.sort(cp * stride + np.arange(len(p))), np.sort(cq * stride + np.arange(len(q)))
    # the k-th place of a shingle in x meets its k-th in y
    place = np.searchsorted(first_p, cp * stride + np.arange(len(p))) - np.searchsorted(first_p, cp * stride)
    low, high = np.searchsorted(first_q, cp * stride), np.searchsorted(first_q, (cp + 1) * stride)
    live = high > low
    at = first_q[np.minimum(low + np.minimum(place, np.maximum(high - low - 1, 0)), len(first_q) - 1)] % stride
    lane = (at - np.arange(len(p)) + len(p)) // _DRIFT
    out = []
    while live.any():
        count = np.bincount(lane[live])
        both = count + np.append(count[1:], 0)
        k = int(both.argmax())
        if both[k] < _FEW:
            return out
        mine = live & ((lane == k) | (lane == k + 1))
        shift = int(np.median(at[mine] - np.flatnonzero(mine)))
        # the place of each shingle of x nearest above the lower edge of the diagonal's band
        from_ = np.maximum(np.arange(len(p)) + shift - _DRIFT, 0)
        spot = np.minimum(np.searchsorted(first_q, cp * stride + from_), len(first_q) - 1)
        found = first_q[spot]
        there = found % stride
        straight = np.arange(len(p)) + shift
        same = (straight >= 0) & (straight < len(q)) & (cq[np.clip(straight, 0, len(q) - 1)] == cp)
        found, there = np.where(same, cp * stride + straight, found), np.where(same, straight, there)
        hit = (found // stride == cp) & (np.abs(there - np.arange(len(p)) - shift) <= _DRIFT)
        for lo, hi in _alike(hit, width, similarity):
            best = _fitted(cp, cq, hit, there, shift, lo, hi, width, similarity)
            if best:
                a0, a1, b0, b1, j = best
                out.append((a0, a1 + shingle - 1, b0, b1 + shingle - 1, j))
        live &= ~mine
    return out


def fewest(width: int, similarity: float) -> int:
    """Shingles of x that stand in y as well, at least, where a stretch of ``width`` is alike: each miss in :func:`_alike` takes
    so many hits."""
    miss = 2 * similarity / (1 - similarity)
    return int(np.ceil(width * miss / (1 + miss) - 1e-6))


def alike_somewhere(hit: np.ndarray, width: int, similarity: float) -> np.ndarray:
    """Of each row of ``hit``, whether :func:`_alike` finds a stretch in it, or in it with more hits."""
    total = np.zeros((len(hit), hit.shape[1] + 1))
    np.cumsum(np.where(hit, 1.0, -2 * similarity / (1 - similarity)), axis=1, out=total[:, 1:])
    return (np.minimum.accumulate(total[:, : max(0, total.shape[1] - width)], axis=1) <= total[:, width:] + 1e-6).any(axis=1)


def least_distinct(token: np.ndarray, width: int) -> int:
    """Distinct shingles, at least, of any ``width`` neighbours or more; 0 where there are fewer."""
    n = len(token)
    if n < width:
        return 0
    order = token.argsort(kind="stable")
    again = np.flatnonzero(token[order[1:]] == token[order[:-1]])
    if not len(again):
        return width
    # of the two places of a repeat, every window with both has one distinct shingle fewer
    first, second = order[again], order[again + 1]
    low, high = np.maximum(0, second - width + 1), np.minimum(first, n - width)
    k = low <= high
    fewer = np.zeros(n - width + 2, np.int64)
    np.add.at(fewer, low[k], 1)
    np.subtract.at(fewer, high[k] + 1, 1)
    return width - int(np.cumsum(fewer)[: n - width + 1].max())


def _one_run(p: np.ndarray, q: np.ndarray) -> tuple[int, int, int] | None:
    """Where neither side repeats a shingle and all shared ones are one run on one diagonal, or there are none: its ends in p
    and its shift. None otherwise."""
    both = np.concatenate([p, q])
    order = both.argsort(kind="stable")
    value = both[order]
    k = np.flatnonzero(value[1:] == value[:-1])
    one, two = order[k], order[k + 1] - len(p)
    if (one >= len(p)).any() or (two < 0).any():
        return None
    if not len(one):
        return 0, 0, 0
    lo, hi, shift = int(one.min()), int(one.max()) + 1, int(two[0] - one[0])
    return (lo, hi, shift) if hi - lo == len(one) and (two - one == shift).all() else None


#: Words that an alignment may drift from its diagonal, and shared shingles that make a diagonal worth a look.
_DRIFT, _FEW = 16, 8


def _alike(hit: np.ndarray, width: int, similarity: float):
    """Longest stretches, apart from each other, in which hits outweigh misses as the similarity asks: n places with m hits
    on both sides have m / (2 n - m)."""
    todo = [(0, len(hit))]
    score = np.where(hit, 1.0, -2 * similarity / (1 - similarity))
    while todo:
        lo, hi = todo.pop()
        if hi - lo < width:
            continue
        total = np.concatenate([[0.0], np.cumsum(score[lo:hi])]) + 1e-9 * np.arange(hi - lo + 1)
        low = np.minimum.accumulate(total)
        # the first start that an end's total is not below
        start = np.searchsorted(-low, -total, "left")
        size = np.arange(hi - lo + 1) - start
        end = int(size.argmax())
        if size[end] < width:
            continue
        a, b = lo + int(start[end]), lo + end
        yield a, b
        todo += [(lo, a), (b, hi)]


def _fitted(cp, cq, hit, there, shift, lo, hi, width, similarity):
    """The stretch without misses at its ends, where that leaves a passage, and trimmed until it is similar enough."""
    for ends in ((0, 1), (1, 0)):
        a0, a1 = lo, hi
        while True:
            for end in ends:
                spots = np.flatnonzero(hit[a0:a1])
                if not len(spots):
                    return None
                if end == 0:
                    a0 = max(a0, min(a0 + int(spots[0]), a1 - width))
                else:
                    a1 = min(a1, max(a0 + int(spots[-1]) + 1, a0 + width))
            spots = a0 + np.flatnonzero(hit[a0:a1])
            b0, b1 = int(there[spots].min()), int(there[spots].max()) + 1
            # missed ends have the same number of places on the other side
            b0, b1 = max(0, b0 - int(spots[0] - a0)), min(len(cq), b1 + int(a1 - 1 - spots[-1]))
            if min(a1 - a0, b1 - b0) < width:
                break
            one, two = np.unique(cp[a0:a1]), np.unique(cq[b0:b1])
            both = len(np.intersect1d(one, two, assume_unique=True))
            j = both / (len(one) + len(two) - both)
            if j >= similarity:
                return a0, a1, b0, b1, j
            # the shorter of the outer runs of hits goes, with the misses next to it
            miss = a0 + np.flatnonzero(~hit[a0:a1])
            if not len(miss) or a1 - a0 <= width:
                break
            if miss[0] - a0 <= a1 - 1 - miss[-1]:
                a0 = min(int(miss[0]) + 1, a1 - width)
            else:
                a1 = max(int(miss[-1]), a0 + width)
    return None


def _verify(shingle: int, passage: int, similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: tuple[list, ...] = ([], [], [], [], [], [])
            x, y = (_tokens([np.frombuffer(v.as_buffer(), np.uint64) for v in b.column(c)], shingle) for c in ("x", "y"))
            for p, q, pair, fa, fb in zip(x, y, *(b.column(c).to_pylist() for c in ("pair", "fa", "fb")), strict=True):
                for found in shared_stretches(p, q, shingle, passage, similarity):
                    for col, v in zip(out, (pair, fa + found[0], fa + found[1], fb + found[2], fb + found[3], found[4]), strict=True):
                        col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), *(pa.array(c, pa.int32()) for c in out[1:5]), pa.array(out[5], pa.float64())], ["pair", "a_start", "a_end", "b_start", "b_end", "similarity"])

    return run


def _small(df: DataFrame) -> DataFrame:
    """A written table, to be broadcast if it is of a size for it."""
    return F.broadcast(df) if df.count() <= BROADCAST_IDS else df


def repeated_passages(docs: DataFrame, passage: int = PASSAGE, similarity: float = 0.8, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``start_word``, ``end_word``, ``other_id``, ``other_start``, ``other_end``, ``similarity``, ``class_id``.

    One row for a passage of a document that another, with a smaller id, has as well; a whole copy is the passage of all
    its words. ``class_id`` is the smallest id among the documents that passages connect.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null")
    keys = ["words", "key1", "key2"]
    profile = materialize(source.mapInArrow(_keyed(passage, False), "doc_id long, words long, key1 long, key2 long"))
    # a number for each text, which ids may not be; in order of ids, so that the least text leads and every later one has a row
    classes = materialize(profile.groupBy(*keys).agg(F.min("doc_id").alias("rep")).orderBy("rep", *keys).withColumn("uid", F.monotonically_increasing_id()))
    small = _small(classes)
    copies = profile.join(small, keys).where("doc_id > rep")

    # an id of one row names its text; of others, the words tell
    several = materialize(source.groupBy("doc_id").count().where("count > 1").select("doc_id"))
    any_several = bool(several.limit(1).count())

    def texts(of: DataFrame) -> DataFrame:
        """``uid`` and ``text`` of some classes."""
        ids = of.select(F.col("rep").alias("doc_id"), "uid")
        if not any_several:
            return source.join(ids, "doc_id").select("uid", "text")
        shared = _small(several)
        rows = source.join(shared, "doc_id", "left_semi").join(_small(materialize(of.select(F.col("rep").alias("doc_id")).distinct())), "doc_id", "left_semi")
        rows = rows.mapInArrow(_keyed(passage, True), "doc_id long, words long, key1 long, key2 long, text string")
        told = rows.join(of, keys).where("doc_id = rep").select("uid", "text")
        return source.join(shared, "doc_id", "left_anti").join(ids, "doc_id").select("uid", "text").unionByName(told)

    def verified(found: DataFrame) -> DataFrame:
        """``a``, ``b`` and stretches of the pairs that are alike."""
        # runs of one pair on the same diagonal, or nearly so, are one candidate
        pairs = found.groupBy("a", "b", F.floor((F.col("a_start") - F.col("b_start")) / 32).alias("lane"), F.floor(F.col("b_start") / 2048).alias("stretch")).agg(F.min("a_start").alias("a_start"), F.max("a_end").alias("a_end"), F.min("b_start").alias("b_start"), F.max("b_end").alias("b_end"))
        pairs = materialize(pairs.withColumn("pair", F.monotonically_increasing_id()))
        side = lambda c, k: pairs.select(F.col(c).alias("uid"), F.col("pair"), F.lit(k).alias("side"), F.col(f"{c}_start").alias("s"), F.col(f"{c}_end").alias("e"))
        sides = side("a", 0).unionByName(side("b", 1))
        # a leader's stretches come in lists of some hundreds, not all in one row
        lots = materialize(sides.groupBy("uid").agg(F.ceil(F.count(F.lit(1)) / 400).alias("lots")))
        few = _small(lots)
        wanted = sides.join(few, "uid").groupBy("uid", F.pmod("pair", "lots").alias("lot")).agg(F.collect_list(F.struct("pair", "side", "s", "e")).alias("wanted"))
        needed = materialize(classes.join(few.select("uid"), "uid", "left_semi"))
        cut = materialize(texts(_small(needed)).join(wanted, "uid").select("text", "wanted").mapInArrow(_slices(shingle, passage), "pair long, side int, first int, raw binary"))
        x, y = cut.where("side = 0").select("pair", F.col("first").alias("fa"), F.col("raw").alias("x")), cut.where("side = 1").select("pair", F.col("first").alias("fb"), F.col("raw").alias("y"))
        passed = x.join(y, "pair").mapInArrow(_verify(shingle, passage, similarity), "pair long, a_start int, a_end int, b_start int, b_end int, similarity double")
        good = materialize(pairs.select("pair", "a", "b").join(passed, "pair").drop("pair"))
        release(pairs, lots, needed, cut)
        return good

    rows = texts(small).mapInArrow(_windows(shingle, passage), _CANDIDATE)
    place = F.when(F.col("b").isNull(), F.col("sig")).otherwise(F.xxhash64("b", "b_start"))
    found = materialize(rows.repartition(place).sortWithinPartitions("sig").mapInArrow(_leaders, _CANDIDATE))
    links = verified(found)
    comp = materialize(components(links.select("a", "b")).select(F.col("node").alias("uid"), "component"))
    known = _small(comp)
    here, there = known.select(F.col("uid").alias("a"), F.col("component").alias("ca")), known.select(F.col("uid").alias("b"), F.col("component").alias("cb"))
    apart = found.join(here, "a", "left").join(there, "b", "left").withColumns({"ca": F.coalesce("ca", "a"), "cb": F.coalesce("cb", "b")})
    mixed = apart.groupBy("sig").agg(F.min(F.least("ca", "cb")).alias("low"), F.max(F.greatest("ca", "cb")).alias("high")).where("low <> high").select("sig")
    # what stands around the occurrences of a signature that more than one class has
    some = apart.join(mixed, "sig", "left_semi")
    at = lambda c: some.select(F.col(c).alias("uid"), F.col(f"c{c}").alias("comp"), F.col(f"{c}_start").alias("s"), F.col(f"{c}_end").alias("e"))
    left = materialize(at("a").unionByName(at("b")).distinct())
    if left.limit(1).count():
        needed = materialize(classes.join(_small(materialize(left.select("uid").distinct())), "uid", "left_semi"))
        wanted = left.groupBy("uid", "comp").agg(F.collect_list(F.struct("s", "e")).alias("wanted"))
        pieces = texts(_small(needed)).join(wanted, "uid").select("uid", "comp", "text", "wanted").mapInArrow(_pieces(2 * passage), "uid long, comp long, s int, e int, raw binary")
        pieces = materialize(pieces.orderBy("comp", "uid", "s").withColumn("piece", F.monotonically_increasing_id()))
        links = links.unionByName(_sharing(pieces, shingle, passage, similarity))
        release(needed, pieces)
    release(comp, left)
    id_of = lambda c, name: small.select(F.col("uid").alias(c), F.col("rep").alias(name))
    linked = links.join(id_of("a", "one"), "a").join(id_of("b", "two"), "b")
    later = F.col("one") <= F.col("two")
    side = lambda x, y: F.when(later, F.col(x)).otherwise(F.col(y))
    linked = linked.select(side("two", "one").alias("doc_id"), side("b_start", "a_start").alias("start_word"), side("b_end", "a_end").alias("end_word"), side("one", "two").alias("other_id"), side("a_start", "b_start").alias("other_start"), side("a_end", "b_end").alias("other_end"), "similarity").distinct()
    whole = F.col("words").cast("int")
    member = copies.select("doc_id", F.lit(0).alias("start_word"), whole.alias("end_word"), F.col("rep").alias("other_id"), F.lit(0).alias("other_start"), whole.alias("other_end"), F.lit(1.0).alias("similarity")).distinct()
    out = materialize(member.unionByName(linked))
    release(found, profile, classes, several)
    comp = materialize(components(out.select(F.col("doc_id").alias("a"), F.col("other_id").alias("b"))).select(F.col("node").alias("doc_id"), F.col("component").alias("class_id")))
    return out.join(_small(comp), "doc_id", "left").withColumn("class_id", F.coalesce("class_id", "doc_id"))

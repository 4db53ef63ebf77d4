"""N-gram Jaccard join by PartEnum signatures.

A document is the set of its distinct word shingles. Two sets with Jaccard similarity of at least ``percent`` / 100
differ in at most ``d`` elements, where ``d`` follows from their sizes. Sizes are cut into bands; for the pairs whose
smaller set is in one band, the element domain is hashed into ``n1`` parts of ``n2`` subparts each, with
``n1 * (k2 + 1) > d``: some part then has at most ``k2`` differences, and the hash of at least one choice of ``n2 - k2``
of its subparts is the same in both sets. Such choices are the signatures; sets that share one are candidates.

Order of work, made for hot groups: equal sets collapse to one representative before anything is joined; a signature
group of up to ``GROUP`` representatives gives all its pairs, a larger one a star around its least member. Candidates
are screened by a sketch of parity bits that never rejects a true pair, then verified on the exact shingle sets: first one pair a
document (a spanning forest), then only pairs that still cross components. Members of each larger group are then dealt
in blocks of ``BLOCK``, two blocks meet in a unit of work, and only pairs that cross components and pass
the screen leave it; in each group the members of its largest component meet only those outside it, so that the work
follows the outsiders. An outsider of several groups with one largest component meets all members of that component in
any larger group, each once and not once a signature; outsiders of one component meet each other so too, or by signature
where that makes fewer pairs. This is done twice: first
each outsider meets the largest component of its widest group
alone and gives one pair in a unit, with the member that its sketch is nearest to; then those still outside meet all
others and give all their pairs. No link that
joins two components is lost.

A choice of subparts that is empty in a set makes a signature that says little and that many sets have, in a group that
grows with the table. So there are ``spare`` more parts than needed: of a similar pair more than ``spare`` parts have few
enough differences, and more still where a set is of a size at which similar sets differ less than the band allows. A
set does without the signatures of empty choices where as many parts remain as a similar pair has to share (``need``): a
choice that both have empty is left out in parts that either of them counts, so the pair still shares ``need`` signatures.
Pairs that share fewer are no candidates, unless a larger group pairs them.

Null text and text without words is an empty set, linked with nothing; a null id is never linked and keeps a null
component. Rows of one id and different texts are sets of their own, which share the id in the result; rows alike in both
are one set. Sets exactly at the threshold link. Long texts are worked on whole. Only the two named columns are read; other
columns, of any name, don't matter.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspan.llm.common import as_signed, chunks, components, give_back, materialize, mix, release, shingles, text_arrays, words

#: k2 and n2: differences allowed in a part, and its subparts.
LEVEL = (1, 3)
#: Representatives that share a signature and are paired one by one.
GROUP = 40
#: Members of larger groups that meet as many others in one task.
BLOCK = 256
#: Ids up to which they are broadcast rather than shuffled with signatures or texts (8 MB).
BROADCAST_IDS = 1_000_000
_BAND = 1.3
#: Parity bits of a sketch for each element that similar sets may differ in.
_BITS = 16


def shingle_sets(batch: pa.RecordBatch, text: str, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each row end to end, and their offsets."""
    data, off = text_arrays(batch.column(text))
    row, _, _, w = words(data, off)
    at, h = shingles(row, w, k)
    of = row[at]
    count = np.bincount(row, minlength=batch.num_rows)
    for i in np.flatnonzero((count > 0) & (count < k)):  # the whole sequence as one
        a = np.searchsorted(row, i)
        one = np.full(1, count[i], np.uint64)
        for x in w[a : a + count[i]]:
            one = mix(one + x)
        of, h = np.append(of, i), np.append(h, one)
    order = np.lexsort((h, of))
    of, h = of[order], h[order]
    if len(h):
        new = np.ones(len(h), bool)
        new[1:] = (of[1:] != of[:-1]) | (h[1:] != h[:-1])
        of, h = of[new], h[new]
    return h, np.searchsorted(of, np.arange(batch.num_rows + 1))


def band_bounds(size: int) -> list[int]:
    """Lower bounds of the size bands up to the one that holds ``size``, and the next."""
    out = [1]
    while out[-1] <= size:
        out.append(max(out[-1] + 1, int(np.ceil(out[-1] * _BAND))))
    return out


class Scheme:
    """Signatures for one threshold and one level."""

    def __init__(self, percent: int, k2: int, n2: int):
        self.percent, self.k2, self.n2 = percent, k2, n2
        self.choices = list(itertools.combinations(range(n2), n2 - k2))

    def most_apart(self, total: int) -> int:
        """Largest symmetric difference of two similar sets with ``total`` elements together."""
        return total * (100 - self.percent) // (100 + self.percent)

    @staticmethod
    def slack(n1: int) -> int:
        return 0 if n1 < 3 else 1 if n1 < 8 else 2 if n1 < 24 else 4

    def spare(self, n1: int) -> int:
        """Parts beyond ``n1``: where there are many, as many more as are likely to have an empty choice."""
        return 2 * self.slack(n1) + (n1 // 32 if n1 >= 24 else 0)

    def own_apart(self, size: int, band: int) -> int:
        """Largest difference of a set of this size and a similar one, of which the smaller is in the band."""
        high = band_bounds(size)[band + 1] - 1
        return self.most_apart(size + (size * 100 // self.percent if size <= high else high))

    def instances(self, size: int) -> Iterator[tuple[int, int]]:
        """(band, largest difference) of the bands for which a set of this size has signatures."""
        bounds = band_bounds(size)
        own = len(bounds) - 2
        for i in (own - 1, own):
            if i >= 0:
                high = bounds[i + 1] - 1
                partner = high * 100 // self.percent
                if size <= partner:
                    yield i, self.most_apart(high + partner)

    def sketches(self, s: np.ndarray) -> tuple[list[int], list[bytes]]:
        """Bands of one set of distinct hashes, and a sketch for each of them: whether the number of elements in each of
        many cells is odd, so that sets differ in at least as many elements as bits. Nothing for bands in which only equal
        sets are similar."""
        bands, out = [], []
        content = self._content(s)
        for band, d in self.instances(len(s)):
            if d >= 1:
                bands.append(band)
                odd = np.bincount((content % np.uint64(_BITS * d)).astype(np.int64), minlength=_BITS * d) & 1
                out.append(np.packbits(odd.astype(np.uint8)).tobytes())
        return bands, out

    @staticmethod
    def _content(s: np.ndarray) -> np.ndarray:
        return mix(s ^ np.uint64(0xA0761D6478BD642F))

    def signatures(self, s: np.ndarray) -> np.ndarray:
        """Signatures of one set of distinct hashes, for the bands that have a sketch."""
        out = []
        content = self._content(s)
        low, high = (content & np.uint64(0xFFFFFFFF)).astype(float), (content >> np.uint64(32)).astype(float)
        for band, d in self.instances(len(s)):
            if d < 1:
                continue
            n1 = -(-(d + 1) // (self.k2 + 1))
            need = self.slack(n1) + 1
            n1 += self.spare(n1)
            salt = np.full(1, band * 1_000_003 + self.n2, np.uint64)
            part = (mix(s + mix(salt)) % np.uint64(n1 * self.n2)).astype(np.int64)
            # halves of up to two million numbers below 2**32 add up exactly
            halves = [np.bincount(part, weights=w, minlength=n1 * self.n2).astype(np.uint64) for w in (low, high)]
            sums = mix(halves[0] + (halves[1] << np.uint64(32))).reshape(n1, self.n2)
            filled = np.bincount(part, minlength=n1 * self.n2).reshape(n1, self.n2) > 0
            place = np.arange(n1, dtype=np.uint64) * np.uint64(len(self.choices))
            some = np.stack([filled[:, list(c)].any(axis=1) for c in self.choices])
            every = (~some.all(axis=0)).sum() > n1 - self.own_apart(len(s), band) // (self.k2 + 1) - need
            for c, choice in enumerate(self.choices):
                h = place + (np.uint64(c) + (salt << np.uint64(32)))
                for j in choice:
                    h = mix(h + sums[:, j])
                # the lowest bits tell how many signatures a similar pair shares at least
                h = (h & ~np.uint64(7)) | np.uint64(need)
                out.append(h if every else h[some[c]])
        return np.concatenate(out) if out else np.zeros(0, np.uint64)

    def describe(self, s: np.ndarray) -> tuple[np.ndarray, list[int], list[bytes]]:
        """Signatures, bands and sketches."""
        return (self.signatures(s), *self.sketches(s))


def content_keys(h: np.ndarray, off: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """Two hashes of each set."""
    out = []
    for salt in (0, 0x5851F42D4C957F2D):
        sums = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(mix(h ^ np.uint64(salt)), out=sums[1:])
        out.append(pa.array(as_signed(sums[off[1:]] - sums[off[:-1]])))
    return tuple(out)


def _prepare(text: str, k: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scheme = Scheme(percent, *LEVEL)
        for b in chunks(batches, text):
            h, off = shingle_sets(b, text, k)
            found = [scheme.sketches(h[s:e]) for s, e in zip(off[:-1], off[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0).cast(pa.int64()), pa.array(np.diff(off), pa.int64()), *content_keys(h, off), pa.array([x for x, _ in found], pa.list_(pa.int32())), pa.array([x for _, x in found], pa.list_(pa.binary()))],
                ["doc_id", "n_shingles", "key1", "key2", "band", "sketch"],
            )

    return run


_PREPARED = "doc_id long, n_shingles long, key1 long, key2 long, band array<int>, sketch array<binary>"


def _signed(text: str, k: int, percent: int):
    """Signatures, made on the way to where they are joined: they take more room than the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scheme = Scheme(percent, *LEVEL)
        for b in chunks(batches, text):
            h, off = shingle_sets(b, text, k)
            sig = [as_signed(scheme.signatures(h[s:e])) for s, e in zip(off[:-1], off[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(np.diff(off), pa.int64()), *content_keys(h, off), pa.array(sig, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "key1", "key2", "sig"])

    return run


_SIGNED = "doc_id long, n_shingles long, key1 long, key2 long, sig array<long>"


def _pairs():
    """From rows (sig, id) in order of sig: pairs of each group with the number of signatures that they need to share; of a
    large group a star, which needs none, and its members (b null), of which no more than ``GROUP`` are held."""

    def table(out: list) -> pa.RecordBatch:
        sig, a, b, pair, need = (np.concatenate([x[j] for x in out]) for j in range(5))
        return pa.RecordBatch.from_arrays([pa.array(sig, mask=pair), pa.array(a), pa.array(b, mask=~pair), pa.array(need)], ["sig", "a", "b", "need"])

    def star(sig: int, first: int, ids: np.ndarray, out: list) -> None:
        n = len(ids)
        out.append((np.full(n, sig), ids, ids, np.zeros(n, bool), np.zeros(n, np.int64)))
        others = ids[ids != first]
        n = len(others)
        out.append((np.full(n, sig), np.minimum(first, others), np.maximum(first, others), np.ones(n, bool), np.zeros(n, np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, first = None, np.zeros(0, np.int64), None
        out: list = []

        def finish() -> None:
            if first is None and len(held) > 1:
                i, j = np.triu_indices(len(held), 1)
                out.append((np.full(len(i), at), held[i], held[j], np.ones(len(i), bool), np.full(len(i), at & 7)))

        for b in batches:
            sig, ids = (b.column(j).to_numpy() for j in range(2))
            if not len(sig):
                continue
            edges = np.concatenate([[0], np.flatnonzero(np.diff(sig)) + 1, [len(sig)]])
            size = np.diff(edges)
            # groups that begin and end in this batch: of one row nothing, of two rows their pair; the others in turn
            inner = np.ones(len(size), bool)
            inner[[0, -1]] = False
            two = edges[:-1][inner & (size == 2)]
            two = two[ids[two] != ids[two + 1]]
            if len(two):
                out.append((sig[two], np.minimum(ids[two], ids[two + 1]), np.maximum(ids[two], ids[two + 1]), np.ones(len(two), bool), sig[two] & 7))
            turn = np.flatnonzero(~inner | (size > 2))
            for s, e in zip(edges[turn], edges[turn + 1], strict=True):
                if sig[s] != at:
                    finish()
                    at, held, first = sig[s], np.zeros(0, np.int64), None
                if first is None:
                    held = np.unique(np.concatenate([held, ids[s:e]]))
                    if len(held) > GROUP:
                        first = held[0]
                        star(at, first, held, out)
                else:
                    star(at, first, np.unique(ids[s:e]), out)
                if len(out) >= 500:
                    yield table(out)
                    out = []
        finish()
        if out:
            yield table(out)
        del out
        give_back()

    return run


def _similar(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column("x"), batch.column("y")
            keep = []
            for i in range(batch.num_rows):
                p, q = np.frombuffer(x[i].as_buffer(), np.uint64), np.frombuffer(y[i].as_buffer(), np.uint64)
                both = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(100 * both >= percent * (len(p) + len(q) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _sets(text: str, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, text):
            h, off = shingle_sets(b, text, k)
            raw = h.tobytes()
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(np.diff(off), pa.int64()), *content_keys(h, off), pa.array([raw[8 * s : 8 * e] for s, e in zip(off[:-1], off[1:], strict=True)], pa.binary())], ["doc_id", "n_shingles", "key1", "key2", "set"])

    return run


def _screen(percent: int):
    """Keeps the pairs whose sketches, in a band that both have, differ in no more bits than similar sets can."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scheme = Scheme(percent, *LEVEL)
        for b in batches:
            col = {c: b.column(c).to_pylist() for c in ("na", "nb", "ba", "bb", "sa", "sb")}
            keep = []
            for na, nb, ba, bb, sa, sb in zip(*col.values(), strict=True):
                d = scheme.most_apart(na + nb)
                ok = 100 * min(na, nb) >= percent * max(na, nb)
                for band, x in zip(ba, sa, strict=True) if ok else ():
                    if band in bb:
                        y = sb[bb.index(band)]
                        ok = (int.from_bytes(x) ^ int.from_bytes(y)).bit_count() <= d
                        break
                keep.append(ok)
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


#: Signatures of members of larger groups that a task looks at together.
TOGETHER = 1_000_000


def _gathered(ids: bool):
    """From rows (id, comp, sigs): of those that a task sees together, the number of each signature's members of one
    component, or the members themselves."""

    def together(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(rows)
        sigs = table.column("sigs").combine_chunks()
        sig, row = sigs.flatten().to_numpy(), np.repeat(np.arange(len(table)), np.diff(sigs.offsets.to_numpy()))
        own, comp = (table.column(c).to_numpy()[row] for c in ("id", "comp"))
        order = np.lexsort((comp, sig))
        sig, comp, own = sig[order], comp[order], own[order]
        new = np.ones(len(sig), bool)
        new[1:] = (sig[1:] != sig[:-1]) | (comp[1:] != comp[:-1])
        first = np.flatnonzero(new)
        off = np.append(first, len(sig))
        last = pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(own)) if ids else pa.array(np.diff(off), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(sig[first]), pa.array(comp[first]), last], ["sig", "comp", "ids" if ids else "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[pa.RecordBatch] = []
        held = 0
        for b in batches:
            if b.num_rows:
                rows.append(b)
                held += len(b.column("sigs").flatten())
            if held > TOGETHER:
                yield together(rows)
                rows, held = [], 0
        if rows:
            yield together(rows)
        del rows
        give_back()

    return run


def _blocks(percent: int, nearest: bool):
    """Pairs of a row outside the largest component with others, that cross components and pass the screen; with ``nearest``
    only that of the least apart."""

    def run(table: pa.Table) -> pa.Table:
        scheme = Scheme(percent, *LEVEL)
        col = {c: table.column(c).to_pylist() for c in ("id", "comp", "n", "outside", "band", "sketch")}
        by_band: dict[int, tuple[list, list]] = {}
        for r, (outside, bands, sketches) in enumerate(zip(col["outside"], col["band"], col["sketch"], strict=True)):
            for band, x in zip(bands, sketches, strict=True):
                by_band.setdefault(band, ([], []))[outside].append((r, x))
        ids, comp, n = (np.array(col[c], np.int64) for c in ("id", "comp", "n"))
        found = set()
        for all_, outsiders in by_band.values():
            if not all_:
                continue
            others = np.array([r for r, _ in all_])
            bits = np.frombuffer(b"".join(x for _, x in all_), np.uint8).reshape(len(all_), -1)
            for r, x in outsiders:
                total = n[r] + n[others]
                some = np.flatnonzero((comp[others] != comp[r]) & (100 * np.minimum(n[r], n[others]) >= percent * np.maximum(n[r], n[others])))
                apart = np.bitwise_count(bits[some] ^ np.frombuffer(x, np.uint8)).sum(axis=1, dtype=np.int64)
                passed = apart <= scheme.most_apart(total[some])
                near = some[passed]
                if nearest and len(near):
                    near = near[[apart[passed].argmin()]]
                for o in others[near].tolist():
                    found.add((min(ids[r], ids[o]), max(ids[r], ids[o])))
        pairs = sorted(found)
        return pa.table({"a": pa.array([x for x, _ in pairs], pa.int64()), "b": pa.array([y for _, y in pairs], pa.int64())})

    return run


def similar_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3, percent: int = 90) -> DataFrame:
    """One row a document: ``doc_id``, ``n_shingles``, ``component_id`` (smallest id reachable by links).

    A null text has ``n_shingles`` 0 and is its own component; a null id has a null component.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    keys = ["n_shingles", "key1", "key2"]
    prepared = materialize(source.mapInArrow(_prepare("text", k, percent), _PREPARED))
    # a number for each set, which ids may not be
    classes = prepared.where("n_shingles > 0").groupBy(*keys).agg(F.min("doc_id").alias("rep")).where("rep is not null")
    classes = materialize(classes.withColumn("uid", F.monotonically_increasing_id()))
    few = classes.count() <= BROADCAST_IDS
    small = F.broadcast(classes) if few else classes
    rows = prepared.where("size(band) > 0").join(small, keys).where("doc_id = rep")
    sketches = rows.select(F.col("uid").alias("id"), "n_shingles", "band", "sketch").dropDuplicates(["id"])

    def screened(pairs: DataFrame) -> DataFrame:
        a = sketches.select(F.col("id").alias("a"), F.col("n_shingles").alias("na"), F.col("band").alias("ba"), F.col("sketch").alias("sa"))
        b = sketches.select(F.col("id").alias("b"), F.col("n_shingles").alias("nb"), F.col("band").alias("bb"), F.col("sketch").alias("sb"))
        return materialize(pairs.join(a, "a").join(b, "b").mapInArrow(_screen(percent), "a long, b long"))

    def verified(pairs: DataFrame) -> DataFrame:
        wanted = pairs.select(F.explode(F.array("a", "b")).alias("uid")).distinct()
        wanted = materialize(classes.join(wanted, "uid", "left_semi"))
        of = F.broadcast(wanted) if wanted.count() <= BROADCAST_IDS else wanted
        texts = source.join(of.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi")
        sets = texts.mapInArrow(_sets("text", k), "doc_id long, n_shingles long, key1 long, key2 long, set binary").join(of, keys).where("doc_id = rep")
        sets = materialize(sets.select(F.col("uid").alias("id"), "set").dropDuplicates(["id"]))
        x, y = sets.select(F.col("id").alias("a"), F.col("set").alias("x")), sets.select(F.col("id").alias("b"), F.col("set").alias("y"))
        out = materialize(pairs.join(x, "a").join(y, "b").mapInArrow(_similar(percent), "a long, b long"))
        release(wanted, sets)
        return out

    def across(pairs: DataFrame, comp: DataFrame) -> DataFrame:
        ca, cb = comp.select(F.col("node").alias("a"), F.col("component").alias("ca")), comp.select(F.col("node").alias("b"), F.col("component").alias("cb"))
        return pairs.join(ca, "a", "left").join(cb, "b", "left").where("coalesce(ca, a) <> coalesce(cb, b)").select("a", "b")

    signed = source.mapInArrow(_signed("text", k, percent), _SIGNED).where("size(sig) > 0").join(small, keys).where("doc_id = rep").select(F.explode("sig").alias("sig"), F.col("uid").alias("id"))
    found = materialize(signed.repartition("sig").sortWithinPartitions("sig").mapInArrow(_pairs(), "sig long, a long, b long, need long").groupBy("sig", "a", "b").agg(F.count(F.lit(1)).alias("n"), F.min("need").alias("need")).where("n >= need").select("sig", "a", "b"))
    pairs = screened(found.where("b is not null").select("a", "b"))
    links = verified(pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"))
    comp = materialize(components(links))
    comp = materialize(components(verified(across(pairs, comp)), comp))
    hot = found.where("b is null").select("sig", F.col("a").alias("id"))
    # one row for each member, with the signatures of its larger groups
    hot = materialize(hot.groupBy("id").agg(F.collect_set("sig").alias("sigs")))
    for nearest in (True, False) if hot.limit(1).count() else ():
        own = hot.join(comp.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("component", "id").alias("comp"), "sigs")
        own = materialize(own)
        sized = own.mapInArrow(_gathered(False), "sig long, comp long, n long").groupBy("sig", "comp").agg(F.sum("n").alias("n")).groupBy("sig").agg(F.sum("n").alias("all"), F.max(F.struct("n", "comp")).alias("top"))
        # a group of one component has nothing left to find
        blocks = lambda c: F.ceil(c / BLOCK).cast("int")
        mixed = materialize(sized.where(F.col("all") > F.col("top.n")).select("sig", F.col("top.comp").alias("largest"), "all"))
        held = own.mapInArrow(_gathered(True), "sig long, comp long, ids array<long>").withColumnRenamed("sig", "of")
        outsiders = held.join(F.broadcast(mixed) if mixed.count() <= BROADCAST_IDS else mixed, (F.col("of") == F.col("sig")) & (F.col("comp") != F.col("largest")))
        outsiders = outsiders.select("sig", F.explode("ids").alias("id"), "comp", "largest", "all")
        if nearest:
            outsiders = outsiders.groupBy("id").agg(F.max(F.struct("all", "sig", "comp", "largest")).alias("one")).select("id", "one.*")
        outsiders = materialize(outsiders)
        # members of a group's largest component are met by component; so are its other outsiders, or by signature where that
        # makes fewer pairs
        by = lambda c, single, of=outsiders: of.select(F.lit(single).alias("single"), F.col(c).alias("key"), "id", "comp").distinct()
        out = others = by("largest", False)
        if not nearest:
            pairs_of = outsiders.groupBy("largest", "sig").agg(F.count(F.lit(1)).alias("n")).groupBy("largest").agg(F.sum(F.col("n") * F.col("n")).alias("each"))
            sparse = materialize(pairs_of.join(outsiders.groupBy("largest").agg(F.countDistinct("id").alias("m")), "largest").where(F.col("m") * F.col("m") > F.col("each")).select(F.col("largest").alias("key")))
            sparse = F.broadcast(sparse) if sparse.count() <= BROADCAST_IDS else sparse
            single = by("sig", True, outsiders.join(sparse, F.col("largest") == F.col("key"), "left_semi"))
            others = out.join(sparse, "key", "left_anti").select(*out.columns).unionByName(single)
            out = out.unionByName(single)
        wide = materialize(out.groupBy("single", "key").agg(blocks(F.count(F.lit(1))).alias("out_blocks")))
        few_keys = F.broadcast(wide) if wide.count() <= BROADCAST_IDS else wide
        met = own.select(F.lit(False).alias("single"), F.col("comp").alias("key"), "id", "comp").join(few_keys.where("not single").select("key"), "key", "left_semi")
        met = met.select("single", "key", "id", "comp")
        met = materialize(met if nearest else met.unionByName(others))
        deep = met.groupBy("single", "key").agg(blocks(F.count(F.lit(1))).alias("blocks"))
        # each row with its sketch once, then in the blocks of the other side
        turn = lambda c: F.array(F.pmod(F.xxhash64("id"), F.col(c)).cast("int"))
        each = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
        dealt = met.withColumn("outside", F.lit(0)).unionByName(out.withColumn("outside", F.lit(1))).join(few_keys, ["single", "key"]).join(deep, ["single", "key"]).join(sketches.withColumnRenamed("n_shingles", "n"), "id")
        dealt = dealt.withColumn("i", F.explode(F.when(F.col("outside") == 1, turn("out_blocks")).otherwise(each("out_blocks"))))
        dealt = dealt.withColumn("j", F.explode(F.when(F.col("outside") == 1, each("blocks")).otherwise(turn("blocks"))))
        dealt = dealt.select("single", "key", "i", "j", "id", "comp", "n", "outside", "band", "sketch")
        more = materialize(dealt.groupBy("single", "key", "i", "j").applyInArrow(_blocks(percent, nearest), "a long, b long").distinct())
        joined = materialize(components(verified(more), comp))
        release(own, mixed, outsiders, wide, met, more, comp)
        comp = joined
    # the smallest id of each component, from one row for each of its sets
    least = comp.join(classes.select(F.col("uid").alias("node"), "rep"), "node").groupBy("component").agg(F.min("rep").alias("least"))
    named = classes.join(comp, F.col("uid") == F.col("node"), "left").join(least, "component", "left").select(*keys, F.coalesce("least", "rep").alias("component_id"))
    named = materialize(named)
    out = prepared.select("doc_id", *keys).join(F.broadcast(named) if few else named, keys, "left")
    release(found, hot, pairs, links)
    return out.select("doc_id", "n_shingles", F.coalesce(F.when(F.col("doc_id").isNotNull(), F.col("component_id")), "doc_id").alias("component_id"))

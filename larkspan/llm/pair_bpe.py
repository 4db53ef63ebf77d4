"""BPE encoding and decoding by a pair occurrence index.

The words of a piece of a partition are gathered once each. All of them are encoded together: their symbols stand in one
array with links to the next and previous symbol, and every adjacent pair that has a rank keeps the list of its
positions. Active ranks are applied in ascending order; a merge joins all its positions at once and adds the pairs that
arise on either side to the lists of their ranks. In a vocabulary where a merged symbol takes part only in later merges
(checked on loading) this gives each word what merging it alone by lowest rank gives.

Texts are normalised and cut into words as the vocabulary file says (composed form, white space runs to one space, lower
case; contractions, letter runs, single digits, other runs), special tokens being cut out first. Characters outside a
range where Python's tables are known to agree go through the tokenizer library's own normaliser and splitter.

Null and empty texts have no tokens, the hash of no ids and the hash of an empty string. Rows with equal or null ids are
separate rows.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspan.llm.common import chunks

#: Words whose encodings a worker keeps between pieces; beyond it starts anew.
KEEP_WORDS = 400_000
#: Bytes of text in a piece.
PIECE_BYTES = 12_000_000
#: Beyond this range of characters the library normalises and splits.
_UNSURE = re.compile("[^\x00-ſ -⁯₠-₵]")
_LETTERS = r"a-zªµºÀ-ÖØ-öø-ſ"
_DIGITS = r"0-9²³¹¼-¾"
_BLANK = r"\t\n\x0b\x0c\r \u0085  -     "


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    letters = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return [letters[b] for b in range(256)]


class Vocabulary:
    """Symbols, ranks and the word splitter of a vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.path, self.suffix = path, model.get("end_of_word_suffix") or ""
        self.ids: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {v: k for k, v in [*self.ids.items(), *self.special.items()]}
        n = max(self.ids.values()) + 1
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        left, right, made = (np.array([self.ids[f(m)] for m in merges], np.int64) for f in (lambda m: m[0], lambda m: m[1], lambda m: m[0] + m[1]))
        rank_of = np.full(n, -1, np.int64)
        rank_of[made] = np.arange(len(merges))
        if (rank_of[left] >= np.arange(len(merges))).any() or (rank_of[right] >= np.arange(len(merges))).any() or len(np.unique(made)) < len(made):
            raise ValueError("a symbol is used before the merge that makes it")
        self.n, self.made = n, made
        key = left * n + right
        self.order = np.argsort(key, kind="stable")
        self.keys = key[self.order]
        letters = byte_letters()
        self.byte_id = np.array([self.ids[c] for c in letters], np.int64)
        self.last_id = np.array([self.ids[c + self.suffix] for c in letters], np.int64)
        self.split_special = re.compile("(" + "|".join(re.escape(x) for x in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.words = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_DIGITS}]|[^{_BLANK}{_LETTERS}{_DIGITS}]+")
        self._library = None

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 where it has none."""
        key = left * self.n + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.order[at], -1)

    def cut(self, text: str) -> list[str]:
        """Words of a text in order, as written; special tokens are among them."""
        if self.split_special is None or "<|" not in text:
            return self._segment(text)
        out = []
        for i, part in enumerate(self.split_special.split(text)):
            out += [part] if i % 2 else self._segment(part)
        return out

    def _segment(self, text: str) -> list[str]:
        if _UNSURE.search(text) is None:
            import unicodedata

            if not text.isascii():
                text = unicodedata.normalize("NFC", text)
            return self.words.findall(text.lower())
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.path)
        whole = self._library.normalizer.normalize_str(text)
        back = {c: b for b, c in enumerate(byte_letters())}
        return [bytes(back[c] for c in w).decode("utf-8", "surrogateescape") for w, _ in self._library.pre_tokenizer.pre_tokenize_str(whole)]

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words end to end, and their offsets."""
        raw = [w.encode("utf-8", "surrogateescape") for w in words]
        size = np.array([len(x) for x in raw], np.int64)
        off = np.zeros(len(raw) + 1, np.int64)
        np.cumsum(size, out=off[1:])
        data = np.frombuffer(b"".join(raw), np.uint8)
        total = len(data)
        sym = self.byte_id[data]
        ends = off[1:][size > 0] - 1
        sym[ends] = self.last_id[data[ends]]
        if not total:
            return sym, off
        word_end = np.zeros(total, bool)
        word_end[ends] = True
        nxt = np.arange(1, total + 1)
        nxt[word_end] = total  # no next
        prv = np.arange(-1, total - 1)
        prv[1:][word_end[:-1]] = -1
        alive = np.ones(total, bool)
        lists: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def add(at: np.ndarray, rank: np.ndarray) -> None:
            ok = rank >= 0
            at, rank = at[ok], rank[ok]
            if not len(at):
                return
            if len(at) > 1:
                order = np.argsort(rank, kind="stable")
                at, rank = at[order], rank[order]
            cuts = np.flatnonzero(rank[1:] != rank[:-1]) + 1
            starts = [0, *cuts.tolist(), len(at)]
            values = rank[[0, *cuts.tolist()]].tolist()
            for i, r in enumerate(values):
                if r not in lists:
                    lists[r] = []
                    heapq.heappush(heap, r)
                lists[r].append(at[starts[i] : starts[i + 1]])

        at = np.flatnonzero(~word_end)
        add(at, self.ranks(sym[at], sym[at + 1]))
        left_of, right_of = self.keys // self.n, self.keys % self.n
        place = np.empty(len(self.order), np.int64)
        place[self.order] = np.arange(len(self.order))
        while heap:
            r = heapq.heappop(heap)
            found = lists.pop(r)
            at = np.unique(np.concatenate(found))
            a, b = left_of[place[r]], right_of[place[r]]
            at = at[alive[at]]
            to = nxt[at]
            ok = (sym[at] == a) & (to < total)
            at, to = at[ok], to[ok]
            ok = sym[to] == b
            at, to = at[ok], to[ok]
            if a == b and len(at) > 1:  # in a run of one symbol, pairs from its left end
                linked = np.zeros(len(at), bool)
                linked[1:] = to[:-1] == at[1:]
                index = np.arange(len(at))
                first = np.maximum.accumulate(np.where(linked, 0, index))
                ok = (index - first) % 2 == 0
                at, to = at[ok], to[ok]
            if not len(at):
                continue
            sym[at] = self.made[r]
            alive[to] = False
            after = nxt[to]
            nxt[at] = after
            inner = after < total
            prv[after[inner]] = at[inner]
            add(at[inner], self.ranks(sym[at[inner]], sym[after[inner]]))
            before = prv[at]
            some = before >= 0
            add(before[some], self.ranks(sym[before[some]], sym[at[some]]))
        count = np.zeros(total + 1, np.int64)
        np.cumsum(alive, out=count[1:])
        return sym[alive], count[off]


class Codec:
    """Encodes texts, keeping what it has found of words."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.known: dict[str, tuple[str, int, str]] = {}
        self.fixed = {k: (str(i), 1, k) for k, i in vocabulary.special.items()}

    def learn(self, words: list[str]) -> None:
        ids, off = self.v.encode_words(words)
        text = [str(x) for x in range(self.v.n)] if not hasattr(self, "_text") else self._text
        self._text = text
        names = self.v.names
        listed, cuts = ids.tolist(), off.tolist()
        for w, s, e in zip(words, cuts[:-1], cuts[1:], strict=True):
            own = listed[s:e]
            self.known[w] = (" ".join([text[i] for i in own]), e - s, " ".join([names[i] for i in own]))

    def encode(self, texts: list[str]) -> Iterator[tuple[int, str, str]]:
        """Number of ids, the ids in decimal joined by a space, and their decoded text, for each text."""
        parts = [self.v.cut(t) for t in texts]
        if len(self.known) > KEEP_WORDS:
            self.known = {}
        self.known |= self.fixed
        new = set()
        for p in parts:
            new.update(p)
        new.difference_update(self.known)
        if new:
            self.learn(sorted(new))
        get = self.known.__getitem__
        for p in parts:
            got = list(map(get, p))
            yield sum([x[1] for x in got]), " ".join([x[0] for x in got]), " ".join([x[2] for x in got])


def encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``n_tokens``, ``ids_sha256``, ``decoded_sha256`` for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(Vocabulary(vocabulary))
        for b in chunks(batches, limit=PIECE_BYTES):
            n, ids, back = [], [], []
            for count, text, decoded in codec.encode([x or "" for x in b.column("text").to_pylist()]):
                n.append(count)
                ids.append(hashlib.sha256(text.encode()).hexdigest())
                back.append(hashlib.sha256(decoded.encode("utf-8", "surrogateescape")).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def decode_ids(vocabulary: Vocabulary, ids: list[int]) -> str:
    """The text of ids: a vocabulary file without a decoder joins its symbols by spaces."""
    return " ".join(vocabulary.names[i] for i in ids)

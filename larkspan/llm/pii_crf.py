"""Personal data by patterns and a semi-Markov conditional random field.

Four patterns give the base spans. Around every digit, ``@`` or written-out address mark, tokens form windows in which a
semi-Markov model scores whole candidate segments by features of the span (its shape, digit count, checksum, parts, cue
before it). Every segment of up to ``LONGEST`` tokens is a candidate, and so is what an entity of more tokens can be
(:func:`longer`: an unbroken key or colon-separated address, a written-out mail address, spaced digits), whatever its length. One dynamic program over ends and types picks the best segmentation, so that
boundaries and types are chosen together. Its spans are added where they don't meet a base span.

The model is fitted here, by stochastic gradient steps on the conditional likelihood (forward and backward sums over all
segmentations) of generated windows: obfuscated addresses, numbers written with other separators, keys after an
assignment, and look-alikes such as dates, versions, prices and long numbers that fail their checksum.

Null text counts as empty and has no spans. Rows with equal or null ids are separate rows. Positions are code points, the
end exclusive.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspan.llm.common import chunks

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret")
#: Tokens up to which every segment is a candidate, and tokens on either side of a mark that a window takes in.
LONGEST, AROUND = 16, 6
_DIM = 1 << 13

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
# possessive forms and the look-behind match what the plain patterns match, in linear time
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_MARK = re.compile(r"[0-9@]|\bdot\b|[\[(]at[\])]")
_TOKEN = re.compile(r"[^\W\d_]+|[0-9]+|\s+|.", re.DOTALL)
#: What an entity of more tokens is made of.
_RUN = re.compile(r"[A-Za-z0-9_\-+/=.:@%~]+")
_HEAD = re.compile(r"(?<![\w.+-])[\w.+-]++ ?(?:\(at\)|\[at\]|at|@) ?[\w-]+")
_PART = re.compile(r" ?(?:\(dot\)|\[dot\]|dot|\.) ?\w+")
_SPACED = re.compile(r"[+(]?[0-9][0-9\x20().+/-]*[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, index of kind) of the patterns, in order."""
    out = []
    at, floor = text.find("@"), 0
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end(), 0))
            floor = m.end()
        else:
            floor = at + 1
        at = text.find("@", at + 1)
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                out.append((m.start(), m.end(), 1))
        for m in _CARD.finditer(text):
            d = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(d) <= 19 and luhn(d):
                out.append((m.start(), m.end(), 2))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                    out.append((m.start(), m.end(), 3))
    return sorted(out, key=lambda x: (x[0], x[2], x[1]))


# --- the model ----------------------------------------------------------------------------------
@functools.lru_cache(maxsize=200_000)
def _bucket(feature: str) -> int:
    return zlib.crc32(feature.encode()) % _DIM


def _features(tokens: list[str], i: int, j: int) -> list[str] | None:
    """Of the segment of tokens i to j (exclusive); None if it can't be an entity."""
    first, last = tokens[i], tokens[j - 1]
    if first.isspace() or last.isspace() or last in ".,;:!?)]}" and not (first in "([" and last in ")]"):
        return None
    span = "".join(tokens[i:j])
    if "\n" in span:
        return None
    digits = "".join(c for c in span if c in "0123456789")
    low = span.lower()
    written = " dot " in low or "(dot)" in low or "[dot]" in low or "[at]" in low or "(at)" in low or " @ " in low
    if not digits and "@" not in span and not written:
        return None
    if not written and any(c.isalpha() for c in span) and any(c.isspace() for c in span):
        return None
    shape = re.sub(r"[0-9]+", lambda m: f"d{min(len(m[0]), 9)}" if len(m[0]) < 10 else "D", re.sub(r"[a-zA-Z]+", "a", span))
    n = len(digits)
    f = ["bias", f"n{min(n, 24)}", f"len{min(len(span) // 4, 16)}", f"tok{min(j - i, LONGEST + 1)}", "s:" + shape[:40]]
    if n and n == len(span):
        f.append(f"plain{min(n, 24)}")
    elif all(c in "0123456789 ().-+/" for c in span):
        f += ["sep:" + "".join(sorted({c for c in span if not c.isdigit()})), f"sepn{min(n, 24)}"]
    if 12 <= n <= 19 and not any(c.isalpha() for c in span):
        f.append("luhn" if luhn(digits) else "notluhn")
    if n and first == "+":
        f.append("plus")
    if first == "(":
        f.append("open")
    parts = re.split(r"\s*[.\s,]\s*", span)
    if len(parts) == 4 and all(p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in parts):
        f.append("quad")
    if re.fullmatch(r"[0-9a-fA-F]{2,4}(?::[0-9a-fA-F]{0,4}){3,7}", span):
        f.append("colonhex")
    if re.fullmatch(r"[0-9a-fA-F]{24,}", span):
        f.append("hex")
    if len(span) >= 16 and re.fullmatch(r"[A-Za-z0-9_\-/+=]+", span) and any(c.isalpha() for c in span) and n >= 3:
        f.append("key")
    if re.fullmatch(r"[\w.+-]+ ?(?:\(at\)|\[at\]|at|@) ?[\w-]+(?: ?(?:\(dot\)|\[dot\]|dot|\.) ?\w+)+", span):
        f.append("address")
    if re.fullmatch(r"(?:19|20)\d\d[-/.]\d\d?[-/.]\d\d?|\d\d?[-/.]\d\d?[-/.](?:19|20)?\d\d", span):
        f.append("date")
    if re.fullmatch(r"[0-9]{1,3}(?:,[0-9]{3})+(?:\.[0-9]+)?|[0-9]+\.[0-9]+", span):
        f.append("amount")
    left = "".join(tokens[max(0, i - 6) : i]).lower()
    cue = re.findall(r"[a-z]+", left)
    if cue:
        f.append("cue:" + cue[-1] if cue[-1] in _CUES else "nocue")
    if left.rstrip().endswith(("=", ":", '"', "'", "=\"")):
        f.append("assigned")
        f += ["assigned+hex"] * ("hex" in f) + ["assigned+key"] * ("key" in f)
    if i and (tokens[i - 1].isalnum() or tokens[i - 1] in "$€£#@-+./_"):
        f.append("glued:" + ("w" if tokens[i - 1].isalnum() else tokens[i - 1]))
    if j < len(tokens) and (tokens[j].isalnum() or tokens[j] in "%@-_/" or tokens[j] == "." and j + 1 < len(tokens) and tokens[j + 1].isalnum()):
        f.append("gluedto:" + ("w" if tokens[j].isalnum() else tokens[j]))
    return f


_CUES = frozenset("email mail contact ip address host server card visa credit phone tel call fax mobile token key secret password api at from version order price date page".split())


def longer(tokens: list[str]) -> list[tuple[int, int]]:
    """Segments of more than ``LONGEST`` tokens that can be an entity, of any length."""
    if len(tokens) <= LONGEST:
        return []
    text = "".join(tokens)
    place = np.concatenate([[0], np.cumsum([len(t) for t in tokens])]).tolist()
    number = {p: k for k, p in enumerate(place)}
    out = set()

    def add(start: int, end: int) -> None:
        i, j = number.get(start), number.get(end)
        if i is not None and j is not None and j - i > LONGEST:
            out.add((i, j))

    for m in _RUN.finditer(text):
        # after an assignment, or from the start; up to the end, or less the marks that end a sentence
        starts = [m.start(), *(m.start() + x.end() for x in re.finditer("[=:]+", m[0]))]
        for end in {m.end(), m.start() + len(m[0].rstrip(".:"))}:
            for start in starts:
                add(start, end)
    for m in _HEAD.finditer(text):
        part = _PART.match(text, m.end())
        while part:
            add(m.start(), part.end())
            part = _PART.match(text, part.end())
    for m in _SPACED.finditer(text):
        # numbers of up to 19 digits, the most that a card has
        i, stop = number.get(m.start()), number.get(m.end())
        if i is None or stop is None or stop - i <= LONGEST:
            continue
        digits = np.cumsum([0] + [len(t) if t[0] in "0123456789" else 0 for t in tokens[i:stop]])
        for a in range(i, stop - LONGEST):
            if tokens[a][0] in "0123456789+(":
                last = i + int(np.searchsorted(digits, digits[a - i] + 19, "right")) - 1
                out.update((a, j) for j in range(a + LONGEST + 1, last + 1) if tokens[j - 1][0] in "0123456789")
    return sorted(out)


class Model:
    """Weights of span features by kind, and of a kind after another; kind 0 is a single outside token."""

    def __init__(self):
        self.w = np.zeros((len(KINDS) + 1, _DIM))
        self.t = np.zeros((len(KINDS) + 1, len(KINDS) + 1))

    def candidates(self, tokens: list[str]) -> list[tuple[int, int, np.ndarray]]:
        out = []
        for i in range(len(tokens)):
            for j in range(i + 1, min(len(tokens), i + LONGEST) + 1):
                f = _features(tokens, i, j)
                if f is not None:
                    out.append((i, j, np.array([_bucket(x) for x in f])))
        for i, j in longer(tokens):
            f = _features(tokens, i, j)
            if f is not None:
                out.append((i, j, np.array([_bucket(x) for x in f])))
        return out

    def decode(self, tokens: list[str]) -> list[tuple[int, int, int]]:
        """Segments (first token, end, kind from 1) of the best segmentation."""
        n, k = len(tokens), len(KINDS) + 1
        best = np.full((n + 1, k), -np.inf)
        best[0, 0] = 0
        back: list[list] = [[None] * k for _ in range(n + 1)]
        ends: dict[int, list] = {}
        for i, j, f in self.candidates(tokens):
            s = self.w[:, f].sum(axis=1)
            if s[1:].max() > -4:
                ends.setdefault(j, []).append((i, s))
        for j in range(1, n + 1):
            from_ = best[j - 1] + self.t[:, 0]
            y = int(from_.argmax())
            best[j, 0], back[j][0] = from_[y], (j - 1, y)
            for i, s in ends.get(j, ()):
                through = best[i][:, None] + self.t[:, 1:]
                y = through.argmax(axis=0)
                total = through[y, np.arange(k - 1)] + s[1:]
                for c in np.flatnonzero(total > best[j, 1:]):
                    best[j, c + 1], back[j][c + 1] = total[c], (i, int(y[c]))
        out, j, y = [], n, int(best[n].argmax())
        while j > 0:
            i, before = back[j][y]
            if y:
                out.append((i, j, y))
            j, y = i, before
        return out[::-1]

    def step(self, tokens: list[str], gold: dict[tuple[int, int], int], rate: float) -> float:
        """A gradient step on the conditional likelihood of one window; its loss before."""
        n, k = len(tokens), len(KINDS) + 1
        cand = [(i, j, f, self.w[:, f].sum(axis=1)) for i, j, f in self.candidates(tokens)]
        if missed := gold.keys() - {c[:2] for c in cand}:
            raise ValueError(f"no candidate for {[''.join(tokens[i:j]) for i, j in missed]}")
        starts: dict[int, list] = {}
        ends: dict[int, list] = {}
        for c in cand:
            starts.setdefault(c[0], []).append(c)
            ends.setdefault(c[1], []).append(c)
        lse = lambda x, axis=None: np.logaddexp.reduce(x, axis=axis)
        a = np.full((n + 1, k), -np.inf)
        a[0, 0] = 0
        for j in range(1, n + 1):
            a[j, 0] = lse(a[j - 1] + self.t[:, 0])
            for i, _, _, s in ends.get(j, ()):
                a[j, 1:] = np.logaddexp(a[j, 1:], lse(a[i][:, None] + self.t[:, 1:], 0) + s[1:])
        b = np.full((n + 1, k), -np.inf)
        b[n] = 0
        for i in range(n - 1, -1, -1):
            b[i] = self.t[:, 0] + b[i + 1, 0]
            for _, j, _, s in starts.get(i, ()):
                b[i] = np.logaddexp(b[i], lse(self.t[:, 1:] + (s[1:] + b[j, 1:])[None], 1))
        z = lse(a[n])
        loss = z
        gw: list[tuple[np.ndarray, np.ndarray]] = []
        gt = np.zeros_like(self.t)
        for i in range(n):
            gt[:, 0] -= np.exp(a[i] + self.t[:, 0] + b[i + 1, 0] - z)
            for _, j, f, s in starts.get(i, ()):
                p = np.exp(a[i][:, None] + self.t[:, 1:] + (s[1:] + b[j, 1:])[None] - z)
                gt[:, 1:] -= p
                g = np.zeros(k)
                g[1:] -= p.sum(axis=0)
                y = gold.get((i, j))
                if y:
                    g[y] += 1
                    loss -= s[y]
                gw.append((f, g))
        i, before = 0, 0
        by_start = {i: (j, y) for (i, j), y in gold.items()}
        while i < n:
            j, y = by_start.get(i, (i + 1, 0))
            gt[before, y] += 1
            loss -= self.t[before, y]
            i, before = j, y
        for f, g in gw:
            if np.abs(g).max() > 1e-4:
                np.add.at(self.w, (slice(None), f), rate * g[:, None])
        self.t += rate * 0.2 * gt
        return float(loss)


def _luhn_number(r: np.random.Generator, n: int, valid: bool) -> str:
    d = "".join(str(x) for x in r.integers(0, 10, n - 1))
    good = next(c for c in "0123456789" if luhn(d + c))
    return d + (good if valid else str((int(good) + int(r.integers(1, 10))) % 10))


def examples(seed: int, count: int) -> Iterator[tuple[list[str], dict[tuple[int, int], int]]]:
    """Generated windows: tokens, and the kind of each gold segment."""
    r = np.random.Generator(np.random.PCG64(seed))
    pick = lambda *x: x[int(r.integers(0, len(x)))]
    num = lambda n: "".join(str(x) for x in r.integers(0, 10, n))
    word = lambda: "".join(pick(*"abdeghilmnorstu") for _ in range(int(r.integers(2, 8))))
    hexa = lambda n: "".join(pick(*"0123456789abcdef") for _ in range(n))
    for _ in range(count):
        kind = int(r.integers(0, 12))
        cue, tail = pick("", "", word() + " "), pick("", " " + word() + ".", ", " + word())
        if kind == 0:
            at, dot = pick((" at ", " dot "), (" [at] ", " [dot] "), ("(at)", "(dot)"), ("[at]", "."), (" (at) ", " (dot) "), (" @ ", "."))
            y, span = 1, word() + pick("", num(2)) + at + word() + dot + pick("com", "org", "net", "de", "co" + dot + "uk")
            cue += pick("", "email ", "mail: ", "contact ")
        elif kind == 1:
            y, span = 1, f"{pick(word(), num(2))}{pick('', '.' + word())}@{word()}{num(1)}.{word()}.com"
        elif kind == 2:
            q = [str(x) for x in r.integers(0, 256, 4)]
            y, span = 2, pick(".", ".", " . ").join(q)
            cue += pick("", "ip ", "host ", "server ")
        elif kind == 3:
            y, span = 2, ":".join(hexa(4) for _ in range(int(r.integers(6, 9))))
            cue += pick("", "ip ", "address ")
        elif kind == 4:
            y, d = 3, _luhn_number(r, 16, True)
            span = pick("{0}{1}{2}{3}", "{0} {1} {2} {3}", "{0}-{1}-{2}-{3}", "{0}.{1}.{2}.{3}", "{0}/{1}/{2}/{3}").format(d[:4], d[4:8], d[8:12], d[12:])
            cue += pick("", "card ", "visa: ")
        elif kind == 5:
            y = 4
            span = pick("+{0} ({1}) {2}-{3}", "({1}) {2}-{3}", "{1}-{2}-{3}", "+{0}.{1}.{2}.{3}", "+{0} {1} {2} {3}", "1-{1}-{2}-{3}").format(num(1), num(3), num(3), num(4))
            cue += pick("", "phone ", "call ", "tel: ")
        elif kind in (6, 7):
            y = 5
            cue += pick("token = \"", "api key: ", "secret = '", "token=", "password: ", "key = \"")
            span = pick(hexa(40), hexa(32), hexa(24), "sk" + hexa(30), "AK" + num(6) + hexa(14).upper())
            tail = ("\"" if cue.endswith("\"") else "'" if cue.endswith("'") else "") + tail
        else:  # look-alikes
            y = 0
            span = pick(
                lambda: f"{r.integers(1950, 2030)}-{r.integers(1, 13):02d}-{r.integers(1, 29):02d}", lambda: f"{r.integers(1, 29)}/{r.integers(1, 13)}/{r.integers(1950, 2030)}", lambda: f"{r.integers(0, 20)}.{r.integers(0, 20)}.{r.integers(0, 20)}",
                lambda: f"${r.integers(1, 999)},{num(3)}.{num(2)}", lambda: num(int(r.integers(1, 9))), lambda: _luhn_number(r, int(r.integers(14, 18)), False), lambda: num(3) + "." + num(2), lambda: "page " + num(3), lambda: f"9{num(2)}.{num(3)}.8{num(2)}.7{num(2)}",
                lambda: f"{num(4)}-{num(4)}", lambda: f"{num(1)},{num(3)},{num(3)}", lambda: word() + num(4), lambda: hexa(8), lambda: f"{num(2)}:{num(2)}:{num(2)}", lambda: "chapter " + num(2) + " dot " + word(), lambda: word() + " @" + word(), lambda: f"{num(5)} {num(5)} {num(5)}",
            )()
            cue += pick("", "version ", "order ", "price ", "date ")
        lead = " ".join(word() for _ in range(int(r.integers(1, 4)))) + pick(" ", ". ", "\n")
        tokens, gold = [], {}
        for k, part in enumerate((lead + cue, span, tail)):
            own = _TOKEN.findall(part)
            if k == 1 and y:
                gold[(len(tokens), len(tokens) + len(own))] = y
            tokens += own
        yield tokens, gold


@functools.lru_cache(maxsize=1)
def fitted(count: int = 420, rounds: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Weights after fitting on ``count`` generated windows."""
    model = Model()
    model.w[1:, _bucket("bias")] = -2
    for k in range(rounds):
        for tokens, gold in examples(11, count):
            model.step(tokens, gold, 0.3 / (1 + k))
    return model.w, model.t


def model_spans(text: str, model: Model) -> list[tuple[int, int, int]]:
    """(start, end, index of kind) of the model's segments."""
    marks = [m.start() for m in _MARK.finditer(text)]
    runs = [(m.start(), m.end()) for m in _RUN.finditer(text) if m.end() - m.start() > LONGEST]
    run_starts = [a for a, _ in runs]

    def run_at(place: int) -> tuple[int, int]:
        """The long unbroken run that a place is in, or the place alone."""
        x = bisect.bisect_right(run_starts, place) - 1
        return runs[x] if x >= 0 and place < runs[x][1] else (place, place + 1)

    out: list[tuple[int, int, int]] = []
    k = 0
    while k < len(marks):
        first = last = marks[k]
        k += 1
        # marks close to each other share a window, which stays short enough for its dynamic program; those of one
        # unbroken run always do
        while k < len(marks) and (marks[k] - last <= 24 and marks[k] - first <= 400 or marks[k] < run_at(last)[1]):
            last = marks[k]
            k += 1
        left, right = run_at(first)[0], run_at(last)[1]
        start = max(text.rfind("\n", 0, first) + 1, min(first - 80, left))
        stop = text.find("\n", last)
        stop = min(len(text) if stop < 0 else stop, max(last + 80, right))
        while start > 0 and start < left and text[start].isalnum() and text[start - 1].isalnum():
            start += 1
        while stop < len(text) and stop > right and text[stop - 1].isalnum() and text[stop].isalnum():
            stop -= 1
        if out and start < out[-1][1]:
            start = min(out[-1][1], first)
        at, spots = start, []
        for t in _TOKEN.findall(text[start:stop]):
            spots.append((at, t))
            at += len(t)
        near = [x for x, (p, t) in enumerate(spots) if p < right and p + len(t) > left]
        if not near:
            continue
        spots = spots[max(0, near[0] - 2 * AROUND) : near[-1] + 2 * AROUND]
        for i, j, y in model.decode([t for _, t in spots]):
            out.append((spots[i][0], spots[j - 1][0] + len(spots[j - 1][1]), y - 1))
    return out


def find(text: str, model: Model) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and all spans, in order of start, then kind."""
    base = base_spans(text)
    more = []
    if _MARK.search(text):
        taken = sorted((s, e) for s, e, _ in base)
        for s, e, k in model_spans(text, model):
            if s < e and not any(s < b and a < e for a, b in taken) and not any(s < b and a < e for a, b, _ in more):
                more.append((s, e, k))
    return base, sorted([*base, *more], key=lambda x: (x[0], x[2], x[1]))


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, e, k in spans)


def redact(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span, or union of spans that meet, replaced by the kind of its first."""
    out, at = [], 0
    for s, e, k in sorted(spans):
        if s >= at:
            out += [text[at:s], f"[{KINDS[k].upper()}]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def annotate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``n_email``, ``n_ip``, ``n_card``, ``n_phone`` (base spans), ``base_sha256``, ``spans``."""
    w, t = fitted()
    shared = docs.sparkSession.sparkContext.broadcast((w, t))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model()
        model.w, model.t = shared.value
        for b in chunks(batches):
            n: list[list[int]] = [[] for _ in BASE]
            digest, spans = [], []
            for text in b.column("text").to_pylist():
                base, all_ = find(text or "", model)
                for k, col in enumerate(n):
                    col.append(sum(x[2] == k for x in base))
                digest.append(hashlib.sha256(listed(base).encode()).hexdigest())
                spans.append(listed(all_))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(x, pa.int64()) for x in n), pa.array(digest, pa.string()), pa.array(spans, pa.string())], ["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redacted(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """All columns of ``docs``, spans in the text replaced by their kind in brackets; null text stays null."""
    w, t = fitted()
    shared = docs.sparkSession.sparkContext.broadcast((w, t))
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model()
        model.w, model.t = shared.value
        for b in batches:
            texts = [x if x is None or not _MARK.search(x) else redact(x, find(x, model)[1]) for x in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(texts, b.schema.field(at).type) if i == at else b.column(i) for i in range(b.num_columns)], schema=b.schema)

    return docs.mapInArrow(run, docs.schema)

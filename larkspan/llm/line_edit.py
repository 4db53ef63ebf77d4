"""Line dedup by a segment-partition edit join, in DataFrame operations alone.

Lines within edit distance ``TAU`` of each other are linked. Equal lines, told by two hashes, collapse to their first
occurrence. The others
are cut into ``TAU + 1`` segments of nearly equal length; of two linked lines, some segment of the shorter stands
unchanged in the longer, at a place that differs by few characters. So each line lists its own segments, with their
number and its length, and looks up the substrings of itself that could be such segments in lists of its length and of
up to ``TAU`` less (:func:`probes` has the places that suffice). Pairs that meet are screened by the letters that they
count (:func:`counts`: an edit changes two counts by one at most) and by twice the distance (:func:`nearby`), relieved of
common ends, and verified by a banded bit-parallel edit distance (:func:`edit_distance_within`): one word holds the band of a column, and a fold over the
characters of a line updates it. Lists of more than ``LIST`` lines only tell who looks them up; lines of both sides carry
their texts into a join of their own.

Of each class of linked lines the first in order of (document, line number, row) is kept. Lines of fewer than ``MIN_CHARS``
characters are too short to tell near copies from chance; with ``short`` their exact copies are classes too, else they
take no part. Empty lines never do. Null texts have no lines; empty texts one empty
line. Null ids take no part either. Every row's lines are its own, whether or not other rows have its id or its text; the
order of such rows is that in which they are read. Long texts and lines are worked on whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspan.llm.common import components, free_name, materialize, release

TAU = 2
MIN_CHARS = 24
#: Lines in a list that are paired before their texts are looked at.
LIST = 16
#: Rows up to which a counted set is broadcast (16 MB).
BROADCAST_ROWS = 1_000_000
#: Sets of characters whose counts are compared before distances are computed.
_SETS = ("eE", "tT", "aA", "oOnN", "iIsS", "rRhH", "lLdD", "uUcC", "0123456789", " .,")


def _segment(length: Column, i: int) -> tuple[Column, Column]:
    """Place (from 1) and length of segment ``i`` of a line; the later segments take the remainder."""
    base, more = F.call_function("div", length, F.lit(TAU + 1)).cast("int"), length % (TAU + 1)
    return F.lit(1) + base * i + F.greatest(F.lit(0), F.lit(i) - (TAU + 1 - more)), base + F.when(F.lit(i) >= TAU + 1 - more, 1).otherwise(0)


def _signatures(line: str, n: str, raw: str, parts: list[tuple[int, int, int]]) -> Column:
    """Hashes of parts (length less than the line's, segment, shift) of a line of ``n`` characters and bytes ``raw``, with
    length and segment. Where every character is a byte, bytes are cut, which takes no count of characters."""

    def hashes(cut) -> Column:
        out = []
        for less, i, shift in parts:
            length = F.col(n) - less
            place, size = _segment(length, i)
            out.append(F.xxhash64(length, F.lit(i), cut(place + shift, size)))
        return F.array(*out)

    plain = hashes(lambda place, size: F.substring(F.col(raw), place, size))
    return F.when(F.octet_length(line) == F.col(n), plain).otherwise(hashes(lambda place, size: F.substr(F.col(line), place, size).cast("binary")))


def segments(line: str = "line", n: str = "n", raw: str = "raw") -> Column:
    """Signatures of a line's own segments."""
    return _signatures(line, n, raw, [(0, i, 0) for i in range(TAU + 1)])


def probes(line: str = "line", n: str = "n", raw: str = "raw") -> Column:
    """Signatures to look up besides a line's own segments: for each length up to ``TAU`` less, and each segment of it,
    substrings whose shift leaves enough edits for what stands on either side."""
    parts = []
    for less in range(TAU + 1):
        for i in range(TAU + 1):
            for shift in range(max(-i, less - (TAU - i)), min(i, less + (TAU - i)) + 1):
                if less or shift:
                    parts.append((less, i, shift))
    return _signatures(line, n, raw, parts)


def counts(line: str = "line", n: str = "n") -> Column:
    """How many characters of each of some sets a line has."""
    return F.array(*(F.col(n) - F.length(F.translate(F.col(line), chars, "")) for chars in _SETS))


def countable(x: Column, y: Column) -> Column:
    """Whether counts of two lines leave room for ``TAU`` edits between them, of which each changes two by one at most."""
    apart = F.lit(0)
    for i in range(len(_SETS)):
        apart = apart + F.abs(F.get(x, F.lit(i)) - F.get(y, F.lit(i)))
    return apart <= 2 * TAU


def nearby(x: Column, y: Column) -> Column:
    """Whether two lines are within twice the edits of a link: keeps the pairs of a crowded list from leaving its join."""
    return F.levenshtein(x, y, 2 * TAU) >= 0


def edit_distance_within(a: Column, b: Column, tau: int = TAU) -> Column:
    """Whether the edit distance of two arrays of characters is ``tau`` at most, by banded bit-parallel dynamic programming.
    The arrays must be columns as stored: what is computed here would be computed again for each character.

    A column of the band is a word of ``2 * tau + 2`` bits: the highest stands for the row ``tau`` below the diagonal, the
    others for the rows above it in order. ``vp`` and ``vn`` hold the rows that exceed the row above by one, and fall
    short of it by one. The score is followed along the lower edge of the band while that has rows, then up the last
    column entries of the last row.
    """
    width = 2 * tau + 2
    full, high = (1 << width) - 1, 1 << (width - 1)
    first = F.size(a) >= F.size(b)
    x, y = F.when(first, a).otherwise(b), F.when(first, b).otherwise(a)
    p, q = F.size(x), F.size(y)

    def matches(i: Column) -> Column:
        c = F.get(y, i)
        bits = F.lit(0)
        for d in range(width):
            bits = bits + F.when(F.get(x, i + (tau - d)) == c, 1 << (width - 1 - d)).otherwise(0)
        return F.struct(i.alias("i"), bits.alias("eq"))

    def step(s: Column, m: Column) -> Column:
        vp, vn, eq = s["vp"], s["vn"], m["eq"]
        d0 = (((eq.bitwiseAND(vp) + vp).bitwiseXOR(vp)).bitwiseOR(eq).bitwiseOR(vn)).bitwiseAND(F.lit(full))
        hp = vn.bitwiseOR(F.lit(full).bitwiseXOR(d0.bitwiseOR(vp)))
        hn = d0.bitwiseAND(vp)
        below = F.shiftright(d0, 1)
        over = m["i"] - (p - tau)
        mark = F.lit(high >> 1) / F.pow(F.lit(2), over)
        row = F.when(over < 0, F.when(d0.bitwiseAND(F.lit(high)) == 0, 1).otherwise(0)).otherwise(F.when(hp.bitwiseAND(mark.cast("int")) != 0, 1).otherwise(0) - F.when(hn.bitwiseAND(mark.cast("int")) != 0, 1).otherwise(0))
        return F.struct(hn.bitwiseOR(F.lit(full).bitwiseXOR(below.bitwiseOR(hp))).alias("vp"), below.bitwiseAND(hp).alias("vn"), (s["score"] + row).cast("int").alias("score"))

    start = F.struct(F.lit(((1 << (tau + 1)) - 1) << (width - 1 - tau)).alias("vp"), F.lit(0).alias("vn"), F.lit(tau).alias("score"))
    score = F.aggregate(F.transform(F.sequence(F.lit(0), q - 1), matches), start, step)["score"]
    return F.coalesce(F.when(p - q > tau, False).when(q == 0, p <= tau).otherwise(score <= tau), F.lit(False))


def without_common_ends(pairs: DataFrame, x: str = "x", y: str = "y", steps: int = 5) -> DataFrame:
    """Strings ``x`` and ``y`` less most of what they begin and end with alike, which leaves their edit distance as it is."""
    for i in range(steps):
        n = F.floor(F.least(F.length(x), F.length(y)) / 2).cast("int")
        same = F.substr(F.col(x), F.lit(1), n) == F.substr(F.col(y), F.lit(1), n)
        pairs = pairs.withColumn("__n", F.when(same, n).otherwise(F.floor(n / 2).cast("int")))
        same = F.substr(F.col(x), F.lit(1), F.col("__n")) == F.substr(F.col(y), F.lit(1), F.col("__n"))
        pairs = pairs.withColumn("__n", F.when(same, F.col("__n")).otherwise(0)).withColumns({c: F.substr(F.col(c), F.col("__n") + 1) for c in (x, y)})
        n = F.floor(F.least(F.length(x), F.length(y)) / 2).cast("int")
        same = F.right(F.col(x), n) == F.right(F.col(y), n)
        pairs = pairs.withColumn("__n", F.when(same, n).otherwise(F.floor(n / 2).cast("int")))
        same = F.right(F.col(x), F.col("__n")) == F.right(F.col(y), F.col("__n"))
        pairs = pairs.withColumn("__n", F.when(same, F.col("__n")).otherwise(0)).withColumns({c: F.substr(F.col(c), F.lit(1), F.length(c) - F.col("__n")) for c in (x, y)})
    return pairs.drop("__n")


def lines_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row: str | None = None) -> DataFrame:
    """``doc_id``, ``line_no`` (from 0) and ``line`` of each line, and ``row``, the row's number, where a column has it."""
    keep = [F.col(row).alias("row")] if row else []
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), *keep, F.posexplode(F.split(F.col(text_col), "\n")).alias("line_no", "line"))


def _small(df: DataFrame) -> DataFrame:
    """A written table, to be broadcast if it is of a size for it."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def duplicate_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", short: bool = False, row: str | None = None) -> DataFrame:
    """``doc_id``, ``line_no``, ``class_doc_id``, ``class_line_no`` (the kept line) and ``kept`` of each line that has
    copies or near copies; ``row`` too where a column has it."""
    lines = lines_of(docs, id_col, text_col, row).where("doc_id is not null").where(F.length("line") >= (1 if short else MIN_CHARS))
    lines = materialize(lines.withColumns({"uid": F.monotonically_increasing_id(), "k": F.xxhash64("line"), "k2": F.xxhash64(F.lit("2"), "line"), "n": F.length("line")}))
    own_row = ["row"] if row else []
    place = F.struct("doc_id", "line_no", "uid")
    # a class of equal lines is known by the number of its first
    classes = lines.groupBy("k", "k2").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n"))
    copied = materialize(classes.where("n > 1").select("k", "k2", "first", F.col("first.uid").alias("rep")))
    copied_small = _small(copied)
    repeats = materialize(lines.select("uid", "k", "k2").join(copied_small, ["k", "k2"]).where("uid <> rep").select("uid", "rep"))
    repeats_small = _small(repeats)
    single = lines.where(F.col("n") >= MIN_CHARS).join(repeats_small, "uid", "left_anti").select("uid", "line", "n")
    # arrays are columns of their own so that what their parts share is computed once a line
    sized = single.withColumn("raw", F.col("line").cast("binary"))
    own = materialize(sized.withColumn("sigs", segments()).select("uid", F.explode("sigs").alias("sig")))
    sought = sized.withColumn("sigs", probes()).select("uid", F.explode("sigs").alias("sig"))
    long = materialize(own.groupBy("sig").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > LIST).select("sig"))
    crowds = long.count()
    hint = F.broadcast if crowds <= BROADCAST_ROWS else (lambda df: df)
    # a long list is one row without a line, which only tells who looks it up
    lists = own.join(hint(long), "sig", "left_anti").unionByName(long.withColumn("uid", F.lit(None).cast("long"))) if crowds else own
    met = lists.alias("o").join(sought.unionByName(own).alias("s"), "sig").where("o.uid is null or o.uid <> s.uid")
    met = materialize(met.select(F.when(F.col("o.uid").isNull(), F.col("sig")).alias("sig"), F.least("o.uid", "s.uid").alias("a"), F.when(F.col("o.uid").isNotNull(), F.greatest("o.uid", "s.uid")).alias("b")).distinct())
    pairs = met.where("sig is null").select("a", "b")
    seekers = met.where("sig is not null").select("sig", F.col("a").alias("uid"))
    members = own.join(hint(long), "sig", "left_semi")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("uid")).unionByName(seekers.select("uid"))
    wanted = materialize((wanted.unionByName(members.select("uid")) if crowds else wanted).distinct())
    texts = materialize(single.join(_small(wanted), "uid", "left_semi").withColumn("c", counts()).select("uid", "line", "c"))
    near = pairs.join(texts.select(F.col("uid").alias("a"), F.col("line").alias("x"), F.col("c").alias("cx")), "a").join(texts.select(F.col("uid").alias("b"), F.col("line").alias("y"), F.col("c").alias("cy")), "b")
    near = near.where(countable(F.col("cx"), F.col("cy")) & nearby(F.col("x"), F.col("y"))).select("a", "b", "x", "y")
    if crowds:
        here, there = members.join(texts, "uid"), seekers.join(texts, "uid")
        meet = (F.col("o.sig") == F.col("s.sig")) & (F.col("o.uid") != F.col("s.uid")) & countable(F.col("o.c"), F.col("s.c")) & nearby(F.col("o.line"), F.col("s.line"))
        less = F.col("o.uid") < F.col("s.uid")
        crowded = here.alias("o").join(there.alias("s"), meet).select(F.least("o.uid", "s.uid").alias("a"), F.greatest("o.uid", "s.uid").alias("b"), F.when(less, F.col("o.line")).otherwise(F.col("s.line")).alias("x"), F.when(less, F.col("s.line")).otherwise(F.col("o.line")).alias("y"))
        near = near.unionByName(crowded.groupBy("a", "b").agg(F.first("x").alias("x"), F.first("y").alias("y")))
    cut = materialize(without_common_ends(near).select("a", "b", F.split("x", "").alias("x"), F.split("y", "").alias("y")))
    links = materialize(cut.where(edit_distance_within(F.col("x"), F.col("y"))).select("a", "b").distinct())
    release(cut, own, long, met, wanted, texts)
    comp = materialize(components(links).select(F.col("node").alias("rep"), "component"))
    # first of each class, from one row for each distinct line in it
    ends = lines.join(_small(comp), F.col("uid") == F.col("rep")).select("rep", "component", place.alias("first"))
    ends = ends.unionByName(copied.join(comp.select("rep"), "rep", "left_anti").select("rep", F.col("rep").alias("component"), "first"))
    firsts = ends.groupBy("component").agg(F.min("first").alias("first"))
    kept = _small(materialize(ends.select("rep", "component").join(firsts, "component").select("rep", "first")))
    # repeats by the number of their first line, first lines by their own
    part = lines.select("uid", "doc_id", *own_row, "line_no").join(repeats_small, "uid", "left").withColumn("rep", F.coalesce("rep", "uid"))
    out = materialize(part.join(kept, "rep").select("doc_id", *own_row, "line_no", F.col("first.doc_id").alias("class_doc_id"), F.col("first.line_no").alias("class_line_no"), (F.col("first.uid") == F.col("uid")).alias("kept")))
    release(lines, copied, repeats, links, comp, kept)
    return out


def without_duplicate_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_left: float = 0.0) -> DataFrame:
    """``docs`` with every line that is not the first of its class left out of the text.

    A document of which only blank lines are left goes; so does one that keeps less than the share ``least_left`` of its
    characters, and so is a near copy of others, unless a line of it is the one kept for others. All other rows, with no such line, stay as they
    are.
    """
    row, found, cut, holds = (free_name(docs, c) for c in ("row", "found", "cut", "holds"))
    numbered = materialize(docs.withColumn(row, F.monotonically_increasing_id()))
    gone = duplicate_lines(numbered, id_col, text_col, row=row).groupBy(F.col("row").alias(found)).agg(F.collect_set(F.when(~F.col("kept"), F.col("line_no"))).alias(cut), F.max("kept").alias(holds))
    gone = materialize(gone.where(F.size(cut) > 0))
    n = gone.agg(F.count(F.lit(1)), F.sum(F.size(cut))).first()
    few = n[0] <= BROADCAST_ROWS and (n[1] or 0) <= 4 * BROADCAST_ROWS  # 16 MB of line numbers
    marked = numbered.join(F.broadcast(gone) if few else gone, F.col(row) == F.col(found), "left")
    left = F.array_join(F.filter(F.split(F.col(text_col), "\n"), lambda x, i: ~F.array_contains(F.col(cut), i)), "\n")
    marked = marked.withColumn(found, F.when(F.col(found).isNotNull(), left))
    enough = (F.length(F.trim(found)) > 0) & (F.col(holds) | (F.length(found) >= least_left * F.length(text_col)))
    rows = marked.where(F.col(found).isNull() | enough)
    return rows.select(*(F.coalesce(found, text_col).alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns))

"""Long exact spans shared between texts.

Problem 9.  The method named hashes runs of whole sentences.  Such runs alone
can't find every shared stretch of a given length: it may lie inside one long
sentence, or touch no sentence end.  So the spans are anchored at sentence
starts where there are any, and inside long sentences at content-defined
places: of every window of consecutive positions the one of highest priority is
an anchor, sentence starts before all others, these by the hash of what
follows.  Each anchor's span of SPAN characters is hashed.  With
WINDOW + SPAN < least, every shared stretch of ``least`` code points holds a
whole window and the span of its anchor, in both texts.

1. Equal texts are collapsed to one representative with its members.
2. Span hashes are joined globally; those of one text only are dropped.
3. Spans of few texts give pairs of texts with an offset between them.  Spans
   that follow each other at one offset are chained; a chain of ``least``
   characters or more is a find.  Shorter chains are extended character by
   character from the texts around them.
4. Spans of many texts never give all their pairs: every stretch of ``least``
   characters around them is hashed instead, and only texts that share such a
   stretch meet, each set of texts once.

``kept_texts`` is the method's other half, on whole sentences: every run of RUN
consecutive sentences is hashed and joined globally, and the sentences covered
by any occurrence of a repeated run but the first are removed.

Defined results: null texts and texts shorter than ``least`` share nothing;
texts of any length are taken whole; a text that repeats itself isn't paired
with itself; repeated rows count once; other columns are ignored.  In
``kept_texts`` a null text gives an empty one, texts of fewer sentences than a
run stay, and a run that a text repeats itself is removed there, too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from normloom.runtime import written

#: Code points of a stretch that counts as shared.
LEAST = 300
#: Texts above which a span's pairs are not formed but its stretches hashed.
MANY = 48
#: Sentences of a run, and characters it must have; a sentence with the signs and white space that end it.
RUN, RUN_CHARS = 3, 60
SENTENCE = r"[^.!?\n]+[.!?\n]*[ \t\r\n]*|[.!?\n]+[ \t\r\n]*"
#: Code points that are handled at once.
BATCH_CHARS = 1 << 20
#: Code points whose hash gives the priority of a place that isn't a sentence start.
GRAM = 8

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    size = 1 << max(16, (n - 1).bit_length())
    if size not in _POWERS:
        _POWERS.clear()
        inverse = pow(int(_BASE), -1, 1 << 64)
        with np.errstate(over="ignore"):
            up, down = np.full(size, _BASE), np.full(size, np.uint64(inverse))
            up[0] = down[0] = 1
            _POWERS[size] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _POWERS[size]


class Rolling:
    """Hashes of stretches of a code point array."""

    def __init__(self, codes: np.ndarray):
        up, self.down = _powers(len(codes) + 1)
        with np.errstate(over="ignore"):
            self.sums = np.zeros(len(codes) + 1, np.uint64)
            np.cumsum(_mix(codes.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019)) * up[: len(codes)], out=self.sums[1:])

    def hash(self, at: np.ndarray, n: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return _mix((self.sums[at + n] - self.sums[at]) * self.down[at])

    def every(self, n: int) -> np.ndarray:
        """Unmixed hashes of all stretches of n."""
        m = len(self.sums) - n
        if m <= 0:
            return np.zeros(0, np.uint64)
        with np.errstate(over="ignore"):
            return (self.sums[n:] - self.sums[:m]) * self.down[:m]


def _sliding(x: np.ndarray, w: int, op: np.ufunc) -> np.ndarray:
    """op over every w consecutive values, in three passes whatever w is."""
    n = len(x) - w + 1
    pad = (-len(x)) % w
    filled = np.concatenate([x, np.full(pad, x[-1], x.dtype)]).reshape(-1, w)
    left = op.accumulate(filled, axis=1).reshape(-1)
    right = np.ascontiguousarray(op.accumulate(filled[:, ::-1], axis=1)[:, ::-1]).reshape(-1)
    return op(right[:n], left[w - 1 : w - 1 + n])


def widths(least: int) -> tuple[int, int]:
    """Window and span whose sum stays below ``least``; one code point before an anchor decides on it, too."""
    span = least // 2
    return least - span - 2, span


def sentence_starts(codes: np.ndarray) -> np.ndarray:
    """Positions after a sentence end and white space, after a line break or after a tag."""
    white = (codes == 32) | (codes == 10) | (codes == 0xA0) | (codes == 9) | (codes == 13)
    stop = (codes == ord(".")) | (codes == ord("!")) | (codes == ord("?")) | (codes == ord(":")) | (codes == ord(";")) | (codes == ord(">"))
    start = np.zeros(len(codes), bool)
    start[2:] = (stop[:-2] & white[1:-1] | (codes[1:-1] == 10)) & ~white[2:]
    return start


def anchors(codes: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """Positions and span hashes of the anchors of texts laid end to end."""
    window, span = widths(least)
    if len(codes) < least:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    rolling = Rolling(codes)
    n = len(codes) - span + 1  # places where a span fits
    rank = (_mix(rolling.every(GRAM)[:n]) >> np.uint64(33)).astype(np.uint32)
    rank[~sentence_starts(codes)[:n]] |= np.uint32(0x80000000)
    best = _sliding(rank, window, np.minimum)
    # A place is an anchor if it is the best of some window over it.
    most = _sliding(np.concatenate([np.zeros(window - 1, np.uint32), best, np.zeros(window - 1, np.uint32)]), window, np.maximum)
    at = np.flatnonzero(rank == most)
    return at, rolling.hash(at, span)


def _laid(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the texts with a line break after each, and where each text ends."""
    joined = "\n".join(texts) + "\n"
    return np.frombuffer(joined.encode("utf-32-le"), np.uint32), np.cumsum([len(t) + 1 for t in texts]) - 1


def _groups(texts: list[str]) -> Iterator[tuple[int, int]]:
    first, total = 0, 0
    for i, t in enumerate(texts):
        if i > first and total + len(t) > BATCH_CHARS:
            yield first, i
            first, total = i, 0
        total += len(t)
    if first < len(texts):
        yield first, len(texts)


def _anchor_table(texts: DataFrame, least: int) -> DataFrame:
    """(id, at, h) for every anchor of every text."""
    kind = dict(texts.dtypes)["id"]
    span = widths(least)[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column(1).to_pylist()
            for a, b in _groups(found):
                codes, ends = _laid(found[a:b])
                at, h = anchors(codes, least)
                text = np.searchsorted(ends, at)
                whole = at + span <= ends[text]
                at, h, text = at[whole], h[whole], text[whole]
                start = np.concatenate([[0], ends[:-1] + 1])[text]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(text + a)), pa.array((at - start).astype(np.int32)), pa.array(h.view(np.int64))], ["id", "at", "h"])

    return texts.select("id", "text").mapInArrow(run, f"id {kind}, at int, h long")


def _stretches(texts: DataFrame, spots: DataFrame, least: int) -> DataFrame:
    """(id, start, g): hashes of all stretches of ``least`` that hold the span of a spot (id, at)."""
    kind = dict(texts.dtypes)["id"]
    window, span = widths(least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (text, at) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
                spots = np.asarray(at, np.int64)
                start = np.unique((spots[:, None] - np.arange(least - span + 1)).reshape(-1))
                start = start[(start >= 0) & (start + least <= len(codes))]
                g = Rolling(codes).hash(start, least)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.full(len(g), i))), pa.array(start.astype(np.int32)), pa.array(g.view(np.int64))], ["id", "start", "g"])

    grouped = spots.groupBy("id").agg(F.collect_set("at").alias("at"))
    return texts.join(grouped, "id").select("id", "text", "at").mapInArrow(run, f"id {kind}, start int, g long")


def _common(a: str, b: str, back: bool) -> int:
    n = min(len(a), len(b))
    if back:
        a, b = a[len(a) - n :][::-1], b[len(b) - n :][::-1]
    x = np.frombuffer(a[:n].encode("utf-32-le"), np.uint32) != np.frombuffer(b[:n].encode("utf-32-le"), np.uint32)
    return int(x.argmax()) if x.any() else n


def _classes(documents: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """Texts long enough (id, text), and membership (id, member) in classes of equal ones, named by the smallest."""
    rows = documents.filter(F.col("doc_id").isNotNull() & (F.length("text") >= least)).select(F.col("doc_id").alias("member"), "text")
    # Texts are compared by two independent 64-bit hashes and their length; the text itself isn't shuffled.
    hashes = rows.select("member", F.xxhash64("text").alias("x"), F.xxhash64(F.lit(7), "text").alias("y"), F.length("text").alias("n"))
    first = hashes.groupBy("x", "y", "n").agg(F.min("member").alias("id"))
    members = written(hashes.join(first, ["x", "y", "n"]).select("id", "member").distinct(), "members")
    return rows.select(F.col("member").alias("id"), "text"), members


def _repeated(texts: DataFrame, members: DataFrame, least: int) -> DataFrame:
    """(id, at, h, n): the anchors of representatives whose span stands in more than one of them, and how often it stands anywhere."""
    # Copies are left out here and not before: anchors are small, texts would have to be shuffled.
    copies = members.filter("id != member").select(F.col("member").alias("id"))
    table = written(_anchor_table(texts, least).join(copies, "id", "left_anti"), "anchors")
    # Counted before they are moved, so a span of many texts is no large group; repeated ones are few, and beyond a
    # broadcast's size the join splits keys of many rows.
    per_hash = table.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("lo"), F.max("id").alias("hi")).filter("lo != hi").select("h", "n")
    return written(table.join(written(per_hash, "spans"), "h"), "repeated")


def shared_spans(documents: DataFrame, least: int = LEAST, many: int = MANY) -> tuple[DataFrame, DataFrame]:
    """Finds between representatives, and membership.

    The first table (id_a, id_b, at_a, at_b, length) has a row for each chain found between two different
    texts; ``length`` is what is proven, at least ``least`` (for spans of many texts one stretch of ``least``).  The second
    (id, member) names the texts equal to each representative, itself among them.
    """
    span = widths(least)[1]
    texts, members = _classes(documents, least)
    kept = _repeated(texts, members, least)
    few = kept.filter(F.col("n") <= many)

    ids = F.array_sort(F.collect_list(F.struct("id", "at")))
    pairs = few.groupBy("h").agg(ids.alias("m")).select(F.explode(F.expr("flatten(transform(m, (x, i) -> transform(slice(m, i + 2, size(m)), y -> struct(x as a, y as b))))")).alias("p"))
    hits = pairs.filter("p.a.id != p.b.id").select(F.col("p.a.id").alias("id_a"), F.col("p.b.id").alias("id_b"), F.col("p.a.at").alias("at"), (F.col("p.b.at") - F.col("p.a.at")).alias("shift"))
    # Spans that overlap or touch at one offset are one chain.
    w = Window.partitionBy("id_a", "id_b", "shift").orderBy("at")
    breaks = F.coalesce((F.col("at") > F.lag("at").over(w) + span).cast("int"), F.lit(1))
    chained = hits.distinct().withColumn("b", breaks).withColumn("chain", F.sum("b").over(w))
    chains = chained.groupBy("id_a", "id_b", "shift", "chain").agg(F.min("at").alias("at"), (F.max("at") + span).alias("to")).drop("chain")
    chains = written(chains, "chains")
    proven = chains.filter(F.col("to") - F.col("at") >= least)
    # Others need the characters around them, at most what is missing on either side.
    short = chains.filter(F.col("to") - F.col("at") < least)
    spots = short.select(F.col("id_a").alias("id"), "at", "to").unionByName(short.select(F.col("id_b").alias("id"), (F.col("at") + F.col("shift")).alias("at"), (F.col("to") + F.col("shift")).alias("to"))).distinct()
    miss = F.lit(least) - (F.col("to") - F.col("at"))
    start = F.greatest(F.col("at") - miss, F.lit(0))
    around = texts.join(spots, "id").select("id", "at", "to", F.substr("text", start + 1, F.col("at") - start).alias("before"), F.substr("text", F.col("to") + 1, miss).alias("after"))
    around = written(around, "around")
    side = lambda s: around.select(F.col("id").alias(f"id_{s}"), F.col("at").alias(f"at_{s}"), F.col("to").alias(f"to_{s}"), F.col("before").alias(f"before_{s}"), F.col("after").alias(f"after_{s}"))
    ends = short.withColumns({"at_a": F.col("at"), "to_a": F.col("to"), "at_b": F.col("at") + F.col("shift"), "to_b": F.col("to") + F.col("shift")}).drop("at", "to", "shift")
    both = ends.join(side("a"), ["id_a", "at_a", "to_a"]).join(side("b"), ["id_b", "at_b", "to_b"])

    def extend(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            left = np.array([_common(p, q, True) for p, q in zip(x["before_a"], x["before_b"], strict=True)], np.int64)
            right = np.array([_common(p, q, False) for p, q in zip(x["after_a"], x["after_b"], strict=True)], np.int64)
            out = pd.DataFrame({"id_a": x["id_a"], "id_b": x["id_b"], "at_a": x["at_a"] - left, "at_b": x["at_b"] - left, "length": x["to_a"] - x["at_a"] + left + right})
            yield out[out["length"] >= least]

    kind = dict(texts.dtypes)["id"]
    shape = f"id_a {kind}, id_b {kind}, at_a int, at_b int, length int"
    finds = proven.select("id_a", "id_b", F.col("at").alias("at_a"), (F.col("at") + F.col("shift")).alias("at_b"), (F.col("to") - F.col("at")).alias("length"))
    finds = finds.unionByName(both.mapInPandas(extend, shape))

    big = kept.filter(F.col("n") > many).select("id", "at")
    if not big.isEmpty():
        finds = finds.unionByName(_met(_stretches(texts, big, least).groupBy("id", "g").agg(F.min("start").alias("start")), least))
    return finds, members


def _met(stretches: DataFrame, least: int, salts: int = 16) -> DataFrame:
    """Pairs of texts that share a stretch; stretches with one and the same set of texts are taken once."""
    mixed = F.xxhash64("id")
    sets = stretches.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(mixed).alias("x"), F.sum(mixed % (1 << 40)).alias("s")).filter("n > 1")
    once = sets.groupBy("n", "x", "s").agg(F.min("g").alias("g")).select("g")
    held = stretches.join(once, "g")
    left = held.select("g", F.col("id").alias("id_a"), F.col("start").alias("at_a"), F.pmod(F.xxhash64("id"), F.lit(salts)).alias("salt"))
    right = held.select("g", F.col("id").alias("id_b"), F.col("start").alias("at_b"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).alias("salt"))
    met = left.join(right, ["g", "salt"]).filter("id_a < id_b").groupBy("id_a", "id_b").agg(F.min(F.struct("at_a", "at_b")).alias("p"))
    return met.select("id_a", "id_b", "p.at_a", "p.at_b", F.lit(least).alias("length"))


def found(documents: DataFrame, least: int = LEAST, many: int = MANY) -> DataFrame:
    """p9_found: (doc_id_a, doc_id_b), all pairs, members of equal texts included."""
    finds, members = shared_spans(documents, least, many)
    pairs = finds.select("id_a", "id_b").distinct()
    of = lambda s: members.select(F.col("id").alias(f"id_{s}"), F.col("member").alias(f"m_{s}"))
    across = pairs.join(of("a"), "id_a").join(of("b"), "id_b").select("m_a", "m_b")
    # Equal texts share themselves; only representatives with other members take part.
    several = members.filter("id != member").select("id").distinct()
    own = members.join(several, "id")
    within = own.select("id", F.col("member").alias("m_a")).join(own.select("id", F.col("member").alias("m_b")), "id").filter("m_a < m_b").select("m_a", "m_b")
    every = across.unionByName(within)
    return every.select(F.least("m_a", "m_b").alias("doc_id_a"), F.greatest("m_a", "m_b").alias("doc_id_b")).distinct()


def shared_share(documents: DataFrame, least: int = LEAST) -> DataFrame:
    """(doc_id, class_id, n_chars, shared_chars, share) for each text: how much of it stands elsewhere, too.

    Shared is what lies in a stretch of ``least`` code points that another text has, too; a text
    with an equal one is shared whole.  No pairs are formed.
    """
    texts, members = _classes(documents, least)
    stretches = written(_stretches(texts, _repeated(texts, members, least).select("id", "at"), least), "stretches")
    common = stretches.groupBy("g").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).filter("lo != hi").select("g")
    starts = stretches.join(common, "g", "left_semi").select("id", "start").distinct()
    # Each start covers ``least`` characters, or those up to the next one.
    ahead = F.lead("start").over(Window.partitionBy("id").orderBy("start")) - F.col("start")
    covered = starts.withColumn("own", F.least(F.coalesce(ahead, F.lit(least)), F.lit(least))).groupBy("id").agg(F.sum("own").alias("shared"))
    several = members.groupBy("id").agg((F.count(F.lit(1)) > 1).alias("copied"))
    lengths = documents.select(F.col("doc_id").alias("member"), F.length("text").alias("n_chars")).filter("member is not null").distinct()
    out = lengths.join(members, "member", "left").join(several, "id", "left").join(covered, "id", "left")
    n = F.coalesce(F.col("n_chars"), F.lit(0))
    shared = F.when(F.col("copied"), n).otherwise(F.coalesce("shared", F.lit(0))).cast("long")
    return out.select(F.col("member").alias("doc_id"), F.coalesce("id", "member").alias("class_id"), n.cast("long").alias("n_chars"), shared.alias("shared_chars"), F.when(n > 0, F.round(shared / n, 6)).otherwise(0.0).alias("share"))


def kept_texts(documents: DataFrame, run: int = RUN, chars: int = RUN_CHARS) -> DataFrame:
    """(doc_id, sentences, removed, kept): each text without the sentences that a repeated run covers.

    The first occurrence of a run, by document and place, stays; of every other one all its sentences go.
    """
    rows = documents.filter(F.col("doc_id").isNotNull()).select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("x", F.xxhash64("text"))
    rows = rows.dropDuplicates(["doc_id", "x"]).select("doc_id", F.regexp_extract_all("text", F.lit(SENTENCE), F.lit(0)).alias("s"))
    hashed = rows.select("doc_id", F.transform("s", lambda x: F.struct(F.xxhash64(x).alias("x"), F.xxhash64(F.lit(7), x).alias("y"), F.length(x).alias("n"))).alias("s"))
    starts = F.when(F.size("s") >= run, F.sequence(F.lit(1), F.size("s") - run + 1))
    runs = hashed.select("doc_id", "s", F.explode(starts).alias("at"))
    parts = [F.try_element_at("s", F.col("at") + i) for i in range(run)]
    total = sum((p["n"] for p in parts[1:]), parts[0]["n"])
    runs = runs.filter(total >= chars).select("doc_id", "at", F.xxhash64(*[p["x"] for p in parts]).alias("x"), F.xxhash64(*[p["y"] for p in parts]).alias("y"))
    runs = written(runs, "runs")
    repeated = runs.groupBy("x", "y").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "at")).alias("first")).filter("n > 1").select("x", "y", "first")
    later = runs.join(written(repeated, "repeated_runs"), ["x", "y"]).filter((F.col("first.doc_id") != F.col("doc_id")) | (F.col("first.at") != F.col("at")))
    covered = later.select("doc_id", F.explode(F.sequence("at", F.col("at") + run - 1)).alias("i")).groupBy("doc_id").agg(F.collect_set("i").alias("gone"))
    left = F.array_except(F.when(F.size("s") > 0, F.sequence(F.lit(1), F.size("s"))).otherwise(F.array().cast("array<int>")), F.coalesce("gone", F.array().cast("array<int>")))
    kept = F.array_join(F.transform(left, lambda i: F.try_element_at("s", i)), "")
    return rows.join(covered, "doc_id", "left").select("doc_id", F.size("s").alias("sentences"), F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).alias("removed"), kept.alias("kept"))

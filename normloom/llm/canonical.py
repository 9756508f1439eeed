"""Free-entered names mapped to the entries of a reference list.

Problem 4.  Values are deduplicated and normalised.  Every entry stands in a
character n-gram inverted index with its name, its abbreviation and the common
shortenings of both.  A value is scored with all spellings by the cosine of
n-gram vectors weighted by inverse document frequency.  The best entry must
reach LEAST_COSINE and lead the next one by NEAR; entries within NEAR of the
best are told apart letter by letter.  An exact check follows: the edits (a swap
of neighbours being one) must stay below what the value's length allows, from
none for abbreviations to MOST_EDITS for long names, in all and in the stem
alone, and the next entry within NEAR must be MARGIN edits behind.  A name whose
first word is cut off with a stop or a dash agrees with the one entry that
reaches LEAST_COSINE and fits both parts.

Reference lists of bounded size are broadcast as an index; larger ones are
joined on n-grams.  There a value looks up only its rarest n-grams: what shares
none of them has a cosine below LEAST_COSINE for certain, as the others' weights
are too small together.

Defined results: null, empty and general words let the second text speak; what
names no entry is -1; of repeated rows one counts; an empty list maps
everything to -1; other columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from normloom.runtime import default_parallelism, written

UNMATCHED = -1
#: Characters of an n-gram; the least cosine of a candidate, and how far behind the best one the next must be to be left out.
GRAM, LEAST_COSINE, NEAR = 3, 0.25, 0.12
#: Edits allowed at most; letters without any, and letters for each edit beyond these.
MOST_EDITS, EXACT_LETTERS, EDIT_LETTERS = 5, 9, 1
#: Letters of the stem for each edit allowed there; edits the next entry must be behind.
STEM_LETTERS, MARGIN = 5, 1
#: Entries of a reference list that is broadcast.
BROADCAST_ENTRIES = 20_000
#: Different values that one task maps.
VALUES_A_TASK = 20_000

# Endings of German acts, their shortenings and inflections.
ENDINGS = {
    "gesetzbuch": ("gesetzbuch", "gesetzbuches", "gesetzbuchs", "gesb", "gb"),
    "gesetz": ("gesetz", "gesetzes", "ges", "g"),
    "verordnung": ("verordnung", "verordnungen", "verordn", "vo", "v"),
    "ordnung": ("ordnung", "ordnungen", "ordn", "o"),
}
# Words that name no particular act, and what may stand before them.
GENERAL = frozenset(
    """gesetz gesetzes gesetze gesetzbuch gesetzbuches gesetzbuchs verordnung verordnungen ordnung ordnungen vorschrift vorschriften regelung regelungen
    bestimmung bestimmungen absatz absatzes abs satz satzes nummer nr artikel artikels art paragraph paragraphen par anlage anhang richtlinie kapitel
    abschnitt teil titel buchstabe halbsatz unterabsatz rechtsverordnung anordnung norm normen law act ordinance regulation section code""".split()
)
ARTICLES = frozenset("der die das des dem den dieses dieser diese diesem diesen ein eine einer eines einem jenes jener the this a".split())

_FOLD = str.maketrans({"ä": "ae", "ö": "oe", "ü": "ue", "ß": "ss", "­": None, "​": None, "‌": None, "‍": None, "﻿": None})
_LEAD = re.compile(r"^(?:(?:i\.?\s?v\.?\s?m\.|gem\.|gemaess|gem[aä]ß|nach|vgl\.|siehe|s\.|dt\.|deutsche[rsn]?|" + "|".join(sorted(ARTICLES, key=len, reverse=True)) + r")\s+)+")
_TRAIL = re.compile(r"(?:\s*\((?:neufassung|[^()]*fassung[^()]*|alt|neu)\)|\s+(?:a\.?\s?f\.?|n\.?\s?f\.?|(?:idf|i\.d\.f\.)(?:\s.*)?|(?:v\.|vom|von)\s?\d.*))+$")
_CITED = re.compile(r"^\s*(?:(?:nach|gem\.|gemäß|i\.\s?v\.\s?m\.|vgl\.|siehe)\s+)*(?:§§?|art\.|artikel|par\.)?\s*\d+\s*[a-z]?\b(?:\s*(?:,|und|bis|-|–|f\.|ff\.)\s*(?:\d+\s*[a-z]?\b)?)*(?:\s*(?:abs\.|absatz|satz|nr\.|nummer|s\.)\s*\d+[a-z]?\b)*", re.I)
_QUOTES = "\"'„“”‚‘’«»`"


def folded(text: str) -> str:
    return unicodedata.normalize("NFKC", text).lower().translate(_FOLD)


def cleaned(text: str | None) -> str:
    """Lower case without quotes, articles, dress and outer signs; inner breaks remain."""
    if not text:
        return ""
    s = unicodedata.normalize("NFKC", unicodedata.normalize("NFC", text)).lower()
    s = " ".join(s.translate({ord(q): None for q in _QUOTES}).split()).strip(" ,;:.")
    for _ in range(3):
        before = s
        s = _TRAIL.sub("", _LEAD.sub("", s)).strip(" ,;:.")
        if s == before:
            break
    return s.translate(_FOLD)


def letters(clean: str) -> str:
    """Only letters and numbers; digits between letters are read as the letters they resemble."""
    s = re.sub(r"[^0-9a-z]", "", clean)
    # What scanned text has for letters.
    return re.sub(r"[01](?=[a-z])|(?<=[a-z])[01]", lambda m: {"0": "o", "1": "l"}[m[0]], s)


def blurred(s: str) -> str:
    """Letters that scanned text mixes up, as one; the same on both sides."""
    return s.replace("rn", "m").replace("vv", "w")


def says_nothing(text: str | None) -> bool:
    """Null, empty, or only a general word with or without article."""
    if not text:
        return True
    words = [w for w in re.findall(r"[^\W_]+", unicodedata.normalize("NFKC", text).lower()) if w not in ARTICLES]
    return not words or (len(words) == 1 and words[0] in GENERAL)


def named(book: str | None, span: str | None) -> str:
    """The text that names the entry: the value, or what follows the numbers of the cited span."""
    if not says_nothing(book):
        return cleaned(book)
    if not span:
        return ""
    rest = _CITED.sub("", unicodedata.normalize("NFKC", span), count=1)
    return "" if says_nothing(rest) else cleaned(rest)


def ending(name: str) -> tuple[str, str]:
    """Stem and kind of a folded name."""
    for kind in ENDINGS:
        if name.endswith(kind):
            return name[: -len(kind)], kind
    return name, ""


def spellings(name: str, short: str) -> set[str]:
    """The name with every ending of its kind, and the abbreviation."""
    stem, kind = ending(letters(cleaned(name)))
    out = {stem + e for e in ENDINGS.get(kind, ("",))} | {letters(cleaned(short))}
    return {s for s in out if s}


def grams(s: str) -> Counter:
    padded = f"^^{s}$"
    return Counter(padded[i : i + GRAM] for i in range(len(padded) - GRAM + 1))


class Index:
    """Posting lists: for each n-gram the spellings that hold it, with weights."""

    def __init__(self, entries: list[tuple[int, str | None, str | None]]):
        self.entry, self.text = [], []
        for key, short, name in sorted(entries, key=lambda e: e[0]):
            for s in sorted(spellings(name or "", short or "")):
                self.entry.append(key)
                self.text.append(s)
        self.keys = np.array(self.entry, np.int64)
        self.spelled: dict[int, list[str]] = defaultdict(list)
        for k, t in zip(self.entry, self.text, strict=True):
            self.spelled[k].append(t)
        self.names = {key: letters(cleaned(name or "")) for key, _, name in entries}
        holds = [grams(s) for s in self.text]
        df = Counter(g for h in holds for g in h)
        self.idf = {g: np.log(1 + len(self.text) / n) for g, n in df.items()}
        self.rare = np.log(1 + len(self.text))
        lists: dict[str, list] = defaultdict(list)
        for i, h in enumerate(holds):
            weights = {g: n * self.idf[g] for g, n in h.items()}
            length = np.sqrt(sum(w * w for w in weights.values()))
            for g, w in weights.items():
                lists[g].append((i, w / length))
        self.lists = {g: (np.array([i for i, _ in x]), np.array([w for _, w in x])) for g, x in lists.items()}
        # Entries whose spellings stand next to each other.
        self.first = np.flatnonzero(np.diff(self.keys, prepend=self.keys[0] - 1)) if len(self.keys) else np.zeros(0, int)

    def scores(self, s: str) -> np.ndarray:
        """The cosine of every spelling with the value."""
        g = grams(s)
        weights = {x: n * self.idf.get(x, self.rare) for x, n in g.items()}
        length = np.sqrt(sum(w * w for w in weights.values()))
        got = [(self.lists[x], w) for x, w in weights.items() if x in self.lists]
        if not got:
            return np.zeros(len(self.keys))
        at, value = np.concatenate([p[0] for p, _ in got]), np.concatenate([p[1] * w for p, w in got])
        return np.bincount(at, value, len(self.keys)) / length

    def candidates(self, s: str) -> list[tuple[int, float]]:
        """All entries that reach the least cosine with their best one, best first."""
        best = np.maximum.reduceat(self.scores(s), self.first)
        at = np.flatnonzero(best >= LEAST_COSINE)
        return [(self.entry[self.first[i]], float(best[i])) for i in at[np.argsort(-best[at], kind="stable")].tolist()]


def edits(a: str, b: str) -> int:
    """Insertions, deletions, replacements and swaps of neighbours between two words, by bit vectors over a."""
    m = len(a)
    if not m:
        return len(b)
    place: dict[str, int] = defaultdict(int)
    for i, c in enumerate(a):
        place[c] |= 1 << i
    every, last = (1 << m) - 1, 1 << (m - 1)
    up, down, zero, before, distance = every, 0, 0, 0, m
    for c in b:
        here = place.get(c, 0)
        swap = (((~zero) & here) << 1) & before
        zero = ((((here & up) + up) ^ up) | here | down | swap) & every
        right, left = (down | ~(zero | up)) & every, zero & up
        distance += 1 if right & last else -1 if left & last else 0
        right, left = (right << 1 | 1) & every, (left << 1) & every
        up, down = (left | ~(zero | right)) & every, zero & right
        before = here
    return distance


def _fits(clean: str, name: str) -> bool:
    """Whether a value with a cut first word (``abcde.rest`` or ``abcde-rest``) fits a name."""
    m = re.match(r"^([a-z]{4,})[.\-]\s?(.{4,})$", clean)
    if not m:
        return False
    rest, (stem, kind) = letters(m[2]), ending(name)
    return name.startswith(m[1]) and any(rest.endswith(e) and len(rest) - len(e) >= 4 and stem.endswith(rest[: len(rest) - len(e)]) and len(m[1]) + len(rest) - len(e) <= len(stem) for e in ENDINGS.get(kind, ()))


def decide(index: Index, clean: str) -> tuple[int, float]:
    """Entry or -1 of a cleaned value, and the agreement reached."""
    s = letters(clean)
    if not s or not len(index.keys):
        return UNMATCHED, 0.0
    return judge(clean, index.candidates(s), index.spelled, index.names)


def allowed(n: int) -> int:
    """Edits that a value of n letters may have."""
    return min(MOST_EDITS, max(0, n - EXACT_LETTERS) // EDIT_LETTERS)


def judge(clean: str, best: list[tuple[int, float]], spelled: dict[int, list[str]], names: dict[int, str]) -> tuple[int, float]:
    """Threshold, margin and exact check of a value's candidates (entry, cosine), best first."""
    s = letters(clean)
    if not best:
        return UNMATCHED, 0.0
    near = [(key, cosine) for key, cosine in best if cosine >= best[0][1] - NEAR]
    if near[0][1] < 1 - 1e-9:
        cut = [key for key, _ in best if _fits(clean, names[key])]
        if len(cut) == 1:
            return cut[0], 1.0
    most = allowed(len(s))
    same = [key for key, _ in near if s in spelled[key]]
    if same:  # Any other is an edit or more away.
        return (same[0], 1.0) if len(same) == 1 else (UNMATCHED, 1.0)
    far = sorted((min((_apart(s, t, most) for t in spelled[key]), default=99), -cosine, key) for key, cosine in near)
    d, _, key = far[0]
    good = d <= most and (len(far) < 2 or far[1][0] - d >= MARGIN) and _stem_apart(s, names[key])
    return (key if good else UNMATCHED), round(max(0.0, 1 - d / len(s)), 6)


def _apart(a: str, b: str, most: int = MOST_EDITS) -> int:
    """Edits between two words, as they stand or blurred; 99 where their lengths show that there are too many."""
    if abs(len(a) - len(b)) > most + MARGIN:
        return 99
    if a == b or not most:
        return 0 if a == b else 99
    d, x, y = edits(a, b), blurred(a), blurred(b)
    return d if not d or (x == a and y == b) else min(d, edits(x, y))


def _stem_apart(s: str, name: str) -> bool:
    """Whether the value begins with something near enough to the name's stem."""
    stem = ending(name)[0]
    most = min(4, max(1 + (len(stem) >= 9), len(stem) // STEM_LETTERS))
    return any(_apart(s[: len(stem) + i], stem) <= most for i in range(-most, most + 1))


@F.pandas_udf(StringType())
def _named(book: pd.Series, span: pd.Series) -> pd.Series:
    return pd.Series([named(b, s) for b, s in zip(book, span, strict=True)], dtype=object)


def _may_say_nothing(c: Column) -> Column:
    """``says_nothing`` inside the JVM; also true for rare letters, of which the exact function decides."""
    articles, general = ("|".join(sorted(w)) for w in (ARTICLES, GENERAL))
    plain = F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " "))
    return c.isNull() | plain.rlike(rf"^(?:(?:{articles}) ?)*(?:(?:{general})(?: (?:{articles}))*)?\z") | c.rlike(r"[^\x00-\xff]")


def _none(x: object) -> bool:
    return x is None or x != x


def _decided(values: DataFrame, entries: DataFrame) -> DataFrame:
    """(value, entry, agreement) with the index of a bounded list on every executor."""
    index = Index([(r[0], r[1], r[2]) for r in entries.distinct().collect()])
    shared = values.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            got = [decide(shared.value, v) for v in batch["value"]]
            yield pd.DataFrame({"value": batch["value"], "entry": [g[0] for g in got], "agreement": [g[1] for g in got]})

    # Few bytes, much work: as many tasks as there are cores, and more as the values grow.  Hashed once more, as an equal
    # partitioning of the step before would be kept and its small partitions joined into one task.
    parts = max(2 * default_parallelism(values.sparkSession), values.count() // VALUES_A_TASK)
    return values.repartition(parts, F.xxhash64("value")).mapInPandas(run, "value string, entry long, agreement double")


def _rarest(weights: list[float]) -> int:
    """How many of the weights, greatest first, must be looked up: the rest together lie below the least cosine."""
    w = np.asarray(weights)
    rest = np.sqrt(np.maximum(0, (w * w).sum() - np.cumsum(w * w)))
    return int(np.argmax(rest < LEAST_COSINE * np.sqrt((w * w).sum()) - 1e-9)) + 1


def _joined(values: DataFrame, entries: DataFrame) -> DataFrame:
    """The same by joins on n-grams, for lists of any size."""
    pair = "array<struct<w:double,g:string>>"

    def spell(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(k, letters(cleaned(None if _none(n) else n)), t, list(g), list(map(float, g.values()))) for k, a, n in batch.itertuples(index=False) for t in sorted(spellings("" if _none(n) else n, "" if _none(a) else a)) for g in [grams(t)]]
            yield pd.DataFrame(rows, columns=["entry", "name", "t", "g", "n"])

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            held = [grams(letters(v)) for v in batch["value"]]
            yield pd.DataFrame({"value": batch["value"], "g": [list(h) for h in held], "n": [list(map(float, h.values())) for h in held]})

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The rarest n-grams of each value."""
        for batch in batches:
            rows = [(v, w, [x["g"] for x in w[: _rarest([x["w"] for x in w])]]) for v, w in zip(batch["value"], map(list, batch["ws"]), strict=True)]
            yield pd.DataFrame(rows, columns=["value", "ws", "rare"])

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for a, b in zip(batch["ws"], batch["own"], strict=True):
                x, y = {p["g"]: p["w"] for p in a}, {p["g"]: p["w"] for p in b}
                out.append(sum(w * y.get(g, 0.0) for g, w in x.items()) / np.sqrt(sum(w * w for w in x.values()) * sum(w * w for w in y.values())))
            yield pd.DataFrame({"value": batch["value"], "entry": batch["entry"], "cosine": out})

    def settle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for value, found in zip(batch["value"], batch["best"], strict=True):
                best = [] if found is None else sorted(((b["entry"], b["cosine"]) for b in found), key=lambda x: (-x[1], x[0]))
                spelled = {} if found is None else {b["entry"]: list(b["spelled"]) for b in found}
                names = {} if found is None else {b["entry"]: b["name"] for b in found}
                out.append((value, *judge(value, best, spelled, names)))
            yield pd.DataFrame(out, columns=["value", "entry", "agreement"])

    spelled = written(entries.distinct().mapInPandas(spell, "entry long, name string, t string, g array<string>, n array<double>"), "spelled")
    parts = values.mapInPandas(split, "value string, g array<string>, n array<double>")
    pairs = lambda df, *keep: df.select(*keep, F.explode(F.arrays_zip("g", "n")).alias("p")).select(*keep, "p.g", "p.n")
    total = spelled.count()
    own = pairs(spelled, "entry", "t")
    idf = own.groupBy("g").agg(F.log(F.lit(1) + F.lit(total) / F.count(F.lit(1))).alias("idf"))
    weighted = lambda df, *keep: df.join(idf, "g", "left").select(*keep, F.struct((F.col("n") * F.coalesce("idf", F.log(F.lit(1.0 + total)))).alias("w"), "g").alias("p"))
    whole = lambda df, name, *keep: weighted(df, *keep).groupBy(*keep).agg(F.sort_array(F.collect_list("p"), asc=False).alias(name))
    left = written(whole(pairs(parts, "value"), "ws", "value").mapInPandas(look, f"value string, ws {pair}, rare array<string>"), "looked")
    right = written(whole(own, "own", "entry", "t"), "postings")
    met = left.select("value", F.explode("rare").alias("g")).join(right.select("entry", "t", F.explode("own.g").alias("g")), "g").select("value", "entry", "t").distinct()
    scored = met.join(left.select("value", "ws"), "value").join(right, ["entry", "t"]).select("value", "entry", "ws", "own").mapInPandas(score, "value string, entry long, cosine double")
    top = scored.filter(F.col("cosine") >= LEAST_COSINE).groupBy("value", "entry").agg(F.max("cosine").alias("cosine"))
    forms = spelled.groupBy("entry", "name").agg(F.array_sort(F.collect_list("t")).alias("spelled"))
    best = top.join(forms, "entry").groupBy("value").agg(F.collect_list(F.struct("entry", "cosine", "name", "spelled")).alias("best"))
    return values.join(best, "value", "left").select("value", "best").mapInPandas(settle, "value string, entry long, agreement double")


def mapped(refs: DataFrame, entries: DataFrame, key: str = "ref_id", first: str = "book", second: str = "span_text", most: int = BROADCAST_ENTRIES) -> DataFrame:
    """(key, value, entry, agreement) for every row of ``refs``; ``entries`` has entry id, abbreviation and name in this order."""
    kinds = dict(refs.dtypes)
    text = lambda c: F.col(c).cast("string") if c in kinds else F.lit(None).cast("string")
    # Where the first text says something, the second is left out, so that equal values meet.
    rows = refs.filter(F.col(key).isNotNull()).select(F.col(key).alias("key"), text(first).alias("a"), F.when(_may_say_nothing(text(first)), text(second)).alias("b")).distinct()
    texts = written(rows.select("a", "b").distinct().withColumn("value", _named("a", "b")), "named")
    values = texts.select("value").filter("value != ''").distinct()
    entries = entries.toDF("entry", "short", "name").filter("entry is not null")
    settled = _decided(values, entries) if entries.count() <= most else _joined(values, entries)
    known = texts.join(settled, "value", "left").select("a", "b", "value", F.coalesce("entry", F.lit(UNMATCHED)).alias("entry"), F.coalesce("agreement", F.lit(0.0)).alias("agreement"))
    left, right = rows.alias("l"), known.alias("r")
    same = F.col("l.a").eqNullSafe(F.col("r.a")) & F.col("l.b").eqNullSafe(F.col("r.b"))
    return left.join(right, same).select(F.col("l.key").alias(key), "r.value", "r.entry", "r.agreement")


def found(refs: DataFrame, books: DataFrame) -> DataFrame:
    """p4_found: (ref_id, book_id), one row for each ref_id."""
    m = mapped(refs, books.select("book_id", "jurabk", "name"))
    return m.groupBy("ref_id").agg(F.max("entry").alias("book_id"))


def unmatched(refs: DataFrame, books: DataFrame) -> DataFrame:
    """(value, refs): the values that name no entry and how often they are cited; empty if nothing is named."""
    m = mapped(refs, books.select("book_id", "jurabk", "name"))
    return m.filter(F.col("entry") == UNMATCHED).groupBy("value").agg(F.count_distinct("ref_id").alias("refs"))

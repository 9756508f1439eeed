"""Records of two sources that are the same act, matched without a common key.

Problem 5.  Both sources are normalised to the same fields.  For each of
several composite sort keys all records are sorted into one line, and records
of different sources less than WINDOW places apart are compared (sorted
neighbourhood); pairs are left out before only where an upper bound of their
score shows that they can't reach the threshold.  The line is cut into blocks of fixed length that overlap by a
window, so equal keys of any number make no large group.  Besides, records with
an equal title body, abbreviation, code or day are all compared, in tiles of a
block by a block, so none of these pairs depends on the window.  Weighted agreements
of title, abbreviation, code and date add up to a score; what reaches the
threshold is a candidate.  Register entries of one act are then taken together,
and the groups are assigned to laws one to one so that the total confidence is
greatest, exactly (shortest augmenting paths) within every connected group of
candidates.  Groups up to LARGEST_EXACT are many and taken in sets; in larger
ones the entries of an act are found by joins, and one task assigns a group
from three numbers for each candidate.  The result is the same either way.

Defined results: missing fields neither speak for nor against a match; records
without title and abbreviation match nothing; of repeated rows one counts; an
empty source gives no pairs; ties go to the older law, then the smaller number;
other columns are ignored.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from normloom.functions.text import empty_to_null, strip_white
from normloom.llm.canonical import edits
from normloom.runtime import default_parallelism, written

#: Places apart that records of a line are compared; records of a block; records of a partition of the line.
WINDOW, BLOCK, PARTITION_ROWS = 12, 4_096, 50_000
#: Score a candidate needs; days that dates may differ; candidates of a connected group that a set's task takes whole.
THRESHOLD, DAYS, LARGEST_EXACT = 5.0, 40, 400
#: Connected groups that one task assigns.
GROUPS_A_TASK = 2_000

_FOLD = str.maketrans({"ä": "ae", "ö": "oe", "ü": "ue", "ß": "ss", "­": None, "​": None})
_SHORT = ((re.compile(r"\bg(?:es)?\."), "gesetz "), (re.compile(r"\b(?:verordng\.|verordn\.|vo\b\.?|v\.)"), "verordnung "), (re.compile(r"\bbek(?:anntm)?\."), "bekanntmachung "), (re.compile(r"\bao\b\.?|\banordng\."), "anordnung "))
_DATED = re.compile(r"\s*\bvom\s+(\d{1,2})\.\s*(\d{1,2})\.\s*(\d{4})\s*$")
_TURNED = re.compile(r"^(.*\S)\s*,\s*([^,]{3,60})$")
_ORDINALS = ("erste", "zweite", "dritte", "vierte", "fuenfte", "sechste", "siebte", "achte", "neunte", "zehnte", "elfte", "zwoelfte")
_ORDINAL = re.compile(r"^(" + "|".join(_ORDINALS) + r")[rsnm]?\b")
_HEAD = re.compile(r"^.{0,90}?\b(?:ueber|betreffend|fuer)\s+(?:die|das|den|der)?\s*")


def fold(text: str) -> str:
    return unicodedata.normalize("NFKC", text).lower().translate(_FOLD)


def day_of(text: str | None) -> tuple[int | None, int | None]:
    """Days since 1970 and year of a date; only the year where no more is said."""
    s = (text or "").strip()
    m = re.fullmatch(r"(\d{4})-(\d{1,2})-(\d{1,2})(?:[T ].*)?", s)
    parts = (m[1], m[2], m[3]) if m else None
    if not parts and (m := re.fullmatch(r"(\d{1,2})\.\s*(\d{1,2})\.\s*(\d{4})", s)):
        parts = (m[3], m[2], m[1])
    if parts:
        try:
            return int((np.datetime64(f"{parts[0]}-{int(parts[1]):02}-{int(parts[2]):02}") - np.datetime64("1970-01-01")).astype(int)), int(parts[0])
        except ValueError:
            return None, int(parts[0])
    return (None, int(s)) if re.fullmatch(r"\d{4}", s) else (None, None)


def code_of(text: str | None) -> str:
    return "-".join(g.lstrip("0") or "0" for g in re.findall(r"\d+", text or ""))


def abbr_of(text: str | None) -> str:
    return re.sub(r"[^a-z0-9]", "", fold(text or ""))


def title_of(text: str | None) -> tuple[str, tuple[str, str, str] | None]:
    """The title in plain order without short name and date, and the date it names."""
    s = " ".join(fold(text or "").split())
    named = _DATED.search(s)
    if named:
        s = s[: named.start()]
    s = re.sub(r"\s*\([^()]*\)?\s*$", "", s)
    m = _TURNED.match(s)
    if m:
        s = f"{re.sub(r'\s*\([^()]*\)?\s*$', '', m[2])} {m[1]}"
    s = re.sub(r"\s*\([^()]*\)", "", s)
    for pattern, word in _SHORT:
        s = pattern.sub(word, s)
    return " ".join(re.sub(r"[^a-z0-9 ]", " ", s).split()), (named[3], named[2], named[1]) if named else None


def prepared(title: str | None, abbr: str | None, code: str | None, date: str | None) -> dict:
    t, named = title_of(title)
    day, year = day_of(date)
    if day is None and named:
        other = day_of("-".join(named))
        if year is None or other[1] == year:
            day, year = other
    short = abbr_of(abbr)
    if year is None and re.fullmatch(r"\D+(?:19|20)\d\d", short):
        year = int(short[-4:])  # a later act bears its year
    m = _ORDINAL.match(t)
    body = _HEAD.sub("", t)
    return {"title": t, "body": body, "ordinal": m[1] if m else "", "abbr": short, "code": code_of(code), "day": day, "year": year}


def sort_keys(r: dict) -> list[str]:
    """Composite keys: body of the title, abbreviation, code, date, and the title from behind."""
    when = f"{r['day'] if r['day'] is not None else -1:06}" if r["year"] is not None else "~"
    year = str(r["year"] or "~")
    keys = []
    if r["body"]:
        keys += [f"1{r['body']} {year} {when}", f"2{' '.join(reversed(r['body'].split()))} {year} {when}"]
    if r["abbr"]:
        keys.append(f"3{r['abbr']} {year}")
    if r["code"]:
        keys.append(f"4{r['code']} {when} {r['body'][:12]}")
    if r["day"] is not None:
        keys.append(f"5{when} {r['body'] or r['abbr']}")
    return keys


def _tail(abbr: str) -> str:
    return re.search(r"\d*$", abbr)[0]


#: Pairs come up under several keys; their titles are compared once in a worker.
_apart = lru_cache(1 << 16)(edits)


def title_points(a: dict, b: dict) -> float:
    x, y = a["title"], b["title"]
    if not x or not y:
        return 0.0
    if a["ordinal"] and b["ordinal"] and a["ordinal"] != b["ordinal"]:
        return -6.0
    if x == y:
        return 6.0
    n = min(len(x), len(y))
    sim = 1 - _apart(x, y) / max(len(x), len(y))
    if sim >= 0.97:
        return 6.0
    if sim >= 0.9:
        return 5.0
    # A title that breaks off agrees as far as it goes.
    if n >= 25 and abs(len(x) - len(y)) > 3 and edits(x[:n], y[:n]) <= n // 12:
        return 3.0 if n >= 45 else 2.0
    return 3.0 if sim >= 0.8 else 0.5 if sim >= 0.65 else -5.0


def abbr_points(a: dict, b: dict) -> float:
    x, y = a["abbr"], b["abbr"]
    if not x or not y:
        return 0.0
    if x == y:
        return 5.0
    if _tail(x) != _tail(y):
        # The year may be left out where the dates agree.
        dated = not (_tail(x) and _tail(y)) and len(_tail(x) + _tail(y)) == 4 and date_points(a, b) > 0
        return 0.0 if dated and edits(x.rstrip("0123456789"), y.rstrip("0123456789")) <= 1 else -6.0
    d = edits(x, y)
    return 3.0 if d <= 1 else 2.0 if d == 2 else 0.0 if d <= 4 else -4.0


def date_points(a: dict, b: dict) -> float:
    if a["year"] is None or b["year"] is None:
        return 0.0
    if a["day"] is not None and b["day"] is not None:
        apart = abs(a["day"] - b["day"])
        return 4.0 if not apart else 3.0 if apart <= DAYS else -12.0
    return 2.0 if a["year"] == b["year"] else -12.0


def code_points(a: dict, b: dict) -> float:
    x, y = a["code"], b["code"]
    if not x or not y:
        return 0.0
    return 2.5 if x == y else 2.0 if x.startswith(f"{y}-") or y.startswith(f"{x}-") else -1.5


def score(a: dict, b: dict, most: float = 6.0) -> float:
    """Points of a pair; where titles can add ``most`` points only and that can't suffice, the points without them."""
    cheap = date_points(a, b) + code_points(a, b)
    if cheap < -8:
        return cheap
    cheap += abbr_points(a, b)
    return cheap if cheap + most < THRESHOLD else cheap + title_points(a, b)


def confidence(points: float) -> float:
    return round(1 / (1 + math.exp(-(points - 3) / 2)), 6)


def _marks(texts: list[str], bits: int = 256) -> list[bytes]:
    """Of each text (ASCII) the bits of its trigrams."""
    codes = np.frombuffer("\n".join([*texts, ""]).encode("ascii"), np.uint8).astype(np.uint32)
    owner = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in texts])[: max(0, len(codes) - 2)]
    gram = (codes[:-2] << 16) | (codes[1:-1] << 8) | codes[2:]
    inside = (codes[:-2] != 10) & (codes[1:-1] != 10) & (codes[2:] != 10)
    with np.errstate(over="ignore"):
        place = ((gram * np.uint32(0x9E3779B1)) >> np.uint32(15)) % np.uint32(bits)
    out = np.zeros((len(texts), bits), bool)
    out[owner[inside], place[inside]] = True
    return [row.tobytes() for row in np.packbits(out, axis=1)]


def numbered(frame: pd.DataFrame) -> pd.DataFrame:
    """``frame`` with what ``Bound`` needs: fields as numbers, equal for equal texts and 0 for empty ones, lengths, and marks."""

    def key(values: pd.Series) -> np.ndarray:
        texts = values.to_numpy(object)
        return np.where(texts == "", 0, pd.util.hash_array(texts, categorize=False).view(np.int64)) if len(texts) else np.zeros(0, np.int64)

    codes, tail = [c.split("-") if c else [] for c in frame["code"]], [_tail(a) for a in frame["abbr"]]
    texts = lambda x: pd.Series(x, dtype=object)
    parts = {"code_k": frame["code"], "first_k": texts([c[0] if c else "" for c in codes]), "second_k": texts(["-".join(c[:2]) for c in codes]), "abbr_k": frame["abbr"], "tail_k": texts(tail), "ordinal_k": frame["ordinal"]}
    # Which letters an abbreviation has, as bits.
    letters = [sum({1 << "0123456789abcdefghijklmnopqrstuvwxyz".index(c) for c in a}) for a in frame["abbr"]]
    lengths = {"abbr_m": np.array(letters, np.int64), "code_n": np.array([len(c) for c in codes], np.int32), "tail_n": np.array([len(x) for x in tail], np.int32), "abbr_n": frame["abbr"].map(len).astype("int32"), "title_n": frame["title"].map(len).astype("int32")}
    return frame.assign(**{n: key(v) for n, v in parts.items()}, **lengths, mark=_marks(frame["title"].tolist()))


class Bound:
    """An upper bound of ``score`` for many pairs at once; what stays below the threshold need not be compared.

    An edit changes at most four trigrams (a swap of neighbours), so titles of which one has t trigrams that the
    other lacks are at least t / 4 edits apart.  All other parts are exact or bounded by the lengths.
    """

    def __init__(self, frame: pd.DataFrame):
        self.year, self.day = (frame[c].astype("Float64").to_numpy(float, na_value=np.nan) for c in ("year", "day"))
        self.code, self.first, self.second, self.parts, self.abbr, self.letters, self.tail, self.tail_length, self.ordinal, self.abbr_length, self.length = (frame[c].to_numpy(np.int64) for c in _NUMBERS)
        self.mark = np.frombuffer(b"".join(frame["mark"]), np.uint64).reshape(len(frame), -1)

    def title(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        x, y, m, n = self.mark[i], self.mark[j], self.length[i], self.length[j]
        only_x, only_y = np.bitwise_count(x & ~y).sum(1).astype(int), np.bitwise_count(y & ~x).sum(1).astype(int)
        apart, most, least = np.maximum(np.maximum(only_x, only_y) / 4, np.abs(m - n)), np.maximum(np.maximum(m, n), 1), np.minimum(m, n)
        sim = 1 - apart / most + 1e-9
        points = np.select([sim >= 0.97, sim >= 0.9, sim >= 0.8, sim >= 0.65], [6.0, 5.0, 3.0, 0.5], -5.0)
        cut = (least >= 25) & (np.abs(m - n) > 3) & (np.where(m <= n, only_x, only_y) <= 4 * (least // 12))
        points = np.where(cut, np.maximum(points, 3.0), points)
        return np.where(least == 0, 0.0, np.where((self.ordinal[i] != 0) & (self.ordinal[j] != 0) & (self.ordinal[i] != self.ordinal[j]), -6.0, points))

    def others(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        years, days = self.year[i] - self.year[j], np.abs(self.day[i] - self.day[j])
        date = np.where(np.isnan(years), 0.0, np.where(np.isnan(days), np.where(years == 0, 2.0, -12.0), np.where(days == 0, 4.0, np.where(days <= DAYS, 3.0, -12.0))))
        m, n = self.parts[i], self.parts[j]
        begins = (m != n) & (self.first[i] == self.first[j]) & ((np.minimum(m, n) < 2) | (self.second[i] == self.second[j]))
        code = np.where((m == 0) | (n == 0), 0.0, np.where(self.code[i] == self.code[j], 2.5, np.where(begins, 2.0, -1.5)))
        # Each edit takes or brings one letter at most.
        x, y = self.letters[i], self.letters[j]
        far = np.maximum(np.abs(self.abbr_length[i] - self.abbr_length[j]), np.maximum(np.bitwise_count(x & ~y), np.bitwise_count(y & ~x)))
        near = np.select([far <= 1, far == 2, far <= 4], [3.0, 2.0, 0.0], -4.0)
        m, n = self.tail_length[i], self.tail_length[j]
        other = np.where((np.minimum(m, n) == 0) & (m + n == 4) & (date > 0), 0.0, -6.0)
        abbr = np.where((self.abbr[i] == 0) | (self.abbr[j] == 0), 0.0, np.where(self.abbr[i] == self.abbr[j], 5.0, np.where(self.tail[i] == self.tail[j], near, other)))
        return date + code + abbr

    def may_reach(self, i: np.ndarray, j: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
        """Which of the pairs (i, j) may reach the threshold, and the most points their titles can add."""
        others = self.others(i, j)
        at = np.flatnonzero(others + 6 >= threshold)
        most = self.title(i[at], j[at])
        kept = others[at] + most >= threshold
        return at[kept], most[kept]


FIELDS = ("title", "body", "ordinal", "abbr", "code")
_NUMBERS = ("code_k", "first_k", "second_k", "code_n", "abbr_k", "abbr_m", "tail_k", "tail_n", "ordinal_k", "abbr_n", "title_n")
_SHAPE = "side int, id long, title string, body string, ordinal string, abbr string, code string, day int, year int, keys array<string>, code_k long, first_k long, second_k long, abbr_k long, tail_k long, ordinal_k long, abbr_m long, code_n int, tail_n int, abbr_n int, title_n int, mark binary"
#: What is moved to find candidates: no texts.
_SLIM = ("side", "id", "day", "year", *_NUMBERS, "mark")


def records(rows: DataFrame, side: int) -> DataFrame:
    """Prepared records of a source with columns id, title, abbr, code, date."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for key, *texts in batch.itertuples(index=False):
                r = prepared(*[None if x is None or x != x else x for x in texts])
                out.append((side, key, *[r[f] for f in FIELDS], r["day"], r["year"], sort_keys(r) if r["title"] or r["abbr"] else []))
            frame = pd.DataFrame(out, columns=["side", "id", *FIELDS, "day", "year", "keys"])
            if len(frame):
                yield numbered(frame).astype({"day": "Int32", "year": "Int32"})

    text = [F.col(c).cast("string").alias(c) for c in ("title", "abbr", "code", "date")]
    known = rows.filter(F.col("id").isNotNull()).select(F.col("id").cast("long").alias("id"), *text).groupBy("id").agg(F.max(F.struct("title", "abbr", "code", "date")).alias("r"))
    return known.select("id", "r.title", "r.abbr", "r.code", "r.date").mapInPandas(run, _SHAPE)


def _line(prepared_records: DataFrame, window: int, block: int) -> DataFrame:
    """Every record at its place in the line of each key, in overlapping blocks (``block``, ``at``, ``shown`` before)."""
    spark = prepared_records.sparkSession
    keyed = prepared_records.select(*_SLIM, F.explode("keys").alias("key"))
    n = keyed.count()
    placed = keyed.repartitionByRange(max(1, -(-n // PARTITION_ROWS)), "key", "side", "id").sortWithinPartitions("key", "side", "id")
    placed = written(placed.withColumn("m", F.monotonically_increasing_id()).withColumn("p", F.shiftright("m", 33)), "line")
    counts = sorted((r["p"], r["n"]) for r in placed.groupBy("p").agg(F.count(F.lit(1)).alias("n")).collect())
    starts, total = [], 0
    for p, k in counts:
        starts.append((p, total))
        total += k
    offsets = spark.createDataFrame(starts or [(0, 0)], "p long, o long")
    at = F.col("o") + F.col("m").bitwiseAND((1 << 33) - 1)
    placed = placed.join(F.broadcast(offsets), "p").withColumn("at", at).drop("m", "p", "o", "key")
    own = F.expr(f"at div {block}")
    # The last records of a block are shown to the next one as well.
    both = F.when(F.col("at") % block >= block - window + 1, F.array(own, own + 1)).otherwise(F.array(own))
    return placed.withColumn("own", own).withColumn("block", F.explode(both))


_PAIR = "law_id long, reg_id long, points double, law_day int, title string, ordinal string, abbr string, code string, day int, year int"
_IDS = "law_id long, reg_id long, most double"


def _ids(frame: pd.DataFrame, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> pd.DataFrame:
    """Pairs of a law and a register entry, each once, from places in either order."""
    side, key = frame["side"].to_numpy(), frame["id"].to_numpy(np.int64)
    law, reg = np.where(side[i] == 0, i, j), np.where(side[i] == 0, j, i)
    return pd.DataFrame({"law_id": key[law], "reg_id": key[reg], "most": most}).drop_duplicates()


def _compare(window: int, threshold: float):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("at", kind="stable").reset_index(drop=True)
        at, own, home, side = (frame[c].to_numpy() for c in ("at", "own", "block", "side"))
        bound, found = Bound(frame), []
        for step in range(1, window):
            # A pair is compared where its later record is at home.
            i = np.arange(len(frame) - step)
            j = i + step
            near = (side[i] != side[j]) & (own[j] == home[j]) & (at[j] - at[i] == step)
            i, j = i[near], j[near]
            kept, most = bound.may_reach(i, j, threshold)
            found.append((i[kept], j[kept], most))
        return _ids(frame, *(np.concatenate(x) for x in zip(*found, strict=True)))

    return run


def _runs(prepared_records: DataFrame, block: int) -> DataFrame:
    """Records whose title body, abbreviation, code or day stands on both sides, in tiles that show every such pair."""
    fields = [F.when(there, F.concat(F.lit(c), F.lit(" "), F.col(c).cast("string"))) for c, there in (*((c, F.col(c) != "") for c in ("body", "abbr", "code")), ("day", F.col("day").isNotNull()))]
    rows = prepared_records.filter(F.size("keys") > 0).select(*_SLIM, F.explode(F.array_compact(F.array(*fields))).alias("run"))
    sizes = rows.groupBy("run").agg(F.sum(1 - F.col("side")).alias("nl"), F.sum("side").alias("nr")).filter("nl > 0 and nr > 0")
    law = F.col("side") == 0
    tiles = [F.ceil(F.col(c) / block) for c in ("nl", "nr")]
    placed = rows.join(sizes, "run").withColumn("own", F.pmod(F.xxhash64("id"), F.when(law, tiles[0]).otherwise(tiles[1])))
    shown = placed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.when(law, tiles[1]).otherwise(tiles[0]) - 1)))
    tile = F.xxhash64("run", F.when(law, F.col("own")).otherwise(F.col("other")), F.when(law, F.col("other")).otherwise(F.col("own")))
    return shown.withColumn("tile", tile).drop("run", "nl", "nr", "own", "other")


#: Pairs of a tile whose bounds are computed at once.
PAIRS_AT_ONCE = 1 << 19


def _compare_tiles(threshold: float):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["tile", "side"], kind="stable").reset_index(drop=True)
        side, (_, tile) = frame["side"].to_numpy(), np.unique(frame["tile"].to_numpy(), return_inverse=True)
        bound, found = Bound(frame), [(np.zeros(0, int), np.zeros(0, int), np.zeros(0))]
        # Within a tile the laws come first, then the entries that each of them meets.
        laws = np.flatnonzero(side == 0)
        regs = np.bincount(tile[side == 1], minlength=tile.max() + 1)[tile[laws]]
        first = np.searchsorted(2 * tile + side, 2 * tile[laws] + 1)
        cuts = np.searchsorted(np.cumsum(regs), np.arange(PAIRS_AT_ONCE, regs.sum() + PAIRS_AT_ONCE, PAIRS_AT_ONCE))
        for a, b in zip([0, *(cuts + 1).tolist()], [*(cuts + 1).tolist(), len(laws)], strict=True):
            n = regs[a:b]
            i = np.repeat(laws[a:b], n)
            j = np.repeat(first[a:b], n) + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
            kept, most = bound.may_reach(i, j, threshold)
            found.append((i[kept], j[kept], most))
        return _ids(frame, *(np.concatenate(x) for x in zip(*found, strict=True)))

    return run


def _scored(pairs: DataFrame, both: DataFrame, threshold: float, parts: int) -> DataFrame:
    """The pairs that reach the threshold, each scored once from all its fields."""
    names = [*(f for f in FIELDS if f != "body"), "day", "year"]
    of = lambda s: both.filter(F.col("side") == s).select(F.col("id").alias(("law_id", "reg_id")[s]), *[F.col(c).alias(f"{c}_{s}") for c in names])
    whole = pairs.join(of(0), "law_id").join(of(1), "reg_id").repartition(parts, F.xxhash64("law_id", "reg_id"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = _rows(batch)
            points = np.array([score(*({c: r[f"{c}_{s}"] for c in names} for s in (0, 1)), r["most"]) for r in rows], float)
            out = pd.DataFrame({"law_id": batch["law_id"], "reg_id": batch["reg_id"], "points": points, "law_day": batch["day_0"], **{c: batch[f"{c}_1"] for c in names}})
            yield out[points >= threshold].astype({"law_day": "Int32", "day": "Int32", "year": "Int32"})

    return whole.mapInPandas(run, _PAIR)


def candidates(laws: DataFrame, register: DataFrame, window: int = WINDOW, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """Pairs that reach the threshold within a window of some key, or with an equal field."""
    both = written(records(laws, 0).unionByName(records(register, 1)), "records")
    line = _line(both, window, block)
    # Few bytes, much work: as many tasks as there are cores, and more as the line grows.
    parts = max(2 * default_parallelism(laws.sparkSession), both.count() // block)
    compared = line.repartition(parts, "block").groupBy("block").applyInPandas(_compare(window, threshold), _IDS)
    runs = _runs(both, block).groupBy(F.pmod("tile", F.lit(parts)).alias("set")).applyInPandas(_compare_tiles(threshold), _IDS)
    return _scored(compared.unionByName(runs).groupBy("law_id", "reg_id").agg(F.max("most").alias("most")), both, threshold, parts)


def hungarian(cost: np.ndarray) -> list[int]:
    """The column of each row in a square matrix so that the sum is least; the dense method ``best_assignment`` is tested against."""
    n = len(cost)
    u, v, match, way = np.zeros(n + 1), np.zeros(n + 1), np.zeros(n + 1, int), np.zeros(n + 1, int)
    for row in range(1, n + 1):
        match[0], col = row, 0
        least, used = np.full(n + 1, np.inf), np.zeros(n + 1, bool)
        while True:
            used[col] = True
            free = ~used
            free[0] = False
            reduced = cost[match[col] - 1] - u[match[col]] - v[1:]
            better = free[1:] & (reduced < least[1:])
            least[1:][better] = reduced[better]
            way[1:][better] = col
            nxt = int(np.where(free, least, np.inf).argmin())
            delta = least[nxt]
            u[match[used]] += delta
            v[used] -= delta
            least[free] -= delta
            col = nxt
            if not match[col]:
                break
        while col:
            match[col] = match[way[col]]
            col = way[col]
    out = [0] * n
    for col in range(1, n + 1):
        out[match[col] - 1] = col - 1
    return out


def best_assignment(row: np.ndarray, column: np.ndarray, gain: np.ndarray) -> list[int]:
    """The column of each row, or -1, so that the total gain (whole numbers above 0) is greatest.

    Ties go to the smaller columns, then to the smaller rows.  All numbers are exact.  Rows are added one after
    the other by the shortest augmenting path under prices of the columns; free columns have price 0.
    """
    n, m = int(row.max(initial=-1)) + 1, int(column.max(initial=-1)) + 1
    order = np.lexsort((column, row))
    column, gain = column[order], gain[order]
    start = np.searchsorted(row[order], np.arange(n + 1)).tolist()
    by_column, by_row = (m + 1) ** 2, (n + 1) ** 2
    price, profit, owner, chosen = [0] * m, [0] * n, [-1] * m, [-1] * n

    def offers(i: int) -> list[tuple[int, int]]:
        c, g = column[start[i] : start[i + 1]].tolist(), gain[start[i] : start[i + 1]].tolist()
        return [(j, (w * by_column - j) * by_row - i - price[j]) for j, w in zip(c, g, strict=True)]

    for first in range(n):
        profit[first] = max([0, *(x for _, x in offers(first))])
        rows, reached, least, way = {first: 0}, {}, {}, {}
        # To leave a row without a column costs its profit.
        end, drop, heap, i = profit[first], first, [], first
        while True:
            for j, x in offers(i):
                far = rows[i] + profit[i] - x
                if j not in reached and far < least.get(j, end + 1) and far <= end:
                    least[j], way[j] = far, i
                    heappush(heap, (far, j))
            while heap and (heap[0][1] in reached or heap[0][0] > least[heap[0][1]]):
                heappop(heap)
            if not heap or heap[0][0] >= end:
                break
            far, j = heappop(heap)
            reached[j] = far
            if owner[j] < 0:
                end, drop = far, -1
                break
            i = owner[j]
            rows[i] = far
            if far + profit[i] < end:
                end, drop = far + profit[i], i
        for k, far in rows.items():
            profit[k] -= end - far
        for k, far in reached.items():
            price[k] += end - far
        if drop >= 0:  # the row gives its column up
            j, chosen[drop] = chosen[drop], -1
        while j >= 0:
            i = way[j]
            owner[j], chosen[i], j = i, j, chosen[i]
    return chosen


def same_act(a: dict, b: dict) -> bool:
    """Whether two register entries are one act."""
    return score(a, b) >= THRESHOLD + 1


def _joined(n: int, alike) -> list[int]:
    """The least member of each one's group, where ``alike(i, j)`` joins i and an earlier j."""
    group = list(range(n))

    def root(i: int) -> int:
        while group[i] != i:
            group[i] = group[group[i]]
            i = group[i]
        return i

    for i in range(n):
        for j in range(i):
            a, b = root(i), root(j)
            if a != b and alike(i, j):
                group[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


def _laws_of_acts(cells: list[tuple[int, int, int | None, float]]) -> dict[int, int]:
    """The law of each act, of connected (act, law_id, law_day, points)."""
    days = {law: day for _, law, day, _ in cells}
    laws = sorted(days, key=lambda x: (10**7 if days[x] is None else days[x], x))
    acts = sorted({c[0] for c in cells})
    law_at, act_at = {x: i for i, x in enumerate(laws)}, {x: i for i, x in enumerate(acts)}
    best = {}
    for act, law, _, points in cells:
        cell = act_at[act], law_at[law]
        best[cell] = max(best.get(cell, points), points)
    # Confidence has six decimals and points are halves, so millionths are whole.  Ties go to the older law.
    gain = [round(1e6 * confidence(x) + 100 * x) for x in best.values()]
    at = np.array(list(best), int).reshape(-1, 2)
    chosen = best_assignment(at[:, 0], at[:, 1], np.array(gain, int))
    return {act: laws[j] for act, j in zip(acts, chosen, strict=True) if j >= 0}


def assign(pairs: list[dict]) -> list[tuple[int, int, float]]:
    """The best assignment of register groups to laws among connected candidates (rows of ``candidates``)."""
    entries = {p["reg_id"]: p for p in sorted(pairs, key=lambda p: p["reg_id"])}
    regs, laws_of = list(entries), defaultdict(set)
    for p in pairs:
        laws_of[p["reg_id"]].add(p["law_id"])
    joined = _joined(len(regs), lambda i, j: bool(laws_of[regs[i]] & laws_of[regs[j]]) and same_act(entries[regs[i]], entries[regs[j]]))
    act = {reg: regs[k] for reg, k in zip(regs, joined, strict=True)}
    law = _laws_of_acts([(act[p["reg_id"]], p["law_id"], p["law_day"], p["points"]) for p in pairs])
    points = {(p["law_id"], p["reg_id"]): p["points"] for p in pairs}
    found = [(law.get(act[reg]), reg) for reg in regs]
    return [(*x, confidence(points[x])) for x in found if x in points]


def _components(pairs: DataFrame) -> DataFrame:
    """(law_id, reg_id, group): connected groups of pairs, named by their least law; least names spread until nothing moves."""
    edges = written(pairs.select("law_id", "reg_id"), "edges")
    names = edges.select("law_id", F.col("law_id").alias("name")).distinct()
    while True:
        # Two steps over register entries for each round, and the name's own name: the reach doubles.
        by_reg = edges.join(names, "law_id").groupBy("reg_id").agg(F.min("name").alias("m"))
        near = edges.join(by_reg, "reg_id").groupBy("law_id").agg(F.min("m").alias("m"))
        jump = names.select(F.col("law_id").alias("m"), F.col("name").alias("far"))
        fresh = written(near.join(jump, "m", "left").select("law_id", F.least("m", F.coalesce("far", "m")).alias("name")), "names")
        moved = fresh.join(names.withColumnRenamed("name", "old"), "law_id").filter("name != old")
        if moved.isEmpty():
            return edges.join(fresh, "law_id").select("law_id", "reg_id", F.col("name").alias("group"))
        names = fresh


_ACT = (*(f for f in FIELDS if f != "body"), "day", "year")


def _rows(frame: pd.DataFrame) -> list[dict]:
    return frame.astype(object).where(frame.notna(), None).to_dict("records")


def _acts(pairs: DataFrame, sets: int) -> DataFrame:
    """(reg_id, act): register entries of one act by the rule of ``assign``, named by the least; joined law by law first."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        out, alike = [], lru_cache(1 << 18)(lambda a, b: same_act(dict(zip(_ACT, a, strict=True)), dict(zip(_ACT, b, strict=True))))
        of_law = defaultdict(lambda: defaultdict(list))
        for r in _rows(frame):
            of_law[r["law_id"]][tuple(r[f] for f in _ACT)].append(r["reg_id"])
        for kinds in of_law.values():
            # Entries that say the same are compared once.
            kind = sorted(kinds, key=lambda k: min(kinds[k]))
            groups = defaultdict(list)
            for k, name in enumerate(_joined(len(kind), lambda i, j: alike(kind[i], kind[j]))):
                groups[name].append(k)
            for members in groups.values():
                regs = [reg for k in members for reg in kinds[kind[k]]]
                one = len(members) > 1 or alike(kind[members[0]], kind[members[0]])
                out += [(min(regs) if one else reg, reg) for reg in regs]
        return pd.DataFrame(out, columns=["law_id", "reg_id"])

    stars = pairs.select("law_id", "reg_id", *_ACT).groupBy(F.pmod(F.xxhash64("law_id"), F.lit(sets)).alias("set")).applyInPandas(run, "law_id long, reg_id long")
    # An entry that leads a star is a member of it, so the stars' names connect them.
    return _components(stars.distinct()).groupBy("reg_id").agg(F.min("group").alias("act"))


def _large(pairs: DataFrame, sets: int) -> DataFrame:
    """(law_id, reg_id, points): what ``assign`` chooses, for connected groups of any size."""
    acts = written(_acts(pairs, sets), "acts")
    named = written(pairs.join(acts, "reg_id").select("group", "law_id", "reg_id", "act", "law_day", "points"), "named")

    def solve(frame: pd.DataFrame) -> pd.DataFrame:
        cells = [(r["act"], r["law_id"], r["law_day"], r["points"]) for r in _rows(frame)]
        return pd.DataFrame(list(_laws_of_acts(cells).items()), columns=["act", "law_id"])

    cells = named.groupBy("group", "act", "law_id").agg(F.max("law_day").alias("law_day"), F.max("points").alias("points"))
    chosen = cells.groupBy("group").applyInPandas(solve, "act long, law_id long")
    return named.join(chosen, ["act", "law_id"]).select("law_id", "reg_id", "points")


def matches(laws: DataFrame, register: DataFrame, window: int = WINDOW, threshold: float = THRESHOLD, largest: int = LARGEST_EXACT, block: int = BLOCK) -> DataFrame:
    """(law_id, reg_id, confidence); both sources have columns id, title, abbr, code, date."""
    pairs = written(candidates(laws, register, window, threshold, block), "candidates")
    by_law = pairs.groupBy("law_id").agg(F.count(F.lit(1)).alias("nl"))
    by_reg = pairs.groupBy("reg_id").agg(F.count(F.lit(1)).alias("nr"))
    counted = pairs.join(by_law, "law_id").join(by_reg, "reg_id")
    sure = 1 / (1 + F.exp(-(F.col("points") - 3) / 2))
    alone = counted.filter("nl = 1 and nr = 1").select("law_id", "reg_id", F.round(sure, 6).alias("confidence"))
    contested = counted.filter("nl > 1 or nr > 1").drop("nl", "nr")
    grouped = written(contested.join(_components(contested), ["law_id", "reg_id"]), "contested")
    sizes = grouped.groupBy("group").agg(F.count(F.lit(1)).alias("n"))
    sized = grouped.join(sizes, "group")

    def solve(frame: pd.DataFrame) -> pd.DataFrame:
        named = defaultdict(list)
        for row in _rows(frame):
            named[row["group"]].append({**row, "body": ""})
        return pd.DataFrame([x for key in sorted(named) for x in assign(named[key])], columns=["law_id", "reg_id", "confidence"])

    # Groups are small and many: a task takes a set of them at once.
    small = sized.filter(F.col("n") <= largest)
    sets = max(2 * default_parallelism(laws.sparkSession), sizes.count() // GROUPS_A_TASK)
    exact = small.groupBy(F.pmod(F.xxhash64("group"), F.lit(sets)).alias("set")).applyInPandas(solve, "law_id long, reg_id long, confidence double")
    out = alone.unionByName(exact)
    big = sized.filter(F.col("n") > largest)
    if not big.isEmpty():
        out = out.unionByName(_large(big, max(sets, big.count() // PARTITION_ROWS)).select("law_id", "reg_id", F.round(sure, 6).alias("confidence")))
    return out


def law_fields(laws: DataFrame) -> DataFrame:
    # A law's short name stands in its slug, too, where the abbreviation is missing.
    return laws.select(F.col("law_id").alias("id"), F.col("langue").alias("title"), F.coalesce(empty_to_null(strip_white(F.col("jurabk"))), F.col("slug")).alias("abbr"), F.col("fna_code").alias("code"), F.col("ausfertigung_datum").alias("date"))


def register_fields(register: DataFrame) -> DataFrame:
    return register.select(F.col("reg_id").alias("id"), F.col("titel").alias("title"), F.col("abk").alias("abbr"), F.col("fna_code").alias("code"), F.col("ausgefertigt").alias("date"))


def matched(laws: DataFrame, register: DataFrame) -> DataFrame:
    """(law_id, reg_id, confidence) of laws and register entries."""
    return matches(law_fields(laws), register_fields(register))


def found(laws: DataFrame, register: DataFrame) -> DataFrame:
    """p5_found: (law_id, reg_id)."""
    return matched(laws, register).select("law_id", "reg_id")

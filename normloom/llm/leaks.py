"""Evaluation texts that leaked into training texts, by winnowing.

Problem 8.  Both sides become sequences of word hashes.  Of every window of
consecutive word 5-grams the least hash is kept as a fingerprint; two texts
that share enough consecutive words share a whole window and so its
fingerprint.  Fingerprints of both sides are joined and every hit is extended
word by word until the shared run is long enough, so that nothing is missed
and nothing reported that isn't there.

Evaluation sets of bounded size are broadcast and the corpus is passed once
without a shuffle; beyond the bound both sides' fingerprints are shuffled.

Defined results: null and empty texts, and texts with fewer words than the
run, leak nothing; repeated rows count once; other columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words of a run that counts as leaked, words of a shingle, and the window that guarantees such runs.
RUN, SHINGLE = 12, 5
#: Words of all evaluation texts up to which they are broadcast (16 MB of hashes).
BROADCAST_WORDS = 2_000_000
#: Characters of text that are handled at once, and word hashes a worker remembers.
BATCH_CHARS, CACHE_WORDS = 1 << 21, 1 << 20

_TAG = re.compile("<[^>]*>")
# The characters that are dropped.
_DROPPED = dict.fromkeys((0x00AD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF))
_HAS_DROPPED = re.compile("[" + "".join(map(chr, _DROPPED)) + "]")
#: A word: letters and numbers of Unicode.  ``\w`` also has the low line and a few marks of number value.
_WORD = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    if not text:
        return []
    if "<" in text:
        text = _TAG.sub(" ", text)
    if not text.isascii():
        if _HAS_DROPPED.search(text):
            text = text.translate(_DROPPED)
        text = unicodedata.normalize("NFKC", text)
    return _WORD.findall(text.lower())


class WordHashes(dict):
    """Word to 64-bit hash, remembered."""

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word.encode())
        return h


_HASHES = WordHashes()


def hashed(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts end to end, and how many each text has."""
    found = [words(t) for t in texts]
    counts = np.fromiter(map(len, found), np.int64, len(found))
    flat = np.fromiter((h for w in found for h in map(_HASHES.__getitem__, w)), np.uint64, int(counts.sum()))
    return flat, counts


def shingle_hashes(h: np.ndarray, k: int = SHINGLE) -> np.ndarray:
    """The hash of every k consecutive words."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        out = np.zeros(n, np.uint64)
        for i in range(k):
            out = out * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n]
        out ^= out >> np.uint64(29)
        out *= np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(32))


def fingerprints(h: np.ndarray, counts: np.ndarray, run: int = RUN, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Positions (in the words end to end) and hashes of the shingles that are least in some window of one text."""
    window = run - k + 1
    s = shingle_hashes(h, k)
    m = len(s) - window + 1
    if m <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    least = s[:m].copy()
    for i in range(1, window):
        np.minimum(least, s[i : i + m], out=least)
    ends = np.repeat(np.cumsum(counts), counts)[:m]
    whole = np.arange(m) + run <= ends  # windows inside one text
    least = np.where(whole, least, np.uint64(0xFFFFFFFFFFFFFFFF))
    kept = np.zeros(len(s), bool)
    for i in range(window):
        kept[i : i + m] |= whole & (s[i : i + m] == least)
    at = np.flatnonzero(kept)
    return at, s[at]


def extend(a: np.ndarray, at: np.ndarray, a_first: np.ndarray, a_end: np.ndarray, b: np.ndarray, bt: np.ndarray, b_first: np.ndarray, b_end: np.ndarray, run: int = RUN, k: int = SHINGLE) -> np.ndarray:
    """Whether the words around each hit (shingle at ``at`` in a and ``bt`` in b) agree over ``run`` words."""
    length = np.zeros(len(at), np.int64)
    for step, limit in ((1, run), (-1, run)):
        going = np.ones(len(at), bool)
        for i in range(limit):
            p, q = at + (i if step > 0 else -1 - i), bt + (i if step > 0 else -1 - i)
            inside = (p >= a_first) & (p < a_end) & (q >= b_first) & (q < b_end)
            going &= inside & (a[np.clip(p, 0, len(a) - 1)] == b[np.clip(q, 0, len(b) - 1)])
            if not going.any():
                break
            length += going
    return length >= run


def _matches(h: np.ndarray, counts: np.ndarray, index: dict, run: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of texts and items that share a run."""
    at, fp = fingerprints(h, counts, run, k)
    lo, hi = np.searchsorted(index["fp"], fp, "left"), np.searchsorted(index["fp"], fp, "right")
    n = hi - lo
    hit = np.flatnonzero(n)
    if not len(hit):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    n = n[hit]
    p = np.repeat(at[hit], n)
    j = np.repeat(lo[hit] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(int(n.sum()))
    q = index["at"][j]
    ends = np.cumsum(counts)
    text = np.searchsorted(ends, p, "right")
    item = np.searchsorted(index["ends"], q, "right")
    first = lambda ends, i: np.where(i > 0, ends[i - 1], 0)
    good = extend(h, p, first(ends, text), ends[text], index["h"], q, first(index["ends"], item), index["ends"][item], run, k)
    pairs = np.unique(np.stack([text[good], item[good]], 1), axis=0)
    return pairs[:, 0], pairs[:, 1]


def build_index(texts: list[str | None], run: int = RUN, k: int = SHINGLE) -> dict:
    h, counts = hashed(texts)
    at, fp = fingerprints(h, counts, run, k)
    order = np.argsort(fp, kind="stable")
    return {"fp": fp[order], "at": at[order], "h": h, "ends": np.cumsum(counts)}


def _batches(batch: pa.RecordBatch, most: int = BATCH_CHARS) -> Iterator[tuple[int, list]]:
    texts = batch.column(1).to_pylist()
    first, total = 0, 0
    for i, t in enumerate(texts):
        if i > first and total + len(t or "") > most:
            yield first, texts[first:i]
            first, total = i, 0
        total += len(t or "")
    if first < len(texts):
        yield first, texts[first:]


def leaks(documents: DataFrame, items: DataFrame, run: int = RUN, k: int = SHINGLE, broadcast_words: int = BROADCAST_WORDS) -> DataFrame:
    """(doc_id, item_id) of every document and item that share ``run`` consecutive words."""
    spark = documents.sparkSession
    kinds = dict(documents.dtypes)["doc_id"], dict(items.dtypes)["item_id"]
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}"
    known = items.filter(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select("item_id", "text").distinct()
    size = known.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    if size > 2 * broadcast_words:  # a word and its gap have two characters at least
        return _shuffled(documents, known, run, k, schema)
    rows = known.collect()
    index = build_index([r["text"] for r in rows], run, k)
    index["id"] = np.array([r["item_id"] for r in rows], object)
    shared = spark.sparkContext.broadcast(index)
    id_type = known.schema["item_id"].dataType

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        index, arrow = shared.value, to_arrow_type(id_type)
        for batch in batches:
            for first, texts in _batches(batch):
                doc, item = _matches(*hashed(texts), index, run, k)
                if len(doc):
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(doc + first)), pa.array(index["id"][item].tolist(), arrow)], ["doc_id", "item_id"])

    return documents.select("doc_id", "text").mapInArrow(search, schema).distinct()


def _printed(df: DataFrame, key: str, run: int, k: int) -> DataFrame:
    """(key, fp, around): each fingerprint with the word hashes around it, absent ones null."""
    kind = dict(df.dtypes)[key]
    reach = run - k

    def run_(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            h, counts = hashed(batch["text"].tolist())
            at, fp = fingerprints(h, counts, run, k)
            ends = np.cumsum(counts)
            text = np.searchsorted(ends, at, "right")
            first = np.where(text > 0, ends[text - 1], 0)
            around = []
            for p, a, b in zip(at.tolist(), first.tolist(), ends[text].tolist(), strict=True):
                lo, hi = max(a, p - reach), min(b, p + k + reach)
                around.append([None] * (lo - p + reach) + h[lo:hi].view(np.int64).tolist() + [None] * (p + k + reach - hi))
            yield pd.DataFrame({key: batch[key].to_numpy()[text], "fp": fp.view(np.int64), "around": around})

    return df.select(key, "text").mapInPandas(run_, f"{key} {kind}, fp long, around array<long>")


def _shuffled(documents: DataFrame, items: DataFrame, run: int, k: int, schema: str) -> DataFrame:
    reach = run - k
    docs = _printed(documents.filter(F.col("text").isNotNull()), "doc_id", run, k)
    evals = _printed(items, "item_id", run, k).withColumnRenamed("around", "other")
    both = docs.join(evals, "fp")
    # Words that agree left of the shingle and right of it; the shingle itself agrees by its hash and is compared, too.
    same = F.zip_with("around", "other", lambda x, y: F.coalesce(x == y, F.lit(False)))
    left = F.aggregate(F.slice(same, 1, reach), F.lit(0), lambda n, x: F.when(x, n + 1).otherwise(0))
    tail = F.slice(same, reach + 1, k + reach)
    right = F.array_position(F.concat(tail, F.array(F.lit(False))), False).cast("int") - 1
    return both.filter((right >= k) & (left + right >= run)).select("doc_id", "item_id").distinct()

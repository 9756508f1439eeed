"""Encoding of whole texts with a public byte-level BPE vocabulary.

Problem 7.  Texts of a batch are laid end to end as one array of code points.
A table gives each its class; where a pre-token begins follows from the class
and the state of a small automaton.  The state is found by an associative scan:
every position stands for a function from state to state, functions of
neighbours are composed in doubling steps, and only positions whose function
isn't constant (an apostrophe that may begin an English contraction and the
letters after it) take part.  No regular expression runs over the text.  The
slices go through a cache of merged pairs, their offsets are kept.

Defined results: null and empty texts give empty lists; text that looks like a
special token is ordinary text; texts of any length are encoded whole; other
columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "byte_bpe_50k"
#: Code points that are laid end to end at once; a longer text makes a batch of its own.
BATCH_CHARS = 1 << 20
#: Slices the cache holds before it starts afresh.
CACHE_SLICES = 1 << 20

LETTER, NUMBER, BLANK, WHITE, OTHER, SHORT, LONG, END = range(8)
#: States: the class of the character before; one or two letters of a contraction to come; nothing open.
ONE, TWO, OPEN = 5, 6, 7


# Letters and numbers that Unicode 16 added to those the standard library knows.
NEW_LETTERS = (
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4),
    (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3),
    (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
)
NEW_NUMBERS = ((0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA))


def class_table() -> np.ndarray:
    """The class of every code point: letter, number, blank, other white space, other."""
    table = np.full(0x110000, OTHER, np.uint8)
    for code in range(0x110000):
        kind = unicodedata.category(chr(code))[0]
        if kind == "L":
            table[code] = LETTER
        elif kind == "N":
            table[code] = NUMBER
    for kind, ranges in ((LETTER, NEW_LETTERS), (NUMBER, NEW_NUMBERS)):
        for first, last in ranges:
            table[first : last + 1] = kind
    # The code points with the property White_Space.
    table[[*range(0x09, 0x0E), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = WHITE
    table[0x20] = BLANK
    return table


def _functions() -> np.ndarray:
    """For each class the next state of every state."""
    f = np.empty((8, 8), np.uint8)
    for c in (LETTER, NUMBER, BLANK, WHITE, OTHER):
        f[c] = c
    f[LETTER, TWO], f[LETTER, ONE] = ONE, OPEN
    for c, then in ((SHORT, ONE), (LONG, TWO)):
        f[c] = then
        f[c, [BLANK, OTHER]] = OTHER  # the apostrophe goes with the blank or the signs before it
    f[END] = OPEN
    return f


_TABLE: list[np.ndarray] = []
_NEXT = _functions()


def states(cls: np.ndarray) -> np.ndarray:
    """The automaton's state after every position, by a scan over composed functions."""
    mark = (cls == SHORT) | (cls == LONG)
    state = np.where(cls == END, OPEN, cls).astype(np.uint8)
    if not mark.any():
        return state
    # Only a mark and the two positions after it depend on the state before.
    free = mark.copy()
    free[1:] |= mark[:-1]
    free[2:] |= mark[:-2]
    free &= mark | (cls == LETTER)
    at = np.flatnonzero(free)
    fn = _NEXT[cls[at]]
    run = np.cumsum(np.diff(at, prepend=-2) != 1)
    first = np.flatnonzero(np.diff(run, prepend=0))
    length = np.arange(len(at)) - first[run - 1]
    step = 1
    while step <= length.max():
        later = np.flatnonzero(length >= step)
        # Composition is associative: the function of a stretch is that of its halves, one after the other.
        fn[later] = np.take_along_axis(fn[later], fn[later - step], axis=1)
        length_done = step * 2
        step = length_done
    before = at - length - 1
    start = np.where(before >= 0, state[np.maximum(before, 0)], OPEN)
    state[at] = fn[np.arange(len(at)), start]
    return state


def boundaries(cls: np.ndarray) -> np.ndarray:
    """Whether a pre-token begins at each position.  END begins one of its own and closes all."""
    state = states(cls)
    prev = np.empty_like(state)
    prev[0], prev[1:] = OPEN, state[:-1]
    white = (cls == BLANK) | (cls == WHITE)
    nxt_solid = np.zeros(len(cls), bool)
    nxt_solid[:-1] = ~white[1:] & (cls[1:] != END)
    prev_white = np.zeros(len(cls), bool)
    prev_white[1:] = white[:-1]
    kind = np.where(cls >= SHORT, OTHER, cls)
    solid = (prev != BLANK) & (prev != ONE) & (prev != TWO) & (prev != kind)
    return np.where(cls == END, True, np.where(white, ~prev_white | nxt_solid, solid))


def classes(codes: np.ndarray) -> np.ndarray:
    if not _TABLE:
        _TABLE.append(class_table())
    cls = _TABLE[0][codes]
    quote = np.flatnonzero(codes == 0x27)
    if len(quote):
        padded = np.concatenate([codes, np.zeros(2, codes.dtype)])
        a, b = padded[quote + 1], padded[quote + 2]
        # The contractions 's 't 'm 'd and 're 've 'll.
        cls[quote[np.isin(a, [ord(x) for x in "stmd"])]] = SHORT
        cls[quote[((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))]] = LONG
    return cls


def slices(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The pre-tokens of all texts, where each begins in its text, and how many each text has."""
    joined = "\n".join(texts) + "\n"
    codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    ends = np.cumsum([len(t) + 1 for t in texts]) - 1
    cls = classes(codes)
    cls[ends] = END
    begin = np.flatnonzero(boundaries(cls))
    text_of = np.searchsorted(ends, begin)
    keep = begin != ends[text_of]
    stop = np.append(begin[1:], len(codes))[keep]
    begin, text_of = begin[keep], text_of[keep]
    words = [joined[a:b] for a, b in zip(begin.tolist(), stop.tolist(), strict=True)]
    starts = np.concatenate([[0], ends[:-1] + 1])
    return words, begin - starts[text_of], np.bincount(text_of, minlength=len(texts))


class Merger(dict):
    """Slice to ids; a slice that isn't known yet is merged pair by pair, lowest rank first."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks = ranks

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= CACHE_SLICES:
            self.clear()
        self[word] = ids = self.merge(word.encode())
        return ids

    def merge(self, raw: bytes) -> tuple[int, ...]:
        ranks = self.ranks
        if raw in ranks:
            return (ranks[raw],)
        if len(raw) > 400:
            return self._merge_long(raw)
        parts = [raw[i : i + 1] for i in range(len(raw))]
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = ranks.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return tuple(ranks[p] for p in parts)

    def _merge_long(self, raw: bytes) -> tuple[int, ...]:
        """The same for long slices: a heap of pairs over a linked list, n log n."""
        import heapq

        ranks, n = self.ranks, len(raw)
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))
        alive = [True] * n
        heap: list[tuple[int, int, int, int]] = []

        def push(i: int) -> None:
            j = end[i]
            if j < n and (r := ranks.get(raw[i : end[j]])) is not None:
                heapq.heappush(heap, (r, i, j, end[j]))

        for i in range(n - 1):
            push(i)
        while heap:
            _, i, j, k = heapq.heappop(heap)
            if not alive[i] or end[i] != j or j >= n or not alive[j] or end[j] != k:
                continue
            alive[j], end[i] = False, k
            if k < n:
                before[k] = i
            push(i)
            if before[i] >= 0:
                push(before[i])
        out, i = [], 0
        while i < n:
            out.append(ranks[raw[i : end[i]]])
            i = end[i]
        return tuple(out)


def read_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}


def vocabulary_file(name: str = VOCABULARY, path: str | None = None) -> bytes:
    """The vocabulary's file of ranks, from ``path`` or the installed public tokenizers."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(f"{name}.tiktoken")
    with open(path, "rb") as f:
        return f.read()


def encode(texts: list[str], merger: Merger) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids of all texts, how many each text has; offsets of slices, ids of each slice, slices of each text."""
    words, offsets, counts = slices(texts)
    merged = list(map(merger.__getitem__, words))
    sizes = np.fromiter(map(len, merged), np.int32, len(merged))
    ids = np.fromiter(chain.from_iterable(merged), np.int32, int(sizes.sum()))
    text_of = np.repeat(np.arange(len(texts)), counts)
    return ids, np.bincount(text_of, sizes, len(texts)).astype(np.int64), offsets.astype(np.int32), sizes, counts


def decode(ids: list[int], names: dict[int, bytes]) -> str:
    """The text of ids; ``names`` is the vocabulary the other way round."""
    return b"".join(names[i] for i in ids).decode("utf-8", "replace")


def groups(sizes: list[int], most: int = BATCH_CHARS) -> Iterator[tuple[int, int]]:
    """Stretches of consecutive items whose sizes add up to ``most`` at most, or one item."""
    first, total = 0, 0
    for i, n in enumerate(sizes):
        if i > first and total + n > most:
            yield first, i
            first, total = i, 0
        total += n
    if first < len(sizes):
        yield first, len(sizes)


def _lists(counts: np.ndarray, values: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(values))


_MERGERS: dict[bytes, Merger] = {}


def tokenize(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, path: str | None = None, offsets: bool = False) -> DataFrame:
    """(key, ids) for every row, and with ``offsets`` each slice's first code point and number of ids."""
    data = vocabulary_file(vocabulary, path)
    shared, digest = df.sparkSession.sparkContext.broadcast(data), hashlib.sha256(data).digest()
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merger = _MERGERS.get(digest)
        if merger is None:
            merger = _MERGERS[digest] = Merger(read_ranks(shared.value))
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in groups([len(t) for t in texts]):
                ids, n, begin, sizes, counts = encode(texts[a:b], merger)
                out = [batch.column(0).slice(a, b - a), _lists(n, ids)]
                if offsets:
                    out += [_lists(counts, begin), _lists(counts, sizes)]
                yield pa.RecordBatch.from_arrays(out, names)

    names = [key, "ids", *(["slice_starts", "slice_sizes"] if offsets else [])]
    schema = f"{key} {kind}, ids array<int>" + ", slice_starts array<int>, slice_sizes array<int>" * offsets
    return df.select(key, F.col(text)).mapInArrow(run, schema)

import random

import pytest

from normloom.llm import tokens as T

P = pytest.importorskip("public_tokenizers")
TEXTS = [
    "", None, " ", "  \n\t x", "it's 'tis we'll we're I'VE they'd o'clock ''s '''s's 's's", "Straße 12½ ²³ §§ 3–5", "a  b   c\n\n d ", "<|endoftext|> ok", "naïve café ́x",
    "中文字 русский עברית \U0001f600\U0001f468‍\U0001f469", "\xa0x　y z", "x" * 5000, "ab" * 3000 + "'s " + "'" * 99, "'ll", "'", "l'été d'abord", "\x00\x01 \x1c",
]


@pytest.fixture(scope="module")
def ranks():
    return T.read_ranks(T.vocabulary_file())


@pytest.fixture(scope="module")
def reference(ranks):
    tiktoken = pytest.importorskip("tiktoken")
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_ids_equal_reference(spark, ranks, reference):
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, ids int, slice_starts string")
    got = {r["doc_id"]: r["ids"] for r in T.tokenize(df).collect()}
    assert got == {i: reference.encode_ordinary(t or "") for i, t in enumerate(TEXTS)}


def test_round_trip_and_offsets(spark, ranks):
    names = {v: k for k, v in ranks.items()}
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    for r in T.tokenize(df, offsets=True).collect():
        text = TEXTS[r["doc_id"]] or ""
        assert T.decode(r["ids"], names) == text
        assert sum(r["slice_sizes"]) == len(r["ids"]) and len(r["slice_starts"]) == len(r["slice_sizes"])
        at = 0
        ends = [*r["slice_starts"][1:], len(text)]
        for start, end, n in zip(r["slice_starts"], ends, r["slice_sizes"], strict=False):
            assert T.decode(r["ids"][at : at + n], names) == text[start:end]
            at += n


def test_fuzz_against_pattern():
    regex = pytest.importorskip("regex")
    pattern, rng = regex.compile(P.PATTERN), random.Random(5)
    texts = ["".join(rng.choice("'''sstremvld  \n\t\xa0aé1².!(中\U0001f600") for _ in range(rng.randrange(30))) for _ in range(4000)]
    words, _, counts = T.slices(texts)
    at = 0
    for t, n in zip(texts, counts.tolist(), strict=True):
        assert words[at : at + n] == pattern.findall(t)
        at += n


def test_long_merge_equals_short(ranks):
    m = T.Merger(ranks)
    rng = random.Random(1)
    for _ in range(30):
        raw = "".join(rng.choice(["the", "ing", "a", "Ü", "zz", "0"]) for _ in range(60)).encode()
        assert m._merge_long(raw) == m.merge(raw)


def test_empty_table(spark):
    assert T.tokenize(spark.createDataFrame([], "doc_id long, text string")).count() == 0

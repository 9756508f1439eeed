import random
import re
import unicodedata

import pytest

from normloom.llm import leaks as L

DOCS, ITEMS = "doc_id long, text string, item_id int, fp string", "item_id long, text string, doc_id int"


def words(text):
    text = re.sub("<[^>]*>", " ", text or "")
    text = "".join(c for c in text if ord(c) not in (0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF))
    out, now = [], ""
    for c in unicodedata.normalize("NFKC", text).lower():
        if unicodedata.category(c)[0] in "LN":
            now += c
        elif now:
            out.append(now)
            now = ""
    return [*out, now] if now else out


def model(docs, items, n=12):
    grams = {}
    for i, t, *_ in items:
        w = words(t)
        for j in range(len(w) - n + 1):
            grams.setdefault(tuple(w[j : j + n]), set()).add(i)
    out = set()
    for d, t, *_ in docs:
        w = words(t)
        for j in range(len(w) - n + 1):
            out |= {(d, i) for i in grams.get(tuple(w[j : j + n]), ())}
    return out


def data(seed):
    rng = random.Random(seed)
    say = lambda n: " ".join(rng.choice(["Äpfel", "ﬁsch", "Haus", "x1", "co\xadop", "<b>rot</b>", "ja", "n²"]) + rng.choice(["", str(rng.randrange(30))]) for _ in range(n))
    items = [(i, say(rng.randrange(5, 40)), 7) for i in range(60)] + [(900, None, 7), (901, "", 7), (902, "kurz", 7)]
    docs = []
    for d in range(200):
        t = say(rng.randrange(0, 60))
        if d % 3 == 0:
            w = (items[rng.randrange(60)][1]).split()
            a = rng.randrange(len(w))
            t += "; " + rng.choice(["", "​"]) + " / ".join(w[a : a + rng.randrange(6, 20)]).upper() + " . " + say(4)
        docs.append((d, t, 1, "z"))
    # A third of all documents hold the same item.
    docs += [(1000 + i, f"{i} {items[3][1]}", 1, "z") for i in range(90)] + [(5000, None, 1, "z"), (5001, "", 1, "z"), (5002, " \n", 1, "z"), (5003, say(30_000) + items[5][1], 1, "z")]
    return docs, items + items[:3]


@pytest.mark.parametrize("broadcast", [10**6, 0])
def test_leaks(spark, broadcast):
    docs, items = data(1)
    got = [tuple(r) for r in L.leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), broadcast_words=broadcast).collect()]
    assert set(got) == model(docs, items) and len(got) == len(set(got)) and len(got) > 100


def test_exact_run_length(spark):
    w = [f"w{i}" for i in range(40)]
    items = [(1, " ".join(w), 0)]
    docs = [(n, "a b c " + " ".join(w[5 : 5 + n]) + " d e", 0, "") for n in range(9, 16)]
    got = {r["doc_id"] for r in L.leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)).collect()}
    assert got == {12, 13, 14, 15}


@pytest.mark.parametrize("broadcast", [10**6, 0])
def test_empty(spark, broadcast):
    docs, items = data(2)
    d, i = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)
    assert L.leaks(d.limit(0), i, broadcast_words=broadcast).count() == 0
    assert L.leaks(d, i.limit(0), broadcast_words=broadcast).count() == 0


def test_word_class():
    for code in [*range(0x20, 0x3000), *range(0x1F000, 0x1F900)]:
        c = chr(code)
        if code not in (0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF, 0x3C):
            assert L.words(c) == words(c), hex(code)

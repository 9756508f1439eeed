import random

import numpy as np
import pytest

from normloom.llm import spans as S

SHAPE = "doc_id long, text string, id int, h string, at int"


def shared(a, b, least):
    grams = {a[i : i + least] for i in range(len(a) - least + 1)}
    return any(b[i : i + least] in grams for i in range(len(b) - least + 1))


def model(docs, least):
    known = {d: t for d, t, *_ in docs if d is not None and t}
    ids = sorted(known)
    return {(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if shared(known[a], known[b], least)}


def text(rng, n):
    out = ""
    while len(out) < n:
        out += " ".join("".join(rng.choice("abcdeü中") for _ in range(rng.randrange(1, 9))) for _ in range(rng.randrange(3, 18))) + rng.choice([". ", "; ", ".\n", "! ", " "])
    return out[:n]


def data(seed, least=60):
    rng = random.Random(seed)
    docs = [text(rng, rng.randrange(0, 400)) for _ in range(70)]
    for _ in range(60):
        source, at = rng.choice(docs), rng.randrange(len(docs))
        if len(source) > least:
            n = rng.choice([least - 1, least, least + 1, least // 2, 2 * least])
            a = rng.randrange(len(source))
            cut = rng.randrange(len(docs[at]) + 1)
            docs[at] = docs[at][:cut] + source[a : a + n] + docs[at][cut:]
    docs += [docs[0]] * 3 + ["x" * 200, "y" + "x" * 130, "ab" * 90, "", None, " " * 80]
    board = text(rng, 70)
    docs += [f"{i} {board} {text(rng, 60)}" for i in range(35)]  # a third share one passage
    docs += [f"{i} {board[:40]}{text(rng, 40)}" for i in range(20)]
    return [(i, t, 1, "q", 2) for i, t in enumerate(docs)] + [(3, docs[3], 1, "q", 2), (None, docs[1], 1, "q", 2)]


@pytest.mark.parametrize(("seed", "many"), [(1, 48), (2, 4), (3, 1), (4, 10**6)])
def test_found(spark, seed, many):
    docs = data(seed)
    got = [tuple(r) for r in S.found(spark.createDataFrame(docs, SHAPE), 60, many).collect()]
    assert set(got) == model(docs, 60) and len(got) == len(set(got))


def test_share(spark):
    docs = data(5)
    known = {d: t or "" for d, t, *_ in docs if d is not None}
    got = {r["doc_id"]: r for r in S.shared_share(spark.createDataFrame(docs, SHAPE), 60).collect()}
    assert set(got) == set(known)
    for d, t in known.items():
        covered = np.zeros(len(t), bool)
        others = {o[i : i + 60] for e, o in known.items() if e != d for i in range(len(o) - 59)}
        for i in range(len(t) - 59):
            if t[i : i + 60] in others:
                covered[i : i + 60] = True
        assert got[d]["shared_chars"] == covered.sum() and got[d]["n_chars"] == len(t)


def test_empty_and_long(spark):
    assert S.found(spark.createDataFrame([], SHAPE)).count() == 0
    rng = random.Random(9)
    long = text(rng, 60_000)
    docs = [(1, long, 1, "", 0), (2, "vorher " + long[500:900] + " nachher", 1, "", 0), (3, text(rng, 500), 1, "", 0), (4, None, 1, "", 0)]
    assert [tuple(r) for r in S.found(spark.createDataFrame(docs, SHAPE)).collect()] == [(1, 2)]


def test_guarantee_of_anchors():
    rng = random.Random(3)
    for _ in range(40):
        stretch = text(rng, 300)
        found = []
        for _ in range(2):
            codes = np.frombuffer((text(rng, rng.randrange(200)) + stretch + text(rng, rng.randrange(200))).encode("utf-32-le"), np.uint32)
            found.append(set(S.anchors(codes)[1].tolist()))
        assert found[0] & found[1]


def test_kept(spark):
    import re

    rng = random.Random(6)
    known = [f"Satz {k} {text(rng, 30).replace('.', ',')}. " for k in range(12)]
    docs = ["".join(rng.choice(known) for _ in range(rng.randrange(0, 14))) for _ in range(30)] + [None, "", "  ", "Kurz. Satz.", "".join(known) * 2]
    rows = [(i, t, 1, "q", 2) for i, t in enumerate(docs)]
    got = {r["doc_id"]: (r["sentences"], r["removed"], r["kept"]) for r in S.kept_texts(spark.createDataFrame(rows + rows[:4] + [(None, docs[0], 1, "q", 2)], SHAPE), 3, 20).collect()}
    seen, gone = set(), {i: set() for i, *_ in rows}
    cut = {i: re.findall(S.SENTENCE, t or "") for i, t, *_ in rows}
    for i in sorted(cut):
        for at in range(len(cut[i]) - 2):
            run = tuple(cut[i][at : at + 3])
            if sum(map(len, run)) >= 20:
                if run in seen:
                    gone[i] |= {at, at + 1, at + 2}
                seen.add(run)
    assert got == {i: (len(s), len(gone[i]), "".join(x for k, x in enumerate(s) if k not in gone[i])) for i, s in cut.items()}
    assert any(gone.values()) and S.kept_texts(spark.createDataFrame([], SHAPE)).count() == 0


def test_many_have_places(spark):
    """Spans of many texts name a place and a length that are shared, as those of few do."""
    docs = data(7)
    finds, members = S.shared_spans(spark.createDataFrame(docs, SHAPE), 60, 4)
    known, rows = {d: t for d, t, *_ in docs if d is not None}, finds.collect()
    assert len(rows) > 100 and members.count() > 0
    for r in rows:
        a, b = known[r["id_a"]][r["at_a"] :][: r["length"]], known[r["id_b"]][r["at_b"] :][: r["length"]]
        assert a == b and len(a) == r["length"] >= 60

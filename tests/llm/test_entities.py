import itertools
import random

import numpy as np
import pytest

from normloom.llm import entities as E

SHAPE = "id long, title string, abbr string, code string, date string"


def test_hungarian():
    rng = np.random.default_rng(1)
    for n in range(1, 6):
        for _ in range(15):
            c = rng.random((n, n))
            best = min(sum(c[i, p[i]] for i in range(n)) for p in itertools.permutations(range(n)))
            assert abs(sum(c[i, j] for i, j in enumerate(E.hungarian(c))) - best) < 1e-9


def test_preparation():
    a = E.prepared("Verordnung über die private Kalkschule im Wärmewesen (Kalkschulverordnung)", "PrKalSchV", "0912-3", "2001-02-03")
    for other in ("VERORDNG. ÜBER DIE PRIVATE KALKSCHULE IM WÄRMEWESEN", "über die private Kalkschule im Waermewesen (Kalkschulverordnung), Verordnung vom 3. 2. 2001"):
        b = E.prepared(other, None, "912/3", None)
        assert b["title"] == a["title"] and b["code"] == a["code"]
    assert b["day"] == a["day"] and E.day_of("1.2.2003")[1] == 2003 and E.day_of("2001-02-30") == (None, 2001) and E.day_of("x") == (None, None)
    assert E.prepared(None, "ABC 2025", None, None)["year"] == 2025


def test_bound_holds():
    """No pair that reaches the threshold is left out before it is compared, however damaged its texts are."""
    rng = random.Random(3)
    letters = "abcdefghijklmnop 0123456789"

    def damaged(t, n):
        t = list(t)
        for _ in range(n):
            k = rng.randrange(4)
            i = rng.randrange(max(1, len(t) - 1))
            if k == 0 and t:
                del t[i]
            elif k == 1:
                t.insert(i, rng.choice(letters))
            elif k == 2 and t:
                t[i] = rng.choice(letters)
            elif len(t) > 1:
                t[i], t[i + 1] = t[i + 1], t[i]
        return "".join(t)

    records = []
    for k in range(700):
        title, abbr = f"gesetz ueber die {rng.choice(NOUNS)} {rng.choice(NOUNS)} im {rng.choice(NOUNS)}wesen", rng.choice(NOUNS)[:5] + rng.choice(["", "g", "1999", "2001"])
        for cut in (None, rng.randrange(20, 60)):
            records.append({"title": " ".join(damaged(title[:cut], rng.randrange(12)).split()) if rng.random() < 0.9 else "", "ordinal": rng.choice(["", "", "erste", "zweite"]), "abbr": damaged(abbr, rng.randrange(4)).replace(" ", "") if rng.random() < 0.8 else "", "code": rng.choice(["", "1-2", "1-2-3", "7-1"]), "day": (day := rng.choice([None, 0, 5, 39, 41, 400])), "year": None if day is None and rng.random() < 0.5 else 1970 + (day or 0) // 365, "body": ""})
    import pandas as pd

    frame = pd.DataFrame(records).astype({"day": "Int32", "year": "Int32"})
    frame = E.numbered(frame)
    i, j = (np.array(x) for x in zip(*[(rng.randrange(len(records)), rng.randrange(len(records))) for _ in range(12_000)], *[(2 * k, 2 * k + 1) for k in range(700)], strict=True))
    bound = E.Bound(frame)
    top = bound.others(i, j) + bound.title(i, j)
    exact = np.array([E.date_points(records[a], records[b]) + E.code_points(records[a], records[b]) + E.abbr_points(records[a], records[b]) + E.title_points(records[a], records[b]) for a, b in zip(i, j, strict=True)])
    assert (exact <= top + 1e-9).all() and (exact >= E.THRESHOLD).sum() > 100
    at, most = bound.may_reach(i, j, E.THRESHOLD)
    assert set(np.flatnonzero(exact >= E.THRESHOLD)) <= set(at) and len(at) < len(i)
    by_score = np.array([E.score(records[a], records[b], m) for a, b, m in zip(i[at], j[at], most, strict=True)])
    assert ((by_score >= E.THRESHOLD) == (exact[at] >= E.THRESHOLD)).all() and (by_score[by_score >= E.THRESHOLD] == exact[at][by_score >= E.THRESHOLD]).all()


NOUNS = ["kalk", "torf", "moor", "obst", "eis", "salz", "wein", "rohr", "seil", "honig", "draht", "kork", "hopfen", "jagd"]


def acts(seed, n):
    rng = random.Random(seed)
    seen, laws, register, truth = set(), [], [], set()
    while len(laws) < n:
        a, b, c = rng.choice(["private", "staedtische", "grenznahe", "saisonale"]), rng.choice(NOUNS) + rng.choice(["schule", "karte", "stelle", "pacht"]), rng.choice(NOUNS)
        if (a, b, c) in seen:
            continue
        seen.add((a, b, c))
        i = len(laws) + 1
        title, abbr, code, date = f"Gesetz über die {a} {b} im {c}wesen", f"{a[:2]}{b[:6]}{c[:3]}G".title(), f"{rng.randrange(1, 9999)}-{rng.randrange(60)}", f"{rng.randrange(1950, 2020)}-0{rng.randrange(1, 9)}-1{rng.randrange(9)}"
        laws.append((i, rng.choice([title] * 9 + [None]), abbr, rng.choice([code, None]), rng.choice([date, date, None])))
        for k in range(rng.choice([0, 1, 1, 1, 2])):
            r = 10_000 + i * 10 + k
            register.append((r, rng.choice([title.upper(), title.replace("Gesetz", "Ges."), title]), rng.choice([abbr.lower(), None]) if laws[-1][1] else abbr, rng.choice([code, code.split("-")[0], None]), rng.choice([date, date[:4], f"{date[8:]}.{date[5:7]}.{date[:4]}"])))
            truth.add((i, r))
        if i % 7 == 0:  # a later act under the same title
            register.append((90_000 + i, title, None, None, "2025-05-05"))
        if i % 11 == 0:  # an amending act
            register.append((95_000 + i, f"Erstes Gesetz zur Änderung der Vorschriften über die {a} {b} im {c}wesen", abbr + "ÄndV 1", None, "1999-09-09"))
    return laws, register, truth


@pytest.mark.parametrize(("block", "largest"), [(E.BLOCK, E.LARGEST_EXACT), (40, 0)])
def test_matches(spark, block, largest):
    laws, register, truth = acts(1, 150)
    got = E.matches(spark.createDataFrame(laws + laws[:9], SHAPE), spark.createDataFrame(register + register[:9], SHAPE), block=block, largest=largest).collect()
    pairs = {(r["law_id"], r["reg_id"]) for r in got}
    assert len(pairs & truth) >= (0.97 if largest else 0.85) * len(truth) and len(pairs - truth) <= 0.03 * len(truth)
    assert len(got) == len(pairs) and all(0.5 < r["confidence"] <= 1 for r in got)
    assert len({r["reg_id"] for r in got}) == len(got)


def test_best_assignment():
    rng = np.random.default_rng(2)
    for _ in range(150):
        n, m = rng.integers(1, 8, 2)
        gain = rng.integers(1, 6, (n, m)) * (rng.random((n, m)) < 0.6)
        row, column = np.nonzero(gain)
        got = E.best_assignment(row, column, gain[row, column])
        used = [j for j in got if j >= 0]
        assert len(set(used)) == len(used) and all(gain[i, j] for i, j in enumerate(got) if j >= 0)
        square = np.zeros((max(n, m),) * 2)
        square[:n, :m] = gain
        assert sum(gain[i, j] for i, j in enumerate(got) if j >= 0) == sum(square[i, j] for i, j in enumerate(E.hungarian(-square)))
    assert E.best_assignment(np.array([0, 0, 1, 1]), np.array([0, 1, 0, 1]), np.array([5, 5, 5, 5])) in ([0, 1], [1, 0])
    assert E.best_assignment(np.array([0, 1]), np.array([0, 0]), np.array([5, 5])) == [0, -1]


@pytest.mark.parametrize("seed", [1, 3])
def test_size_of_groups_does_not_matter(spark, seed):
    laws, register, _ = acts(seed, 150)
    # Undated and year-only second entries of acts that share their title.
    title = "Gesetz über die private Kalkschule im Torfwesen"
    laws += [(500 + i, title, f"KalG {1950 + i}", None, f"{1950 + i}-01-01") for i in range(30)]
    register += [(50_000 + 10 * i + k, title, abbr, None, date) for i in range(30) for k, (abbr, date) in enumerate([(f"KalG {1950 + i}", None), (None, str(1950 + i)), (f"KalG {1950 + i}", f"{1950 + i}-01-01")])]
    a, b = spark.createDataFrame(laws, SHAPE), spark.createDataFrame(register, SHAPE)
    small, large = ({tuple(r) for r in E.matches(a, b, largest=n).collect()} for n in (10**9, 0))
    assert small == large and len(small) > 150


def test_hot_title(spark):
    laws = [(i, "Gesetz über die private Kalkschule im Torfwesen", f"KalG {1900 + i}", None, f"{1900 + i}-01-01") for i in range(120)]
    register = [(1000 + i, "Gesetz über die private Kalkschule im Torfwesen", None, None, f"{1900 + i}-01-01") for i in range(120)]
    got = {(r["law_id"], r["reg_id"]) for r in E.matches(spark.createDataFrame(laws, SHAPE), spark.createDataFrame(register, SHAPE), block=50).collect()}
    assert got == {(i, 1000 + i) for i in range(120)}


@pytest.mark.parametrize("date", [None, "1987"])
def test_hot_title_without_days(spark, date):
    rng = random.Random(5)
    names = ["".join(rng.choices("abcdefghklmnoprstuw", k=12)) for _ in range(60)]
    laws = [(i, "Gesetz über die private Kalkschule im Torfwesen", name, None, date) for i, name in enumerate(names)]
    register = [(1000 + i, "Gesetz über die private Kalkschule im Torfwesen", f"{'xyz'[i % 3]}{name[1:]}", None, date) for i, name in enumerate(names)]
    got = {(r["law_id"], r["reg_id"]) for r in E.candidates(spark.createDataFrame(laws, SHAPE), spark.createDataFrame(register, SHAPE), block=25).collect()}
    assert {(i, 1000 + i) for i in range(60)} <= got


def test_empty_and_null(spark):
    laws, register, _ = acts(2, 20)
    a, b = spark.createDataFrame(laws, SHAPE), spark.createDataFrame(register, SHAPE)
    assert E.matches(a.limit(0), b).count() == 0 and E.matches(a, b.limit(0)).count() == 0
    nothing = spark.createDataFrame([(1, None, None, None, None), (2, "", "", "", ""), (None, "x", "y", "1", "2001-01-01"), (3, "x " * 20_000, None, None, None)], SHAPE)
    assert E.matches(nothing, nothing.withColumn("id", nothing["id"] + 100)).filter("law_id < 3").count() == 0


def test_found_columns(spark):
    laws = spark.createDataFrame([(1, "a", "AbcG", "AbcG", "2001-01-01", "Gesetz über Abc", 1, "1-2", 1, "t")], "law_id long, slug string, jurabk string, amtabk string, ausfertigung_datum string, langue string, norm_count int, fna_code string, main_group int, opening_text string")
    register = spark.createDataFrame([(9, "Gesetz über Abc", "AbcG", "1-2", "2001-01-01", None)], "reg_id long, titel string, abk string, fna_code string, ausgefertigt string, fundstelle string")
    assert [tuple(r) for r in E.found(laws, register).collect()] == [(1, 9)]

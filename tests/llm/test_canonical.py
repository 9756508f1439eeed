import random

import pytest

from normloom.llm import canonical as C

BOOKS = [(1, "MueAbgG", "Mühlenabgabengesetz"), (2, "GerFoeV", "Gerbereiförderverordnung"), (3, "GerFoeO", "Gerbereiförderordnung"), (4, "TorZonGB", "Torfzonengesetzbuch"), (5, "KlaPacO", "Kläranlagenpachtordnung"), (6, "WegKenV", "Wegekennzeichnungsverordnung"), (7, None, None)]
CASES = {
    "mühlenabgabengesetzes": 1, "MUEABGG": 1, "Mue.Abg.G.": 1, "i.V.m. Mühlenabgaben-\ngesetz": 1, "„des Mühlenabgabenges.“": 1, "mühl.abgabengesetz": 1, "muehlenabgabeng a.f.": 1, "mühlenbgabengestez": 1,
    "gerbeeiförderverordnung": 2, "Gerbereiförder-VO": 2, "gerbereiförderordn. (neufassung)": 3, "gerfoeo": 3, "gerfoe": -1,
    "torfzonengesetzbuchs v. 1998": 4, "torfzonen-gb": 4, "k1äranlagenpacht0rdnung": 5, "kläranlagen\xadpachto": 5,
    "blaskapellenkennzeichnungsverordnung": -1, "richtlinie 96/170/ibg": -1, "x?#q": -1, "kegelclubabgabengesetz": -1,
}
SHAPE = "ref_id long, book string, span_text string, entry int, value string"


def slow(a, b):
    d = [[i + j if not i or not j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def test_edits():
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randrange(10)))
    for _ in range(500):
        a, b = word(), word()
        assert C.edits(a, b) == slow(a, b)


def _rows():
    out = [(i, v, None, 9, "z") for i, v in enumerate(CASES)]
    out += [(100, None, "§ 3 Abs. 2 MueAbgG", 9, "z"), (101, "", "nach § 4, 5 der Gerbereiförderordnung", 9, "z"), (102, "dieses Gesetzes", "Art. 7a Abs. 1 KlaPacO", 9, "z"), (103, "der Verordnung", "§ 3 Abs. 2", 9, "z"), (104, None, None, 9, "z"), (105, "nr.", "", 9, "z"), (106, "gerfoev", "§ 1 KlaPacO", 9, "z")]
    hot = [(200 + i, "klapaco", f"§ {i} KlaPacO", 9, "z") for i in range(60)]
    return out + hot + out[:5] + [(None, "klapaco", None, 9, "z")]


WANT = {**dict(enumerate(CASES.values())), 100: 1, 101: 3, 102: 5, 103: -1, 104: -1, 105: -1, 106: 2, **{200 + i: 5 for i in range(60)}}


@pytest.mark.parametrize("most", [100, 0])
def test_mapping(spark, most):
    books = spark.createDataFrame(BOOKS + BOOKS[:2], "book_id long, jurabk string, name string")
    got = C.mapped(spark.createDataFrame(_rows(), SHAPE), books, most=most).collect()
    assert {r["ref_id"]: r["entry"] for r in got} == WANT and len(got) == len(WANT)


def test_found_and_unmatched(spark):
    books = spark.createDataFrame(BOOKS, "book_id long, jurabk string, name string")
    refs = spark.createDataFrame(_rows(), SHAPE)
    assert {tuple(r) for r in C.found(refs, books).collect()} == set(WANT.items())
    assert sum(r["refs"] for r in C.unmatched(refs, books).collect()) == sum(v == -1 for v in WANT.values())


@pytest.mark.parametrize("most", [100, 0])
def test_empty(spark, most):
    books = spark.createDataFrame(BOOKS, "book_id long, jurabk string, name string")
    refs = spark.createDataFrame(_rows(), SHAPE)
    assert C.mapped(refs.limit(0), books, most=most).count() == 0
    assert {r["entry"] for r in C.mapped(refs, books.limit(0), most=most).collect()} == {-1}


def test_long_value():
    index = C.Index(BOOKS)
    assert C.decide(index, C.named("klapaco " * 20_000, None))[0] == -1


def test_siblings_and_both_ways(spark):
    """More than ten entries that differ by their endings, and the same results by the index and by joins."""
    rng = random.Random(5)
    stems = ["muehlen", "torf", "kalk", "gerberei", "klaeranlagen"]
    second = ["abgaben", "foerder", "pacht", "zonen", "messungs", "karten", "wacht"]
    books = [(i, f"A{i}Xyz", f"{a}{b}{c}") for i, (a, b, c) in enumerate((a, b, c) for a in stems for b in second for c in ("gesetz", "verordnung", "ordnung", "gesetzbuch"))]
    values = {name: i for i, _, name in books} | {short.lower(): i for i, short, _ in books}
    for i, _, name in books:
        at = rng.randrange(1, len(name) - 12)
        values[name[:at] + "q" + name[at:]] = i
    refs = [(i, v, None, 1, "x") for i, v in enumerate(values)]
    table, rows = spark.createDataFrame(books, "book_id long, jurabk string, name string"), spark.createDataFrame(refs, SHAPE)
    by_index, by_join = ({r["ref_id"]: (r["entry"], r["agreement"]) for r in C.mapped(rows, table, most=most).collect()} for most in (1_000, 0))
    assert by_index == by_join
    want = dict(enumerate(values.values()))
    wrong = [i for i in want if by_index[i][0] != want[i]]
    assert all(by_index[i][0] == C.UNMATCHED for i in wrong) and len(wrong) <= 0.03 * len(want)


def test_allowed():
    """The fewer letters, the fewer edits, without a step from one length to the next."""
    edits = [C.allowed(n) for n in range(40)]
    assert edits[0] == edits[C.EXACT_LETTERS] == 0 and edits[-1] == C.MOST_EDITS and all(b - a in (0, 1) for a, b in zip(edits, edits[1:], strict=False))

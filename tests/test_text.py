import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from normloom.functions import text as T


def _apply(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(f(F.col("v"))).collect()]


def test_norm_id(spark):
    values = ["§ 1", "§ 2a", "Art. 3", "Art 4", "§§ 1 bis 3", "Anlage (zu § 3)", None, "", "  ", "§ 1\xa0", "Eingangsformel", "§", "Übersicht 2", "---", "Art.3", "art. 5", "§1a"]
    want = ["1", "2a", "art-3", "art-4", "1-bis-3", "anlage-zu--3", "norm-6", "norm-7", "norm-8", "1", "eingangsformel", "norm-11", "übersicht-2", "norm-13", "art-3", "art-5", "1a"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").orderBy("i")
    got = [r[0] for r in df.select(T.norm_id(F.col("v"), F.col("i"))).collect()]
    want[4] = "-1-bis-3".strip("-")
    assert got == want


def test_keys(spark):
    assert _apply(spark, ["Straßenverkehrs-Ordnung (StVO)", "Größe ½", None, ""], T.norm_title) == ["straenverkehrsordnung", "groe12", None, ""]
    assert _apply(spark, ["StVO 2013", "§", None], T.norm_abbr) == ["stvo2013", None, None]
    assert _apply(spark, ["Straßengesetzes", "BGBs", "Ordnungs", "kurzes", "Abgabengess", None], T.normalize_book) == ["strassengesetz", "bgbs", "ordnungs", "kurzes", "abgabengess", None]
    assert _apply(spark, ["Gesetz (Kurz - ABC)", "ohne", "(a) (b–cd)", None], T.block_abbr) == ["abc", None, "cd", None]
    assert _apply(spark, ["Gesetz (Kurzname) ", "Gesetz (abc)", "(Name) am Anfang", None], T.short_name) == ["Kurzname", None, None, None]
    assert _apply(spark, ["0x-1", "912-3", "x1", "", None], T.main_group) == [0, 9, None, None, None]


def test_decompositions(spark):
    """Keys are those of the compatibility decomposition, whatever the character."""
    characters = [chr(c) for c in range(0x80, 0x1FC00) if not 0xD800 <= c < 0xE000 and unicodedata.normalize("NFKD", chr(c)) != chr(c)]
    values = [f"x{c}y" for c in characters] + ["".join(characters[i : i + 50]) for i in range(0, len(characters), 50)]

    def model(v):
        plain = "".join(c for c in unicodedata.normalize("NFKD", v) if not unicodedata.combining(c)).lower()
        return "".join(c for c in plain if c in "abcdefghijklmnopqrstuvwxyz0123456789") or None

    assert _apply(spark, values, T.norm_abbr) == [model(v) for v in values]


def test_links(spark):
    links = ["https://a.example/bgb/index.html", "https://a.example/bgb/xml.zip", "bgb", "https://a.example/bgb/"]
    assert _apply(spark, links, T.slug_from_link) == ["bgb", "bgb", "bgb", "a.example"]
    assert _apply(spark, links[:2], T.zip_url_from_link) == ["https://a.example/bgb/xml.zip"] * 2


def test_labels(spark):
    assert _apply(spark, ["a" * 14, "b" * 15, None], T.label) == ["a" * 14, "b" * 13 + "…", None]
    assert _apply(spark, ["x\n" * 60, None], T.tooltip) == [("x " * 60)[:90], None]


def test_tags_and_white(spark):
    assert _apply(spark, ["<P>a\xa0 <B>b</B> .</P>", "", None, "<>"], T.strip_tags) == ["a b .", "", None, "<>"]
    assert _apply(spark, ["\xa0 \t a b   ", None], T.strip_white) == ["a b", None]
    # The generated map agrees with the standard library on Latin letters.
    letters = [chr(c) for c in range(0xC0, 0x250)]
    plain = ["".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x)) for c in letters]
    got = _apply(spark, letters, T.strip_accents)
    assert [g for g, p in zip(got, plain, strict=True) if len(p) == 1] == [p for p in plain if len(p) == 1]


def _short(s, most):
    s = s.strip()
    if not s:
        return None
    if len(s) <= most:
        return s
    head = s[:most]
    return (head.rsplit(" ", 1)[0].rstrip() if " " in head else head) or None


def test_hard_cut(spark):
    values = ["aaaaaaa\xa0a", "aaaaaaaaaa", "aaaaaa  bb", "aaa\xa0 bbbb", " " * 20, None]
    assert _apply(spark, values, lambda c: T.short_desc(c, 8)) == ["aaaaaaa\xa0", "a" * 8, "aaaaaa", "aaa", None, None]


@settings(max_examples=10, deadline=None, derandomize=True)
@given(st.lists(st.text(alphabet="ab \xa0ü", max_size=30), min_size=1, max_size=40))
def test_short_desc(spark, values):
    assert _apply(spark, values, lambda c: T.short_desc(c, 8)) == [_short(v, 8) for v in values]

from pyspark.sql import functions as F

from normloom.operators import citations, resolve, taxonomy


def _number(word):
    return word.isascii() and word.isdigit()


def _dated(words):
    """Whether words begin with ``D. M. YYYY``, its parts written together or apart."""
    text = "".join(words)
    day, _, rest = text.partition(".")
    month, _, year = rest.partition(".")
    return _number(day) and len(day) <= 2 and _number(month) and len(month) <= 2 and _number(year[:4]) and len(year) >= 4


def _entries(text):
    """Entries of a text, line by line."""
    out, lines = [], text.split("\n")
    for i, line in enumerate(lines):
        first = line.split()[0] if line.split() and not line[0].isspace() else ""
        parts = first.split("-")
        code = len(parts) in (2, 3) and all(map(_number, parts)) and len(parts[0]) <= 4 and (i + 1 < len(lines) or len(line) > len(first))
        if code:
            out.append([first, line[len(first) :]])
        elif out:
            out[-1][1] += "\n" + line
    rows = []
    for code, block in out:
        block = block.lstrip()
        cuts = [i for i in range(len(block)) if block.startswith("vom", i) and _dated(block[i + 3 :].split())]
        rows.append((code, (block[: cuts[0]] if cuts else block[:140]).strip()))
    return rows


def test_segments(spark):
    texts = [
        "Vorwort\n1-2 Kurz\n12-3-4 Gesetz über A\nzweite Zeile vom 1. 2. 1999 BGBl. 7\n9999-1 " + "x" * 200 + "\n12-3-4 Doppelt",
        None,
        "",
        "12345-1 zu lang\n1-2-3-4 zu viele\n1-2\n\n 3-4 eingerückt\n5-6\t vom 1.2.99 vom 11.12.2001x\n7-8",
        "1-1\n2-2 \n3-3\n",
        "10-2 vom vom 3. 4.1950 vom 5.6.1970\r\n10-3\xa0geschützt",
    ]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    got = [tuple(r) for r in taxonomy.segment_entries(rows, keep=("k",)).orderBy("k", "pos").collect()]
    want = [(k, i, *e) for k, t in enumerate(texts) for i, e in enumerate(_entries(t or ""))]
    assert got == want and len(got) == 11


def test_priority_join(spark):
    entries = spark.createDataFrame([("1-1", "Gesetz über Alpha", 1), ("2-2", "Gesetz über Alpha", 2), ("3-3", "Gesetz Beta (Kurz - BetaG)", 3), ("4-4", "kurz", 4), (None, "ohne Code hier", 5)], "code string, block string, ord long")
    by_title, by_abbr = taxonomy.join_maps(entries)
    assert {tuple(r) for r in by_title.collect()} == {("gesetzuberalpha", "1-1"), ("gesetzbeta", "3-3")}
    assert {tuple(r) for r in by_abbr.collect()} == {("betag", "3-3")}
    toc = spark.createDataFrame([("a", "x"), ("b", "Gesetz über Alpha"), ("c", "x"), ("betag", None), ("e", "y")], "slug string, title string")
    slugs = spark.createDataFrame([("a", "n", "Gesetz über Alpha"), ("b", None, "z"), ("c", "Beta-G", None)], "slug string, jurabk string, langue string")
    got = {tuple(r) for r in taxonomy.join_taxonomy(toc, slugs, by_title, by_abbr).collect()}
    assert got == {("a", "1-1", "langue"), ("b", "1-1", "toc_title"), ("c", "3-3", "jurabk"), ("betag", "3-3", "slug")}
    stats = {r["how"]: r["laws"] for r in taxonomy.match_stats(taxonomy.join_taxonomy(toc, slugs, by_title, by_abbr), 5).collect()}
    assert stats == {"langue": 1, "toc_title": 1, "jurabk": 1, "slug": 1}


def test_classify_and_opening(spark):
    laws = spark.createDataFrame([("a", [("", None), ("x", "<P> </P>"), ("y", "<P>Text</P>")]), ("b", [])], "slug string, norms array<struct<enbez:string,text_xml:string>>")
    got = {r["slug"]: r["o"] for r in laws.select("slug", taxonomy.opening_text(F.col("norms"), 3).alias("o")).collect()}
    assert got == {"a": "Tex", "b": None}
    codes = spark.createDataFrame([("a", "03-1")], "slug string, fna_code string")
    assert {r["slug"]: r["main_group"] for r in taxonomy.classify(laws, codes).collect()} == {"a": 0, "b": None}


def test_citations(spark):
    text = "Nach § 242 BGB und §§ 3 Abs. 2 Satz 1 des Mühlenabgabengesetzes, Art. 5 GG 2020; § 7 Verordnung; Artikel 9 der Hausordnung. § 12 ohne Buch"
    rows = spark.createDataFrame([(1, f"<P>{text}</P>"), (2, None), (3, "")], "k int, text_xml string")
    got = [(r["book"], r["number"], r["unit"]) for r in citations.extract(rows, ["k"]).orderBy("cit_pos").collect()]
    assert got == [("bgb", "242", "par"), ("mühlenabgabengesetzes", "3", "par"), ("gg 2020", "5", "art"), ("hausordnung", "9", "art")]


def test_resolution(spark):
    laws = spark.createDataFrame([("bgb", "BGB", "Bürgerliches Gesetzbuch", 1), ("x", "XG", "Gesetz über X (Kurzgesetz)", 2), ("y", "XG", None, 3)], "slug string, jurabk string, langue string, ord long")
    index = resolve.book_index(laws, laws.select("slug", F.col("langue").alias("title"), "ord"))
    keys = {r["key"]: r["slug"] for r in index.collect()}
    assert keys["bgb"] == "bgb" and keys["kurzgesetz"] == "x" and "xg" not in keys
    refs = spark.createDataFrame([("x", "bgb", "§ 1 BGB", 1, 0), ("x", "BGB", "§ 2 BGB", 2, 0), ("bgb", "Kurzgesetzes", " § 1 bgb ", 0, 0), ("x", "nichts", None, 3, 0), ("x", "Gesetz", "§ 4", 4, 0), ("x", None, "§ 4", 4, 0)], "source_slug string, book string, span_text string, norm_pos int, cit_pos int")
    done = resolve.resolve(resolve.drop_false_positives(refs), index, laws)
    assert {(r["source"], r["target"]) for r in resolve.edges(done).collect()} == {("de-bund/XG", "de-bund/BGB"), ("de-bund/BGB", "de-bund/XG")}
    assert {tuple(r) for r in resolve.resolver(done).collect()} == {("§ 1 bgb", "de-bund/XG"), ("§ 2 bgb", "de-bund/BGB")}
    assert resolve.stats(done).first().asDict() == {"resolved": 3, "unresolved": 1, "coverage_pct": 75.0, "unique_edges": 2, "resolver_entries": 2}
    assert [tuple(r) for r in resolve.top_unresolved(done).collect()] == [("nichts", 1)]
    assert resolve.stats(done.limit(0)).first()["coverage_pct"] == 0.0


def test_pages(spark):
    page = '<tr><td class="fnal"> 12-3 </td> <td>x <a href="a?b=1&amp;c=2" id="i" class="ltg"><b>Gesetz &lt;A&gt;</b> (Kurz)</a></td></tr><td class="fnal">9</td><td><a href="z" class="ltg">B</a>'
    rows = [tuple(r) for r in taxonomy.page_rows(spark.createDataFrame([(page,), (None,), ("",)], "html string")).collect()]
    assert rows == [(0, "12-3", "a?b=1&c=2", "Gesetz <A>", 1), (1, "9", "z", "B", 9)]
    odd = '<td class="fnal">1-x</td><td><a href="u" class="ltg">T</a><td class="fnal">2</td><td>ohne</td><td class="fnal">3</td> <td><a name="n">y</a><a\n href="u3" class="ltg" >T<br/>3</a><a href="u4" class="ltg">U</a>'
    assert [tuple(r) for r in taxonomy.page_rows(spark.createDataFrame([(odd,)], "html string")).collect()] == [(0, "3", "u3", "T3", 3)]
    deep = [("1" * i, "1" * i, "1" * (i + 1), "1" * (i + 1)) for i in range(1, 8)]
    assert taxonomy.reached_pages(spark.createDataFrame(deep, "parent string, parent_code string, child string, child_code string"), spark.createDataFrame([("1",)], "path string")).count() == 8
    links = spark.createDataFrame([("r", "1", "a", "12"), ("a", "12", "b", "123"), ("b", "123", "r", "1"), ("b", "123", "c", "99"), ("q", "5", "s", "51"), ("b", "123", "d", "123x"), ("b", None, "e", "1234")], "parent string, parent_code string, child string, child_code string")
    got = taxonomy.reached_pages(links, spark.createDataFrame([("r",)], "path string"))
    assert {r["path"] for r in got.collect()} == {"r", "a", "b"}


def test_opening_texts_of_rows(spark):
    rows = [("a", 2, "<P>zwei</P>"), ("a", 1, "<P> \xa0</P>"), ("a", 1, None), ("a", 2, "<B>anders</B>"), ("b", 1, ""), (None, 3, "ohne Schlüssel"), ("c", 5, "<>"), ("c", None, "zuerst"), ("d", 1, "<a <b> x")]
    got = {r["slug"]: r["opening_text"] for r in taxonomy.opening_texts(spark.createDataFrame(rows + rows[:2], "slug string, norm_pos int, text_xml string"), ["slug"], 5).collect()}
    assert got == {"a": "ander", None: "ohne ", "c": "zuers", "d": "x"}


def test_plain_index(spark):
    rows = [("stgb", "Strafgesetzbuch", 1), ("stpo", "Strafprozeßordnung", 2), ("burlg", "Mindesturlaubsgesetz (B UrlG)", 3), ("lang-stgb", "Strafgesetzbuch", 4), ("xx", "STGB", 5), ("yyyy", "Maße", 6), ("kurz", "(ab)", 7), ("leer", None, 8)]
    got = {r["key"]: r["slug"] for r in resolve.plain_index(spark.createDataFrame(rows, "slug string, title string, ord long")).collect()}
    assert got["strafgesetzbuch"] == "stgb" and got["strafprozessordnung"] == got["strafprozeßordnung"] == "stpo" and got["burlg"] == "burlg"
    # The shorter slug wins even against the slug itself; of equally long ones the slug.
    assert got["stgb"] == "xx" and got["masse"] == "yyyy" and got["(ab)"] == "kurz" and got["leer"] == "leer" and "ab" not in got

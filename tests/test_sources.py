import datetime as dt
import io
import json
import zipfile

from pyspark.sql import functions as F

from normloom.operators.history import HistoryStore
from normloom.sources import laws, sinks, toc
from normloom.streaming import ingest

LAW = """<?xml version="1.0"?><dokumente><norm><metadaten><jurabk> ABC</jurabk><amtabk>A</amtabk><ausfertigung-datum manuell="ja">2001-02-03</ausfertigung-datum>
<langue>Gesetz <B>x</B></langue></metadaten><textdaten><fussnoten>f</fussnoten></textdaten></norm>
<norm><metadaten><enbez>§ 1</enbez><titel>Zweck</titel></metadaten><textdaten><text format="XML">vor &lt; <P>a &lt; b<BR/>c</P> nach</text></textdaten></norm>
<norm><metadaten><titel>Ohne</titel></metadaten><textdaten/></norm></dokumente>"""


def test_parse_law():
    law = laws.parse_law(LAW.encode())
    assert (law["jurabk"], law["amtabk"], law["ausfertigung_datum"], law["langue"]) == (" ABC", "A", "2001-02-03", "Gesetz ")
    assert law["norm_count"] == 2 and law["parse_warnings"] == []
    assert law["norms"][0] == {"enbez": "§ 1", "titel": "Zweck", "text_xml": "vor < <P>a &lt; b<BR/>c</P> nach"}
    assert law["norms"][1] == {"enbez": None, "titel": "Ohne", "text_xml": None}


def test_broken_documents():
    broken = laws.parse_law(b"<dokumente><norm><metadaten><jurabk>X</jurabk></metadaten><textdaten><text><B>offen</text></textdaten></norm>")
    assert broken["jurabk"] == "X" and "XML recovered" in broken["parse_warnings"] and "missing langue" in broken["parse_warnings"]
    for data in (b"", None, b"\x00\xff no markup"):
        assert laws.parse_law(data)["parse_warnings"] == ["Unrecoverable XML"]
    lines = laws.parse_law(b"<d><norm/><norm><textdaten><text><P a='1 /&gt;'>x\r\ny /&gt; </P><!-- a /> --></text></textdaten></norm></d>")["norms"][0]["text_xml"]
    assert lines == '<P a="1 /&gt;">x\ny /&gt; </P><!-- a /> -->'
    assert laws.parse_law(b"<d><norm/><norm><textdaten><text><P>x\r\ny</P></text></textdaten></norm>")["norms"][0]["text_xml"] == "<P>x\ny</P>"
    empty = laws.parse_law(b"<dokumente/>")
    assert empty["norm_count"] == 0 and empty["parse_warnings"] == ["no norms"]


def test_archives_and_files(spark, tmp_path):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("bild.png", b"x")
        z.writestr("abc.xml", LAW)
    (tmp_path / "abc.zip").write_bytes(data.getvalue())
    (tmp_path / "kaputt.zip").write_bytes(b"kein Archiv")
    got = laws.parse_laws(laws.read_archives(spark, str(tmp_path))).collect()
    assert [(r["slug"], r["norm_count"]) for r in got] == [("abc", 2)]
    (tmp_path / "def.xml").write_text(LAW)
    assert [r["slug"] for r in laws.read_xml_files(spark, str(tmp_path)).collect()] == ["def"]


def test_toc(spark, tmp_path):
    (tmp_path / "toc.xml").write_text("""<items><item><title>Eins</title><link>http://x.example/eins/xml.zip</link></item><item><title>Ohne</title></item><item><link>http://x.example/b/xml.zip</link></item>
<item><title>Zwei</title><link>http://x.example/zwei_2020/xml.zip</link></item><item><title> Neu </title><link> http://x.example/eins/xml.zip </link></item><item><title>Leer</title><link> </link></item></items>""")
    got = {r["slug"]: (r["title"], r["zip_url"]) for r in toc.read_toc(spark, str(tmp_path / "toc.xml")).collect()}
    assert got == {"eins": ("Neu", "http://x.example/eins/xml.zip"), "zwei_2020": ("Zwei", "http://x.example/zwei_2020/xml.zip")}


def test_html(spark):
    df = spark.createDataFrame([("s", "A&B", None, [("§ 1", "T<i>", "<P>x</P>"), (None, None, None)])], f"slug string, jurabk string, langue string, norms array<{laws.NORM}>")
    page = df.select(laws.law_html(*[F.col(c) for c in ("slug", "jurabk", "langue", "norms")])).first()[0]
    want = ["<!DOCTYPE html>", '<html lang="de">', "<head>", '  <meta charset="UTF-8">', "  <title>A&amp;B – A&amp;B</title>", "</head>", "<body>", '<h1 data-slug="s">A&amp;B – A&amp;B</h1>', '<section id="1">', "  <h2>§ 1 T&lt;i&gt;</h2>", '  <div class="norm-text"><P>x</P></div>', "</section>", '<section id="norm-1">', "</section>", "</body>", "</html>"]
    assert page.split("\n") == want
    bare = df.select(laws.law_html(F.col("slug"), F.lit(""), F.lit("T"), F.array().cast(f"array<{laws.NORM}>"))).first()[0]
    assert bare.endswith('<h1 data-slug="s">s – T</h1>\n</body>\n</html>')
    assert df.select(F.size(laws.content_norms(F.col("norms")))).first()[0] == 1


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("b", None, 2), ("a", "ü", 1)], "id string, name string, n int")
    assert sinks.write_json_array(df.orderBy("id"), str(tmp_path / "o/nodes.json"), ("name",)) == 2
    assert json.loads((tmp_path / "o/nodes.json").read_text()) == [{"id": "a", "name": "ü", "n": 1}, {"id": "b", "name": None, "n": 2}]
    assert laws.read_graph_json(spark, str(tmp_path / "o/nodes.json")).count() == 2
    sinks.write_json_map(df, "id", "n", str(tmp_path / "m.json"))
    assert json.loads((tmp_path / "m.json").read_text()) == {"a": 1, "b": 2}
    sinks.write_table(df, str(tmp_path / "t"), ["n"])
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2
    assert sinks.summary(df.filter("id = 'a'")) == "id: a\nname: ü\nn: 1"
    sinks.write_json_array(df.limit(0), str(tmp_path / "e.json"))
    assert json.loads((tmp_path / "e.json").read_text()) == []


def test_law_json(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"jurabk": "A", "norms": [{"enbez": "§ 1", "titel": None, "text_xml": "x"}], "norm_count": 1}))
    (tmp_path / "b.json").write_text("{kaputt")
    assert [(r["slug"], r["norm_count"]) for r in laws.read_law_json(spark, str(tmp_path / "*.json")).collect()] == [("a", 1)]


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.xml").write_text(LAW)
    run = lambda: ingest.ingest_laws(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "c1")).awaitTermination()
    run()
    (tmp_path / "in/b.xml").write_text(LAW)
    run()
    assert sorted(r["slug"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b"]

    shape = "update_id long, node_id string, created_at string, repealed_at string, op string, observed_at timestamp, ingested_at timestamp"
    store = HistoryStore(spark, f"file://{tmp_path}/store")
    t = dt.datetime(2024, 1, 1)
    for i, op in enumerate("UD"):
        spark.createDataFrame([(i, "n", None, None, op, t + dt.timedelta(days=i), t)], shape).write.mode("append").parquet(str(tmp_path / "updates"))
        ingest.ingest_updates(spark, str(tmp_path / "updates"), shape, store, str(tmp_path / "c2")).awaitTermination()
    assert [(r["node_id"], (r["to_ts"] - r["from_ts"]).days) for r in store.chains().collect()] == [("n", 1)]

"""Laws from XML documents, zip archives and per-law JSON.

The standard library parses each document; one that isn't well formed goes
through a tolerant parser that closes what is open.  ``from_xml`` would resolve
references inside the norms' markup and can't recover, so this runs as an
Arrow-batched function.  Defined results: null or empty bytes give a law
without norms and a warning; missing names and titles are null with a warning;
documents of any size are parsed whole.
"""

from __future__ import annotations

import io
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from normloom.functions.text import escape_html, norm_id, strip_white

NORM = "struct<enbez:string,titel:string,text_xml:string>"
LAW = f"jurabk string, amtabk string, ausfertigung_datum string, langue string, norm_count int, parse_warnings array<string>, norms array<{NORM}>"


class _Tolerant(HTMLParser):
    """Builds a tree from markup with errors: open elements end with their parent, stray ends are ignored."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = ET.Element("recovered")
        self.open = [self.root]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.open.append(ET.SubElement(self.open[-1], self._case(tag), {k: v or "" for k, v in attrs}))

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        ET.SubElement(self.open[-1], self._case(tag), {k: v or "" for k, v in attrs})

    def handle_endtag(self, tag: str) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag.lower() == tag:
                del self.open[i:]
                return

    def handle_data(self, data: str) -> None:
        top = self.open[-1]
        if len(top):
            top[-1].tail = (top[-1].tail or "") + data
        else:
            top.text = (top.text or "") + data

    def _case(self, tag: str) -> str:
        # The parser lowers names; the start tag's text has them as they stand.
        text = self.get_starttag_text() or ""
        return text[1 : 1 + len(tag)] if text[1 : 1 + len(tag)].lower() == tag else tag


def _tree(data: bytes) -> tuple[ET.Element | None, list[str]]:
    try:
        # Comments stay where they are, as they part the texts around them.
        return ET.fromstring(data, ET.XMLParser(target=ET.TreeBuilder(insert_comments=True))), []
    except ET.ParseError:
        pass
    text = data.decode("utf-8", "replace")
    if "<" not in text:
        return None, ["Unrecoverable XML"]
    parser = _Tolerant()
    parser.feed(text.replace("\r\n", "\n").replace("\r", "\n"))  # line ends as the strict parser reads them
    parser.close()
    return (parser.root, ["XML recovered"]) if len(parser.root) else (None, ["Unrecoverable XML"])


_EMPTY = re.compile(r"(<!--.*?-->)| />", re.S)


def inner_xml(e: ET.Element) -> str | None:
    """Text before the first child as it reads and the children as markup, trimmed; null if nothing remains."""
    markup = "".join(ET.tostring(c, encoding="unicode") for c in e)
    # A literal > stands in tags and comments alone; empty elements are written without a blank.
    text = (e.text or "") + _EMPTY.sub(lambda m: m[1] or "/>", markup)
    return text.strip() or None


def parse_law(data: bytes | None) -> dict:
    """Fields of one document."""
    law: dict = {"jurabk": None, "amtabk": None, "ausfertigung_datum": None, "langue": None, "norm_count": 0, "parse_warnings": [], "norms": []}
    root, law["parse_warnings"] = _tree(data or b"")
    if root is None:
        return law
    found = root.findall(".//norm")
    if not found:
        law["parse_warnings"].append("no norms")
        return law

    def text(norm: ET.Element, name: str) -> str | None:
        """The leading text of an entry of a norm's metadata."""
        return norm.findtext(f"metadaten/{name}") or None

    for field, name in (("jurabk", "jurabk"), ("amtabk", "amtabk"), ("ausfertigung_datum", "ausfertigung-datum"), ("langue", "langue")):
        law[field] = text(found[0], name)
    law["parse_warnings"] += [f"missing {f}" for f in ("jurabk", "langue") if law[f] is None]
    for e in found[1:]:
        body = e.find(".//textdaten/text")
        law["norms"].append({"enbez": text(e, "enbez"), "titel": text(e, "titel"), "text_xml": inner_xml(body) if body is not None else None})
    law["norm_count"] = len(law["norms"])
    return law


def parse_laws(documents: DataFrame, key: str = "slug", content: str = "content", keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, keep and the fields of a law) from documents as bytes."""
    keys = [key, *keep]
    kinds = dict(documents.dtypes)
    fields = ("jurabk", "amtabk", "ausfertigung_datum", "langue", "norm_count", "parse_warnings", "norms")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            laws = [parse_law(None if c is None else bytes(c)) for c in batch[content]]
            yield pd.DataFrame({**{k: batch[k] for k in keys}, **{f: [x[f] for x in laws] for f in fields}})

    return documents.select(*keys, content).mapInPandas(run, f"{', '.join(f'{k} {kinds[k]}' for k in keys)}, {LAW}")


def first_xml(archive: bytes | None) -> bytes | None:
    """The first ``.xml`` member of a zip archive; null if there is none or the archive is broken."""
    try:
        with zipfile.ZipFile(io.BytesIO(archive or b"")) as z:
            name = next((n for n in z.namelist() if n.lower().endswith(".xml")), None)
            return z.read(name) if name else None
    except (zipfile.BadZipFile, OSError, RuntimeError, NotImplementedError):
        return None


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(slug, content) of the zip archives of a folder; slug is the file name without its ending."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"slug": batch["slug"], "content": [first_xml(bytes(c)) for c in batch["content"]]})

    slug = F.regexp_extract("path", r"([^/]+)\.zip$", 1)
    return files.select(slug.alias("slug"), "content").mapInPandas(run, "slug string, content binary").filter("content is not null")


def read_xml_files(spark: SparkSession, path: str) -> DataFrame:
    """(slug, content) of the XML files of a folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xml").load(path)
    return files.select(F.regexp_extract("path", r"([^/]+)\.xml$", 1).alias("slug"), "content")


def read_law_json(spark: SparkSession, path: str) -> DataFrame:
    """Per-law JSON files of a folder with their slug; files that aren't JSON are left out."""
    shape = f"{LAW}, slug string, _bad string"
    rows = spark.read.schema(shape).option("multiLine", True).option("columnNameOfCorruptRecord", "_bad").json(path)
    named = rows.withColumn("slug", F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.json$", 1))
    return named.filter(F.col("_bad").isNull()).drop("_bad")


def read_graph_json(spark: SparkSession, path: str) -> DataFrame:
    """A JSON file that holds one array of rows (nodes or edges)."""
    return spark.read.option("multiLine", True).json(path)


def content_norms(norms: Column) -> Column:
    return F.filter(norms, lambda n: n["enbez"].isNotNull())


def slug_table(laws: DataFrame) -> DataFrame:
    """(slug, jurabk, langue, ausfertigung_datum) of laws with an abbreviation or a title."""
    there = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    return laws.filter(there("jurabk") | there("langue")).select("slug", "jurabk", "langue", "ausfertigung_datum")


def law_html(slug: Column, jurabk: Column, langue: Column, norms: Column) -> Column:
    """A law as an HTML page: names escaped, a section with its anchor for each norm, the norm's markup as it stands.

    The name falls back to the slug, the title to the name; a norm without number and title has no heading, one
    without text no body.
    """
    some = lambda c: F.when(c != "", c)
    name = escape_html(F.coalesce(some(jurabk), slug))
    shown = F.concat(name, F.lit(" – "), escape_html(F.coalesce(some(langue), some(jurabk), slug)))

    def section(n: Column, i: Column) -> Column:
        heading = F.concat(escape_html(F.coalesce(n["enbez"], F.lit(""))), F.coalesce(F.concat(F.lit(" "), escape_html(some(n["titel"]))), F.lit("")))
        begin = F.concat(F.lit('<section id="'), norm_id(n["enbez"], i), F.lit('">'))
        # The lines of a page.
        return F.concat_ws("\n", begin, F.concat(F.lit("  <h2>"), some(heading), F.lit("</h2>")), F.concat(F.lit('  <div class="norm-text">'), some(n["text_xml"]), F.lit("</div>")), F.lit("</section>"))

    head = [F.lit('<!DOCTYPE html>\n<html lang="de">\n<head>\n  <meta charset="UTF-8">'), F.concat(F.lit("  <title>"), shown, F.lit("</title>")), F.lit("</head>\n<body>")]
    top = F.concat(F.lit('<h1 data-slug="'), escape_html(slug), F.lit('">'), shown, F.lit("</h1>"))
    return F.concat_ws("\n", *head, top, some(F.array_join(F.transform(norms, section), "\n")), F.lit("</body>\n</html>"))

"""Citations in running text, found inside the JVM.

A citation is a marker, a number, further divisions, and the law: an
abbreviation with at least two capitals, or a word that ends like the name of
an act.  The pattern has no look-around and matches in linear time.  Defined
results: null and empty texts have no citations; text is stripped of tags
before; texts of any length are searched whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from normloom.functions.text import strip_tags
from normloom.operators.resolve import drop_false_positives

_WORD = "[A-Za-zÄÖÜäöüß]"
ABBREVIATION = rf"[A-ZÄÖÜ]{_WORD}*[A-ZÄÖÜ]{_WORD}*"
COMPOUND = rf"{_WORD}{{2,80}}(?:gesetzbuchs|gesetzbuches|gesetzbuch|gesetzes|gesetz|verordnung|ordnung)"
CITATION = rf"(§§|§|Artikel|Art\.) ?([0-9]+[a-z]?)((?: (?:Absatz|Abs\.|Satz|Nummer|Nr\.) ?[0-9]+[a-z]?)*) (?:des |der |dem |das )?({COMPOUND}|{ABBREVIATION}(?: [0-9]{{1,4}})?)"
#: Trust in a citation with an abbreviation and in one with a long name.
SURE, LIKELY = 0.9, 0.8


def citations_of(text: Column) -> Column:
    """Array of (span_text, unit, number, book, confidence) of a text, in order."""
    spans = F.regexp_extract_all(text, F.lit(CITATION), F.lit(0))

    def parts(span: Column) -> Column:
        get = lambda i: F.regexp_extract(span, CITATION, i)
        unit = F.when(F.substring(get(1), 1, 1) == "§", "par").otherwise("art")
        return F.struct(span.alias("span_text"), unit.alias("unit"), get(2).alias("number"), get(4).alias("book"), F.when(get(4).rlike(rf"^{COMPOUND}$"), LIKELY).otherwise(SURE).alias("confidence"))

    return F.transform(spans, parts)


def extract(norms: DataFrame, keep: list[str], text: str = "text_xml") -> DataFrame:
    """(keep, cit_pos, span_text, unit, number, book, confidence) for every citation; the book in lower case, generic ones dropped."""
    rows = norms.filter(F.coalesce(F.col(text), F.lit("")) != "").withColumn("_c", citations_of(strip_tags(F.col(text))))
    out = rows.select(*keep, F.posexplode("_c").alias("cit_pos", "c"))
    return drop_false_positives(out.select(*keep, "cit_pos", "c.span_text", "c.unit", "c.number", F.lower("c.book").alias("book"), "c.confidence"))

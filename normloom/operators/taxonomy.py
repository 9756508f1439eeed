"""The taxonomy of laws: entries from its text, keys, prioritised join, classes.

Defined results: entries without code are none; keys shorter than the minimum
are none; of several entries with one key the first in order wins; laws without
any match keep a null code; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from normloom.functions.text import WHITE, block_abbr, empty_to_null, main_group, norm_abbr, norm_title, strip_tags, strip_white
from normloom.operators.graph import first_per_key

#: Shortest keys of titles and of abbreviations; characters of a block without a citation date; of an opening text.
TITLE_KEY, ABBR_KEY, BLOCK_CHARS, OPENING_CHARS = 6, 2, 140, 500

# Digits that the parts of a code may have, and the numeric date of a citation, which ends the title.
CODE_PARTS, FIRST_DIGITS = (2, 3), 4
CITED = r"vom\s*\d{1,2}\.\s*\d{1,2}\.\s*\d{4}"


def block_title(block: Column) -> Column:
    at = F.regexp_instr(block, F.lit(CITED))
    return strip_white(F.when(at > 0, F.substring(block, F.lit(1), at - 1)).otherwise(F.substring(block, 1, BLOCK_CHARS)))


def _first_word(line: Column) -> Column:
    return F.regexp_extract(line, f"^[^{WHITE}]*", 0)


def _is_code(word: Column) -> Column:
    """Two or three numbers joined by hyphens, the first of at most four digits."""
    parts = F.split(word, "-")
    digits = F.forall(parts, lambda p: (p != "") & (F.translate(p, "0123456789", "") == ""))
    return F.size(parts).between(*CODE_PARTS) & digits & (F.length(F.try_element_at(parts, F.lit(1))) <= FIRST_DIGITS)


def segment_entries(texts: DataFrame, text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(keep, pos, code, title) for every entry of every text, in order.

    An entry is a line whose first word is a code, with the lines after it up to the next such line.  A code
    that ends the whole text begins no entry.
    """

    def folded(lines: Column) -> Column:
        n = F.size(lines)
        last = lambda i: F.try_element_at(lines, i)
        begins = lambda i: _is_code(_first_word(last(i))) & ((i < n) | (F.length(last(i)) > F.length(_first_word(last(i)))))
        starts = F.filter(F.sequence(F.lit(1), n), begins)
        # Each start with the one after it.
        spans = F.arrays_zip(starts.alias("a"), F.slice(F.concat(starts, F.array(n + 1)), F.lit(2), F.size(starts)).alias("b"))

        def entry(s: Column) -> Column:
            own = F.array_join(F.slice(lines, s["a"], s["b"] - s["a"]), "\n")
            code = _first_word(last(s["a"]))
            return F.struct(code.alias("code"), F.substr(own, F.length(code) + 1).alias("block"))

        return F.transform(spans, entry)

    # The lines are bound to a variable once; written out they would be split again for every line.
    lines = F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)
    entries = F.element_at(F.transform(F.array(lines), folded), 1)
    out = texts.select(*keep, F.posexplode(entries).alias("pos", "e"))
    return out.select(*keep, "pos", "e.code", block_title(F.regexp_replace("e.block", f"^[{WHITE}]+", "")).alias("title"))


def distinct_entries(entries: DataFrame) -> DataFrame:
    """(code, block, ord): of entries with one code the first."""
    return first_per_key(entries, "code", ["ord"], ["block", "ord"])


def join_maps(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key, code) by title and by abbreviation; ``entries`` has code, block and ord."""
    known = entries.filter(F.col("code").isNotNull())
    by_title = known.select(norm_title(F.col("block")).alias("key"), "code", "ord").filter(F.length("key") >= TITLE_KEY)
    by_abbr = known.select(block_abbr(F.col("block")).alias("key"), "code", "ord").filter(F.length("key") >= ABBR_KEY)
    order = ["ord", "code"]
    return first_per_key(by_title, "key", order, ["code"]), first_per_key(by_abbr, "key", order, ["code"])


def join_taxonomy(toc: DataFrame, slugs: DataFrame, by_title: DataFrame, by_abbr: DataFrame) -> DataFrame:
    """(slug, fna_code, how): the first match of title, title in the table of contents, abbreviation, slug.

    ``toc`` has slug and title; ``slugs`` has slug, jurabk and langue.  Unmatched slugs are left out.
    """
    both = toc.select("slug", F.col("title").alias("toc_title")).join(slugs.select("slug", "jurabk", "langue"), "slug", "left")
    keyed = both.select("slug", norm_title(F.col("langue")).alias("k1"), norm_title(F.col("toc_title")).alias("k2"), norm_abbr(F.col("jurabk")).alias("k3"), norm_abbr(F.col("slug")).alias("k4"))
    # Missing keys would all meet in one task; each gets a key of its own that nothing has.
    keyed = keyed.select("slug", *[F.coalesce(f"k{i}", F.concat(F.lit("\x00"), "slug")).alias(f"k{i}") for i in range(1, 5)])
    for i, keys in enumerate((by_title, by_title, by_abbr, by_abbr), 1):
        keyed = keyed.join(keys.select(F.col("key").alias(f"k{i}"), F.col("code").alias(f"c{i}")), f"k{i}", "left")
    how = F.coalesce(*[F.when(F.col(f"c{i}").isNotNull(), F.lit(n)) for i, n in enumerate(("langue", "toc_title", "jurabk", "slug"), 1)])
    return keyed.select("slug", F.coalesce("c1", "c2", "c3", "c4").alias("fna_code"), how.alias("how")).filter("fna_code is not null")


def match_stats(matched: DataFrame, total: int) -> DataFrame:
    """(how, laws, share): matches by kind, in percent of all laws with one decimal."""
    share = F.bround(F.lit(100.0) * F.count(F.lit(1)) / max(total, 1), 1)
    return matched.groupBy("how").agg(F.count(F.lit(1)).alias("laws"), share.alias("share"))


def opening_text(norms: Column, most: int = OPENING_CHARS) -> Column:
    """First stripped text of an array of norms that isn't empty, cut to ``most`` characters."""
    texts = F.filter(F.transform(norms, lambda n: strip_tags(n["text_xml"])), lambda t: t != "")
    return F.substring(F.try_element_at(texts, F.lit(1)), 1, most)


def opening_texts(norms: DataFrame, keys: list[str], most: int = OPENING_CHARS) -> DataFrame:
    """(keys, opening_text) from rows of norms with norm_pos and text_xml.

    First the places alone are aggregated, in a hash table of numbers; only the texts that stand there are
    stripped and compared, so that no text is sorted or shuffled in vain.  A null place comes first, null keys
    are a group of their own; of several texts at one place the smallest counts.
    """
    seen = F.regexp_replace("text_xml", "<[^>]+>", "").rlike(f"[^{WHITE}]")
    place = F.coalesce(F.col("norm_pos").cast("long"), F.lit(-(1 << 40)))
    rows = norms.select(*keys, place.alias("_p"), "text_xml").filter(seen)
    first = rows.groupBy(*keys).agg(F.min("_p").alias("_f"))
    left, right = rows.alias("l"), first.alias("r")
    same = F.col("l._p") == F.col("r._f")
    for k in keys:
        same = same & F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}"))
    there = left.join(right, same).select("l.*").distinct()
    return there.groupBy(*keys).agg(F.min(F.substring(strip_tags(F.col("text_xml")), 1, most)).alias("opening_text"))


def classify(laws: DataFrame, codes: DataFrame) -> DataFrame:
    """``laws`` with fna_code and main_group from (slug, fna_code); others keep nulls."""
    joined = laws.drop("fna_code", "main_group").join(codes.select("slug", "fna_code"), "slug", "left")
    return joined.withColumn("main_group", main_group(F.col("fna_code")))


def group_histogram(classified: DataFrame) -> DataFrame:
    """(main_group, laws)."""
    return classified.groupBy("main_group").agg(F.count(F.lit(1)).alias("laws"))


def field_presence(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(field, present, percent): rows with a value in each column, whole percent downwards."""
    counts = rows.agg(F.count(F.lit(1)).alias("_n"), *[F.count(empty_to_null(F.col(c).cast("string"))).alias(c) for c in columns])
    out = counts.select("_n", F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("present")) for c in columns])).alias("e"))
    return out.select("e.field", "e.present", F.expr("case when _n = 0 then 0 else (100 * e.present) div _n end").alias("percent"))


# The classes that mark the cell of a code and the link of a title on the pages of a taxonomy.
CODE_CELL, TITLE_LINK = '<td class="fnal">', 'class="ltg"'
# The references that a title can hold.
_REFERENCES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&#x27;", "'"), ("&nbsp;", "\xa0"), ("&amp;", "&"))


def page_rows(pages: DataFrame, keep: tuple[str, ...] = (), html: str = "html") -> DataFrame:
    """(keep, pos, code, url, title, main_group) for every law row of taxonomy pages; a trailing parenthetical of the title goes.

    A page is cut at its code cells.  What follows a cell is its row: the cell after it must hold a title link,
    whose first attribute is its address; rows without one are left out.
    """

    def plain(c: Column) -> Column:
        for ref, text in _REFERENCES:
            c = F.replace(c, F.lit(ref), F.lit(text))
        return c

    def after(c: Column, mark: str) -> Column:
        """What follows the first mark; empty if there is none."""
        at = F.locate(mark, c)
        return F.when(at > 0, F.substr(c, at + len(mark))).otherwise("")

    def row(piece: Column) -> Column:
        links = F.slice(F.split(after(piece, "</td>"), r"<a\s+"), F.lit(2), F.lit(1 << 30))
        marked = F.filter(links, lambda a: a.startswith('href="') & F.contains(F.substring_index(a, ">", 1), F.lit(TITLE_LINK)) & F.contains(a, F.lit("</a>")))
        return F.struct(strip_white(F.substring_index(piece, "</td>", 1)).alias("code"), strip_white(after(piece, "</td>")).alias("rest"), F.try_element_at(marked, F.lit(1)).alias("link"))

    def whole(r: Column) -> Column:
        code = F.translate(r["code"], "0123456789-", "") == ""
        return code & r["code"].rlike("^[0-9]") & r["rest"].startswith("<td>") & r["link"].isNotNull()

    pieces = F.slice(F.split(F.coalesce(F.col(html), F.lit("")), CODE_CELL, -1), F.lit(2), F.lit(1 << 30))
    out = pages.select(*keep, F.posexplode(F.filter(F.transform(pieces, row), whole)).alias("pos", "r"))
    url, shown = F.substring_index(F.substr("r.link", F.lit(7)), '"', 1), F.substring_index(after(F.col("r.link"), ">"), "</a>", 1)
    title = strip_white(F.regexp_replace(strip_white(plain(F.regexp_replace(shown, "<[^>]+>", ""))), r"\s*\([^()]+\)\s*\z", ""))
    return out.select(*keep, "pos", "r.code", plain(url).alias("url"), title.alias("title"), main_group(F.col("r.code")).alias("main_group"))


def reached_pages(links: DataFrame, roots: DataFrame) -> DataFrame:
    """(path): pages reached from ``roots`` (path) over ``links`` (parent, parent_code, child, child_code).

    A child counts only if its code consists of digits and strictly extends its parent's.  Each round is one join
    with the pages reached last and ends with those not seen before, so the walk ends by itself, however deep.
    """
    from normloom.runtime import written

    down = links.filter(F.col("parent_code").rlike(r"^\d+\z") & F.col("child_code").rlike(r"^\d+\z") & F.col("child_code").startswith(F.col("parent_code")) & (F.length("child_code") > F.length("parent_code")))
    down = written(down.select("parent", "child").distinct(), "links")
    seen = last = written(roots.select("path").distinct(), "reached")
    while True:
        fresh = last.join(down, last["path"] == down["parent"]).select(F.col("child").alias("path")).distinct().join(seen, "path", "left_anti")
        last = written(fresh, "reached")
        if last.isEmpty():
            return seen
        seen = written(seen.unionByName(last), "seen")

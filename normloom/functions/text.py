"""Text normalisation as column expressions, all inside the JVM.

Spark's ``trim`` knows only the space and ``\\s`` of Java's regular expressions
is ASCII; these helpers follow Unicode instead.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space including the no-break spaces, as a Java character class.
WHITE = r"\t-\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def _decompositions() -> tuple[str, str, dict[str, str]]:
    """Characters whose compatibility decomposition gives ASCII: one for one, and those that give several."""
    source, target, several = [], [], {}
    for code in range(0x80, 0x1FC00):
        base = "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c))
        if base == chr(code) or not any(c.isascii() and not c.isspace() for c in base) and not 0xC0 <= code < 0x250:
            continue
        if len(base) == 1:
            source.append(chr(code))
            target.append(base)
        elif base:
            several[chr(code)] = base
    return "".join(source), "".join(target), several


_COMPOSED, _BASE, _SEVERAL = _decompositions()


def _ranges(characters: list[str], gap: int = 256) -> str:
    """A character class of few ranges that holds all of ``characters``."""
    codes, out = sorted(map(ord, characters)), []
    for code in codes:
        if out and code - out[-1][1] <= gap:
            out[-1][1] = code
        else:
            out.append([code, code])
    return "[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in out) + "]"


#: Texts without any of these hold no character of ``_SEVERAL``; a few ranges are tested faster than hundreds of characters.
_MAYBE_SEVERAL = _ranges([c for c in _SEVERAL if ord(c) < 0x2000], 16)[:-1] + _ranges([c for c in _SEVERAL if ord(c) >= 0x2000])[1:]


#: The same characters as lines for a map.
_KNOWN = "\n".join(f"{k}\t{v}" for k, v in _SEVERAL.items())


def strip_white(c: Column) -> Column:
    """Without outer white space, no-break spaces included."""
    return F.regexp_replace(F.regexp_replace(c, f"^[{WHITE}]+", ""), f"[{WHITE}]+\\z", "")


def empty_to_null(c: Column) -> Column:
    return F.when(c != "", c)


def strip_accents(c: Column) -> Column:
    """Letters and digits as their plain ASCII ones, by compatibility decomposition; combining marks go.

    Ligatures, fractions, roman numerals and other characters that give several are looked up one by one,
    in texts that hold any.  Characters without ASCII in their decomposition stay.
    """
    known = F.str_to_map(F.lit(_KNOWN), F.lit("\n"), F.lit("\t"))
    spelled = F.array_join(F.transform(F.split(c, ""), lambda x: F.coalesce(F.try_element_at(known, x), x)), "")
    single = F.when(c.rlike(_MAYBE_SEVERAL), spelled).otherwise(c)
    return F.regexp_replace(F.translate(single, _COMPOSED, _BASE), r"[\x{300}-\x{36f}]", "")


def strip_tags(c: Column) -> Column:
    """Tags become blanks, white space becomes one blank, the ends are trimmed."""
    text = F.regexp_replace(c, "<[^>]+>", " ")
    return F.trim(F.regexp_replace(text, f"[{WHITE}]+", " "))


def norm_title(c: Column) -> Column:
    """Key of a title: innermost parenthesised groups dropped once, then only a-z and 0-9."""
    plain = F.regexp_replace(F.lower(strip_accents(c)), r"\([^()]*\)", " ")
    return F.regexp_replace(plain, "[^a-z0-9]", "")


def norm_abbr(c: Column) -> Column:
    """Key of an abbreviation: a-z and 0-9 only; null if nothing remains."""
    return empty_to_null(F.regexp_replace(F.lower(strip_accents(c)), "[^a-z0-9]", ""))


def block_abbr(c: Column) -> Column:
    """Abbreviation named in the last parentheses of a taxonomy block, after its last dash."""
    last = F.element_at(F.regexp_extract_all(c, F.lit(r"\(([^()]*)\)"), F.lit(1)), -1)
    found = F.when(F.size(F.regexp_extract_all(c, F.lit(r"\(([^()]*)\)"), F.lit(1))) > 0, last)
    return norm_abbr(F.element_at(F.split(found, "[–-]"), -1))


def normalize_book(c: Column) -> Column:
    """Key of a cited book: ß as ss, genitive endings of long names dropped."""
    key = F.regexp_replace(F.regexp_replace(F.lower(strip_accents(c)), "ß", "ss"), "[^a-z0-9]", "")
    n = F.length(key)
    return (
        F.when((n > 10) & key.endswith("es"), F.substring(key, 1, n - 2))
        .when((n > 8) & key.endswith("s") & ~key.endswith("ss"), F.substring(key, 1, n - 1))
        .otherwise(key)
    )


def short_name(c: Column) -> Column:
    """Trailing parenthetical of at least four characters, or null."""
    return empty_to_null(strip_white(F.regexp_extract(c, r"\(([^()]{4,})\)\s*$", 1)))


def main_group(code: Column) -> Column:
    """First digit of a taxonomy code as int; null where there is none."""
    return F.when(F.substring(code, 1, 1).rlike("^[0-9]$"), F.substring(code, 1, 1).cast("int"))


def norm_id(enbez: Column, idx: Column) -> Column:
    """Anchor id of a norm: ``§ 1`` gives ``1``, ``Art. 3`` and ``Art.3`` give ``art-3``, nothing gives ``norm-<idx>``."""
    fallback = F.concat(F.lit("norm-"), idx.cast("string"))
    s = strip_white(enbez)
    s = F.regexp_replace(s, f"^§[{WHITE}]*", "")
    s = F.regexp_replace(s, f"^Art\\.[{WHITE}]*", "art-")
    s = F.regexp_replace(F.lower(s), f"[{WHITE}]+", "-")
    s = F.regexp_replace(s, r"(?U)[^\w-]", "")
    s = F.regexp_replace(s, r"^-+|-+\z", "")
    return F.when(F.coalesce(s, F.lit("")) == "", fallback).otherwise(s)


def short_desc(c: Column, most: int = 200) -> Column:
    """At most ``most`` characters, cut at the last word boundary; empty gives null."""
    text = strip_white(c)
    head = F.substring(text, 1, most)
    # Without a blank the hard cut stays as it is.
    cut = F.when(F.contains(head, F.lit(" ")), F.regexp_replace(F.regexp_replace(head, r" [^ ]*\z", ""), f"[{WHITE}]+\\z", "")).otherwise(head)
    return empty_to_null(F.when((F.length(text) > most) & F.lit(most != 0), cut).otherwise(text))


def node_id(jurabk: Column, slug: Column, jurisdiction: str = "de-bund") -> Column:
    """``jurisdiction/`` and the trimmed abbreviation, or the slug where it is null or empty."""
    name = F.when(F.coalesce(jurabk, F.lit("")) == "", slug).otherwise(strip_white(jurabk))
    return F.concat(F.lit(f"{jurisdiction}/"), name)


def embedding_text(langue: Column, slug: Column, opening: Column) -> Column:
    """Title (or slug) and opening text, trimmed, with one blank between."""
    title = strip_white(F.coalesce(empty_to_null(langue), slug))
    return F.concat_ws(" ", title, empty_to_null(strip_white(opening)))


def escape_html(c: Column) -> Column:
    for raw, ref in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(raw), F.lit(ref))
    return c


def slug_from_link(link: Column) -> Column:
    """Second to last path segment of a link; the whole link if it has only one."""
    parts = F.split(F.regexp_replace(link, r"/+\z", ""), "/")
    return F.when(F.size(parts) >= 2, F.try_element_at(parts, F.lit(-2))).otherwise(link)


def zip_url_from_link(link: Column) -> Column:
    """The link with its last segment replaced by ``xml.zip``."""
    return F.concat(F.regexp_replace(link, r"/[^/]*\z", ""), F.lit("/xml.zip"))


def tooltip(title: Column) -> Column:
    return F.substring(F.replace(title, F.lit("\n"), F.lit(" ")), 1, 90)


def label(name: Column) -> Column:
    """Names over 14 characters become 13 and an ellipsis."""
    return F.when(F.length(name) > 14, F.concat(F.substring(name, 1, 13), F.lit("…"))).otherwise(name)

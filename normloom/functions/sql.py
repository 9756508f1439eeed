"""The text helpers as SQL functions of a session.

They are SQL bodies, not Python: the optimizer inlines them, so they run where
built-in functions run.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from normloom.functions.text import _BASE, _COMPOSED, _KNOWN, _MAYBE_SEVERAL, WHITE
from normloom.operators.citations import CITATION, COMPOUND, LIKELY, SURE


def _lit(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _accents(c: str) -> str:
    marks = _lit(r"[\x{300}-\x{36f}]")
    spelled = f"array_join(transform(split({c}, ''), x -> coalesce(try_element_at(str_to_map({_lit(_KNOWN)}, '\n', '\t'), x), x)), '')"
    single = f"case when regexp_like({c}, {_lit(_MAYBE_SEVERAL)}) then {spelled} else {c} end"
    return f"regexp_replace(translate({single}, {_lit(_COMPOSED)}, {_lit(_BASE)}), {marks}, '')"


def _bodies() -> dict[str, tuple[str, str, str]]:
    key = f"regexp_replace(replace(lower({_accents('s')}), 'ß', 'ss'), '[^a-z0-9]', '')"
    tags = f"trim(regexp_replace(regexp_replace(s, '<[^>]+>', ' '), {_lit(f'[{WHITE}]+')}, ' '))"
    inner = _lit(r"\([^()]*\)")
    number = lambda i: f"regexp_extract(x, {_lit(CITATION)}, {i})"
    found = (
        f"select pos as cit_pos, x as span_text, case when left(x, 1) = '§' then 'par' else 'art' end as unit, {number(2)} as number, {number(4)} as book, "
        f"case when regexp_like({number(4)}, {_lit(f'^{COMPOUND}$')}) then {LIKELY}D else {SURE}D end as confidence "
        f"from (select posexplode(regexp_extract_all({tags}, {_lit(CITATION)}, 0)) as (pos, x))"
    )
    return {
        "strip_tags": ("s string", "string", tags),
        "norm_title": ("s string", "string", f"regexp_replace(regexp_replace(lower({_accents('s')}), {inner}, ' '), '[^a-z0-9]', '')"),
        "norm_abbr": ("s string", "string", f"nullif(regexp_replace(lower({_accents('s')}), '[^a-z0-9]', ''), '')"),
        "normalize_book": (
            "s string", "string",
            f"case when length({key}) > 10 and {key} like '%es' then left({key}, length({key}) - 2) "
            f"when length({key}) > 8 and {key} like '%s' and {key} not like '%ss' then left({key}, length({key}) - 1) else {key} end",
        ),
        "main_group": ("s string", "int", "case when left(s, 1) rlike '^[0-9]$' then cast(left(s, 1) as int) end"),
        "size_of_degree": ("d bigint", "double", "bround(2.0D + sqrt(cast(greatest(d, 0) as double)) * 1.25D, 1)"),
        "extract_citations": ("s string", "table(cit_pos int, span_text string, unit string, number string, book string, confidence double)", found),
    }


def register(spark: SparkSession) -> list[str]:
    """Create the functions as temporary ones; returns their names."""
    bodies = _bodies()
    for name, (takes, gives, body) in bodies.items():
        spark.sql(f"create or replace temporary function {name}({takes}) returns {gives} return {body}")
    return list(bodies)

"""Queries of the problems this subpackage solves, and their equivalent SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from normloom.llm import canonical, entities, leaks, neighbours, spans, tokens
from normloom.runtime import table


def p1_found(spark: SparkSession, directory: str) -> DataFrame:
    return neighbours.found(table(spark, directory, "opening_vectors"))


def p4_found(spark: SparkSession, directory: str) -> DataFrame:
    return canonical.found(table(spark, directory, "refs_raw"), table(spark, directory, "book_list"))


def p4_unmatched(spark: SparkSession, directory: str) -> DataFrame:
    return canonical.unmatched(table(spark, directory, "refs_raw"), table(spark, directory, "book_list"))


def p5_found(spark: SparkSession, directory: str) -> DataFrame:
    return entities.found(table(spark, directory, "laws_classified"), table(spark, directory, "law_register"))


def p5_confidence(spark: SparkSession, directory: str) -> DataFrame:
    return entities.matched(table(spark, directory, "laws_classified"), table(spark, directory, "law_register"))


def p7_ids(spark: SparkSession, directory: str) -> DataFrame:
    return tokens.tokenize(table(spark, directory, "documents"))


def p8_found(spark: SparkSession, directory: str) -> DataFrame:
    return leaks.leaks(table(spark, directory, "documents"), table(spark, directory, "eval_items"))


def p9_found(spark: SparkSession, directory: str) -> DataFrame:
    return spans.found(table(spark, directory, "documents"))


def p9_shared(spark: SparkSession, directory: str) -> DataFrame:
    return spans.shared_share(table(spark, directory, "documents"))


def p9_kept(spark: SparkSession, directory: str) -> DataFrame:
    return spans.kept_texts(table(spark, directory, "documents"))


QUERIES = {"p1_found": p1_found, "p4_found": p4_found, "p4_unmatched": p4_unmatched, "p5_found": p5_found, "p5_confidence": p5_confidence, "p7_ids": p7_ids, "p8_found": p8_found, "p9_found": p9_found, "p9_shared": p9_shared, "p9_kept": p9_kept}

_STRETCHES = f"""g as (select doc_id, i, hash(substring(text, i::bigint, {spans.LEAST})) as h
  from (select doc_id, text, unnest(range(1, length(text) - {spans.LEAST} + 2)) as i from documents where length(text) >= {spans.LEAST}))"""

#: Words as the problem states them; of compatibility decompositions those of the characters that occur.
_WORDS = "nfc_normalize(regexp_replace(regexp_replace(text, '<[^>]*>', ' ', 'g'), '[\\x{AD}\\x{200B}\\x{200C}\\x{200D}\\x{2060}\\x{FEFF}]', '', 'g'))"
for _character, _plain in (("ﬁ", "fi"), ("ﬂ", "fl"), ("№", "No"), ("①", "1"), ("②", "2"), ("²", "2"), ("³", "3"), ("½", "1⁄2"), ("Ⅳ", "IV")):
    _WORDS = f"replace({_WORDS}, '{_character}', '{_plain}')"


def _runs(key: str, name: str) -> str:
    """(key, r): every run of words of a table's texts."""
    found = f"select {key}, regexp_extract_all(lower({_WORDS}), '[\\p{{L}}\\p{{N}}]+') as w from {name} where text is not null"
    return f"select distinct {key}, array_to_string(w[k:k + {leaks.RUN} - 1], ' ') as r from (select {key}, w, unnest(range(1, len(w) - {leaks.RUN} + 2)) as k from ({found}))"


ORACLES: dict[str, str] = {
    # Every run of words of every text.
    "p8_found": f"with d as ({_runs('doc_id', 'documents')}), i as ({_runs('item_id', 'eval_items')}) select distinct doc_id, item_id from d join i on d.r = i.r",
    # Every pair of vectors.
    "p1_found": """
with v as (select distinct vec_id, list_transform(embedding, lambda x: x::double) as e from opening_vectors where embedding is not null and len(embedding) = 64),
u as (select vec_id, list_transform(e, lambda x: x / sqrt(list_inner_product(e, e))) as e from v where list_inner_product(e, e) > 0),
s as (select a.vec_id as a, b.vec_id as b, round(list_inner_product(a.e, b.e), 6) as s from u a join u b on a.vec_id <> b.vec_id),
n as (select a, b from s qualify row_number() over (partition by a order by s desc, b) <= 10)
select distinct least(a, b) as vec_id_a, greatest(a, b) as vec_id_b from n""",
    # Every stretch of every text.
    "p9_found": f"""
with {_STRETCHES}, d as (select distinct doc_id, h from g)
select distinct a.doc_id as doc_id_a, b.doc_id as doc_id_b from d a join d b on a.h = b.h and a.doc_id < b.doc_id""",
    # Every run of sentences, from the texts themselves.
    "p9_kept": f"""
with d as (select distinct doc_id, regexp_extract_all(coalesce(text, ''), '{spans.SENTENCE}') as s from documents where doc_id is not null),
r as (select doc_id, k, array_to_string(s[k:k + {spans.RUN} - 1], chr(0)) as h from (select doc_id, s, unnest(range(1, len(s) - {spans.RUN} + 2)) as k from d)),
n as (select *, row_number() over (partition by h order by doc_id, k) as occurrence from r where length(h) - {spans.RUN} + 1 >= {spans.RUN_CHARS}),
c as (select distinct doc_id, unnest(range(k, k + {spans.RUN})) as i from n where occurrence > 1),
w as (select doc_id, unnest(range(1, len(s) + 1)) as i, unnest(s) as x from d)
select d.doc_id, len(d.s)::int as sentences, count(c.i)::int as removed, coalesce(string_agg(w.x, '' order by w.i) filter (where c.i is null), '') as kept
from d left join w on d.doc_id = w.doc_id left join c on w.doc_id = c.doc_id and w.i = c.i group by d.doc_id, d.s""",
    "p9_shared": f"""
with {_STRETCHES}, c as (select h from g group by h having min(doc_id) <> max(doc_id)),
s as (select doc_id, i, lead(i) over (partition by doc_id order by i) as nxt from g where h in (select h from c)),
t as (select doc_id, sum(least(coalesce(nxt - i, {spans.LEAST}), {spans.LEAST})) as shared from s group by 1),
k as (select doc_id, min(doc_id) over (partition by text) as class_id from documents where length(text) >= {spans.LEAST})
select d.doc_id, coalesce(k.class_id, d.doc_id) as class_id, coalesce(length(d.text), 0) as n_chars, coalesce(t.shared, 0)::bigint as shared_chars,
  case when length(d.text) > 0 then round(coalesce(t.shared, 0)::double / length(d.text), 6) else 0.0 end::double as share
from documents d left join k on d.doc_id = k.doc_id left join t on d.doc_id = t.doc_id""",
}

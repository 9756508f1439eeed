"""Queries of the analytics operators over the test tables, each with its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from normloom.functions import text as T
from normloom.operators import citations, color, graph, layout, resolve, search, taxonomy, validate, vectors
from normloom.runtime import table, written
from normloom.sources import laws as law_source
from normloom.sources.toc import toc_of

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its own name, with its SQL."""

    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return keep


# ---------------------------------------------------------------- inputs


def laws(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "laws_classified").distinct()


def norms(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "norm_snapshots").distinct()


def latest_norms(spark: SparkSession, d: str) -> DataFrame:
    """(slug, norms): the norms of every law in the latest delivery, in order; of several rows of a norm the one loaded last counts."""
    rows = table(spark, d, "norm_snapshots").filter(F.col("dok_nr").isNotNull() & F.col("slug").isNotNull())
    last = rows.join(F.broadcast(rows.agg(F.max("snapshot_no").alias("snapshot_no"))), "snapshot_no")
    one = last.groupBy("dok_nr").agg(F.max(F.struct("loaded_at", "slug", "norm_pos", "enbez", "titel", "text_xml")).alias("r"))
    norm = F.struct("r.norm_pos", "dok_nr", "r.enbez", "r.titel", "r.text_xml")
    listed = one.groupBy(F.col("r.slug").alias("slug")).agg(F.array_sort(F.collect_list(norm)).alias("norms"))
    return listed.select("slug", F.transform("norms", lambda n: F.struct(n["enbez"], n["titel"], n["text_xml"])).alias("norms"))


def nodes(spark: SparkSession, d: str) -> DataFrame:
    return graph.latest_nodes(table(spark, d, "graph_nodes"))


def edges(spark: SparkSession, d: str) -> DataFrame:
    key = graph.key_of_id
    return table(spark, d, "graph_edges").select("edge_id", key(F.col("source")).alias("source"), key(F.col("target")).alias("target"), "type", "weight").distinct()


def books(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "book_list").select(F.lower("jurabk").alias("slug"), "jurabk", F.col("name").alias("langue"), F.col("book_id").alias("ord"))


def resolved(spark: SparkSession, d: str) -> DataFrame:
    b = books(spark, d)
    refs = resolve.drop_false_positives(table(spark, d, "refs_raw").distinct())
    return resolve.resolve(refs, resolve.book_index(b, b.select("slug", F.col("langue").alias("title"), "ord")), b)


def entries(spark: SparkSession, d: str) -> DataFrame:
    """Of every code the first entry."""
    rows = table(spark, d, "law_register").filter("fna_code is not null")
    return taxonomy.distinct_entries(rows.select(F.col("fna_code").alias("code"), F.col("titel").alias("block"), F.col("reg_id").alias("ord")))


W = T.WHITE
BS = "\\"


def _strip(c: str) -> str:
    return f"regexp_replace(regexp_replace({c}, '^[{W}]+', ''), '[{W}]+$', '')"


def _tags(c: str) -> str:
    return f"trim(regexp_replace(regexp_replace({c}, '<[^>]+>', ' ', 'g'), '[{W}]+', ' ', 'g'), ' ')"


def _title(c: str) -> str:
    return f"regexp_replace(regexp_replace(lower(strip_accents({c})), '\\([^()]*\\)', ' ', 'g'), '[^a-z0-9]', '', 'g')"


def _abbr(c: str) -> str:
    return f"nullif(regexp_replace(lower(strip_accents({c})), '[^a-z0-9]', '', 'g'), '')"


def _block_abbr(c: str) -> str:
    return _abbr(f"string_split_regex(regexp_extract_all({c}, '\\(([^()]*)\\)', 1)[-1], '[–-]')[-1]")


def _book(c: str) -> str:
    key = f"regexp_replace(replace(lower(strip_accents({c})), 'ß', 'ss'), '[^a-z0-9]', '', 'g')"
    return (
        f"case when length({key}) > 10 and {key} like '%es' then left({key}, length({key}) - 2) "
        f"when length({key}) > 8 and {key} like '%s' and {key} not like '%ss' then left({key}, length({key}) - 1) else {key} end"
    )


def _short(c: str) -> str:
    return f"nullif({_strip(f"regexp_extract({c}, '\\(([^()]{{4,}})\\)\\s*$', 1)")}, '')"


def _group(c: str) -> str:
    return f"case when regexp_matches(left({c}, 1), '[0-9]') then left({c}, 1)::int end"


def _node(jurabk: str, slug: str) -> str:
    return f"'de-bund/' || case when coalesce({jurabk}, '') = '' then {slug} else {_strip(jurabk)} end"


def _id(c: str) -> str:
    return f"nullif(lower({_strip(c)}), '')"


def _desc(c: str, n: int) -> str:
    t = _strip(c)
    cut = _strip(f"regexp_replace(left({t}, {n}), ' [^ ]*$', '')")
    return f"nullif(case when length({t}) > {n} and contains(left({t}, {n}), ' ') then {cut} when length({t}) > {n} then left({t}, {n}) else {t} end, '')"


_LAWS = "laws as (select distinct * from laws_classified)"
_NODES = f"""nodes as (
  select * from (select {_id("id")} as id, loaded_at, jurabk, title, classification.code as code, classification.main_group as main_group, created_at, repealed_at, x, y from graph_nodes)
  where id is not null
  qualify row_number() over (partition by id order by loaded_at desc nulls last, jurabk desc nulls last, title desc nulls last, code desc nulls last,
    main_group desc nulls last, created_at desc nulls last, repealed_at desc nulls last, x desc nulls last, y desc nulls last) = 1)"""
_EDGES = f"edges as (select distinct edge_id, {_id('source')} as source, {_id('target')} as target, type, weight from graph_edges)"
_WHOLE = "whole as (select * from edges where source is not null and target is not null)"

# ---------------------------------------------------------------- text


@query(f"select distinct snapshot_no, dok_nr, loaded_at, {_tags('text_xml')} as plain from norm_snapshots")
def strip_tags(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "norm_snapshots").select("snapshot_no", "dok_nr", "loaded_at", T.strip_tags(F.col("text_xml")).alias("plain")).distinct()


@query(rf"""
with n as (select distinct snapshot_no, dok_nr, loaded_at, norm_pos, enbez from norm_snapshots),
s as (select *, regexp_replace(regexp_replace(regexp_replace(lower(regexp_replace(regexp_replace({_strip("enbez")}, '^§[{W}]*', ''), '^Art\.[{W}]*', 'art-')),
  '[{W}]+', '-', 'g'), '[^\w-]', '', 'g'), '^-+|-+$', '', 'g') as a from n)
select snapshot_no, dok_nr, loaded_at, case when coalesce(a, '') = '' then 'norm-' || norm_pos else a end as anchor from s""")
def norm_anchors(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "norm_snapshots").select("snapshot_no", "dok_nr", "loaded_at", "norm_pos", "enbez").distinct()
    return rows.select("snapshot_no", "dok_nr", "loaded_at", T.norm_id(F.col("enbez"), F.col("norm_pos")).alias("anchor"))


@query(f"""with {_LAWS} select law_id, {_title("langue")} as title_key, {_abbr("jurabk")} as abbr_key, {_book("jurabk")} as book_key,
{_short("langue")} as short_name, {_block_abbr("langue")} as block_key, {_group("fna_code")} as first_digit from laws""")
def law_keys(spark: SparkSession, d: str) -> DataFrame:
    t, a = F.col("langue"), F.col("jurabk")
    return laws(spark, d).select(
        "law_id", T.norm_title(t).alias("title_key"), T.norm_abbr(a).alias("abbr_key"), T.normalize_book(a).alias("book_key"),
        T.short_name(t).alias("short_name"), T.block_abbr(t).alias("block_key"), T.main_group(F.col("fna_code")).alias("first_digit"),
    )


@query(f"select distinct book, {_book('book')} as key from refs_raw")
def book_keys(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "refs_raw").select("book", T.normalize_book(F.col("book")).alias("key")).distinct()


@query(f"""
with r as (select distinct snapshot_no, slug, norm_pos, {_tags("text_xml")} as t from norm_snapshots)
select snapshot_no, slug, left(t, 500) as opening_text from r where t <> ''
qualify row_number() over (partition by snapshot_no, slug order by norm_pos nulls first, left(t, 500)) = 1""")
def opening_texts(spark: SparkSession, d: str) -> DataFrame:
    return taxonomy.opening_texts(table(spark, d, "norm_snapshots"), ["snapshot_no", "slug"])


@query(f"""with {_LAWS} select slug, concat_ws(' ', {_strip("coalesce(nullif(langue, ''), slug)")}, nullif({_strip("opening_text")}, '')) as text from laws""")
def embedding_texts(spark: SparkSession, d: str) -> DataFrame:
    return laws(spark, d).select("slug", T.embedding_text(F.col("langue"), F.col("slug"), F.col("opening_text")).alias("text"))


@query(f"""with {_LAWS} select law_id, {_node("jurabk", "slug")} as node, {_desc("opening_text", 200)} as short, {_desc("opening_text", 20)} as shorter from laws""")
def node_ids(spark: SparkSession, d: str) -> DataFrame:
    o = F.col("opening_text")
    return laws(spark, d).select("law_id", T.node_id(F.col("jurabk"), F.col("slug")).alias("node"), T.short_desc(o).alias("short"), T.short_desc(o, 20).alias("shorter"))


@query("""select doc_id, 'https://laws.example/' || slug || '/index.html' as link, coalesce(slug, 'x') as slug,
'https://laws.example/' || slug || '/xml.zip' as zip_url from documents where slug is not null""")
def toc_links(spark: SparkSession, d: str) -> DataFrame:
    links = table(spark, d, "documents").filter("slug is not null").select("doc_id", F.concat(F.lit("https://laws.example/"), "slug", F.lit("/index.html")).alias("link"))
    return links.select("doc_id", "link", T.slug_from_link(F.col("link")).alias("slug"), T.zip_url_from_link(F.col("link")).alias("zip_url"))


@query(f"""
with i as (select doc_id as ord, source as title, slug from documents where slug is not null and source is not null)
select slug, min(ord) as ord, 'https://laws.example/' || slug || '/xml.zip' as zip_url, {_strip("arg_max(title, ord)")} as title from i group by slug""")
def toc_last_wins(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "documents").filter("slug is not null").select(F.col("doc_id").alias("ord"), F.col("source").alias("title"), F.concat(F.lit("https://laws.example/"), "slug", F.lit("/xml.zip")).alias("link"))
    return toc_of(items)


# ---------------------------------------------------------------- taxonomy


@query(rf"""
with {_LAWS},
l as (select law_id, fna_code as code, regexp_replace(langue, '[\r\n]+', ' ', 'g') as t, 'S. ' || law_id as rest, ausfertigung_datum as a from laws
  where langue is not null and regexp_full_match(fna_code, '\d{{1,4}}-\d+(-\d+)?')),
e as (select law_id, 0 as pos, code, {_strip("t")} as title from l
  union all select law_id, 1, '9999-' || law_id, {_strip("left(t || ' ohne Datum ' || rest || chr(10) || 'Fortsetzung der zweiten Zeile', 140)")} from l)
select law_id, pos::int as pos, code, title from e""")
def taxonomy_entries(spark: SparkSession, d: str) -> DataFrame:
    rows = laws(spark, d).filter(F.col("langue").isNotNull() & F.col("fna_code").rlike(r"^\d{1,4}-\d+(-\d+)?\z"))
    t = F.regexp_replace("langue", r"[\r\n]+", " ")
    own = F.concat("fna_code", F.lit(" "), t, F.lit(" vom 1. 2. 1999 BGBl. I\nS. 7\n"))
    other = F.concat(F.lit("9999-"), "law_id", F.lit(" "), t, F.lit(" ohne Datum S. "), "law_id", F.lit("\nFortsetzung der zweiten Zeile"))
    return taxonomy.segment_entries(rows.select("law_id", F.concat(own, other).alias("text")), keep=("law_id",))


@query(rf"""with {_LAWS}, l as (select law_id, fna_code, langue from laws where langue is not null and regexp_full_match(fna_code, '[0-9][0-9-]*'))
select law_id, p::int as pos, fna_code as code, 'https://laws.example/' || law_id || '.htm' as url, {_strip(f"regexp_replace({_strip('langue')}, '{BS}s*{BS}([^()]+{BS}){BS}s*$', '')")} as title, {_group("fna_code")} as main_group
from l, (select unnest([0, 1]) as p)""")
def taxonomy_page_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = laws(spark, d).filter(F.col("langue").isNotNull() & F.col("fna_code").rlike("^[0-9][0-9-]*\\z"))
    row = F.concat(F.lit('<tr><td class="fnal"> '), "fna_code", F.lit('</td>\n<td><i>x</i> <a href="https://laws.example/'), F.col("law_id").cast("string"), F.lit('.htm" title="t" class="ltg"><b>'), T.escape_html(F.col("langue")), F.lit("</b></a></td></tr>\n"))
    return taxonomy.page_rows(rows.select("law_id", F.concat(F.lit("<table>"), row, row, F.lit("</table>")).alias("html")), keep=("law_id",))


_ENTRIES = "entries as (select fna_code as code, titel as block, reg_id as ord from law_register where fna_code is not null qualify row_number() over (partition by fna_code order by reg_id) = 1)"
_BY_TITLE = f"by_title as (select {_title('block')} as key, code, ord from entries where length({_title('block')}) >= 6 qualify row_number() over (partition by key order by ord, code) = 1)"
_BY_ABBR = f"by_abbr as (select {_block_abbr('block')} as key, code, ord from entries where length({_block_abbr('block')}) >= 2 qualify row_number() over (partition by key order by ord, code) = 1)"
_JOIN = f"""joined as (
  select l.slug, coalesce(a.code, b.code, c.code, e.code) as fna_code,
    case when a.code is not null then 'langue' when b.code is not null then 'toc_title' when c.code is not null then 'jurabk' when e.code is not null then 'slug' end as how
  from laws l
  left join by_title a on a.key = case when coalesce(l.jurabk, '') <> '' or coalesce(l.langue, '') <> '' then {_title("l.langue")} end
  left join by_title b on b.key = {_title("l.langue")}
  left join by_abbr c on c.key = {_abbr("l.jurabk")} left join by_abbr e on e.key = {_abbr("l.slug")})"""


def _joined(spark: SparkSession, d: str) -> DataFrame:
    rows = laws(spark, d)
    toc = rows.select("slug", F.col("langue").alias("title"))
    return taxonomy.join_taxonomy(toc, law_source.slug_table(rows), *taxonomy.join_maps(entries(spark, d)))


@query(f"with {_ENTRIES}, {_BY_TITLE} select key, code from by_title")
def title_map(spark: SparkSession, d: str) -> DataFrame:
    return taxonomy.join_maps(entries(spark, d))[0]


@query(f"with {_ENTRIES}, {_BY_ABBR} select key, code from by_abbr")
def abbr_map(spark: SparkSession, d: str) -> DataFrame:
    return taxonomy.join_maps(entries(spark, d))[1]


@query(f"with {_ENTRIES} select code, block, ord from entries")
def distinct_entries(spark: SparkSession, d: str) -> DataFrame:
    return entries(spark, d)


@query(f"with {_LAWS}, {_ENTRIES}, {_BY_TITLE}, {_BY_ABBR}, {_JOIN} select slug, fna_code, how from joined where fna_code is not null")
def taxonomy_join(spark: SparkSession, d: str) -> DataFrame:
    return _joined(spark, d)


@query(f"""with {_LAWS}, {_ENTRIES}, {_BY_TITLE}, {_BY_ABBR}, {_JOIN}
select how, count(*) as laws, round_even(100.0::double * count(*) / (select count(*) from laws), 1) as share from joined where fna_code is not null group by how""")
def match_stats(spark: SparkSession, d: str) -> DataFrame:
    return taxonomy.match_stats(_joined(spark, d), laws(spark, d).count())


@query(f"""with {_LAWS}, {_ENTRIES}, {_BY_TITLE}, {_BY_ABBR}, {_JOIN}
select l.law_id, l.slug, j.fna_code, {_group("j.fna_code")} as main_group from laws l left join joined j on l.slug = j.slug""")
def classify(spark: SparkSession, d: str) -> DataFrame:
    return taxonomy.classify(laws(spark, d), _joined(spark, d)).select("law_id", "slug", "fna_code", "main_group")


@query(f"with {_LAWS} select main_group, count(*) as laws from laws group by 1")
def group_histogram(spark: SparkSession, d: str) -> DataFrame:
    return taxonomy.group_histogram(laws(spark, d))


_FIELDS = ["jurabk", "amtabk", "ausfertigung_datum", "langue", "fna_code", "main_group", "opening_text"]


@query(f"with {_LAWS} " + " union all ".join(f"select '{c}' as field, count(nullif({c}::varchar, '')) as present, 100 * count(nullif({c}::varchar, '')) // count(*) as percent from laws" for c in _FIELDS))
def field_presence(spark: SparkSession, d: str) -> DataFrame:
    return taxonomy.field_presence(laws(spark, d), _FIELDS)


@query(f"with {_LAWS}, n as (select law_id, slug, row_number() over (order by law_id) as rn from laws) select law_id, slug from n where (rn - 1) % 7 = 0")
def systematic_sample(spark: SparkSession, d: str) -> DataFrame:
    return graph.systematic_sample(laws(spark, d).select("law_id", "slug"), ["law_id"], 7)


# ---------------------------------------------------------------- citations


@query(f"""
with s as (select doc_id, regexp_extract_all({_tags("text")}, '{citations.CITATION}') as spans from documents where coalesce(text, '') <> ''),
u as (select doc_id, unnest(range(len(spans)))::int as cit_pos, unnest(spans) as span_text from s),
p as (select doc_id, cit_pos, span_text, case when span_text like '§%' then 'par' else 'art' end as unit,
  regexp_extract(span_text, '{citations.CITATION}', 2) as number, regexp_extract(span_text, '{citations.CITATION}', 4) as b from u)
select doc_id, cit_pos, span_text, unit, number, lower(b) as book, case when regexp_full_match(b, '{citations.COMPOUND}') then 0.8 else 0.9 end::double as confidence
from p where lower(b) not in {resolve.FALSE_POSITIVES}""")
def citations_found(spark: SparkSession, d: str) -> DataFrame:
    return citations.extract(table(spark, d, "documents"), ["doc_id"], "text")


@query(f"""
with n as (select distinct snapshot_no, dok_nr, loaded_at, {_tags("text_xml")} as t from norm_snapshots where coalesce(text_xml, '') <> ''),
s as (select snapshot_no, dok_nr, loaded_at, regexp_extract_all(t, '{citations.CITATION}') as spans from n),
u as (select snapshot_no, dok_nr, loaded_at, unnest(range(len(spans)))::int as cit_pos, unnest(spans) as span_text from s)
select distinct snapshot_no, dok_nr, loaded_at, cit_pos, span_text, case when span_text like '§%' then 'par' else 'art' end as unit, regexp_extract(span_text, '{citations.CITATION}', 2) as number,
  lower(regexp_extract(span_text, '{citations.CITATION}', 4)) as book from u where lower(regexp_extract(span_text, '{citations.CITATION}', 4)) not in {resolve.FALSE_POSITIVES}""")
def norm_citations(spark: SparkSession, d: str) -> DataFrame:
    """Citations in all norms of all deliveries."""
    found = citations.extract(table(spark, d, "norm_snapshots"), ["snapshot_no", "dok_nr", "loaded_at"])
    return found.drop("confidence").distinct()


@query(f"select distinct * exclude (extracted_at) from refs_raw where coalesce(book, '') <> '' and lower(book) not in {resolve.FALSE_POSITIVES}")
def false_positive_filter(spark: SparkSession, d: str) -> DataFrame:
    return resolve.drop_false_positives(table(spark, d, "refs_raw").drop("extracted_at").distinct())


_INDEX = f"""keys as (
  select {_book("jurabk")} as key, lower(jurabk) as slug, 1 as pass, book_id as ord from book_list
  union all select {_book("name")}, lower(jurabk), 2, book_id from book_list
  union all select {_book(_short("name"))}, lower(jurabk), 3, book_id from book_list),
idx as (select key, slug from keys where length(key) >= 3 qualify row_number() over (partition by key order by pass, ord, slug) = 1)"""
_RESOLVED = f"""{_INDEX},
refs as (select distinct * from refs_raw where coalesce(book, '') <> '' and lower(book) not in {resolve.FALSE_POSITIVES}),
res as (select r.*, i.slug as target_slug, coalesce({_node("s.jurabk", "lower(s.jurabk)")}, 'de-bund/' || r.source_slug) as source,
    case when i.slug is not null then coalesce('de-bund/' || t.jurabk, 'de-bund/' || i.slug) end as target
  from refs r left join idx i on i.key = {_book("r.book")} left join book_list s on lower(s.jurabk) = r.source_slug left join book_list t on lower(t.jurabk) = i.slug)"""


@query(f"with {_INDEX} select key, slug from idx")
def book_index(spark: SparkSession, d: str) -> DataFrame:
    b = books(spark, d)
    return resolve.book_index(b, b.select("slug", F.col("langue").alias("title"), "ord"))


def _spelled(k: str) -> str:
    return f"case when contains({k}, 'ß') then replace({k}, 'ß', 'ss') else replace({k}, 'ss', 'ß') end"


@query(f"""with {_LAWS}, n as (select slug, law_id, regexp_replace(lower(langue), '[{W}]+', '', 'g') as t, regexp_replace(lower(regexp_extract(langue, '\\(([^)]{{3,}})\\)\\s*$', 1)), '[{W}]+', '', 'g') as p from laws),
k as (select slug, law_id, 0 as pass, lower(slug) as key from n union all select slug, law_id, 1, unnest([t, {_spelled("t")}, p, {_spelled("p")}]) from n)
select key, slug from k where key <> '' qualify row_number() over (partition by key order by length(slug), pass, law_id, slug) = 1""")
def plain_index(spark: SparkSession, d: str) -> DataFrame:
    return resolve.plain_index(laws(spark, d).select("slug", F.col("langue").alias("title"), F.col("law_id").alias("ord")))


@query(f"with {_RESOLVED} select distinct source, target, 'explicit' as type, 1.0::double as weight, null::date as valid_from, null::date as valid_to from res where target is not null and source is not null")
def resolved_edges(spark: SparkSession, d: str) -> DataFrame:
    return resolve.edges(resolved(spark, d))


_RESOLVER = f"""resolver as (select lower({_strip("span_text")}) as span_key, target as node_id from res where target is not null and lower({_strip("span_text")}) <> ''
  qualify row_number() over (partition by span_key order by source_slug nulls first, norm_pos nulls first, cit_pos nulls first, target) = 1)"""


@query(f"with {_RESOLVED}, {_RESOLVER} select span_key, node_id from resolver")
def resolver_map(spark: SparkSession, d: str) -> DataFrame:
    return resolve.resolver(resolved(spark, d))


@query(f"""with {_RESOLVED}, {_RESOLVER}
select count(target) as resolved, count(*) - count(target) as unresolved, round_even(100.0::double * count(target) / count(*), 1) as coverage_pct,
  (select count(*) from (select distinct source, target from res where target is not null and source is not null)) as unique_edges,
  (select count(*) from resolver) as resolver_entries from res""")
def coverage_stats(spark: SparkSession, d: str) -> DataFrame:
    return resolve.stats(resolved(spark, d))


@query(f"with {_RESOLVED} select book, count(*) as citations from res where target is null group by book order by citations desc, book limit 20")
def top_unresolved(spark: SparkSession, d: str) -> DataFrame:
    return resolve.top_unresolved(resolved(spark, d))


# ---------------------------------------------------------------- graph

_DEGREE = f"{_EDGES}, {_WHOLE}, deg as (select id, count(*) as degree from (select source as id from whole union all select target from whole) group by id)"
_SIZE = "round_even(2.0 + sqrt(greatest(coalesce(g.degree, 0), 0)::double) * 1.25, 1)"


@query(f"with {_NODES}, {_DEGREE} select n.id, coalesce(g.degree, 0) as degree, {_SIZE} as size from nodes n left join deg g on n.id = g.id")
def node_degree(spark: SparkSession, d: str) -> DataFrame:
    return graph.with_degree(nodes(spark, d), edges(spark, d)).select("id", "degree", "size")


@query(f"""with {_NODES}, {_DEGREE}
select min(coalesce(g.degree, 0)) as least, max(coalesce(g.degree, 0)) as most, count(*) as nodes, count(n.main_group) as classified, count(*) - count(n.main_group) as orphans
from nodes n left join deg g on n.id = g.id""")
def degree_summary(spark: SparkSession, d: str) -> DataFrame:
    return graph.degree_summary(graph.with_degree(nodes(spark, d), edges(spark, d)))


@query(f"""with {_LAWS}, {_DEGREE}, m as (select lower({_node("jurabk", "slug")}) as id, * from laws)
select m.id, lower(m.jurabk) as jurabk, m.langue as title, m.fna_code as code, m.main_group, m.ausfertigung_datum as created_at, coalesce(g.degree, 0) as degree, {_SIZE} as size
from m left join deg g on m.id = g.id""")
def built_graph(spark: SparkSession, d: str) -> DataFrame:
    g = graph.build_graph(laws(spark, d).withColumn("jurabk", F.lower("jurabk")), edges(spark, d))
    return g.select("id", "jurabk", "title", F.col("classification.code").alias("code"), F.col("classification.main_group").alias("main_group"), "created_at", "degree", "size")


@query(f"with {_EDGES} select edge_id, source, target, type, weight from edges where type = 'explicit' union all select edge_id, source, target, type, weight from edges where type = 'soft'")
def edge_union(spark: SparkSession, d: str) -> DataFrame:
    e = edges(spark, d)
    return graph.union_edges(e.filter("type = 'explicit'"), e.filter("type = 'soft'"))


@query(f"with {_EDGES}, {_WHOLE} select least(source, target) as a, greatest(source, target) as b, round(sum(case when coalesce(weight, 0) = 0 then 1.0 else weight end), 6) as weight from whole group by 1, 2")
def undirected_weights(spark: SparkSession, d: str) -> DataFrame:
    return graph.undirected(edges(spark, d)).withColumn("weight", F.round("weight", 6))


@query(f"with {_NODES}, {_EDGES} select edge_id, source, target, type, weight from edges where source in (select id from nodes) and target in (select id from nodes)")
def dangling_filter(spark: SparkSession, d: str) -> DataFrame:
    return graph.known_only(edges(spark, d), nodes(spark, d)).select("edge_id", "source", "target", "type", "weight")


_ADJ = f"""{_EDGES}, {_WHOLE}, adj as (
  select source as id, 'out' as direction, row_number() over (partition by source order by edge_id, target) as "at", target as other from whole
  union all select target, 'in', row_number() over (partition by target order by edge_id, source) as "at", source from whole)"""


@query(f"with {_ADJ} select id, direction, \"at\", other from adj")
def adjacency(spark: SparkSession, d: str) -> DataFrame:
    return graph.adjacency(edges(spark, d))


@query(f"""with {_NODES}, {_ADJ}, c as (select id, direction, greatest(count(*) - 25, 0) as more from adj group by 1, 2)
select a.id, a.direction, a."at", a.other, c.more from adj a join c on a.id = c.id and a.direction = c.direction where a."at" <= 25 and a.other in (select id from nodes)""")
def panel_top25(spark: SparkSession, d: str) -> DataFrame:
    return graph.panel(edges(spark, d), nodes(spark, d))


@query(f"with {_EDGES}, {_WHOLE} select distinct source, target from whole")
def directed_once(spark: SparkSession, d: str) -> DataFrame:
    return graph.directed_once(edges(spark, d))


@query(f"with {_NODES} select (min(x) + max(x)) / 2 as cx, (min(y) + max(y)) / 2 as cy from nodes")
def bounding_centre(spark: SparkSession, d: str) -> DataFrame:
    return graph.bounding_centre(nodes(spark, d))


# ---------------------------------------------------------------- vectors


@query("""
with v as (select vec_id, label, list_transform(embedding, lambda x: x::double) as v from embeddings),
c as (select o.vec_id as source, n.vec_id as target, list_inner_product(o.v, n.v) as s from v o, v n where o.label = 0 and o.vec_id <> n.vec_id)
select source, target, 'soft' as type, 0.1::double as weight, round(s, 6) as cos from c qualify row_number() over (partition by source order by round(s, 12) desc, target) <= 5""")
def soft_edges(spark: SparkSession, d: str) -> DataFrame:
    base = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").alias("v"))
    return vectors.soft_edges(base.filter("label = 0"), base)


@query("with v as (select vec_id, list_transform(embedding, lambda x: x::double) as v from embeddings) select vec_id, round(sqrt(list_inner_product(v, v)), 6) as length, abs(sqrt(list_inner_product(v, v)) - 1) < 1e-5 as is_unit from v")
def vector_lengths(spark: SparkSession, d: str) -> DataFrame:
    n = vectors.norm(F.col("embedding"))
    return table(spark, d, "embeddings").select("vec_id", F.round(n, 6).alias("length"), (F.abs(n - 1) < 1e-5).alias("is_unit"))


@query("select count(*) as n, 0.0::double as mean, 1.0::double as spread, 1.0::double as fixed, true as greatest from embeddings where embedding is not null")
def pca_checks(spark: SparkSession, d: str) -> DataFrame:
    """What a first principal component must fulfil: scores of mean 0 and spread 1 that a step of the power method leaves as they are, with a variance no single column exceeds."""
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    z = written(rows.join(vectors.pca_z(rows), "id"), "scored")
    values = z.select("z", F.posexplode(F.col("v").cast("array<double>")).alias("at", "x"))
    loads = values.groupBy("at").agg(F.covar_pop("x", "z").alias("load"), F.avg("x").alias("mean"), F.var_pop("x").alias("variance"))
    again = z.select("id", "z", F.posexplode(F.col("v").cast("array<double>")).alias("at", "x")).join(loads, "at")
    step = again.groupBy("id").agg(F.first("z").alias("z"), F.sum(F.col("load") * (F.col("x") - F.col("mean"))).alias("s"))
    most = loads.agg(F.sum(F.col("load") * F.col("load")).alias("own"), F.max("variance").alias("most")).select((F.col("own") >= F.col("most") - 1e-9).alias("greatest"))
    whole = step.agg(F.count(F.lit(1)).alias("n"), (F.round(F.avg("z"), 6) + 0.0).alias("mean"), F.round(F.stddev_pop("z"), 6).alias("spread"), F.round(F.corr("z", "s"), 5).alias("fixed"))
    one = F.lit(1).alias("_one")  # each side is a single row
    return whole.select("*", one).join(most.select("*", one), "_one").drop("_one")


@query()
def pca_z(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return vectors.pca_z(rows).select(F.col("id").alias("vec_id"), F.round("z", 6).alias("z"))


# ---------------------------------------------------------------- colours


def _hex(h: str, s: str, l: str) -> str:  # noqa: E741
    m2 = f"(case when {l} / 100.0 <= 0.5 then {l} / 100.0 * ({s} / 100.0 + 1.0) else {l} / 100.0 + {s} / 100.0 - {l} / 100.0 * ({s} / 100.0) end)"
    m1 = f"({l} / 100.0 * 2.0 - {m2})"

    def part(shift: str) -> str:
        u = f"(({h} / 360.0 + {shift}) - floor({h} / 360.0 + {shift}))"
        v = f"case when {s} = 0 then {l} / 100.0 when {u} < 1.0 / 6 then {m1} + ({m2} - {m1}) * {u} * 6.0 when {u} < 0.5 then {m2} when {u} < 2.0 / 3 then {m1} + ({m2} - {m1}) * (2.0 / 3 - {u}) * 6.0 else {m1} end"
        return f"format('{{:02x}}', round_even(255.0 * ({v}), 0)::int)"

    return f"'#' || {part('1.0 / 3')} || {part('0.0')} || {part('-1.0 / 3')}"


_PALETTE = "pal(main_group, ph, ps, pl, cluster) as (values " + ", ".join(f"({g}, {h}::double, {s}::double, {l}::double, '{c}')" for g, (h, s, l, c) in color.PALETTE.items()) + ")"
_MIX = "degrees(atan2(sum({w} * sin(radians({h}))), sum({w} * cos(radians({h}))))) as h0, sum({w} * {s}) / sum({w}) as s, sum({w} * {l}) / sum({w}) as l"
_OWN = f"""{_NODES}, {_EDGES}, {_PALETTE},
cnt as (select e.source, t.main_group, count(*) as n from edges e join nodes t on e.target = t.id where e.type = 'explicit' and t.main_group is not null group by 1, 2),
mix as (select source, groups, case when h0 < 0 then h0 + 360 else h0 end as h, s, l from (
  select c.source, count(*) as groups, {_MIX.format(w="c.n::double", h="coalesce(p.ph, 200.0)", s="coalesce(p.ps, 20.0)", l="coalesce(p.pl, 50.0)")}
  from cnt c left join pal p on c.main_group = p.main_group where c.source is not null group by 1)),
own as (select n.id, n.main_group, coalesce(m.groups, 0) >= 2 as bridging, coalesce(p.cluster, 'other') as cluster,
  case when m.groups >= 2 then m.h else coalesce(p.ph, 200.0) end as h, case when m.groups >= 2 then m.s else coalesce(p.ps, 20.0) end as s,
  case when m.groups >= 2 then m.l else coalesce(p.pl, 50.0) end as l
  from nodes n left join pal p on n.main_group = p.main_group left join mix m on m.source = n.id where n.main_group is not null)"""
_ORPHANS = f"""om as (select source, case when h0 < 0 then h0 + 360 else h0 end as h, s, l from (
  select e.source, {_MIX.format(w="e.weight", h="o.h", s="o.s", l="o.l")} from edges e join own o on e.target = o.id
  where e.type = 'soft' and e.source in (select id from nodes where main_group is null) group by 1 having sum(e.weight) > 0)),
orp as (select n.id, coalesce(m.h, 200.0) as h, coalesce(m.s, 20.0) as s, coalesce(m.l, 50.0) as l from nodes n left join om m on m.source = n.id where n.main_group is null)"""


@query(f"with {_OWN} select id, {_hex('h', 's', 'l')} as color, cluster, bridging from own")
def classified_colors(spark: SparkSession, d: str) -> DataFrame:
    from normloom.functions.color import hsl_to_hex

    own = color.classified_colors(nodes(spark, d).select("id", "main_group"), edges(spark, d))
    return own.select("id", hsl_to_hex(F.col("hsl.h"), F.col("hsl.s"), F.col("hsl.l")).alias("color"), "cluster", "bridging")


@query(f"with {_OWN}, {_ORPHANS} select id, {_hex('h', 's', 'l')} as color, cluster from own union all select id, {_hex('h', 's', 'l')}, 'unclassified' from orp")
def colors_frozen(spark: SparkSession, d: str) -> DataFrame:
    return color.assign_colors(nodes(spark, d).select("id", "main_group"), edges(spark, d), "frozen")


def _blend(l: str) -> str:  # noqa: E741
    """Blend of a list of (w, h, s, l): null if its weights add up to nothing."""
    total = lambda f: f"list_sum(list_transform({l}, lambda x: x.w * ({f})))"
    hue = f"degrees(atan2({total('sin(radians(x.h))')}, {total('cos(radians(x.h))')}))"
    turned = f"case when {hue} < 0 then {hue} + 360 else {hue} end"
    return f"case when list_sum(list_transform({l}, lambda x: x.w)) > 0 then struct_pack(h := {turned}, s := {total('x.s')} / {total('1')}, l := {total('x.l')} / {total('1')}) end"


@query(f"""with recursive {_OWN},
o as (select id, row_number() over (order by id) as k from nodes where main_group is null),
soft as (select o.k, e.target as t, e.weight as w from edges e join o on e.source = o.id where e.type = 'soft' and e.weight is not null),
fixed as (select s.k, list(struct_pack(w := s.w, h := c.h, s := c.s, l := c.l)) as v from soft s join own c on s.t = c.id group by 1),
before as (select s.k, list(struct_pack(t := s.t, w := s.w)) as v from soft s join o p on s.t = p.id where p.k < s.k group by 1),
todo as (select o.id, o.k, coalesce(f.v, []) as f, coalesce(b.v, []) as b from o left join fixed f on o.k = f.k left join before b on o.k = b.k),
walk(k, id, c, seen) as (
  select 0::bigint, ''::varchar, struct_pack(h := 200.0::double, s := 20.0::double, l := 50.0::double), map([''], [struct_pack(h := 200.0::double, s := 20.0::double, l := 50.0::double)])
  union all
  select k, id, c, map_concat(seen, map([id], [c])) from (
    select t.k, t.id, w.seen, coalesce({_blend("(t.f || list_transform(t.b, lambda x: struct_pack(w := x.w, h := w.seen[x.t].h, s := w.seen[x.t].s, l := w.seen[x.t].l)))")}, struct_pack(h := 200.0::double, s := 20.0::double, l := 50.0::double)) as c
    from walk w join todo t on t.k = w.k + 1))
select id, {_hex('h', 's', 'l')} as color, cluster from own union all select id, {_hex('c.h', 'c.s', 'c.l')}, 'unclassified' from walk where k > 0""")
def colors_ordered(spark: SparkSession, d: str) -> DataFrame:
    return color.assign_colors(nodes(spark, d).select("id", "main_group"), edges(spark, d), "ordered")


@query(f"with {_PALETTE} select 'FNA' as scheme, main_group::varchar as main_group, cluster, {_hex('ph', 'ps', 'pl')} as color from pal")
def meta_taxonomy(spark: SparkSession, d: str) -> DataFrame:
    return color.meta_taxonomy(spark)


@query(f"""with {_NODES}
select id, x / 20 as vx, y / 20 as vy, case when main_group is not null then (main_group - 5) * 100.0 else 0.0 end::double as vz, ((ascii(id) % 11) - 5) * 20.0::double as lifted from nodes""")
def view_modes(spark: SparkSession, d: str) -> DataFrame:
    n = nodes(spark, d).withColumn("z", F.lit(None).cast("double"))
    return color.view(n, "3d").join(color.view(n, "id").select("id", F.col("vz").alias("lifted")), "id")


@query(f"""with {_OWN}, {_ORPHANS}, c as (select id, {_hex('h', 's', 'l')} as color from own union all select id, {_hex('h', 's', 'l')} from orp),
hit as (select id from nodes where contains(lower(coalesce(jurabk, '') || ' ' || coalesce(title, '')), 'mühlen'))
select c.id, case when h.id is not null then color else '#1a1d24' end as color, case when h.id is not null then 1.0 else 0.22 end::double as opacity from c left join hit h on c.id = h.id""")
def highlight(spark: SparkSession, d: str) -> DataFrame:
    n = nodes(spark, d)
    return color.highlight(color.assign_colors(n.select("id", "main_group"), edges(spark, d)), search.search(n, " Mühlen "))


# ---------------------------------------------------------------- layout, search, time, checks


@query(f"""with {_LAWS}, {_NODES}, m as (select distinct lower({_node("jurabk", "slug")}) as id from laws)
select m.id, coalesce(n.x, 0.0) as x, coalesce(n.y, 0.0) as y, null::double as z from m left join nodes n on m.id = n.id""")
def merged_layout(spark: SparkSession, d: str) -> DataFrame:
    ids = laws(spark, d).select(F.lower(T.node_id(F.col("jurabk"), F.col("slug"))).alias("id")).distinct()
    return layout.merge_layout(ids, nodes(spark, d).select("id", "x", "y"))


@query()
def force_layout(spark: SparkSession, d: str) -> DataFrame:
    return layout.run_layout(nodes(spark, d), edges(spark, d), iterations=30)


@query(f"""with {_LAWS}, {_NODES}, own as (select lower({_node("jurabk", "slug")}) as id, slug, opening_text from laws),
t as (select id, {_desc("arg_max(coalesce(opening_text, ''), slug)", 200)} as "desc" from own group by id)
select n.id, n.jurabk, n.title, t."desc" from nodes n left join t on n.id = t.id""")
def search_docs(spark: SparkSession, d: str) -> DataFrame:
    rows = laws(spark, d).withColumn("jurabk", F.lower("jurabk"))
    return search.search_docs(nodes(spark, d), rows)


@query(f"with {_NODES} select id, jurabk, title from nodes where contains(lower(coalesce(jurabk, '') || ' ' || coalesce(title, '')), 'hafen')")
def substring_search(spark: SparkSession, d: str) -> DataFrame:
    return search.search(nodes(spark, d), " HAFEN").select("id", "jurabk", "title")


@query(f"""with {_NODES} select id, case when length(coalesce(jurabk, id)) > 14 then left(coalesce(jurabk, id), 13) || '…' else coalesce(jurabk, id) end as label,
left(replace(title, chr(10), ' '), 90) as tooltip from nodes""")
def labels(spark: SparkSession, d: str) -> DataFrame:
    return search.labels(nodes(spark, d))


@query(f"""with {_NODES} select id from nodes where try_cast({_strip("created_at")} as date) <= date '2000-01-01'
and (try_cast({_strip("repealed_at")} as date) is null or try_cast({_strip("repealed_at")} as date) > date '2000-01-01')""")
def visible_at(spark: SparkSession, d: str) -> DataFrame:
    return search.visible_at(nodes(spark, d), "2000-01-01").select("id")


@query(f"""with {_RESOLVED}, {_RESOLVER}, {_NODES}, {_EDGES}, b as (select count(*)::double as n, count(*) - count(main_group) as o, count(distinct id) as d from nodes),
ends as (select source as id from edges union all select target from edges)
select 'nodes' as "check", n as value, n between 5000 and 8000 as ok from b
union all select 'orphan_share', round(o / n, 6), round(o / n, 6) <= 0.35 from b
union all select 'repeated_ids', n - d, n = d from b
union all select 'schema', 0.0, true
union all select 'dangling_ends', count(*)::double, count(*) = 0 from ends where id is not null and id not in (select id from nodes)
union all select 'dangling_resolver', count(*)::double, count(*) = 0 from resolver where lower(node_id) not in (select id from nodes)""")
def validation(spark: SparkSession, d: str) -> DataFrame:
    resolver = written(resolve.resolver(resolved(spark, d)), "resolver")
    return validate.validate(nodes(spark, d), edges(spark, d), resolver.withColumn("node_id", F.lower("node_id")))


# ---------------------------------------------------------------- documents


def _reads(c: str, kept: str) -> str:
    """A text of XML as a parser reads it: references resolved but for ``kept``, line ends as line feeds."""
    pieces = f"regexp_extract_all(regexp_replace({c}, '\\r\\n?', chr(10), 'g'), '&[#a-zA-Z0-9]{{1,10}};|[^&]+|&')"
    return (
        f"array_to_string(list_transform({pieces}, lambda p: case when p in ({kept}) then p when p in ('&#38;', '&#x26;') then {{}} when p = '&amp;' then '&' when p = '&lt;' then '<' when p = '&gt;' then '>' "
        "when p = '&quot;' then chr(34) when p = '&apos;' then chr(39) when regexp_full_match(p, '&#[0-9]+;') then chr(p[3:-2]::int) when regexp_full_match(p, '&#[xX][0-9a-fA-F]+;') then chr(('0x' || p[4:-2])::int) else p end), '')"
    )


#: The text before the first tag reads plainly; in markup the reserved characters stay references, and empty elements have no blank.
_INNER = "nullif({strip}, '')".format(
    strip=_strip("(" + _reads("regexp_extract(text_xml, '^[^<]*')", "''").replace("{}", "'&'") + " || regexp_replace(" + _reads("regexp_replace(text_xml, '^[^<]*', '')", "'&amp;', '&lt;', '&gt;'").replace("{}", "'&amp;'") + ", ' +/>', '/>', 'g'))")
)
_ENBEZ = "nullif(regexp_replace(enbez, '\\r\\n?', chr(10), 'g'), '')"


def _documents(spark: SparkSession, d: str, names: str, end: str) -> DataFrame:
    """A document of a header and one norm for each row of the deliveries."""
    rows = table(spark, d, "norm_snapshots").select("snapshot_no", "dok_nr", "loaded_at", "enbez", "text_xml")
    enbez = F.coalesce(F.concat(F.lit("<enbez>"), T.escape_html(F.col("enbez")), F.lit("</enbez>")), F.lit(""))
    xml = F.concat(F.lit(f"<dokumente><norm><metadaten>{names}</metadaten></norm><norm><metadaten>"), enbez, F.lit("</metadaten><textdaten><text>"), F.coalesce("text_xml", F.lit("")), F.lit(f"</text></textdaten>{end}"))
    return rows.select("snapshot_no", "dok_nr", "loaded_at", xml.cast("binary").alias("content"))


def _parsed(documents: DataFrame) -> DataFrame:
    parsed = law_source.parse_laws(documents, "snapshot_no", keep=("dok_nr", "loaded_at"))
    one = F.try_element_at("norms", F.lit(1))
    return parsed.select("snapshot_no", "dok_nr", "loaded_at", "jurabk", "langue", "norm_count", F.array_join("parse_warnings", "; ").alias("warnings"), one["enbez"].alias("enbez"), one["text_xml"].alias("text_xml")).distinct()


@query(f"select distinct snapshot_no, dok_nr, loaded_at, 'J' as jurabk, 'L & M' as langue, 1::int as norm_count, '' as warnings, {_ENBEZ} as enbez, {_INNER} as text_xml from norm_snapshots")
def parsed_laws(spark: SparkSession, d: str) -> DataFrame:
    return _parsed(_documents(spark, d, "<jurabk>J</jurabk><langue>L &amp; M<B>fett</B></langue>", "</norm></dokumente>"))


@query(f"select distinct snapshot_no, dok_nr, loaded_at, 'J' as jurabk, null::varchar as langue, 1::int as norm_count, 'XML recovered; missing langue' as warnings, {_ENBEZ} as enbez, {_INNER} as text_xml from norm_snapshots")
def recovered_laws(spark: SparkSession, d: str) -> DataFrame:
    """The same documents broken off before their end."""
    return _parsed(_documents(spark, d, "<jurabk>J</jurabk>", "</norm>"))


def _escaped(c: str) -> str:
    for raw, ref in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&#x27;")):
        c = f"replace({c}, '{raw}', '{ref}')"
    return c


_LATEST = """latest as (
  select * from norm_snapshots where dok_nr is not null and slug is not null and snapshot_no = (select max(snapshot_no) from norm_snapshots)
  qualify row_number() over (partition by dok_nr order by loaded_at desc nulls last, slug desc, norm_pos desc nulls last, enbez desc nulls last, titel desc nulls last, text_xml desc nulls last) = 1)"""
_ANCHOR = rf"""regexp_replace(regexp_replace(regexp_replace(lower(regexp_replace(regexp_replace({_strip("enbez")}, '^§[{W}]*', ''), '^Art\.[{W}]*', 'art-')), '[{W}]+', '-', 'g'), '[^\p{{L}}\p{{N}}\p{{M}}_-]', '', 'g'), '^-+|-+$', '', 'g')"""


@query(f"""with {_LAWS}, {_LATEST},
n as (select *, row_number() over (partition by slug order by norm_pos nulls first, dok_nr) - 1 as i from latest),
t as (select slug, i, '<section id="' || coalesce(nullif({_ANCHOR}, ''), 'norm-' || i) || '">' || chr(10)
    || coalesce('  <h2>' || nullif({_escaped("coalesce(enbez, '')")} || coalesce(' ' || {_escaped("nullif(titel, '')")}, ''), '') || '</h2>' || chr(10), '')
    || coalesce('  <div class="norm-text">' || nullif(text_xml, '') || '</div>' || chr(10), '') || '</section>' as part from n),
s as (select slug, string_agg(part, chr(10) order by i) || chr(10) as parts from t group by slug),
e as (select law_id, slug, {_escaped("coalesce(nullif(jurabk, ''), slug)")} || ' – ' || {_escaped("coalesce(nullif(langue, ''), nullif(jurabk, ''), slug)")} as shown from laws)
select law_id, md5('<!DOCTYPE html>' || chr(10) || '<html lang="de">' || chr(10) || '<head>' || chr(10) || '  <meta charset="UTF-8">' || chr(10) || '  <title>' || shown || '</title>' || chr(10) || '</head>' || chr(10) || '<body>' || chr(10)
  || '<h1 data-slug="' || {_escaped("e.slug")} || '">' || shown || '</h1>' || chr(10) || coalesce(parts, '') || '</body>' || chr(10) || '</html>') as page
from e left join s on e.slug = s.slug""")
def law_pages(spark: SparkSession, d: str) -> DataFrame:
    """The page of every law with all its norms of the latest delivery."""
    whole = laws(spark, d).join(latest_norms(spark, d), "slug", "left")
    norms = F.coalesce("norms", F.array().cast(f"array<{law_source.NORM}>"))
    return whole.select("law_id", F.md5(law_source.law_html(F.col("slug"), F.col("jurabk"), F.col("langue"), norms)).alias("page"))


@query()
def full_build(spark: SparkSession, d: str) -> DataFrame:
    """The whole build over the laws of the test tables, each with its norms of the latest delivery; where that has none, with its opening text."""
    from normloom.plans.pipeline import build

    rows = laws(spark, d)
    one = F.array(F.struct(F.lit("§ 1").alias("enbez"), F.lit(None).cast("string").alias("titel"), F.col("opening_text").alias("text_xml")))
    whole = rows.join(latest_norms(spark, d), "slug", "left").withColumn("norms", F.coalesce("norms", one))
    parsed = written(whole.select("slug", "jurabk", "amtabk", "ausfertigung_datum", "langue", F.size("norms").alias("norm_count"), F.array().cast("array<string>").alias("parse_warnings"), "norms"), "parsed")
    toc = rows.select("slug", F.col("law_id").alias("ord"), F.col("langue").alias("title"))
    vectors_of = table(spark, d, "opening_vectors").filter("embedding is not null and size(embedding) = 64").select("slug", "embedding").dropDuplicates(["slug"])
    out = build(parsed, toc, entries(spark, d), vectors_of)
    return out.nodes.select("id", "title", "meta_cluster", "color", "degree", "size", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), F.round("z", 6).alias("z"))

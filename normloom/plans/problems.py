"""Queries of the general data-preparation problems 2, 3 and 6."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from normloom.functions.text import WHITE
from normloom.operators import history, orphans, snapshots
from normloom.runtime import table


def p2_found(spark: SparkSession, directory: str) -> DataFrame:
    return snapshots.found(table(spark, directory, "norm_snapshots"))


def p3_found(spark: SparkSession, directory: str) -> DataFrame:
    return history.found(table(spark, directory, "node_updates"))


def p6_found(spark: SparkSession, directory: str) -> DataFrame:
    return orphans.found(table(spark, directory, "graph_edges"), table(spark, directory, "graph_nodes"))


def p6_report(spark: SparkSession, directory: str) -> DataFrame:
    return orphans.report(table(spark, directory, "graph_edges"), table(spark, directory, "graph_nodes"))


QUERIES = {"p2_found": p2_found, "p3_found": p3_found, "p6_found": p6_found, "p6_report": p6_report}

_BLANK = r"'^[\s\x{a0}\x{2007}\x{202f}]+|[\s\x{a0}\x{2007}\x{202f}]+$'"

_P6 = f"""
with n as (select lower(regexp_replace(id, {_BLANK}, '', 'g')) k, loaded_at, removed_at from graph_nodes where id is not null),
r as (
  select distinct edge_id, field, k, seen_at from (
    select edge_id, 'source' as field, lower(regexp_replace(source, {_BLANK}, '', 'g')) k, seen_at from graph_edges
    union all
    select edge_id, 'target', lower(regexp_replace(target, {_BLANK}, '', 'g')), seen_at from graph_edges)
  where k is not null and k <> ''),
j as (
  select r.edge_id, r.field, r.k, r.seen_at, count(n.k) as known,
    count(n.k) filter (where n.loaded_at <= r.seen_at and (n.removed_at is null or n.removed_at > r.seen_at)) as present,
    count(n.k) filter (where n.loaded_at <= r.seen_at) as loaded
  from r left join n on r.k = n.k group by all),
o as (
  select edge_id, field, k, seen_at, case when known = 0 then 'missing' when loaded = 0 then 'late' else 'deleted' end as reason
  from j where present = 0)
"""



def _canonical(c: str) -> str:
    """References resolved once, NFC, without white space."""
    parts = f"regexp_extract_all(coalesce({c}, ''), '&[#a-zA-Z0-9]{{1,10}};|[^&]+|&')"
    text = (
        "lambda p: case when regexp_full_match(p, '&#[0-9]+;') then chr(p[3:-2]::int) when regexp_full_match(p, '&#[xX][0-9a-fA-F]+;') then chr(('0x' || p[4:-2])::int) "
        "when p = '&amp;' then '&' when p = '&lt;' then '<' when p = '&gt;' then '>' when p = '&quot;' then chr(34) when p = '&apos;' then chr(39) else p end"
    )
    return f"regexp_replace(nfc_normalize(array_to_string(list_transform({parts}, {text}), '')), '[{WHITE}]+', '', 'g')"


ORACLES = {
    "p2_found": f"""
with w as (
  select snapshot_no, dok_nr, {_canonical("enbez")} as e, {_canonical("text_xml")} as t from norm_snapshots where snapshot_no is not null and dok_nr is not null
  qualify row_number() over (partition by snapshot_no, dok_nr order by loaded_at desc nulls last) = 1),
s as (select snapshot_no as later, lag(snapshot_no) over (order by snapshot_no) as earlier from (select distinct snapshot_no from w)),
a as (select s.later, w.* from s join w on w.snapshot_no = s.earlier),
b as (select s.later, w.* from s join w on w.snapshot_no = s.later where s.earlier is not null)
select coalesce(a.later, b.later) as snapshot_no, coalesce(a.dok_nr, b.dok_nr) as dok_nr,
  case when a.dok_nr is null then 'added' when b.dok_nr is null then 'removed' else 'changed' end as change
from a full join b on a.later = b.later and a.dok_nr = b.dok_nr where a.dok_nr is null or b.dok_nr is null or a.e <> b.e or a.t <> b.t""",
    "p3_found": r"""
with o as (
  select node_id, observed_at, op,
    regexp_replace(created_at, '^[\s\x{a0}]+|[\s\x{a0}]+$', '', 'g') c, regexp_replace(repealed_at, '^[\s\x{a0}]+|[\s\x{a0}]+$', '', 'g') p
  from node_updates where node_id is not null and observed_at is not null and op in ('U', 'D')
  qualify row_number() over (partition by node_id, observed_at order by ingested_at desc, update_id desc) = 1),
d as (
  select node_id, observed_at, op,
    nullif(case when regexp_full_match(c, '\d{4}-\d{2}-\d{2}([T ].*)?') then try_cast(left(c, 10) as date)
         when regexp_full_match(c, '\d{1,2}\.\d{1,2}\.\d{4}') then try_strptime(c, '%d.%m.%Y')::date end, date '9999-12-31') c,
    nullif(case when regexp_full_match(p, '\d{4}-\d{2}-\d{2}([T ].*)?') then try_cast(left(p, 10) as date)
         when regexp_full_match(p, '\d{1,2}\.\d{1,2}\.\d{4}') then try_strptime(p, '%d.%m.%Y')::date end, date '9999-12-31') p
  from o),
w as (
  select *, lag(op) over q lop, lag(c) over q lc, lag(p) over q lp from d window q as (partition by node_id order by observed_at)),
e as (
  select * from w
  where (op = 'U' and (lop is null or lop = 'D' or c is distinct from lc or p is distinct from lp)) or (op = 'D' and lop = 'U')),
v as (select *, lead(observed_at) over (partition by node_id order by observed_at) nxt from e)
select distinct node_id, strftime(observed_at, '%Y-%m-%d') as valid_from, coalesce(strftime(nxt, '%Y-%m-%d'), '9999-12-31') as valid_to
from v where op = 'U'
""",
    "p6_found": _P6 + "select distinct edge_id, field, reason from o",
    "p6_report": _P6 + "select 'graph_edges' as child, field, strftime(seen_at, '%Y-%m') as month, reason, count(*) as orphans from o group by all",
}

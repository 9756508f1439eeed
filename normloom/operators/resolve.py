"""From cited book names to edges between laws.

Defined results: empty and generic book names are dropped; a name that no law
bears stays unresolved and is counted; one edge for each pair of laws, one
target for each cited text (the first in order); self-citations stay unless
``exclude_self``; empty tables give empty results and a coverage of 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from normloom.functions.text import WHITE, node_id, normalize_book, short_name, strip_white
from normloom.operators.graph import first_per_key

# Generic words that are no names of laws.
FALSE_POSITIVES = (
    "vorschriften", "vorschrift", "verordnung", "rechtsverordnung", "anordnung", "haftung", "bundes", "überwachung",
    "ordnungswidrigkeiten", "bestimmungen", "bestimmung", "regelung", "regelungen", "gesetz",
)
#: Shortest key of the index; weight of an explicit edge.
KEY, EXPLICIT_WEIGHT = 3, 1.0


def drop_false_positives(refs: DataFrame) -> DataFrame:
    book = F.lower("book")
    return refs.filter((F.coalesce(book, F.lit("")) != "") & ~book.isin(*FALSE_POSITIVES))


def book_index(laws: DataFrame, toc: DataFrame) -> DataFrame:
    """(key, slug): abbreviations before titles before short names, then in order; ``laws``: slug, jurabk, langue, ord; ``toc``: slug, title, ord."""
    keys = (
        laws.select(normalize_book(F.col("jurabk")).alias("key"), "slug", F.lit(1).alias("pass"), "ord")
        .unionByName(toc.select(normalize_book(F.col("title")).alias("key"), "slug", F.lit(2).alias("pass"), "ord"))
        .unionByName(laws.select(normalize_book(short_name(F.col("langue"))).alias("key"), "slug", F.lit(3).alias("pass"), "ord"))
    )
    return first_per_key(keys.filter(F.length("key") >= KEY), "key", ["pass", "ord", "slug"], ["slug"])


def resolve(refs: DataFrame, index: DataFrame, laws: DataFrame, jurisdiction: str = "de-bund") -> DataFrame:
    """``refs`` with key, target_slug, source and target node (null if unresolved)."""
    names = laws.select("slug", node_id(F.col("jurabk"), F.col("slug"), jurisdiction).alias("node")).dropDuplicates(["slug"])
    keyed = refs.withColumn("key", normalize_book(F.col("book")))
    hit = keyed.join(index.select("key", F.col("slug").alias("target_slug")), "key", "left")
    side = lambda df, slug, out: df.join(names.select(F.col("slug").alias(slug), F.col("node").alias(f"_{out}")), slug, "left").withColumn(out, F.coalesce(f"_{out}", F.concat(F.lit(f"{jurisdiction}/"), slug))).drop(f"_{out}")
    return side(side(hit, "source_slug", "source"), "target_slug", "target")


def edges(resolved: DataFrame, exclude_self: bool = False) -> DataFrame:
    """(source, target, type, weight, valid_from, valid_to), each pair once."""
    pairs = resolved.filter("target is not null and source is not null").select("source", "target").distinct()
    if exclude_self:
        pairs = pairs.filter("source != target")
    none = [F.lit(None).cast("date").alias(c) for c in ("valid_from", "valid_to")]
    return pairs.select("source", "target", F.lit("explicit").alias("type"), F.lit(EXPLICIT_WEIGHT).alias("weight"), *none)


def resolver(resolved: DataFrame) -> DataFrame:
    """(span_key, node_id): the first target of each cited text, in order of file, norm and place."""
    rows = resolved.filter(F.col("target").isNotNull()).withColumn("span_key", F.lower(strip_white(F.col("span_text")))).filter("span_key != ''")
    return first_per_key(rows, "span_key", ["source_slug", "norm_pos", "cit_pos", "target"], ["target"]).withColumnRenamed("target", "node_id")


def stats(resolved: DataFrame) -> DataFrame:
    """One row: resolved, unresolved, coverage_pct, unique_edges, resolver_entries.

    Each reference gives a row to count, one for its edge and one for its span; equal ones meet in one
    aggregation, so ``resolved`` is computed once.
    """
    hit, span = F.col("target").isNotNull(), F.lower(strip_white(F.col("span_text")))
    kinds = F.array_compact(
        F.array(
            F.struct(F.when(hit, "hit").otherwise("miss").alias("kind"), F.lit("").alias("a"), F.lit("").alias("b")),
            F.when(hit & F.col("source").isNotNull(), F.struct(F.lit("edge").alias("kind"), F.col("source").alias("a"), F.col("target").alias("b"))),
            F.when(hit & (F.coalesce(span, F.lit("")) != ""), F.struct(F.lit("span").alias("kind"), span.alias("a"), F.lit("").alias("b"))),
        )
    )
    counts = resolved.select(F.explode(kinds).alias("k")).groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    of = lambda kind: F.col("k.kind") == kind
    rows = lambda kind: F.coalesce(F.sum(F.when(of(kind), F.col("n"))), F.lit(0))
    n = counts.agg(rows("hit").alias("resolved"), rows("miss").alias("unresolved"), F.count_if(of("edge")).alias("unique_edges"), F.count_if(of("span")).alias("resolver_entries"))
    total = F.col("resolved") + F.col("unresolved")
    share = F.when(total > 0, F.bround(F.lit(100.0) * F.col("resolved") / total, 1)).otherwise(0.0)
    return n.select("resolved", "unresolved", share.alias("coverage_pct"), "unique_edges", "resolver_entries")


def top_unresolved(resolved: DataFrame, most: int = 20) -> DataFrame:
    """(book, citations): the names cited most that no law bears."""
    counts = resolved.filter(F.col("target").isNull()).groupBy("book").agg(F.count(F.lit(1)).alias("citations"))
    return counts.orderBy(F.col("citations").desc(), "book").limit(most)


def plain_index(toc: DataFrame) -> DataFrame:
    """(key, slug): the simpler index over ``toc`` (slug, title, ord); of several slugs the shortest wins, then the first.

    Keys are the slug, the title and the title's trailing parenthetical of three characters or more, in lower
    case without white space, the last two also in the other spelling of ß.  Slugs count before titles.
    """
    bare = lambda c: F.regexp_replace(F.lower(c), f"[{WHITE}]+", "")
    other = lambda k: F.when(F.contains(k, F.lit("ß")), F.replace(k, F.lit("ß"), F.lit("ss"))).otherwise(F.replace(k, F.lit("ss"), F.lit("ß")))
    title, short = bare(F.col("title")), bare(F.regexp_extract("title", r"\(([^)]{3,})\)\s*$", 1))
    names = toc.select("slug", "ord", F.array(F.lower("slug"), title, other(title), short, other(short)).alias("names"))
    keys = names.select("slug", "ord", F.length("slug").alias("n"), F.posexplode("names").alias("at", "key")).filter("key != ''")
    return first_per_key(keys.withColumn("pass", F.least("at", F.lit(1))), "key", ["n", "pass", "ord", "slug"], ["slug"])

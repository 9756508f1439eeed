"""The table of contents of laws: an XML file of items with title and link.

Defined results: items without title or link element, or with a blank link, are
skipped; an empty title stays empty; of several items with one slug the last
one's fields count and the first one's place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from normloom.functions.text import slug_from_link, strip_white, zip_url_from_link
from normloom.operators.graph import numbered

_SHAPE = "title string, link string"


def read_toc(spark: SparkSession, path: str) -> DataFrame:
    """(slug, ord, zip_url, title) of an XML file of ``item`` elements under any root."""
    items = spark.read.format("xml").option("rowTag", "item").option("nullValue", "\0").schema(_SHAPE).load(path)
    return toc_of(items.select(F.monotonically_increasing_id().alias("ord"), "title", "link"))


def toc_of(items: DataFrame) -> DataFrame:
    """The same from rows (ord, title, link)."""
    link = strip_white(F.col("link"))
    good = items.filter(F.col("title").isNotNull() & (F.coalesce(link, F.lit("")) != ""))
    rows = good.select(slug_from_link(link).alias("slug"), "ord", zip_url_from_link(link).alias("zip_url"), strip_white(F.col("title")).alias("title"))
    last = F.max_by(F.struct("zip_url", "title"), "ord")
    return rows.groupBy("slug").agg(F.min("ord").alias("ord"), last.alias("r")).select("slug", "ord", "r.zip_url", "r.title")


def slug_order(laws: DataFrame) -> DataFrame:
    """``laws`` with ``ord`` by slug, where there is no table of contents."""
    return numbered(laws, ["slug"]).withColumnRenamed("pos", "ord")

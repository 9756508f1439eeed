"""Search documents, literal search, labels and time filter.

Defined results: an empty or blank query finds nothing; null names and titles
count as empty; nodes without description keep null.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from normloom.functions.text import label, node_id, short_desc, strip_white, tooltip


def search_docs(nodes: DataFrame, classified: DataFrame, most: int = 200, jurisdiction: str = "de-bund") -> DataFrame:
    """(id, jurabk, title, desc): nodes with the cut opening text of the law of that id, the last slug if several."""
    own = classified.select(node_id(F.col("jurabk"), F.col("slug"), jurisdiction).alias("id"), F.struct("slug", "opening_text").alias("r"))
    texts = own.groupBy("id").agg(F.max("r").alias("r")).select("id", short_desc(F.col("r.opening_text"), most).alias("desc"))
    return nodes.select("id", "jurabk", "title").join(texts, "id", "left")


def search(nodes: DataFrame, query: str) -> DataFrame:
    """Nodes whose name and title hold the query literally, whatever the case."""
    q = query.strip().lower()
    text = F.lower(F.concat(F.coalesce("jurabk", F.lit("")), F.lit(" "), F.coalesce("title", F.lit(""))))
    return nodes.filter(F.contains(text, F.lit(q)) if q else F.lit(False))


def labels(nodes: DataFrame) -> DataFrame:
    """(id, label, tooltip)."""
    return nodes.select("id", label(F.coalesce("jurabk", "id")).alias("label"), tooltip(F.col("title")).alias("tooltip"))


def visible_at(nodes: DataFrame, day: str) -> DataFrame:
    """Nodes created by ``day`` and not yet repealed; dates are ISO text, others count as missing."""
    at = F.lit(day).cast("date")
    date = lambda c: F.try_to_date(strip_white(F.col(c)), "yyyy-MM-dd")
    return nodes.filter((date("created_at") <= at) & (date("repealed_at").isNull() | (date("repealed_at") > at)))

"""Nodes, edges and degrees of the citation graph.

Edges have source, target, type and weight.  Defined results: edges with a null
end are no edges; a null or zero weight is 1; unknown ends count for the known
one; nodes without edges have degree 0; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from normloom.functions.text import node_id, strip_white


def key_of_id(c: Column) -> Column:
    """Ids as they are compared: without outer white space, in lower case; blank is null."""
    k = F.lower(strip_white(c))
    return F.when(k != "", k)


def whole_edges(edges: DataFrame) -> DataFrame:
    return edges.filter(F.col("source").isNotNull() & F.col("target").isNotNull())


def union_edges(*parts: DataFrame) -> DataFrame:
    """All edges of all parts, nothing merged across types."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def degrees(edges: DataFrame) -> DataFrame:
    """(id, degree): in plus out; an edge from a node to itself counts twice."""
    return whole_edges(edges).select(F.explode(F.array("source", "target")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))


def size_of(degree: Column) -> Column:
    """Drawn size: 2 + 1.25 * sqrt(degree), one decimal, halves to even."""
    return F.bround(F.lit(2.0) + F.sqrt(F.greatest(degree, F.lit(0)).cast("double")) * 1.25, 1)


def with_degree(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``nodes`` with degree and size; a broadcast or shuffle join as the sizes suggest."""
    d = F.coalesce("degree", F.lit(0).cast("long"))
    return nodes.join(degrees(edges), "id", "left").withColumn("degree", d).withColumn("size", size_of(d))


def build_graph(laws: DataFrame, edges: DataFrame, jurisdiction: str = "de-bund") -> DataFrame:
    """A node for each law with degree and size; place and colour are still null."""
    code, group = F.col("fna_code"), F.col("main_group")
    nodes = laws.select(
        node_id(F.col("jurabk"), F.col("slug"), jurisdiction).alias("id"), F.lit(jurisdiction).alias("jurisdiction"), "jurabk", F.col("langue").alias("title"),
        F.struct(F.lit("FNA").alias("scheme"), code.alias("code"), group.cast("int").alias("main_group")).alias("classification"),
        F.col("ausfertigung_datum").alias("created_at"), F.lit(None).cast("string").alias("repealed_at"),
    )
    none = [F.lit(None).cast(t).alias(n) for n, t in (("meta_cluster", "string"), ("x", "double"), ("y", "double"), ("color", "string"))]
    return with_degree(nodes, edges).select("*", *none)


def known_only(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose ends are both nodes."""
    ids = nodes.select("id").distinct()
    out = edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi")
    return out.join(ids.withColumnRenamed("id", "target"), "target", "left_semi")


def undirected(edges: DataFrame) -> DataFrame:
    """(a, b, weight): parallel and opposite edges as one, weights added; a <= b."""
    w = F.when(F.coalesce("weight", F.lit(0.0)) == 0, 1.0).otherwise(F.col("weight"))
    return whole_edges(edges).groupBy(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).agg(F.sum(w).alias("weight"))


def directed_once(edges: DataFrame) -> DataFrame:
    """(source, target): every directed pair once."""
    return whole_edges(edges).select("source", "target").distinct()


def _ends(edges: DataFrame, order: str) -> DataFrame:
    """(k, o, other): both ends of every edge with its direction in the key."""
    e = whole_edges(edges)
    end = lambda d, own, other: F.struct(F.concat(F.lit(d), own).alias("k"), F.col(order).alias("o"), F.col(other).alias("other"))
    return e.select(F.explode(F.array(end("out:", "source", "target"), end("in:", "target", "source"))).alias("e")).select("e.*")


def _direction() -> tuple[Column, Column]:
    return F.expr("substring(k, instr(k, ':') + 1)").alias("id"), F.substring_index("k", ":", 1).alias("direction")


def adjacency(edges: DataFrame, order: str = "edge_id") -> DataFrame:
    """(id, direction, at, other): neighbours of each node in edge order, numbered from 1.

    Rows, not a list for each node, so that a hub of any size stays distributed.
    """
    from normloom.operators.slices import running_sums, with_slices

    line, sliced = with_slices(_ends(edges, order), "k", F.col("o").cast("long"))
    numbered = running_sums(line, "k", ["o", "other"], {"at": F.lit(1).cast("long")}, sliced)
    return numbered.select(*_direction(), "at", "other")


def panel(edges: DataFrame, nodes: DataFrame, order: str = "edge_id", most: int = 25) -> DataFrame:
    """(id, direction, at, other, more): the first ``most`` neighbours and how many follow; unknown ones are dropped after the cut.

    The limit is applied to each partition before rows are moved, so a hub costs no more than another node.
    """
    ends = _ends(edges, order)
    at = F.row_number().over(Window.partitionBy("k").orderBy("o", "other"))
    first = ends.withColumn("at", at).filter(F.col("at") <= most)
    counts = ends.groupBy("k").agg(F.greatest(F.count(F.lit(1)) - most, F.lit(0)).alias("more"))
    known = nodes.select(F.col("id").alias("other")).distinct()
    listed = first.join(counts, "k").join(known, "other", "left_semi")
    return listed.select(*_direction(), F.col("at").cast("long").alias("at"), "other", "more")


def bounding_centre(nodes: DataFrame) -> DataFrame:
    """(cx, cy): the middle of the bounding box."""
    mid = lambda c: ((F.min(c) + F.max(c)) / 2)
    return nodes.agg(mid("x").alias("cx"), mid("y").alias("cy"))


def degree_summary(nodes: DataFrame) -> DataFrame:
    """(least, most, nodes, classified, orphans) of a graph with degrees."""
    group = F.col("main_group")
    return nodes.agg(F.min("degree").alias("least"), F.max("degree").alias("most"), F.count(F.lit(1)).alias("nodes"), F.count(group).alias("classified"), F.count_if(group.isNull()).alias("orphans"))


def latest_nodes(nodes: DataFrame) -> DataFrame:
    """One row for each id, the one loaded last."""
    row = F.struct("loaded_at", "jurabk", "title", F.col("classification.code").alias("code"), F.col("classification.main_group").alias("main_group"), "created_at", "repealed_at", "x", "y")
    best = nodes.select(key_of_id(F.col("id")).alias("id"), row.alias("r")).filter("id is not null").groupBy("id").agg(F.max("r").alias("r"))
    return best.select("id", "r.*")


def first_per_key(rows: DataFrame, key: str, order: list[str], values: list[str]) -> DataFrame:
    """(key, values): of each key the values of the first row, by partial aggregation."""
    picked = rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(F.struct(*values), F.struct(*order)).alias("r"))
    return picked.select(key, "r.*")


def numbered(rows: DataFrame, order: list[str], partitions: int | None = None) -> DataFrame:
    """``rows`` with ``pos`` from 1 in a total order, without a window over the whole table.

    Range partitions are sorted on their own; the numbers of rows before each are added.
    """
    from normloom.runtime import default_parallelism, written

    spark = rows.sparkSession
    parts = partitions or default_parallelism(spark)
    placed = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    placed = written(placed.withColumn("_m", F.monotonically_increasing_id()).withColumn("_p", F.shiftright("_m", 33)), "numbered")
    starts, total = [], 0
    for r in sorted(placed.groupBy("_p").agg(F.count(F.lit(1)).alias("n")).collect(), key=lambda r: r["_p"]):
        starts.append((r["_p"], total))
        total += r["n"]
    offsets = spark.createDataFrame(starts or [(0, 0)], "_p long, _o long")
    pos = F.col("_o") + F.col("_m").bitwiseAND((1 << 33) - 1) + 1
    return placed.join(F.broadcast(offsets), "_p").withColumn("pos", pos).drop("_m", "_p", "_o")


def systematic_sample(rows: DataFrame, order: list[str], step: int, most: int | None = None) -> DataFrame:
    """Every ``step``-th row in order, beginning with the first, and at most ``most`` of them."""
    if step < 1:
        raise ValueError("step must be 1 or more")
    hit = numbered(rows, order).filter((F.col("pos") - 1) % step == 0)
    return (hit.filter(F.col("pos") <= (most - 1) * step + 1) if most else hit).drop("pos")



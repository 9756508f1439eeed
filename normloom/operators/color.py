"""Colours and clusters of nodes.

Classified nodes take their group's colour; those whose explicit citations hit
two or more groups blend these groups by number of citations.  Orphans blend
their soft neighbours.  Defined results: unknown groups are neutral and
``other``; orphans without coloured neighbours are neutral; empty tables give
empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from normloom.functions.color import blended, hsl_to_hex
from normloom.runtime import written

# Hue, saturation, lightness and cluster of the nine main groups, and of nodes without.
PALETTE = {
    1: (224.0, 90.0, 62.0, "state-law"),
    2: (185.0, 72.0, 50.0, "admin-law"),
    3: (350.0, 80.0, 55.0, "justice"),
    4: (35.0, 88.0, 58.0, "civil-law"),
    5: (140.0, 68.0, 48.0, "commercial-law"),
    6: (70.0, 75.0, 52.0, "labor-social"),
    7: (275.0, 68.0, 60.0, "finance"),
    8: (310.0, 72.0, 58.0, "transport"),
    9: (200.0, 30.0, 55.0, "other"),
}
NEUTRAL, UNCLASSIFIED, OTHER = (200.0, 20.0, 50.0), "unclassified", "other"
#: Rounds of the ordered colouring whose results are merged into one table.
MERGED_ROUNDS = 16


def palette_table(spark: SparkSession, palette: dict | None = None) -> DataFrame:
    """(main_group, ph, ps, pl, cluster): a small dimension."""
    return spark.createDataFrame([(g, *v) for g, v in (palette or PALETTE).items()], "main_group int, ph double, ps double, pl double, cluster string")


def _neutral():
    return F.struct(*[F.lit(v).alias(n) for n, v in zip("hsl", NEUTRAL, strict=True)])


def group_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(source, main_group, n): explicit citations of each node by the target's group; unknown targets don't count."""
    groups = nodes.filter(F.col("main_group").isNotNull()).select(F.col("id").alias("target"), "main_group")
    return edges.filter(F.col("type") == "explicit").join(groups, "target").groupBy("source", "main_group").agg(F.count(F.lit(1)).alias("n"))


def classified_colors(nodes: DataFrame, edges: DataFrame, palette: dict | None = None) -> DataFrame:
    """(id, main_group, hsl, cluster, bridging) of the classified nodes."""
    dims = F.broadcast(palette_table(nodes.sparkSession, palette))  # one row for each group of the palette
    own = nodes.filter(F.col("main_group").isNotNull()).select("id", "main_group").join(dims, "main_group", "left")
    counts = group_counts(nodes, edges).join(dims.drop("cluster"), "main_group", "left")
    hue = [F.coalesce(c, F.lit(v)) for c, v in zip(("ph", "ps", "pl"), NEUTRAL, strict=True)]
    bridge = counts.groupBy("source").agg(F.count(F.lit(1)).alias("groups"), blended(*hue, F.col("n").cast("double")).alias("mix"))
    both = own.join(bridge.withColumnRenamed("source", "id"), "id", "left")
    plain = F.struct(*[h.alias(n) for h, n in zip(hue, "hsl", strict=True)])
    bridging = F.coalesce(F.col("groups") >= 2, F.lit(False))
    return both.select("id", "main_group", F.when(bridging, F.col("mix")).otherwise(plain).alias("hsl"), F.coalesce("cluster", F.lit(OTHER)).alias("cluster"), bridging.alias("bridging"))


def _soft(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    orphans = nodes.filter(F.col("main_group").isNull()).select(F.col("id").alias("source"))
    return edges.filter(F.col("type") == "soft").join(orphans, "source", "left_semi").select("source", "target", "weight")


def _mix(seen: DataFrame) -> DataFrame:
    return seen.groupBy("source").agg(blended(F.col("hsl.h"), F.col("hsl.s"), F.col("hsl.l"), F.col("weight")).alias("hsl"))


def orphan_colors_frozen(nodes: DataFrame, edges: DataFrame, colored: DataFrame) -> DataFrame:
    """(id, hsl) of the orphans from their classified neighbours alone."""
    mixed = _mix(_soft(nodes, edges).join(colored.select(F.col("id").alias("target"), "hsl"), "target"))
    orphans = nodes.filter(F.col("main_group").isNull()).select("id")
    return orphans.join(mixed.withColumnRenamed("source", "id"), "id", "left").select("id", F.coalesce("hsl", _neutral()).alias("hsl"))


def orphan_colors_ordered(nodes: DataFrame, edges: DataFrame, colored: DataFrame) -> DataFrame:
    """(id, hsl) of the orphans as if coloured one after the other in order of id, each seeing the ones before.

    In every round all orphans are coloured whose earlier orphan neighbours are, the first of those waiting at
    least; so the rounds end by themselves after the longest chain of such neighbours.  Each is written down, and
    many are merged, so that neither lineage nor plan grow with the chain.
    """
    soft = written(_soft(nodes, edges), "soft")
    waiting = written(nodes.filter(F.col("main_group").isNull()).select("id").distinct(), "waiting")
    orphans = waiting
    # Only earlier orphans are waited for; later ones have no colour yet when the orphan's turn comes.
    before = written(soft.join(orphans.withColumnRenamed("id", "target"), "target", "left_semi").filter("target < source").select("source", "target").distinct(), "before")
    have = colored.select("id", "hsl")
    done, rounds = None, 0
    while not waiting.isEmpty():
        blocked = before.join(waiting.withColumnRenamed("id", "target"), "target", "left_semi").select(F.col("source").alias("id"))
        ready = waiting.join(blocked, "id", "left_anti")
        known = have if done is None else have.unionByName(done)
        mine = soft.join(ready.withColumnRenamed("id", "source"), "source", "left_semi")
        later = mine.join(orphans.withColumnRenamed("id", "target"), "target", "left_semi").filter("target >= source").select("source", "target").distinct()
        seen = mine.join(later, ["source", "target"], "left_anti").join(known.withColumnRenamed("id", "target"), "target")
        fresh = ready.join(_mix(seen).withColumnRenamed("source", "id"), "id", "left").select("id", F.coalesce("hsl", _neutral()).alias("hsl"))
        fresh = written(fresh, "colored")
        done, rounds = fresh if done is None else done.unionByName(fresh), rounds + 1
        if rounds % MERGED_ROUNDS == 0:
            done = written(done, "colored")
        waiting = written(waiting.join(fresh.select("id"), "id", "left_anti"), "waiting")
    return done if done is not None else orphans.select("id", _neutral().alias("hsl"))


def assign_colors(nodes: DataFrame, edges: DataFrame, mode: str = "frozen", palette: dict | None = None) -> DataFrame:
    """(id, color, cluster) of all nodes; ``mode`` is frozen or ordered."""
    own = classified_colors(nodes, edges, palette)
    orphan = {"frozen": orphan_colors_frozen, "ordered": orphan_colors_ordered}[mode](nodes, edges, own)
    both = own.select("id", "hsl", "cluster").unionByName(orphan.select("id", "hsl", F.lit(UNCLASSIFIED).alias("cluster")))
    return both.select("id", hsl_to_hex(F.col("hsl.h"), F.col("hsl.s"), F.col("hsl.l")).alias("color"), "cluster")


def meta_taxonomy(spark: SparkSession, scheme: str = "FNA", palette: dict | None = None) -> DataFrame:
    """(scheme, main_group, cluster, color)."""
    dims = palette_table(spark, palette)
    return dims.select(F.lit(scheme).alias("scheme"), F.col("main_group").cast("string").alias("main_group"), "cluster", hsl_to_hex(F.col("ph"), F.col("ps"), F.col("pl")).alias("color"))


def view(nodes: DataFrame, mode: str = "3d") -> DataFrame:
    """(id, vx, vy, vz): drawn places.  ``3d`` takes z or else the group's level, ``2d`` is flat, ``id`` lifts by the id's first letter."""
    lift = {
        "3d": F.when(F.col("z").isNotNull(), F.col("z") / 20).when(F.col("main_group").isNotNull(), (F.col("main_group") - 5) * 100.0).otherwise(0.0),
        "2d": F.lit(0.0),
        "id": ((F.ascii("id") % 11) - 5) * 20.0,
    }[mode]
    return nodes.select("id", (F.col("x") / 20).alias("vx"), (F.col("y") / 20).alias("vy"), lift.cast("double").alias("vz"))


#: Colour and opacity of nodes that a search doesn't hit.
DIMMED = ("#1a1d24", 0.22)


def highlight(nodes: DataFrame, hits: DataFrame | None) -> DataFrame:
    """(id, color, opacity): all as they are without a search, else those not hit dimmed."""
    if hits is None:
        return nodes.select("id", "color", F.lit(1.0).alias("opacity"))
    hit = nodes.join(hits.select("id").distinct().withColumn("_hit", F.lit(True)), "id", "left")
    return hit.select("id", F.when(F.col("_hit"), F.col("color")).otherwise(DIMMED[0]).alias("color"), F.when(F.col("_hit"), 1.0).otherwise(DIMMED[1]).alias("opacity"))

"""Checks of a finished graph, as one row for each check."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Nodes a graph should have, and the share of orphans it may have.
NODES, ORPHANS = (5_000, 8_000), 0.35
#: Columns that must be there.
NODE_FIELDS, EDGE_FIELDS = ("id", "main_group"), ("source", "target", "type", "weight")


def validate(nodes: DataFrame, edges: DataFrame, resolver: DataFrame | None = None, count: tuple[int, int] = NODES, orphans: float = ORPHANS) -> DataFrame:
    """(check, value, ok): number of nodes, share of orphans, repeated ids, dangling ends and resolver targets, missing columns."""
    spark = nodes.sparkSession
    missing = [c for c in NODE_FIELDS if c not in nodes.columns] + [c for c in EDGE_FIELDS if c not in edges.columns]
    if missing:
        return spark.createDataFrame([("schema", float(len(missing)), False)], "check string, value double, ok boolean")
    ids = nodes.select("id").distinct()
    base = nodes.agg(F.count(F.lit(1)).cast("double").alias("n"), F.count_if(F.col("main_group").isNull()).alias("o"), F.count_distinct("id").alias("d"))
    share = F.when(F.col("n") > 0, F.round(F.col("o") / F.col("n"), 6)).otherwise(0.0)
    checks = F.array(
        F.struct(F.lit("nodes").alias("check"), F.col("n").alias("value"), F.col("n").between(*count).alias("ok")),
        F.struct(F.lit("orphan_share").alias("check"), share.alias("value"), (share <= orphans).alias("ok")),
        F.struct(F.lit("repeated_ids").alias("check"), (F.col("n") - F.col("d")).alias("value"), (F.col("n") == F.col("d")).alias("ok")),
        F.struct(F.lit("schema").alias("check"), F.lit(0.0).alias("value"), F.lit(True).alias("ok")),
    )
    out = base.select(F.explode(checks).alias("c")).select("c.*")

    def dangling(name: str, targets: DataFrame) -> DataFrame:
        lost = targets.filter("id is not null").join(ids, "id", "left_anti").agg(F.count(F.lit(1)).cast("double").alias("value"))
        return lost.select(F.lit(name).alias("check"), "value", (F.col("value") == 0).alias("ok"))

    out = out.unionByName(dangling("dangling_ends", edges.select(F.explode(F.array("source", "target")).alias("id"))))
    return out.unionByName(dangling("dangling_resolver", resolver.select(F.col("node_id").alias("id")))) if resolver is not None else out

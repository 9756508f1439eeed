"""Ordered work on keys of any size.

A window over one key runs in one task.  Where a key may hold a third of all
rows, its time line is cut into slices of nearly equal size; windows run inside
the slices and what has to pass from one slice to the next is carried by a
small table with one row for each slice.  Keys with fewer rows than the
threshold are one slice, so they cost nothing extra.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from normloom.runtime import written

#: Rows of a key above which its time line is sliced.
SLICE_ROWS = 200_000


def hot_keys(df: DataFrame, key: str, rows: int = SLICE_ROWS) -> tuple[DataFrame, int]:
    """(key, n) of the keys with more rows than the threshold, as a table of any length, and the most rows of one."""
    counts = written(df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > rows), "hot")
    return counts, counts.agg(F.max("n")).first()[0] or 0


def with_slices(df: DataFrame, key: str, order: Column, rows: int = SLICE_ROWS) -> tuple[DataFrame, bool]:
    """``df`` with ``_slice`` (0 for small keys) and whether any key is sliced.

    ``order`` is a long that never decreases along the key's order; rows equal in it share a slice.
    """
    hot, most = hot_keys(df, key, rows)
    if not most:
        return df.withColumn("_slice", F.lit(0)), False
    parts = max(2, -(-most // rows) * 2)
    # Tables of hot keys are joined as their size allows; beyond a broadcast the join splits the hot keys' rows.
    cuts = (
        df.select(key, order.alias("_o")).join(hot.select(key), key, "left_semi")
        .groupBy(key).agg(F.percentile_approx("_o", [i / parts for i in range(1, parts)], 10_000).alias("_cuts"))
    )
    sliced = df.join(written(cuts, "cuts"), key, "left").withColumn("_o", order)
    below = F.size(F.filter("_cuts", lambda x: x < F.col("_o")))
    return sliced.withColumn("_slice", F.when(F.col("_cuts").isNull(), 0).otherwise(below)).drop("_cuts", "_o"), True


def neighbour(df: DataFrame, key: str, order: list[str], values: list[str], sliced: bool, name: str, forward: bool = False) -> DataFrame:
    """``df`` with ``name``: a struct of ``values`` of the row before (or after) within the key.

    ``order`` must be a total order within the key.  Null where there is no such row.
    """
    w = Window.partitionBy(key, "_slice").orderBy(*order)
    pick = F.lead if forward else F.lag
    out = df.withColumn(name, pick(F.struct(*values)).over(w))
    if not sliced:
        return out
    edge = F.min_by if forward else F.max_by
    edges = df.groupBy(key, "_slice").agg(edge(F.struct(*values), F.struct(*order)).alias("_edge"), F.max("_slice").alias("_last"))
    hot = edges.groupBy(key).agg(F.max("_last").alias("_m")).filter("_m > 0").select(key)
    along = Window.partitionBy(key).orderBy(F.col("_slice").desc() if forward else F.col("_slice"))
    edges = edges.join(hot, key, "left_semi").select(key, "_slice", F.lag("_edge").over(along).alias("_carried"))
    return (
        out.join(edges, [key, "_slice"], "left")
        .withColumn(name, F.coalesce(name, "_carried")).drop("_carried")
    )


def running_sums(df: DataFrame, key: str, order: list[str], sums: dict[str, Column], sliced: bool) -> DataFrame:
    """``df`` with running sums from the key's first row up to and including each row."""
    w = Window.partitionBy(key, "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = df.withColumns({name: F.sum(c).over(w) for name, c in sums.items()})
    if not sliced:
        return out
    totals = df.groupBy(key, "_slice").agg(*[F.sum(c).alias(f"_t_{name}") for name, c in sums.items()])
    hot = totals.groupBy(key).agg(F.max("_slice").alias("_m")).filter("_m > 0").select(key)
    before = Window.partitionBy(key).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.join(hot, key, "left_semi").select(key, "_slice", *[F.sum(f"_t_{n}").over(before).alias(f"_t_{n}") for n in sums])
    out = out.join(totals, [key, "_slice"], "left")
    return out.withColumns({n: F.col(n) + F.coalesce(F.col(f"_t_{n}"), F.lit(0)) for n in sums}).drop(*[f"_t_{n}" for n in sums])

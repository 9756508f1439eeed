"""Force-directed places of nodes, for graphs of any size.

Attraction is a sum over edges.  Repulsion is aggregated on a grid: nodes of a
cell push as one body at the cell's centre, and the nodes' own and adjacent
cells likewise at their centres of mass.  The grid has at most CELLS cells, so
the table of bodies that is broadcast has a fixed bound, whatever the graph.
Small graphs run in one NumPy kernel.  Defined results: every node gets a
finite place; the same seed and graph give the same places; edges to unknown
nodes and from a node to itself don't pull.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from normloom.operators.graph import known_only, undirected
from normloom.runtime import written

#: Cells along each side of the grid; nodes up to which one kernel lays out the graph.
SIDE, SMALL = 24, 20_000
#: Half the width of the square of first places; strength of repulsion and of the pull to the centre.
START, SCALING, GRAVITY = 10.0, 8.0, 0.3


def start_places(nodes: DataFrame, seed: int = 42) -> DataFrame:
    """(id, x, y): places that depend on id and seed alone."""
    at = lambda salt: (F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), "id"), F.lit(1 << 30)) / float(1 << 30) * 2 - 1) * START
    return nodes.select("id").filter("id is not null").distinct().select("id", at(1).alias("x"), at(2).alias("y"))


def _bodies(x: np.ndarray, y: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Mass and centre of mass of the cells of a grid over all places."""
    span = max(np.ptp(x), np.ptp(y), 1e-9)
    cell = np.minimum(((x - x.min()) / span * SIDE).astype(int), SIDE - 1) * SIDE + np.minimum(((y - y.min()) / span * SIDE).astype(int), SIDE - 1)
    mass = np.bincount(cell, m, SIDE * SIDE)
    used = mass > 0
    return np.stack([mass[used], (np.bincount(cell, m * x, SIDE * SIDE)[used]) / mass[used], (np.bincount(cell, m * y, SIDE * SIDE)[used]) / mass[used]], 1)


def repulsion(x: np.ndarray, y: np.ndarray, m: np.ndarray, bodies: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Push of all bodies on each node, and the pull to the centre."""
    fx, fy = np.zeros(len(x)), np.zeros(len(x))
    for a in range(0, len(x), 4096):
        dx, dy = x[a : a + 4096, None] - bodies[:, 1], y[a : a + 4096, None] - bodies[:, 2]
        push = SCALING * m[a : a + 4096, None] * bodies[:, 0] / (dx * dx + dy * dy + 1e-2)
        fx[a : a + 4096], fy[a : a + 4096] = (push * dx).sum(1), (push * dy).sum(1)
    r = np.sqrt(x * x + y * y) + 1e-9
    return fx - GRAVITY * m * x / r, fy - GRAVITY * m * y / r


def _step(fx: np.ndarray, fy: np.ndarray, m: np.ndarray, heat: float) -> tuple[np.ndarray, np.ndarray]:
    """Moves along the force, at most ``heat`` far."""
    ax, ay = fx / m, fy / m
    far = np.sqrt(ax * ax + ay * ay) + 1e-12
    scale = np.minimum(far, heat) / far
    return ax * scale, ay * scale


def _heats(iterations: int) -> np.ndarray:
    return START * np.geomspace(1, 1e-2, max(iterations, 1))[:iterations]


def kernel(ids: list, x: np.ndarray, y: np.ndarray, a: np.ndarray, b: np.ndarray, w: np.ndarray, iterations: int) -> tuple[np.ndarray, np.ndarray]:
    """Layout of a small graph; a, b are positions in ids."""
    m = 1.0 + np.bincount(np.concatenate([a, b]), minlength=len(ids))
    for heat in _heats(iterations):
        fx, fy = repulsion(x, y, m, _bodies(x, y, m))
        dx, dy = x[b] - x[a], y[b] - y[a]
        # Pull grows with distance and is shared out over the edges of a hub.
        for end, sx, sy in ((a, dx, dy), (b, -dx, -dy)):
            fx += np.bincount(end, w * sx, len(ids))
            fy += np.bincount(end, w * sy, len(ids))
        mx, my = _step(fx, fy, m, heat)
        x, y = x + mx, y + my
    return x, y


def run_layout(nodes: DataFrame, edges: DataFrame, iterations: int = 50, seed: int = 42, small: int = SMALL) -> DataFrame:
    """(id, x, y) of every node."""
    places = start_places(nodes, seed)
    pulls = undirected(known_only(edges, nodes)).filter("a != b")
    n = places.count()
    if n <= small and pulls.count() <= 20 * small:
        return _in_one(places, pulls, iterations)
    pulls = written(pulls, "pulls")
    mass = pulls.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("d"))
    at = written(places.join(mass, "id", "left").select("id", "x", "y", (F.coalesce("d", F.lit(0)) + 1.0).alias("m")), "places")
    for heat in _heats(iterations):
        at = written(_round(at, pulls, float(heat)), "places")
    return at.select("id", "x", "y")


def _in_one(places: DataFrame, pulls: DataFrame, iterations: int) -> DataFrame:
    kind = dict(places.dtypes)["id"]
    rows = places.select(F.lit(1).alias("g"), "id", "x", "y")
    ties = pulls.select(F.lit(1).alias("g"), "a", "b", "weight")

    def lay(p: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("id").reset_index(drop=True)
        e = e.sort_values(["a", "b"])
        at = pd.Series(np.arange(len(p)), index=p["id"])
        a, b = at.reindex(e["a"]).to_numpy(int), at.reindex(e["b"]).to_numpy(int)
        x, y = kernel(p["id"].tolist(), p["x"].to_numpy(float), p["y"].to_numpy(float), a, b, e["weight"].to_numpy(float), iterations)
        return pd.DataFrame({"id": p["id"], "x": x, "y": y})

    return rows.groupBy("g").cogroup(ties.groupBy("g")).applyInPandas(lay, f"id {kind}, x double, y double")


def _round(at: DataFrame, pulls: DataFrame, heat: float) -> DataFrame:
    kind = dict(at.dtypes)["id"]
    box = at.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    span = max(box[1] - box[0], box[3] - box[2], 1e-9)
    cell = lambda c, low: F.least(F.floor((F.col(c) - low) / span * SIDE), F.lit(SIDE - 1))
    cells = at.groupBy(cell("x", box[0]), cell("y", box[2])).agg(F.sum("m"), F.sum(F.col("m") * F.col("x")) / F.sum("m"), F.sum(F.col("m") * F.col("y")) / F.sum("m"))
    bodies = at.sparkSession.sparkContext.broadcast(np.array(sorted(tuple(r)[2:] for r in cells.collect()), float))  # SIDE * SIDE rows at most
    xy = at.select("id", "x", "y")
    ends = pulls.join(xy.toDF("a", "ax", "ay"), "a").join(xy.toDF("b", "bx", "by"), "b")
    pull = ends.select(F.explode(F.array(*[F.struct(F.col(i).alias("id"), (F.col("weight") * s * (F.col("bx") - F.col("ax"))).alias("px"), (F.col("weight") * s * (F.col("by") - F.col("ay"))).alias("py")) for i, s in (("a", 1), ("b", -1))])).alias("e"))
    pull = pull.select("e.*").groupBy("id").agg(F.sum("px").alias("px"), F.sum("py").alias("py"))
    forced = at.join(pull, "id", "left").select("id", "x", "y", "m", F.coalesce("px", F.lit(0.0)).alias("px"), F.coalesce("py", F.lit(0.0)).alias("py"))

    def move(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            x, y, m = (p[c].to_numpy(float) for c in "xym")
            fx, fy = repulsion(x, y, m, bodies.value)
            mx, my = _step(fx + p["px"].to_numpy(float), fy + p["py"].to_numpy(float), m, heat)
            yield pd.DataFrame({"id": p["id"], "x": x + mx, "y": y + my, "m": m})

    return forced.mapInPandas(move, f"id {kind}, x double, y double, m double")


def merge_layout(nodes: DataFrame, places: DataFrame) -> DataFrame:
    """``nodes`` with x, y (0 where missing) and z (null unless the layout has it)."""
    z = F.col("z") if "z" in places.columns else F.lit(None)
    rows = places.select("id", F.col("x").alias("_x"), F.col("y").alias("_y"), z.cast("double").alias("_z"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return nodes.drop("x", "y", "z").join(rows, "id", "left").withColumns({"x": zero("_x"), "y": zero("_y"), "z": F.col("_z")}).drop("_x", "_y", "_z")


def attach_z(places: DataFrame, scores: DataFrame) -> DataFrame:
    """``places`` with z from (id, z), 0 where missing; more scores than places is an error."""
    if scores.count() > places.count():
        raise ValueError("there are more scores than nodes")
    return places.join(scores.select("id", F.col("z").alias("_z")), "id", "left").withColumn("z", F.coalesce("_z", F.lit(0.0))).drop("_z")

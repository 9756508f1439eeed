import colorsys
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from normloom.functions.color import hsl_to_hex
from normloom.operators import color, graph, layout, search, validate, vectors

EDGES = "edge_id long, source string, target string, type string, weight double"


def _edges(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], EDGES)


def test_degree_and_size(spark):
    e = _edges(spark, [("a", "b", "explicit", 1.0), ("a", "a", "explicit", 1.0), ("a", "zz", "soft", 0.1), (None, "b", "explicit", 1.0)])
    n = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    assert {r["id"]: (r["degree"], r["size"]) for r in graph.with_degree(n, e).collect()} == {"a": (4, 4.5), "b": (1, 3.2), "c": (0, 2.0)}
    sizes = spark.range(0, 2000).orderBy("id").select(graph.size_of(F.col("id"))).collect()
    assert [r[0] for r in sizes] == [round(2 + math.sqrt(d) * 1.25, 1) for d in range(2000)]


def test_edges_forms(spark):
    e = _edges(spark, [("a", "b", "explicit", 1.0), ("b", "a", "soft", 0.1), ("a", "b", "soft", None), ("a", "a", "explicit", 0.0)])
    assert {(r["a"], r["b"]): round(r["weight"], 6) for r in graph.undirected(e).collect()} == {("a", "b"): 2.1, ("a", "a"): 1.0}
    assert graph.directed_once(e).count() == 3
    n = spark.createDataFrame([("a",)], "id string")
    assert [r["edge_id"] for r in graph.known_only(e, n).collect()] == [3]


def test_adjacency_of_a_hub(spark, monkeypatch):
    from normloom.operators import slices

    rows = [("hub", f"n{i:03}", "explicit", 1.0) for i in range(90)] + [("x", "hub", "explicit", 1.0)]
    e = _edges(spark, rows)
    line = graph.adjacency(e)
    assert [r["other"] for r in line.filter("id = 'hub' and direction = 'out'").orderBy("at").collect()] == [f"n{i:03}" for i in range(90)]
    k = e.select(F.col("source").alias("k"), "edge_id")
    sliced, hot = slices.with_slices(k, "k", F.col("edge_id"), 10)
    assert hot and sliced.select("_slice").distinct().count() > 5
    sums = slices.running_sums(sliced, "k", ["edge_id"], {"at": F.lit(1)}, hot)
    assert [r["at"] for r in sums.filter("k = 'hub'").orderBy("edge_id").collect()] == list(range(1, 91))
    n = spark.createDataFrame([(f"n{i:03}",) for i in range(1, 90)], "id string")
    panel = graph.panel(e, n).filter("id = 'hub' and direction = 'out'")
    assert panel.count() == 24 and {r["more"] for r in panel.collect()} == {65}


def test_sample(spark):
    rows = spark.range(0, 103).select((102 - F.col("id")).alias("v"))
    assert sorted(r["v"] for r in graph.systematic_sample(rows, ["v"], 10, 5).collect()) == [0, 10, 20, 30, 40]
    assert graph.systematic_sample(rows.limit(0), ["v"], 10).count() == 0


def test_hex(spark):
    rng = random.Random(1)
    values = [(rng.uniform(0, 360), rng.uniform(0, 100), rng.uniform(0, 100)) for _ in range(500)] + [(0.0, 100.0, 50.0), (0.0, 0.0, 100.0), (0.0, 0.0, 0.0)]
    df = spark.createDataFrame([(i, *v) for i, v in enumerate(values)], "i int, h double, s double, l double").orderBy("i")
    got = [r[0] for r in df.select(hsl_to_hex(F.col("h"), F.col("s"), F.col("l"))).collect()]
    want = ["#" + "".join(f"{round(c * 255):02x}" for c in colorsys.hls_to_rgb(h / 360, l / 100, s / 100)) for h, s, l in values]  # noqa: E741
    assert got == want


def _blend(parts):
    total = sum(w for _, w in parts)
    if not parts or total == 0:
        return color.NEUTRAL
    y, x = (sum(w * f(math.radians(h)) for (h, _, _), w in parts) for f in (math.sin, math.cos))
    return (math.degrees(math.atan2(y, x)) % 360, *(sum(w * c[i] for c, w in parts) / total for i in (1, 2)))


def _sequential(nodes, edges):
    group, hsl = dict(nodes), {}
    for n, g in nodes:
        if g is None:
            continue
        counts = {}
        for s, t, kind, _ in edges:
            if s == n and kind == "explicit" and group.get(t) is not None:
                counts[group[t]] = counts.get(group[t], 0) + 1
        pal = lambda g: color.PALETTE.get(g, (*color.NEUTRAL, ""))[:3]
        hsl[n] = _blend([(pal(k), v) for k, v in counts.items()]) if len(counts) >= 2 else pal(g)
    for n, g in sorted(nodes):
        if g is None:
            hsl[n] = _blend([(hsl[t], w) for s, t, kind, w in edges if s == n and kind == "soft" and t in hsl])
    return {n: "#" + "".join(f"{round(c * 255):02x}" for c in colorsys.hls_to_rgb(h / 360, l / 100, s / 100)) for n, (h, s, l) in hsl.items()}  # noqa: E741


def test_ordered_colors(spark):
    rng = random.Random(4)
    nodes = [(f"n{i:02}", rng.choice([None, None, 1, 2, 5, 9, 42])) for i in range(60)] + [("o1", None), ("o2", None), ("o3", None), ("o4", None)]
    names = [n for n, _ in nodes]
    edges = [(rng.choice(names), rng.choice(names), rng.choice(["explicit", "soft"]), rng.choice([0.1, 1.0])) for _ in range(260)]
    edges += [("o2", "o1", "soft", 0.1), ("o3", "o2", "soft", 0.1), ("o1", "o3", "soft", 0.1)]
    n = spark.createDataFrame(nodes, "id string, main_group int")
    got = {r["id"]: r["color"] for r in color.assign_colors(n, _edges(spark, edges), "ordered").collect()}
    assert got == _sequential(nodes, edges)
    n = n.union(spark.createDataFrame([("zz", None)], "id string, main_group int"))
    frozen = {r["id"]: (r["color"], r["cluster"]) for r in color.assign_colors(n, _edges(spark, edges), "frozen").collect()}
    neutral = "#" + "".join(f"{round(c * 255):02x}" for c in colorsys.hls_to_rgb(200 / 360, 0.5, 0.2))
    assert len(frozen) == len(nodes) + 1 and frozen["zz"] == (neutral, "unclassified")
    assert color.assign_colors(n.limit(0), _edges(spark, edges), "ordered").count() == 0


def test_highlight_and_views(spark):
    n = spark.createDataFrame([("a", "#111111", 10.0, 20.0, None, 7), ("b", "#222222", 0.0, 0.0, 5.0, None)], "id string, color string, x double, y double, z double, main_group int")
    assert {r["id"]: (r["color"], r["opacity"]) for r in color.highlight(n, n.filter("id = 'a'")).collect()} == {"a": ("#111111", 1.0), "b": (color.DIMMED[0], color.DIMMED[1])}
    assert {r["id"]: r["vz"] for r in color.view(n).collect()} == {"a": 200.0, "b": 0.25}
    assert {r["id"]: r["vz"] for r in color.view(n, "2d").collect()} == {"a": 0.0, "b": 0.0}


def test_nearest_is_exact(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(120, 8)).round(1)
    x[5] = x[6] = x[7]
    rows = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(999, None)], "id long, v array<double>")
    got = vectors.nearest(rows.filter("id < 40"), rows, 4, block_rows=17).collect()
    s = np.round(x @ x.T, 12)
    want = set()
    for i in range(40):
        order = sorted((j for j in range(120) if j != i), key=lambda j: (-s[i, j], j))[:4]
        want |= {(i, j) for j in order}
    assert {(r["source"], r["target"]) for r in got} == want
    assert vectors.nearest(rows.limit(1), rows.limit(1), 3).count() == 0 and vectors.nearest(rows, rows, 0).count() == 0
    assert vectors.soft_edges(rows.filter("id < 3"), rows, 200).count() == 3 * 119


def test_pca(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(50, 5)) * [5, 1, 1, 1, 1]
    rows = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, v array<double>")
    z = np.array([r["z"] for r in vectors.pca_z(rows).orderBy("id").collect()])
    c = x - x.mean(0)
    u, s, vt = np.linalg.svd(c, full_matrices=False)
    want = u[:, 0] * s[0] * np.sign(vt[0][np.abs(vt[0]).argmax()])
    assert np.allclose(z, want / want.std(), atol=1e-8)
    flat = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(4)], "id long, v array<double>")
    assert all(abs(r["z"]) < 1e-9 for r in vectors.pca_z(flat).collect())


@pytest.mark.parametrize("small", [1000, 0])
def test_layout(spark, small):
    rng = random.Random(5)
    edges = [(f"n{a}", f"n{b}", "explicit", 1.0) for g in range(2) for _ in range(60) for a, b in [(g * 20 + rng.randrange(20), g * 20 + rng.randrange(20))]] + [("n0", "lost", "explicit", 1.0)]
    n = spark.createDataFrame([(f"n{i}",) for i in range(41)], "id string")
    steps = 25 if small else 4
    run = lambda: {r["id"]: (r["x"], r["y"]) for r in layout.run_layout(n, _edges(spark, edges), steps, small=small).collect()}
    a = run()
    assert len(a) == 41 and all(map(math.isfinite, sum(a.values(), ())))
    if small:
        assert a == run()
        far = lambda p, q: math.dist(a[p], a[q])
        tied = np.mean([far(s, t) for s, t, *_ in edges[:-1] if s != t])
        assert tied < np.mean([far(f"n{i}", f"n{j}") for i in range(40) for j in range(i)])
    assert layout.run_layout(n.limit(0), _edges(spark, edges), 2, small=small).count() == 0


def test_layout_is_the_same_on_many_executors(spark):
    """The rounds over the cluster move every node as the kernel in one task does."""
    rng = random.Random(6)
    edges = [(f"n{rng.randrange(60)}", f"n{rng.randrange(60)}", "explicit", rng.choice([1.0, 0.1])) for _ in range(150)]
    n = spark.createDataFrame([(f"n{i}",) for i in range(61)], "id string")
    whole, parts = ({r["id"]: (r["x"], r["y"]) for r in layout.run_layout(n, _edges(spark, edges), 4, small=small).collect()} for small in (1_000, 0))
    assert whole.keys() == parts.keys() and all(math.dist(whole[k], parts[k]) < 1e-6 for k in whole)


def test_long_chain_of_orphans(spark):
    """A chain longer than the rounds that are merged: every orphan sees the one before."""
    nodes = [("a", 1)] + [(f"o{i:02}", None) for i in range(color.MERGED_ROUNDS + 3)]
    edges = [("o00", "a", "soft", 1.0)] + [(f"o{i:02}", f"o{i - 1:02}", "soft", 1.0) for i in range(1, color.MERGED_ROUNDS + 3)]
    got = {r["id"]: r["color"] for r in color.assign_colors(spark.createDataFrame(nodes, "id string, main_group int"), _edges(spark, edges), "ordered").collect()}
    assert got == _sequential(nodes, edges) and len(set(got.values())) == 1


def test_scratch_is_removed(spark):
    from pathlib import Path

    from normloom import runtime

    with runtime.scratch(spark):
        made = runtime.written(spark.range(3), "made")
        assert made.count() == 3
        at = Path(made.inputFiles()[0].removeprefix("file://")).parent
        assert at.exists()
    kept = runtime.written(spark.range(3), "kept")
    assert not at.exists() and kept.count() == 3


def test_merge_layout(spark):
    n = spark.createDataFrame([("a", 9.0), ("b", 9.0)], "id string, x double")
    p = spark.createDataFrame([("a", 1.0, 2.0)], "id string, x double, y double")
    assert {r["id"]: (r["x"], r["y"], r["z"]) for r in layout.merge_layout(n, p).collect()} == {"a": (1.0, 2.0, None), "b": (0.0, 0.0, None)}
    z = spark.createDataFrame([("a", 3.0)], "id string, z double")
    assert layout.attach_z(p, z).first()["z"] == 3.0
    with pytest.raises(ValueError):
        layout.attach_z(p, spark.createDataFrame([("a", 1.0), ("b", 1.0)], "id string, z double"))


def test_search_and_time(spark):
    n = spark.createDataFrame([("1", "BGB", "Bürgerliches Gesetz", "2000-01-01", None), ("2", None, "100% (x)", "1990-01-01", "1995-01-01"), ("3", "X", None, "kaputt", None)], "id string, jurabk string, title string, created_at string, repealed_at string")
    ids = lambda df: sorted(r["id"] for r in df.collect())
    assert ids(search.search(n, " bgb ")) == ["1"] and ids(search.search(n, "% (")) == ["2"] and ids(search.search(n, " ")) == []
    assert ids(search.visible_at(n, "1994-12-31")) == ["2"] and ids(search.visible_at(n, "2001-01-01")) == ["1"]


def test_validation(spark):
    n = spark.createDataFrame([("a", 1), ("b", None), ("b", None)], "id string, main_group int")
    e = _edges(spark, [("a", "x", "explicit", 1.0)])
    got = {r["check"]: (r["value"], r["ok"]) for r in validate.validate(n, e, spark.createDataFrame([("k", "a")], "span_key string, node_id string"), (1, 5)).collect()}
    assert got == {"nodes": (3.0, True), "orphan_share": (0.666667, False), "repeated_ids": (1.0, False), "schema": (0.0, True), "dangling_ends": (1.0, False), "dangling_resolver": (0.0, True)}
    assert not validate.validate(n.drop("main_group"), e).first()["ok"]

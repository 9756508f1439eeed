import tracemalloc

import numpy as np
import pyarrow.parquet as pq
import pytest

from normloom.llm import neighbours as N

SHAPE = "vec_id long, embedding array<float>, cid long, leaf int, v string"


def rows_of(x, ids=None):
    return [(int(i), [float(v) for v in r], 1, 2, "x") for i, r in zip(range(len(x)) if ids is None else ids, x, strict=True)]


def model(rows, k, width):
    known = {i: v for i, v, *_ in rows if i is not None and v is not None and len(v) == width and all(a is not None and np.isfinite(a) for a in v) and any(v)}
    ids = np.array(sorted(known))
    x = np.array([known[i] for i in ids], np.float32).astype(float).reshape(-1, width)
    x /= np.sqrt((x * x).sum(1))[:, None]
    s = np.round(x @ x.T, 6)
    out = {}
    for a in range(len(ids)):
        out[int(ids[a])] = sorted((int(i) for i in ids if i != ids[a]), key=lambda i: (-s[a, np.searchsorted(ids, i)], i))[:k]
    return out


def test_queue_order_equals_keys():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(900, 6)).astype(np.float32)
    tree = N.fit(x, 9)
    assert len(tree.leaves) > 30 and tree.levels.max() > 1
    order = np.array([list(tree.best_bin_first(q)) for q in x[:40]])
    keys = tree.leaf_keys(x[:40])
    assert (np.sort(order, 1) == np.arange(len(tree.leaves))).all() and (np.diff(np.take_along_axis(keys, order, 1), axis=1) >= -1e-6).all()
    for visits in (1, 3, 12, len(tree.leaves), 10_000):
        leaf, far = tree.walk(x[:40], visits)
        assert leaf.shape[1] >= min(visits, len(tree.leaves))
        for i in range(40):
            got = leaf[i][leaf[i] >= 0]
            assert len(got) == min(visits, len(tree.leaves)) == len(set(got))
            # Ties aside these are the leaves the queue gives first.
            assert np.allclose(np.sort(keys[i][got]), np.sort(keys[i][order[i][: len(got)]]), atol=1e-6) and np.allclose(np.sort(far[i][leaf[i] >= 0]), np.sort(keys[i][got]), atol=1e-6)
    assert (np.take_along_axis(keys, tree.assign(x[:40])[:, None], 1)[:, 0] <= keys.min(1) + 1e-6).all()


def test_single_leaf():
    tree = N.fit(np.ones((5, 3), np.float32), 2)
    assert list(tree.best_bin_first(np.zeros(3, np.float32))) == [0] and tree.walk(np.zeros((2, 3), np.float32), 4)[0].tolist() == [[0], [0]]
    assert N.fit(np.zeros((0, 3), np.float32), 2).assign(np.ones((2, 3), np.float32)).tolist() == [0, 0]


@pytest.mark.parametrize("options", [{"leaf": 8}, {"leaf": 128}, {"leaf": 16, "most_leaves": 3}, {"leaf": 16, "most_rows": 64, "sample": 100}])
def test_recall(spark, options):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(700, 8)).astype(np.float32)
    x[100:130] = x[100]
    x[200] = x[201] * 3
    rows = rows_of(x)
    got = {}
    for r in N.neighbours(spark.createDataFrame(rows + rows[:9], SHAPE), k=5, width=8, **options).collect():
        got.setdefault(r["id"], {})[r["rank"]] = r["neighbour"]
    want = model(rows, 5, 8)
    assert set(got) == set(want) and all(sorted(v) == [1, 2, 3, 4, 5] for v in got.values())
    hits = sum(len(set(v.values()) & set(want[i])) for i, v in got.items())
    assert hits >= 0.95 * 5 * len(want)


def test_hot_class_and_unusable(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([np.tile(rng.normal(size=4), (40, 1)), rng.normal(size=(80, 4))]).astype(np.float32)
    rows = rows_of(x)
    bad = [(900, None, 1, 2, "x"), (901, [1.0, 2.0], 1, 2, "x"), (902, [0.0] * 4, 1, 2, "x"), (903, [1.0, None, 1.0, 1.0], 1, 2, "x"), (904, [float("nan")] * 4, 1, 2, "x"), (None, [1.0] * 4, 1, 2, "x")]
    got = {}
    for r in N.neighbours(spark.createDataFrame(rows + bad, SHAPE), k=3, width=4, target=1.0).collect():
        got.setdefault(r["id"], []).append((r["rank"], r["neighbour"]))
    assert {i: [n for _, n in sorted(v)] for i, v in got.items()} == model(rows, 3, 4)


def test_few_vectors(spark):
    rows = rows_of(np.eye(3, 64))
    assert {tuple(r) for r in N.found(spark.createDataFrame(rows, SHAPE)).collect()} == {(0, 1), (0, 2), (1, 2)}
    assert N.found(spark.createDataFrame([], SHAPE)).count() == 0
    assert N.found(spark.createDataFrame(rows[:1], SHAPE)).count() == 0


def test_prunes(spark):
    """On data with structure few pairs are compared, and fewer of them as the table grows."""
    rng, shares = np.random.default_rng(4), []
    for n in (1_000, 8_000):
        x = (rng.normal(size=(n // 20, 16)).repeat(20, 0) + 0.2 * rng.normal(size=(n, 16))).astype(np.float32)
        seen = {}
        rows = N.neighbours(spark.createDataFrame(rows_of(x), SHAPE), k=5, width=16, leaf=32, measured=seen).collect()
        unit = x / np.linalg.norm(x, axis=1)[:, None]
        sim = unit @ unit.T
        np.fill_diagonal(sim, -2)
        kth = -np.partition(-sim, 4, axis=1)[:, 4]
        hits = sum(sim[r["id"], r["neighbour"]] >= kth[r["id"]] - 1e-5 for r in rows)
        assert len(rows) == 5 * n and hits >= 0.98 * 5 * n and seen["vectors"] == n
        shares.append(seen["share"])
    assert shares[1] < 0.5 * shares[0] and shares[1] < 0.1


def peak_of(f):
    tracemalloc.start()
    try:
        out = f()
        return out, tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_memory_of_large_trees():
    """Assigning and walking hold no table of all queries and nodes: with 16,384 leaves those took hundreds of MB."""
    rng = np.random.default_rng(5)
    inner = rng.normal(size=(128, 16)).astype(np.float32)
    leaves = (inner[:, None] + rng.normal(size=(128, 128, 16))).reshape(-1, 16)
    parents = np.concatenate([[0], np.zeros(128, np.int64), 1 + np.repeat(np.arange(128), 128)])
    tree = N.Tree(np.concatenate([np.zeros((1, 16)), inner, leaves]), parents, np.repeat([0, 1, 2], [1, 128, 128 * 128]))
    x = rng.normal(size=(2_000, 16)).astype(np.float32)
    got, peak = peak_of(lambda: tree.assign(x))
    assert peak < 60
    keys = tree.leaf_keys(x[:200])
    assert (np.take_along_axis(keys, got[:200, None], 1)[:, 0] <= keys.min(1) + 1e-6).all()


def test_memory_of_many_hits():
    """Of vectors that are all but equal only k for a query are kept, by similarity and id."""
    rng = np.random.default_rng(6)
    raw = (np.ones((4_000, 8)) + 1e-5 * rng.normal(size=(4_000, 8))).astype(np.float32)
    cids = rng.permutation(4_000)
    tree = N.fit(np.zeros((0, 8), np.float32), 2)
    block = N.Block(N.Block.packed(cids, raw, np.zeros(4_000, np.int64), tree, 4_000), 8)
    every = np.arange(4_000)
    (row, col, sim, pairs), peak = peak_of(lambda: block.search(block.units, np.full(4_000, -2.0), np.full(4_000, np.inf), [(0, every)], 5))
    assert peak < 150 and pairs == 16_000_000 and (np.bincount(row) == 5).all()
    # All similarities round to 1, so the least ids are first.
    assert (sim == 1).all() and (block.cids[col].reshape(-1, 5) == np.arange(5)).all()


def test_sample_is_moved_as_bytes(spark):
    x = np.random.default_rng(7).normal(size=(300, 8)).astype(np.float32)
    reps = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "cid long, v array<float>")
    got = N._sampled(reps, 1, 1_000, 300, 8)
    assert got.dtype == np.float32 and sorted(map(tuple, got)) == sorted(map(tuple, x))
    assert N._sampled(reps.limit(0), 1, 1_000, 0, 8).shape == (0, 8)


def test_row_groups_of_wide_tables(spark, monkeypatch):
    """Rows of some megabytes are never decoded by the thousand: executors ran out of heap on the table of what blocks ask."""
    tables, written = {}, N.written
    monkeypatch.setattr(N, "written", lambda df, name, *rest: tables.setdefault(name, written(df, name, *rest)))
    x = np.random.default_rng(8).normal(size=(600, 8)).astype(np.float32)
    assert N.neighbours(spark.createDataFrame(rows_of(x), SHAPE), k=5, width=8, leaf=8, most_rows=32).count() == 3_000
    sizes = {name: [m.row_group(i).num_rows for f in tables[name].inputFiles() for m in [pq.ParquetFile(f.removeprefix("file://")).metadata] for i in range(m.num_row_groups)] for name in ("asked", "blocks")}
    assert sum(sizes["asked"]) > 100 and max(max(n) for n in sizes.values()) <= N.GROUP == 8

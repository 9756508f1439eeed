import datetime as dt
import random

import pytest

from normloom.operators import orphans as O

EDGES = "edge_id long, source string, target string, type string, seen_at timestamp_ntz, id string, key string"
NODES = "id string, loaded_at timestamp_ntz, removed_at timestamp_ntz, at int, source string"
T0 = dt.datetime(2024, 1, 1)


def model(edges, nodes):
    by = {}
    for i, a, b, *_ in nodes:
        if i and i.strip():
            by.setdefault(i.strip().lower(), []).append((a, b))
    out = set()
    for e, s, t, _, at, *_ in edges:
        for f, x in (("source", s), ("target", t)):
            if x is None or not x.strip():
                continue
            rows = by.get(x.strip().lower())
            if not rows:
                out.add((e, f, "missing"))
            elif at is None or any(a is not None and a <= at and (b is None or b > at) for a, b in rows):
                continue
            else:
                out.add((e, f, "deleted" if any(a is not None and a <= at for a, _ in rows) else "late"))
    return out


def data(seed, n=500):
    rng = random.Random(seed)
    when = lambda: T0 + dt.timedelta(hours=rng.randrange(100))
    nodes = [(rng.choice(["a/{}", " A/{}", "\xa0a/{} "]).format(rng.randrange(30)), rng.choice([when(), when(), when(), None]), rng.choice([None, when()]), 1, "x") for _ in range(80)]
    nodes += [("A/hot", when(), when(), 1, "x") for _ in range(40)] + [(None, T0, None, 1, "x"), (" ", T0, None, 1, "x")]
    name = lambda: rng.choice([f"a/{rng.randrange(40)}", f"A/{rng.randrange(40)} ", "a/hot", "a/hot", None, " "])
    edges = [(i, name(), name(), "t", rng.choice([when()] * 20 + [None]), "i", "k") for i in range(n)]
    return edges + edges[:30], nodes + nodes[:5]


@pytest.mark.parametrize("options", [{}, {"slice_rows": 20}, {"most_bits": 64}, {"most_bits": 128, "tested_rows": 20}])
def test_orphans(spark, options):
    edges, nodes = data(1)
    got = O.edge_orphans(spark.createDataFrame(edges, EDGES), spark.createDataFrame(nodes, NODES), **options)
    rows = [(r["ref"], r["field"], r["reason"]) for r in got.collect()]
    assert set(rows) == model(edges, nodes) and len(rows) == len(set(rows))


def test_report_counts_all(spark):
    edges, nodes = data(2)
    e, n = spark.createDataFrame(edges, EDGES), spark.createDataFrame(nodes, NODES)
    assert sum(r["orphans"] for r in O.report(e, n).collect()) == O.found(e, n).count() == len(model(edges, nodes))


def test_empty_tables(spark):
    edges, nodes = data(3, 20)
    e, n = spark.createDataFrame(edges, EDGES), spark.createDataFrame(nodes, NODES)
    assert O.found(spark.createDataFrame([], EDGES), n).count() == 0
    assert {r["reason"] for r in O.found(e, spark.createDataFrame([], NODES)).collect()} == {"missing"}


@pytest.mark.parametrize("most", [1 << 27, 512])
def test_filters_deny_as_many_in_parts(spark, most):
    """However many keys there are, a filter of its part lets few strangers pass and no key fail."""
    keys = spark.range(3_000).selectExpr("concat('k', id) as key")
    asked = spark.range(6_000).selectExpr("id", "concat('k', id) as key")
    rows = O.with_may(asked, keys, "key", most_bits=most).collect()
    assert len(rows) == 6_000 and all(r["may"] for r in rows if r["id"] < 3_000)
    assert sum(r["may"] for r in rows if r["id"] >= 3_000) < 150

import datetime as dt
import random

import pytest

from normloom.operators import history as H

SHAPE = "update_id long, node_id string, jurabk string, title string, created_at string, repealed_at string, op string, observed_at timestamp_ntz, ingested_at timestamp_ntz, x int"
T0 = dt.datetime(2024, 1, 1)


def model(rows):
    best = {}
    for u, n, _, _, c, r, op, o, i, _ in rows:
        if n is None or o is None or op not in ("U", "D"):
            continue
        k = (i is not None, i or T0, u is not None, u or 0, op, c is not None, c or "", r is not None, r or "")
        if (n, o) not in best or best[n, o][0] < k:
            best[n, o] = (k, op, c, r)
    out = set()
    for n in {k[0] for k in best}:
        start = state = None
        for o in sorted(k[1] for k in best if k[0] == n):
            _, op, c, r = best[n, o]
            new = (c, r)
            if op == "D":
                if start:
                    out.add((n, str(start.date()), str(o.date())))
                start = None
            elif start is None or new != state:
                if start:
                    out.add((n, str(start.date()), str(o.date())))
                start, state = o, new
        if start:
            out.add((n, str(start.date()), "9999-12-31"))
    return out


def rows_of(seed, n=400, nodes=9, hot=0.4):
    rng, out = random.Random(seed), []
    for u in range(n):
        node = "hot" if rng.random() < hot else f"n{rng.randrange(nodes)}"
        o = T0 + dt.timedelta(hours=rng.randrange(2000))
        out.append((u, rng.choice([node] * 30 + [None]), None, None, rng.choice(["2001-01-01", "2002-02-02", None]), rng.choice([None, "2003-03-03"]), rng.choice("UUUUUUUDX"), rng.choice([o] * 30 + [None]), o + dt.timedelta(hours=rng.randrange(300)), 1))
    return out + out[:20]


@pytest.mark.parametrize("slice_rows", [10, 200_000])
def test_whole_history(spark, slice_rows):
    rows = rows_of(1)
    got = H.build_chains(spark.createDataFrame(rows, SHAPE), slice_rows)
    day = lambda d: str(d.date()) if d else "9999-12-31"
    assert {(r["node_id"], day(r["from_ts"]), day(r["to_ts"])) for r in got.collect()} == model(rows)


def test_found_with_late_batch(spark):
    rows = rows_of(2)
    got = [tuple(r) for r in H.found(spark.createDataFrame(rows, SHAPE)).collect()]
    assert set(got) == model(rows) and len(got) == len(set(got))


def _days(chains):
    day = lambda d: str(d.date()) if d else "9999-12-31"
    return {(r["node_id"], day(r["from_ts"]), day(r["to_ts"])) for r in chains.collect()}


@pytest.mark.parametrize(("bucket_rows", "after"), [(30, 2), (500_000, 8)])
def test_store_rebuilds_only_touched(spark, tmp_path, bucket_rows, after):
    rows = rows_of(3)
    store = H.HistoryStore(spark, f"file://{tmp_path}/store", bucket_rows, after)
    with pytest.raises(FileNotFoundError):
        store.chains()
    store.load(spark.createDataFrame([], SHAPE))
    assert store.chains().count() == 0
    for a in range(0, len(rows), 110):
        store.load(spark.createDataFrame(rows[a : a + 110], SHAPE), 20)
        assert _days(store.chains()) == model(rows[: a + 110])
    store.load(spark.createDataFrame([], SHAPE))
    assert store.chains().count() == H.build_chains(store.raw()).count()


def test_store_reads_and_replaces_entities(spark, tmp_path, monkeypatch):
    """A late change reads its entity's rows alone and replaces its chains alone; a reader of before sees all as it was."""
    rows = [(i, f"n{i % 50}", None, None, f"2001-01-{i % 28 + 1:02}", None, "U", T0 + dt.timedelta(days=i), T0, 1) for i in range(400)]
    store = H.HistoryStore(spark, f"file://{tmp_path}/store", 20)
    store.load(spark.createDataFrame(rows, SHAPE))
    old, before = store.chains(), _days(store.chains())
    late = [(900, "n7", None, None, "1999-09-09", None, "U", T0 + dt.timedelta(days=9), T0, 1)]
    seen = []
    build = H.build_chains
    monkeypatch.setattr(H, "build_chains", lambda raw, slice_rows=1: seen.append({r[0] for r in raw.select("node_id").distinct().collect()}) or build(raw, slice_rows))
    store.load(spark.createDataFrame(late, SHAPE))
    assert seen == [{"n7"}] and _days(store.chains()) == model(rows + late) and _days(old) == before == model(rows)
    assert {r[0] for r in spark.read.parquet(f"{tmp_path}/store/chains-2").select("node_id").collect()} == {"n7"}


def test_one_writer(spark, tmp_path):
    store = H.HistoryStore(spark, f"file://{tmp_path}/store")
    rows = spark.createDataFrame(rows_of(4, 30), SHAPE)
    store.load(rows)
    with store._locked(), pytest.raises(RuntimeError, match="lock"):
        store.load(rows)
    # A load that another one overtook publishes nothing.
    state = store._state()
    store.load(rows)
    with pytest.raises(RuntimeError, match="another writer"):
        store._publish(state, {**state, "generation": 9})


def test_empty_and_null_times(spark):
    assert H.found(spark.createDataFrame([], SHAPE)).count() == 0
    row = (1, "a", None, None, None, None, "U", T0, None, 1)
    assert [tuple(r) for r in H.found(spark.createDataFrame([row], SHAPE)).collect()] == [("a", "2024-01-01", "9999-12-31")]


def test_free_dates(spark):
    from pyspark.sql import functions as F

    values = ["2001-02-03", " 2001-02-03T04:05:06Z", "2001-02-03 04:05", "\xa03.2.2001 ", "03.02.2001", "31.02.2001", "2001-02-30", "9999-12-31", "n/a", "", None, "2001-2-3", "2001-02-03 x"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").orderBy("i")
    got = [r[0] for r in df.select(H.free_date(F.col("v"))).collect()]
    assert got == [dt.date(2001, 2, 3)] * 5 + [None] * 8

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from normloom.operators import snapshots as S

SHAPE = "snapshot_no int, dok_nr string, enbez string, text_xml string, loaded_at timestamp_ntz, key int, at int, bucket int"
T0 = dt.datetime(2024, 1, 1)


def test_canonical():
    assert S.canonical("a &amp; b&#252;&#xFC;&#38;") == "a&büü&"
    assert S.canonical("&amp;#252; &unknown; &#0; &#x110000;") == "&#252;&unknown;&#0;&#x110000;"
    assert S.canonical("ü\xa0  x\n") == "\xfcx"


def test_native_text_equals_canonical(spark):
    values = ["a b", "a\xa0b\t\r\nc", "\x0b\x0c", "ü", "&#252;", "中文 x", "a…b", "", None, "\U0001f600 x", "가", "x\x85y", "Å"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").orderBy("i")
    got = [r[0] for r in df.select(S.canonical_text(F.col("v"))).collect()]
    assert got == [S.canonical(v) if v else "" for v in values]


def test_hash_equals_builtin(spark):
    rng = np.random.default_rng(1)
    a, b = rng.integers(-(2**63), 2**63 - 1, (2, 200))
    df = spark.createDataFrame([(i, int(x), int(y)) for i, (x, y) in enumerate(zip(a, b, strict=True))], "i int, a long, b long").orderBy("i")
    got = [r[0] for r in df.select(F.xxhash64("a", "b", F.lit(3).cast("long"))).collect()]
    assert got == S.xxhash64_longs([a, b, np.full(200, 3)]).tolist()


def model(rows):
    best = {}
    for s, k, e, t, at, *_ in rows:
        if s is None or k is None:
            continue
        v = (S.canonical(e or ""), S.canonical(t or ""))
        order = (at is not None, at or T0)
        if (s, k) not in best or best[s, k][0] < order:
            best[s, k] = (order, v)
    numbers = sorted({s for s, _ in best})
    out = set()
    for a, b in zip(numbers, numbers[1:], strict=False):
        old, new = ({k: v[1] for (s, k), v in best.items() if s == n} for n in (a, b))
        for k in old.keys() | new.keys():
            if k not in old:
                out.add((b, k, "added"))
            elif k not in new:
                out.add((b, k, "removed"))
            elif old[k] != new[k]:
                out.add((b, k, "changed"))
    return out


def rows_of(seed, keys=300):
    rng, out, n = random.Random(seed), [], 0
    for s in (1, 2, 4):
        for k in range(keys):
            if rng.random() < 0.1:
                continue
            for _ in range(rng.choice([1, 1, 1, 2])):
                n += 1
                out.append((s, f"k{k}", rng.choice(["§ 1", "§  1", None, ""]) if k % 2 else "§ 2", rng.choice(["a b", "a&#32;b", "ab", "other" if rng.random() < 0.2 else "a  b"]), T0 + dt.timedelta(seconds=n), 1, 2, 3))
    # One key holds a third of all rows; some rows are repeated; some have no key.
    out += [(2, "k0", "§ 9", f"v{i}", T0 - dt.timedelta(days=i + 1), 1, 2, 3) for i in range(len(out) // 2)]
    return out + out[:50] + [(2, None, "x", "x", T0, 1, 2, 3), (None, "k1", "x", "x", T0, 1, 2, 3), (4, "k7", "x", "late null", None, 1, 2, 3)]


@pytest.mark.parametrize(("bucket_keys", "cells"), [(2048, 256), (40, 9), (10_000, 3)])
def test_changes(spark, bucket_keys, cells):
    rows = rows_of(1)
    got = [tuple(r) for r in S.changes(spark.createDataFrame(rows, SHAPE), "dok_nr", ["enbez", "text_xml"], bucket_keys=bucket_keys, first_cells=cells).collect()]
    assert set(got) == model(rows) and len(got) == len(set(got))


def test_everything_differs(spark):
    rows = [(s, f"k{i}", None, f"{s}", T0, 1, 2, 3) for s in (1, 2) for i in range(500)]
    assert {tuple(r) for r in S.found(spark.createDataFrame(rows, SHAPE)).collect()} == {(2, f"k{i}", "changed") for i in range(500)}


def test_empty_and_single(spark):
    assert S.found(spark.createDataFrame([], SHAPE)).count() == 0
    assert S.found(spark.createDataFrame([(1, "a", None, None, T0, 1, 2, 3)], SHAPE)).count() == 0
    assert S.found(spark.createDataFrame([(1, "a", None, "", T0, 1, 2, 3), (2, "a", "", None, T0, 1, 2, 3)], SHAPE)).count() == 0
    long = [(1, "a", None, "x " * 200_000, T0, 1, 2, 3), (2, "a", None, "x " * 200_000 + "y", T0, 1, 2, 3)]
    assert [tuple(r) for r in S.found(spark.createDataFrame(long, SHAPE)).collect()] == [(2, "a", "changed")]


def test_digests_find_what_peeling_missed(spark):
    """A bucket whose recovered pairs lack one, or have one too many, doesn't reproduce its digest."""
    from pyspark.sql import DataFrame

    shape = "pair int, bucket long, key_hash long, value_hash long, sign long"
    true = [(1, 0, 5, 6, 1), (1, 0, 5, 7, -1), (1, 1, 8, 9, 1), (1, 2, 1, 1, -1)]
    digests: DataFrame = spark.createDataFrame(true, shape).groupBy("pair", "bucket").agg(*S._digest())
    assert S._unproven(digests, spark.createDataFrame(true, shape)).isEmpty()
    wrong = [true[0], (1, 1, 8, 9, 1), (1, 2, 1, 2, -1)]
    assert {tuple(r) for r in S._unproven(digests, spark.createDataFrame(wrong, shape)).collect()} == {(1, 0), (1, 2)}

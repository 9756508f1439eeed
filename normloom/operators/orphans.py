"""References to records that don't exist, by a Bloom filter and an exact check.

Problem 6.  A Bloom filter over the parent keys is broadcast; a reference it
denies has no parent for certain and is reported without any join.  More keys
than a filter of MOST_BITS holds are split by their hash, with a filter for
each part, and references meet the filter of their part.  Only the
references it lets pass are compared exactly with the parents' periods, in one
ordered sweep over both for each key, whose hot keys are cut into time slices.

Defined results: null and blank ends are no references; a null time of the
reference is reported only if the key is missing altogether; a parent without
load time was never present and counts as late; repeated rows count once; no
parents at all makes every reference missing; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from normloom.functions.text import strip_white
from normloom.operators.slices import SLICE_ROWS, running_sums, with_slices
from normloom.runtime import written

#: Bits of a filter for each parent key, and its size at most (16 MiB to each executor); references that one task tests.
BITS_A_KEY, MOST_BITS, TESTED_ROWS = 12, 1 << 27, 4_000_000
PROBES = 5


def key_of(c: Column) -> Column:
    """Ids are compared without outer white space and in lower case; blank ids are null."""
    k = F.lower(strip_white(c))
    return F.when(k != "", k)


def _places(h: np.ndarray, bits: int) -> list[np.ndarray]:
    a, b = h & 0xFFFFFFFF, ((h >> 32) & 0xFFFFFFFF) | 1
    return [(a + i * b) % bits for i in range(PROBES)]


def _set(filled: np.ndarray, h: np.ndarray, bits: int) -> None:
    for p in _places(h, bits):
        np.bitwise_or.at(filled, p >> 6, np.uint64(1) << (p & 63).astype(np.uint64))


def _hit(full: np.ndarray, h: np.ndarray, bits: int) -> np.ndarray:
    hit = np.ones(len(h), bool)
    for p in _places(h, bits):
        hit &= (full[p >> 6] >> (p & 63).astype(np.uint64)) & np.uint64(1) == 1
    return hit


def bloom_filters(keys: DataFrame, column: str, bits_a_key: int = BITS_A_KEY, most_bits: int = MOST_BITS) -> tuple[DataFrame, int, int]:
    """(part, words): the filters of all parts as rows, how many there are, and the bits of each."""
    n = keys.count()
    parts = max(1, -(-n * bits_a_key // most_bits))
    bits = max(64, -(-n * bits_a_key // parts // 64) * 64)
    hashed = keys.select(F.xxhash64(column).alias("h"), _part(column, parts).alias("part"))

    def words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # Words are kept for one part after the other, as a task may see all of them.
        for batch in batches:
            for part, rows in batch.groupby("part"):
                filled = np.zeros(bits // 64, np.uint64)
                _set(filled, rows["h"].to_numpy(np.int64), bits)
                used = np.flatnonzero(filled)
                yield pd.DataFrame({"part": part, "word": used, "bits": filled[used].view(np.int64)})

    def whole(rows: pd.DataFrame) -> pd.DataFrame:
        full = np.zeros(bits // 64, np.uint64)
        full[rows["word"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64).view(np.uint64)
        return pd.DataFrame({"part": rows["part"].iloc[:1], "words": [full.tobytes()]})

    merged = hashed.mapInPandas(words, "part long, word long, bits long").groupBy("part", "word").agg(F.bit_or("bits").alias("bits"))
    return merged.groupBy("part").applyInPandas(whole, "part long, words binary"), parts, bits


def _part(column: str, parts: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(11), column), F.lit(parts)).cast("long")


def with_may(references: DataFrame, keys: DataFrame, column: str, tested_rows: int = TESTED_ROWS, **size: int) -> DataFrame:
    """``references`` with ``may``: False where the key is certainly not in ``keys``."""
    filters, parts, bits = bloom_filters(keys, column, **size)
    if parts == 1:
        rows = filters.collect()
        shared = keys.sparkSession.sparkContext.broadcast(np.frombuffer(rows[0]["words"], np.uint64) if rows else np.zeros(bits // 64, np.uint64))

        @F.pandas_udf("boolean")
        def test(h: pd.Series) -> pd.Series:
            return pd.Series(_hit(shared.value, h.to_numpy(np.int64), bits))

        return references.withColumn("may", test(F.xxhash64(column)))
    # Each filter goes to as many tasks as its references need, in front of them.
    salts = max(1, -(-references.count() // (parts * tested_rows)))
    fields, names = [f"{n} {t}" for n, t in references.dtypes], [*references.columns, "may"]
    first = F.lit(0).alias("_order")
    blank = [F.lit(None).cast(t).alias(n) for n, t in references.dtypes]
    shown = filters.select(F.col("part").alias("_part"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).alias("_salt"), first, F.col("words").alias("_words"), *blank, F.lit(0).cast("long").alias("_h"))
    asked = references.select(_part(column, parts).alias("_part"), F.pmod(F.monotonically_increasing_id(), F.lit(salts)).alias("_salt"), F.lit(1).alias("_order"), F.lit(None).cast("binary").alias("_words"), *references.columns, F.xxhash64(column).alias("_h"))
    line = shown.unionByName(asked).repartition(parts * salts, "_part", "_salt").sortWithinPartitions("_part", "_salt", "_order")

    def test_in_order(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        full, of = np.zeros(0, np.uint64), None
        for batch in batches:
            batch["may"] = False
            for (part, salt), rows in batch.groupby(["_part", "_salt"], sort=False):
                head = rows["_words"].notna()
                if head.any():
                    full, of = np.frombuffer(rows.loc[head, "_words"].iloc[0], np.uint64), (part, salt)
                # A part without keys has no filter: nothing of it exists.
                if (part, salt) == of:
                    batch.loc[rows.index, "may"] = _hit(full, rows["_h"].to_numpy(np.int64), bits)
            yield batch.loc[batch["_order"] == 1, names]

    return line.mapInPandas(test_in_order, ", ".join([*fields, "may boolean"]))


def orphans(references: DataFrame, parents: DataFrame, slice_rows: int = SLICE_ROWS, **size: int) -> DataFrame:
    """(ref, field, key, at, reason) of the references without a parent present at their time.

    ``references``: ref, field, key, at.  ``parents``: key, loaded_at, removed_at.  Keys are compared as they are.
    """
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    refs = references.filter(F.col("key").isNotNull()).select("ref", "field", "key", micros("at").alias("at"))
    rows = parents.filter(F.col("key").isNotNull()).select("key", micros("loaded_at").alias("on"), micros("removed_at").alias("off"))
    names = rows.select("key").distinct()
    tested = written(with_may(refs, names, "key", **size), "tested")
    denied = tested.filter(~F.col("may")).select("ref", "field", "key", "at", F.lit("missing").alias("reason"))

    # One line of events for each key: loads and removals up to a reference's time come before it.
    loads = rows.filter(F.col("on").isNotNull())
    kept = loads.filter(F.col("off").isNull() | (F.col("off") > F.col("on")))
    none = [F.lit(None).cast(t).alias(n) for n, t in (("ref", dict(refs.dtypes)["ref"]), ("field", "string"))]
    event = lambda df, at, load, here: df.select("key", F.col(at).alias("at"), F.lit(0).alias("probe"), F.lit(load).cast("long").alias("load"), F.lit(here).cast("long").alias("here"), *none)
    probes = tested.filter(F.col("may") & F.col("at").isNotNull()).select("key", "at", F.lit(1).alias("probe"), F.lit(0).cast("long").alias("load"), F.lit(0).cast("long").alias("here"), "ref", "field")
    line = event(loads, "on", 1, 0).unionByName(event(kept, "on", 0, 1)).unionByName(event(kept.filter(F.col("off").isNotNull()), "off", 0, -1)).unionByName(probes)
    line, sliced = with_slices(written(line, "events"), "key", F.col("at"), slice_rows)
    swept = running_sums(line, "key", ["at", "probe"], {"loads": F.col("load"), "present": F.col("here")}, sliced)
    absent = swept.filter((F.col("probe") == 1) & (F.col("present") <= 0))
    deleted = absent.filter("loads > 0").select("ref", "field", "key", "at", F.lit("deleted").alias("reason"))
    # No load so far: late if the key has a row at all, else the filter erred and the key is missing.
    unknown = absent.filter("loads = 0").select("ref", "field", "key", "at").unionByName(tested.filter(F.col("may") & F.col("at").isNull()).select("ref", "field", "key", "at"))
    unknown = unknown.join(names.withColumn("there", F.lit(True)), "key", "left")
    unknown = unknown.filter(F.col("there").isNull() | F.col("at").isNotNull())
    unknown = unknown.select("ref", "field", "key", "at", F.when(F.col("there"), "late").otherwise("missing").alias("reason"))
    out = denied.unionByName(deleted).unionByName(unknown)
    return out.withColumn("at", F.timestamp_micros("at")).distinct()


def edge_references(edges: DataFrame) -> DataFrame:
    """Both ends of every edge as references; repeated rows count once."""
    ends = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), key_of(F.col(f)).alias("key")) for f in ("source", "target")]))
    return edges.select(F.col("edge_id").alias("ref"), F.col("seen_at").alias("at"), ends.alias("e")).select("ref", "e.field", "e.key", "at")


def edge_orphans(edges: DataFrame, nodes: DataFrame, **options: int) -> DataFrame:
    return orphans(edge_references(edges), nodes.select(key_of(F.col("id")).alias("key"), "loaded_at", "removed_at"), **options)


def found(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """p6_found: (edge_id, field, reason)."""
    return edge_orphans(edges, nodes).select(F.col("ref").alias("edge_id"), "field", "reason").distinct()


def report(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Orphan references per table, field, reason and month: (child, field, month, reason, orphans)."""
    month = F.date_format(F.col("at"), "yyyy-MM").alias("month")
    return edge_orphans(edges, nodes).groupBy(F.lit("graph_edges").alias("child"), "field", month, "reason").agg(F.count(F.lit(1)).alias("orphans"))

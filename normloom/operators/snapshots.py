"""What changed between consecutive full snapshots of a table.

Problem 2.  Of each snapshot every key is reduced to a hash pair (key, value).
The pairs go into invertible Bloom lookup tables, one for each hash bucket of
keys and snapshot.  Subtracting the tables of two consecutive snapshots leaves
the differing pairs alone, however large the snapshots are; peeling recovers
them.  Besides, every bucket of every snapshot has a digest of its pairs, made
apart from the tables and with a hash of its own: the pairs that come out must
reproduce the difference of the two digests and of the numbers of keys, else
the bucket counts as failed.  Failed buckets are built again with twice as many
cells, from their own keys, which are set aside once.  A key on both sides is changed, on the later side added, on the earlier side removed.

Defined results: rows with a null key or snapshot number are left out; a null
load time is the earliest; of equal load times the greater value hash counts;
null equals empty; a snapshot is compared with the one before that has rows;
an empty table gives no changes; other columns are ignored.
"""

from __future__ import annotations

import html
import re
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from normloom.runtime import written

#: Keys of a snapshot that share a bucket, and cells of a bucket's table at first.
BUCKET_KEYS, FIRST_CELLS = 2_048, 256
#: Buckets that one call of the peeling function handles together.
BUCKETS_A_GROUP = 64
HASHES = 3
#: Cells beyond which a bucket can't fail any more: twice its pairs fit with room.
MOST_ROUNDS = 24

_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def xxhash64_longs(columns: list[np.ndarray], seed: int = 42) -> np.ndarray:
    """XXH64 of 64-bit integers, chained over the columns, as the built-in ``xxhash64`` gives it."""
    with np.errstate(over="ignore"):
        h = np.full(len(columns[0]), seed, np.uint64)
        turn = lambda x, r: (x << np.uint64(r)) | (x >> np.uint64(64 - r))
        for c in columns:
            h = h + _P5 + np.uint64(8)
            h ^= turn(c.astype(np.int64).view(np.uint64) * _P2, 31) * _P1
            h = turn(h, 27) * _P1 + _P4
            h ^= h >> np.uint64(33)
            h *= _P2
            h ^= h >> np.uint64(29)
            h *= _P3
            h ^= h >> np.uint64(32)
    return h.view(np.int64)


#: Characters that may change under NFC, references, and rare white space: such texts take the exact way.
_RARE = r"[&\x1c-\x1f\x85\x{300}-\x{200f}\x{2028}-\x{202f}\x{205f}-\x{20a9}\x{20ad}-\x{10ffff}]"
_REFERENCE = re.compile(r"&(?:#(\d{1,7})|#[xX]([0-9a-fA-F]{1,6})|(amp|lt|gt|quot|apos));")


def _resolved(m: re.Match) -> str:
    if m[3]:
        return html.unescape(m[0])
    code = int(m[1]) if m[1] else int(m[2], 16)
    return chr(code) if 0 < code < 0x110000 and not 0xD800 <= code < 0xE000 else m[0]


def canonical(text: str) -> str:
    """Character references resolved once, NFC, without white space."""
    return "".join(unicodedata.normalize("NFC", _REFERENCE.sub(_resolved, text)).split())


@F.pandas_udf(StringType())
def _canonical(texts: pd.Series) -> pd.Series:
    return texts.map(canonical, na_action="ignore")


def canonical_text(c: Column) -> Column:
    """``canonical`` inside the JVM where the text allows; null becomes empty."""
    rare = F.coalesce(c.rlike(_RARE), F.lit(False))
    plain = c
    for white in (" ", "\xa0", "\n", "\r", "\t", "\x0b", "\x0c"):
        plain = F.replace(plain, F.lit(white), F.lit(""))
    exact = _canonical(F.when(rare, c))
    return F.coalesce(F.when(rare, exact).otherwise(plain), F.lit(""))


def current_rows(snapshots: DataFrame, key: str, values: list[str], number: str = "snapshot_no", at: str = "loaded_at") -> DataFrame:
    """Of each snapshot and key the row that counts: snapshot, key, key_hash, value_hash."""
    rows = snapshots.filter(F.col(number).isNotNull() & F.col(key).isNotNull())
    value = F.xxhash64(*[canonical_text(F.col(v)) for v in values])
    rows = rows.select(F.col(number).alias("snapshot"), F.col(key).alias("key"), F.unix_micros(F.col(at).cast("timestamp")).alias("at"), value.alias("value"))
    best = rows.groupBy("snapshot", "key").agg(F.max(F.struct("at", "value")).alias("best"))
    return best.select("snapshot", "key", F.xxhash64("key").alias("key_hash"), F.col("best.value").alias("value_hash"))


def _cells(signed: DataFrame, cells: int, salt: int) -> DataFrame:
    """The subtracted tables: one row for each cell that isn't zero."""
    check = F.xxhash64("key_hash", "value_hash", F.lit(salt).cast("long"))
    part = cells // HASHES
    # Three cells, one in each third of the table, from disjoint bits of the check hash.
    places = F.array(*[(F.pmod(F.shiftrightunsigned("check", 21 * i), F.lit(part)) + part * i).cast("int") for i in range(HASHES)])
    spread = signed.withColumn("check", check).withColumn("cell", F.explode(places))
    return (
        spread.groupBy("pair", "bucket", "cell")
        .agg(F.sum("sign").alias("n"), F.bit_xor("key_hash").alias("k"), F.bit_xor("value_hash").alias("v"), F.bit_xor("check").alias("c"))
        .filter("n != 0 or k != 0 or v != 0 or c != 0")
    )


def peel(table: pd.DataFrame, cells: int, salt: int) -> pd.DataFrame:
    """Peel the tables of several buckets at once: recovered pairs, and a row without key for each failed bucket.

    ``table`` has the columns pair, bucket, cell, n, k, v, c.
    """
    owner, first = np.unique(table[["pair", "bucket"]].to_numpy(np.int64), axis=0, return_inverse=True)
    first = first.reshape(-1)
    n, k, v, c = (np.zeros(len(owner) * cells, np.int64) for _ in range(4))
    at = first * cells + table["cell"].to_numpy(np.int64)
    for full, name in ((n, "n"), (k, "k"), (v, "v"), (c, "c")):
        full[at] = table[name].to_numpy(np.int64)
    part, out = cells // HASHES, []
    todo = np.unique(at)
    while len(todo):
        todo = todo[np.abs(n[todo]) == 1]
        todo = todo[xxhash64_longs([k[todo], v[todo], np.full(len(todo), salt)]) == c[todo]]
        group = todo // cells
        # A pair can be alone in several of its cells; it is taken once.
        _, once = np.unique(np.stack([group, c[todo]]), axis=1, return_index=True)
        todo, group = todo[once], group[once]
        got = (group, k[todo], v[todo], n[todo], c[todo])
        out.append(got[:4])
        touched = []
        for i in range(HASHES):
            cell = group * cells + ((got[4].view(np.uint64) >> np.uint64(21 * i)).view(np.int64) % part) + part * i
            np.subtract.at(n, cell, got[3])
            for full, x in ((k, got[1]), (v, got[2]), (c, got[4])):
                np.bitwise_xor.at(full, cell, x)
            touched.append(cell)
        todo = np.unique(np.concatenate(touched)) if len(todo) else todo
    left = np.zeros(len(owner), bool)
    left[np.flatnonzero((n != 0) | (k != 0) | (v != 0) | (c != 0)) // cells] = True
    group, key, value, sign = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 4
    good = ~left[group]
    failed = np.flatnonzero(left)
    columns = {"pair": owner[group[good], 0], "bucket": owner[group[good], 1], "key_hash": key[good], "value_hash": value[good], "sign": sign[good]}
    lost = {"pair": owner[failed, 0], "bucket": owner[failed, 1], "key_hash": np.zeros(len(failed), np.int64), "value_hash": np.zeros(len(failed), np.int64), "sign": np.zeros(len(failed), np.int64)}
    return pd.concat([pd.DataFrame(columns), pd.DataFrame(lost)], ignore_index=True)


def _recover(signed: DataFrame, cells: int, salt: int) -> DataFrame:
    """Rows of ``peel`` for all buckets of ``signed``; sign 0 marks a failed bucket."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        return peel(group, cells, salt)

    table = _cells(signed, cells, salt).withColumn("part", F.expr(f"bucket div {BUCKETS_A_GROUP}"))
    return table.groupBy("pair", "part").applyInPandas(run, "pair int, bucket long, key_hash long, value_hash long, sign long")


#: Seed of the digests; the tables' check hashes have no column like it.
_DIGEST = 0x5EED


def _digest() -> list[Column]:
    """Number and digest of signed pairs: equal pairs of both sides cancel out."""
    return [F.sum("sign").alias("n"), F.bit_xor(F.xxhash64(F.lit(_DIGEST), "value_hash", "key_hash")).alias("d")]


def _unproven(digests: DataFrame, pairs: DataFrame) -> DataFrame:
    """(pair, bucket) of the buckets whose recovered pairs don't reproduce their digest."""
    got = pairs.groupBy("pair", "bucket").agg(*_digest()).withColumnsRenamed({"n": "got_n", "d": "got_d"})
    zero = F.lit(0).cast("long")
    same = (F.col("n") == F.coalesce("got_n", zero)) & (F.col("d") == F.coalesce("got_d", zero))
    return digests.join(got, ["pair", "bucket"], "left").filter(~same).select("pair", "bucket")


def changes(snapshots: DataFrame, key: str, values: list[str], number: str = "snapshot_no", at: str = "loaded_at", bucket_keys: int = BUCKET_KEYS, first_cells: int = FIRST_CELLS) -> DataFrame:
    """(snapshot, key, change) for every key whose presence or values differ from the snapshot before."""
    current = written(current_rows(snapshots, key, values, number, at), "current")
    spark = snapshots.sparkSession
    sizes = sorted((r["snapshot"], r["n"]) for r in current.groupBy("snapshot").agg(F.count(F.lit(1)).alias("n")).collect())
    kind = dict(current.dtypes)["snapshot"]
    empty = spark.createDataFrame([], f"snapshot {kind}, key {dict(current.dtypes)['key']}, change string")
    if len(sizes) < 2:
        return empty
    buckets = max(1, -(-max(n for _, n in sizes) // bucket_keys))
    later = spark.createDataFrame([(s, i, 1) for i, (s, _) in enumerate(sizes) if i] + [(s, i + 1, -1) for i, (s, _) in enumerate(sizes[:-1])], f"snapshot {kind}, pair int, sign long")
    placed = current.select("snapshot", "key_hash", "value_hash", F.pmod("key_hash", F.lit(buckets)).alias("bucket"))
    sides = lambda df: df.join(F.broadcast(later), "snapshot").drop("snapshot")  # noqa: E731 - two rows for each snapshot
    # Digests of snapshots first, then of their differences.
    each = placed.withColumn("sign", F.lit(1).cast("long")).groupBy("snapshot", "bucket").agg(*_digest())
    digests = written(sides(each).groupBy("pair", "bucket").agg(F.sum(F.col("n") * F.col("sign")).alias("n"), F.bit_xor("d").alias("d")), "digests")
    # All of a bucket is brought together once; cells are then summed where they are.
    signed = sides(placed.repartition("bucket"))
    cells, parts = first_cells // HASHES * HASHES, []
    for salt in range(MOST_ROUNDS):
        got = written(_recover(signed, cells, salt).filter("sign != 0"), "peeled")
        failed = written(_unproven(digests, got), "failed")
        if failed.isEmpty():
            parts.append(got)
            break
        parts.append(got.join(failed, ["pair", "bucket"], "left_anti"))
        digests = digests.join(failed, ["pair", "bucket"], "left_semi")
        signed = written((sides(placed) if salt == 0 else signed).join(failed, ["pair", "bucket"], "left_semi"), "again")
        cells = cells * 2 // HASHES * HASHES
    else:
        raise RuntimeError("a bucket can't be peeled: two keys share a 64-bit hash")
    pairs = parts[0]
    for p in parts[1:]:
        pairs = pairs.unionByName(p)
    kinds = pairs.groupBy("pair", "key_hash").agg(F.max_by("value_hash", "sign").alias("value_hash"), F.max("sign").alias("sign"), F.count_distinct("sign").alias("sides"))
    change = F.when(F.col("sides") == 2, "changed").when(F.col("sign") > 0, "added").otherwise("removed")
    numbers = spark.createDataFrame([(i, sizes[i - 1][0], sizes[i][0]) for i in range(1, len(sizes))], f"pair int, earlier {kind}, later {kind}")
    where = F.when(F.col("sign") > 0, F.col("later")).otherwise(F.col("earlier"))
    named = kinds.join(F.broadcast(numbers), "pair").select("key_hash", "value_hash", where.alias("snapshot"), "later", change.alias("change"))
    # The key itself stands in the later snapshot, or in the earlier one if it was removed; both hashes name it.
    names = current.select("snapshot", "key", "key_hash", "value_hash")
    return named.join(names, ["snapshot", "key_hash", "value_hash"]).select(F.col("later").alias("snapshot"), "key", "change").distinct()


def found(snapshots: DataFrame) -> DataFrame:
    """p2_found: (snapshot_no, dok_nr, change)."""
    out = changes(snapshots, "dok_nr", ["enbez", "text_xml"])
    return out.select(F.col("snapshot").alias("snapshot_no"), F.col("key").alias("dok_nr"), "change")

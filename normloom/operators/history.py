"""History of changing attributes: versions with the period each was valid.

Problem 3.  The raw changes stay in a store; the versions ("chains") of an
entity are a function of all its raw changes.  A batch of late or corrected
changes therefore touches few entities: only theirs are read again, their
chains rebuilt and replaced in one step (affected-chain rebuild).  The chains of
a load stand beside those before; a reader takes those of an entity from the
last load that touched it.  Every COMPACT_AFTER loads chains and raw changes are
merged and the number of buckets fitted to the table.

Defined results: rows with a null entity or observation time are no
observations; an operation other than U or D is ignored; text that is no date
is null; an empty table gives an empty history; other columns are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from normloom.functions.text import strip_white
from normloom.operators.slices import SLICE_ROWS, neighbour, with_slices
from normloom.runtime import scratch_path, written

OPEN_END = "9999-12-31"
#: Raw changes of a hash bucket of entities, buckets at most; loads after which a store is merged.
BUCKET_ROWS, MOST_BUCKETS, COMPACT_AFTER = 500_000, 8_192, 8
#: Touched entities up to which their ids are handed to the files' own filters.
FILTERED_IDS = 500
#: Columns of a version.
CHAIN = "node_id string, from_ts timestamp_ntz, to_ts timestamp_ntz, created date, repealed date"
RAW = ("node_id", "created_at", "repealed_at", "op", "observed_at", "ingested_at", "update_id")


def free_date(c: Column) -> Column:
    """A date from ``yyyy-mm-dd`` (alone or before a time) or ``d.m.yyyy``; else, and for 9999-12-31, null."""
    s = strip_white(c)
    iso = F.regexp_extract(s, r"^(\d{4}-\d{2}-\d{2})(?:[T ]\d{1,2}:\d{2}(?::\d{2}(?:[.,]\d+)?)?\s*(?:Z|[+-]\d{2}:?\d{2})?)?\z", 1)
    german = F.regexp_extract(s, r"^(\d{1,2}\.\d{1,2}\.\d{4})\z", 1)
    day = F.when(iso != "", F.try_to_date(iso, "yyyy-MM-dd")).when(german != "", F.try_to_date(german, "d.M.yyyy"))
    return F.when(day != F.to_date(F.lit(OPEN_END)), day)


def observations(raw: DataFrame) -> DataFrame:
    """One row for each entity and observation time: the latest ingested, then the largest update_id."""
    known = raw.filter(F.col("node_id").isNotNull() & F.col("observed_at").isNotNull() & F.col("op").isin("U", "D"))
    # Equal in time and id, the greater values count, so that the result is defined.
    rank = F.struct("ingested_at", "update_id", "op", "created_at", "repealed_at")
    best = known.groupBy("node_id", "observed_at").agg(F.max(rank).alias("r"))
    return best.select("node_id", "observed_at", (F.col("r.op") == "D").alias("gone"), free_date(F.col("r.created_at")).alias("created"), free_date(F.col("r.repealed_at")).alias("repealed"))


def build_chains(raw: DataFrame, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """All versions of all entities in ``raw``: node_id, from_ts, to_ts (null if open), created, repealed."""
    order = F.unix_micros(F.col("observed_at").cast("timestamp"))
    # Written once: the search for hot entities and the windows both read it.
    seen, sliced = with_slices(written(observations(raw), "observations"), "node_id", order, slice_rows)
    seen = neighbour(seen, "node_id", ["observed_at"], ["gone", "created", "repealed"], sliced, "before")
    same = F.col("before.created").eqNullSafe(F.col("created")) & F.col("before.repealed").eqNullSafe(F.col("repealed"))
    starts = ~F.col("gone") & (F.col("before").isNull() | F.col("before.gone") | ~same)
    ends = F.col("gone") & F.col("before").isNotNull() & ~F.col("before.gone")
    events = seen.filter(starts | ends).drop("before")
    events = neighbour(events, "node_id", ["observed_at"], ["observed_at"], sliced, "after", forward=True)
    return events.filter(~F.col("gone")).select("node_id", F.col("observed_at").cast("timestamp_ntz").alias("from_ts"), F.col("after.observed_at").cast("timestamp_ntz").alias("to_ts"), "created", "repealed")


class HistoryStore:
    """Raw changes and chains in a folder; readers follow a pointer that is replaced in one step.

    ``raw/load=n`` holds the changes of a load in hash buckets of entities, sorted by entity within a file, so that
    a few entities' rows are found without reading the rest.  ``chains-n`` holds the chains of the entities that
    load touched, ``touched-n`` their ids.  Until the pointer names them readers see the chains before; a failed
    load leaves nothing they can see.  One writer at a time: a load holds a lock file while it runs.
    """

    def __init__(self, spark: SparkSession, path: str, bucket_rows: int = BUCKET_ROWS, compact_after: int = COMPACT_AFTER):
        self.spark, self.path, self.bucket_rows, self.compact_after = spark, path.rstrip("/"), bucket_rows, compact_after

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path
        return at(self.path).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def _state(self) -> dict:
        fs, at = self._fs()
        if not fs.exists(at(f"{self.path}/current.json")):
            return {"generation": 0, "base": None, "deltas": [], "raw": {}}
        return json.loads(self.spark.read.text(f"{self.path}/current.json").first()[0])

    def _publish(self, before: dict, state: dict) -> None:
        if self._state()["generation"] != before["generation"]:
            raise RuntimeError("the store was changed by another writer")
        fs, at = self._fs()
        staged = at(f"{self.path}/next.json")
        out = fs.create(staged, True)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        sc = self.spark.sparkContext
        overwrite = getattr(sc._jvm.org.apache.hadoop.fs, "Options$Rename")
        how = sc._gateway.new_array(overwrite, 1)
        how[0] = overwrite.OVERWRITE
        sc._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), sc._jsc.hadoopConfiguration()).rename(staged, at(f"{self.path}/current.json"), how)

    @contextmanager
    def _locked(self) -> Iterator[None]:
        fs, at = self._fs()
        lock = at(f"{self.path}/lock")
        try:
            fs.create(lock, False).close()
        except Py4JJavaError as e:
            raise RuntimeError(f"{self.path}/lock is held by another writer, or was left by one that was lost: then remove it") from e
        try:
            yield
        finally:
            fs.delete(lock, False)

    def _write_raw(self, rows: DataFrame, number: int, buckets: int) -> None:
        # Hot buckets are split over several files by the rebalance.
        placed = rows.withColumn("bucket", F.pmod(F.xxhash64("node_id"), F.lit(buckets)).cast("int")).hint("rebalance", "bucket")
        placed.sortWithinPartitions("bucket", "node_id").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/raw/load={number}")

    def _read_raw(self, loads: dict[str, int]) -> DataFrame | None:
        """The raw changes of loads (number -> buckets)."""
        out = None
        for number in loads:
            part = self.spark.read.parquet(f"{self.path}/raw/load={number}")
            out = part if out is None else out.unionByName(part)
        return out

    def _theirs(self, loads: dict[str, int], touched: DataFrame) -> DataFrame | None:
        """The raw changes of the touched entities in loads; of other buckets no file is read."""
        few = [r[0] for r in touched.limit(FILTERED_IDS + 1).collect()]
        parts = []
        for number, buckets in loads.items():
            own = touched.select(F.pmod(F.xxhash64("node_id"), F.lit(buckets)).cast("int").alias("b")).distinct()
            part = self._read_raw({number: buckets}).filter(F.col("bucket").isin([r["b"] for r in own.collect()]))  # MOST_BUCKETS numbers at most
            if len(few) <= FILTERED_IDS:
                part = part.filter(F.col("node_id").isin(few))
            parts.append(part.select(*RAW).join(touched, "node_id", "left_semi"))
        out = parts[0] if parts else None
        for part in parts[1:]:
            out = out.unionByName(part)
        return out

    def _read_chains(self, state: dict) -> DataFrame:
        """Of every entity the chains of the last load that touched it."""
        read = lambda n: self.spark.read.schema(CHAIN).parquet(f"{self.path}/chains-{n}")
        later, parts = None, []
        for n in [*reversed(state["deltas"]), state["base"]]:
            parts.append(read(n) if later is None else read(n).join(later, "node_id", "left_anti"))
            touched = self.spark.read.parquet(f"{self.path}/touched-{n}") if n != state["base"] else None
            later = touched if later is None else later if touched is None else later.unionByName(touched)
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out

    def chains(self) -> DataFrame:
        state = self._state()
        if state["base"] is None:
            if state["generation"]:
                return self.spark.createDataFrame([], CHAIN)
            raise FileNotFoundError(self.path)
        return self._read_chains(state)

    def raw(self) -> DataFrame | None:
        """All raw changes."""
        rows = self._read_raw(self._state()["raw"])
        return None if rows is None else rows.select(*RAW)

    def load(self, batch: DataFrame, slice_rows: int = SLICE_ROWS) -> None:
        """Add a batch of raw changes and replace the chains of the entities it touches."""
        with self._locked():
            state = self._state()
            n = state["generation"] + 1
            rows = batch.filter(F.col("node_id").isNotNull()).select(*RAW)
            counted = rows.count()
            if not counted:
                self._publish(state, {**state, "generation": n})
                return
            buckets = max([*state["raw"].values(), self._buckets(counted)])
            self._write_raw(rows, n, buckets)
            fresh = self._read_raw({n: buckets}).select(*RAW)
            fresh.select("node_id").distinct().write.mode("overwrite").parquet(f"{self.path}/touched-{n}")
            before = self._theirs(state["raw"], self.spark.read.parquet(f"{self.path}/touched-{n}"))
            theirs = fresh if before is None else fresh.unionByName(before)
            build_chains(theirs, slice_rows).write.mode("overwrite").parquet(f"{self.path}/chains-{n}")
            after = {"generation": n, "base": n, "deltas": []} if state["base"] is None else {"generation": n, "base": state["base"], "deltas": [*state["deltas"], n]}
            after["raw"] = {**state["raw"], str(n): buckets}
            self._publish(state, after)
            if len(after["deltas"]) >= self.compact_after:
                self._compact(after)

    def _buckets(self, rows: int) -> int:
        return int(min(MOST_BUCKETS, -(-rows // self.bucket_rows)))

    def _compact(self, state: dict) -> None:
        """Merge all loads into one and remove what no reader of the last two pointers needs."""
        n = state["generation"] + 1
        rows = self._read_raw(state["raw"]).select(*RAW)
        buckets = self._buckets(rows.count())
        self._write_raw(rows, n, buckets)
        self._read_chains(state).write.mode("overwrite").parquet(f"{self.path}/chains-{n}")
        self._publish(state, {"generation": n, "base": n, "deltas": [], "raw": {str(n): buckets}, "before": state["generation"]})
        fs, at = self._fs()
        kept = {n, state["base"], *state["deltas"]}
        for old in range(1, n):
            if old not in kept:
                for name in (f"raw/load={old}", f"chains-{old}", f"touched-{old}"):
                    if str(old) not in state["raw"] or not name.startswith("raw"):
                        fs.delete(at(f"{self.path}/{name}"), True)


def history(updates: DataFrame, late_share: float = 0.05, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """The chains of a whole feed: a first load, then the last ``late_share`` by ingestion as a late batch."""
    spark = updates.sparkSession
    store = HistoryStore(spark, scratch_path(spark, "history"))
    at = F.unix_micros(F.col("ingested_at").cast("timestamp"))
    cut = updates.agg(F.percentile_approx(at, 1 - late_share, 10_000)).first()[0]
    if cut is None:
        store.load(updates, slice_rows)
        return store.chains()
    late = F.coalesce(at > F.lit(cut), F.lit(False))
    store.load(updates.filter(~late), slice_rows)
    store.load(updates.filter(late), slice_rows)
    return store.chains()


def found(updates: DataFrame) -> DataFrame:
    """p3_found: (node_id, valid_from, valid_to) with ISO dates, each case once."""
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    return history(updates).select("node_id", day("from_ts").alias("valid_from"), F.coalesce(day("to_ts"), F.lit(OPEN_END)).alias("valid_to")).distinct()

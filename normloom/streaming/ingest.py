"""Incremental ingest: new files are read once, whatever was read before is skipped.

Structured Streaming's file source remembers what it read in its checkpoint, so
a stopped ingest goes on where it ended.  Batches of node updates go into the
history store, where only the entities they touch are rebuilt.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from normloom.operators.history import HistoryStore
from normloom.sources.laws import parse_laws


def ingest_laws(spark: SparkSession, source: str, target: str, checkpoint: str, files_a_batch: int = 1_000) -> StreamingQuery:
    """Parse XML files as they arrive and append the laws to a parquet table; runs until nothing is left."""
    shape = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(shape).option("pathGlobFilter", "*.xml").option("maxFilesPerTrigger", files_a_batch).load(source)
    laws = parse_laws(files.select(F.regexp_extract("path", r"([^/]+)\.xml$", 1).alias("slug"), "content"))
    return laws.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest_updates(spark: SparkSession, source: str, schema: str, store: HistoryStore, checkpoint: str, files_a_batch: int = 100) -> StreamingQuery:
    """Load parquet files of node updates into a history store as they arrive.

    A batch that is repeated after a failure changes nothing: equal changes count once.
    """

    def load(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            store.load(batch)

    updates = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(source)
    return updates.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def not_yet(candidates: DataFrame, done: DataFrame, key: str = "slug") -> DataFrame:
    """What hasn't been read yet: an anti-join on the key."""
    return candidates.join(done.select(key).distinct(), key, "left_anti")

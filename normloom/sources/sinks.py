"""Where results go: parquet for tables, JSON for the front end, text for summaries."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "overwrite") -> None:
    """A parquet table."""
    writer = df.write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_json_lines(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One JSON object a line, written by all executors; null fields are left out."""
    df.write.mode(mode).json(path)


def write_json_array(df: DataFrame, path: str, keep_null: tuple[str, ...] = ()) -> int:
    """One local file with an array of rows, for the front end; rows are fetched one partition at a time.

    Null fields are left out unless named in ``keep_null``.  Returns the number of rows.
    """
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    n = 0
    with open(path, "w", encoding="utf-8") as out:
        out.write("[")
        for row in df.toLocalIterator(prefetchPartitions=True):
            fields = {k: v for k, v in row.asDict(recursive=True).items() if v is not None or k in keep_null}
            out.write(("," if n else "") + "\n" + json.dumps(fields, ensure_ascii=False, default=str))
            n += 1
        out.write("\n]\n")
    return n


def write_json_map(df: DataFrame, key: str, value: str, path: str) -> int:
    """One local file with an object from key to value, in order of key."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    n = 0
    with open(path, "w", encoding="utf-8") as out:
        out.write("{")
        for row in df.select(key, value).orderBy(key).toLocalIterator():
            shown = row[1].asDict(recursive=True) if hasattr(row[1], "asDict") else row[1]
            out.write(("," if n else "") + "\n" + json.dumps(str(row[0]), ensure_ascii=False) + ": " + json.dumps(shown, ensure_ascii=False))
            n += 1
        out.write("\n}\n")
    return n


def write_pages(df: DataFrame, slug: str, html: str, path: str) -> None:
    """A page for each law, in a folder of its slug."""
    df.select(F.col(slug).alias("slug"), F.col(html).alias("value")).write.mode("overwrite").partitionBy("slug").text(path)


def summary(stats: DataFrame) -> str:
    """The lines of a one-row table of figures as text."""
    row = stats.first()
    return "" if row is None else "\n".join(f"{k}: {v}" for k, v in row.asDict().items())

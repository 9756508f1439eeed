"""Session helpers: tables of a data directory and shared scratch tables.

Lineage is cut by writing a parquet table into the shared folder the cluster
names in ``spark.checkpoint.dir``.  Every executor can read such a table, so a
lost executor costs a retry and no data.  Only where the setting is absent (a
local test session) a temporary folder of this machine is used.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_RUN = uuid.uuid4().hex[:12]
_LOCAL: dict[str, tempfile.TemporaryDirectory] = {}


def ship(spark: SparkSession) -> None:
    """Make this package importable in the Python workers of any cluster."""
    sc = spark.sparkContext
    if getattr(sc, "_normloom", False):
        return
    folder = tempfile.mkdtemp(prefix="normloom-zip-")
    atexit.register(shutil.rmtree, folder, True)
    package = Path(__file__).parent
    with zipfile.ZipFile(at := f"{folder}/normloom.zip", "w", zipfile.ZIP_DEFLATED) as z:
        for source in sorted(package.rglob("*.py")):
            z.write(source, source.relative_to(package.parent))
    sc.addPyFile(at)
    sc._normloom = True


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """The parquet table ``name`` of a data directory, lazily."""
    return spark.read.parquet(os.path.join(directory, f"{name}.parquet"))


def shared_dir(spark: SparkSession) -> str:
    """The folder for scratch tables that all executors can reach."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if "dir" not in _LOCAL:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        _LOCAL["dir"] = tempfile.TemporaryDirectory(prefix="normloom-", ignore_cleanup_errors=True)
    return f"file://{_LOCAL['dir'].name}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; removed when the driver ends."""
    root = f"{shared_dir(spark)}/normloom-{_RUN}"
    if root not in _SEEN:
        _SEEN.add(root)
        atexit.register(_drop, spark, root)
    path = f"{root}/{name}-{uuid.uuid4().hex[:8]}"
    for made in _MADE[-1:]:
        made.append(path)
    return path


_SEEN: set[str] = set()
_MADE: list[list[str]] = []


def delete(spark: SparkSession, path: str) -> None:
    """Remove a path of the shared folder, whatever file system holds it."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _drop(spark: SparkSession, root: str) -> None:
    try:
        delete(spark, root)
    except Exception:  # noqa: BLE001 - the session may be gone already
        pass


def written(df: DataFrame, name: str, group: int | None = None) -> DataFrame:
    """``df`` as a parquet table in the shared folder: its lineage ends there.

    ``group``: rows of a row group at most.  A reader decodes up to 4,096 rows of one at once, so tables with
    rows of many kilobytes need few.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    writer = df.write.option("compression", "zstd")
    (writer.option("parquet.block.row.count.limit", group) if group else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Removes the scratch tables written within it at its end: results must be computed before.

    A driver that lives long runs each query so, else its tables stay until ``release`` or its own end.
    """
    _MADE.append([])
    try:
        yield
    finally:
        for path in _MADE.pop():
            try:
                delete(spark, path)
            except Exception:  # noqa: BLE001 - what can't be removed goes when the driver ends
                pass


def release(spark: SparkSession) -> None:
    """Remove all scratch tables of this driver; results that still read them can't be computed again."""
    for root in list(_SEEN):
        _drop(spark, root)
        _SEEN.discard(root)


def default_parallelism(spark: SparkSession) -> int:
    return spark.sparkContext.defaultParallelism

"""Intermediate tables in the folder that driver and executors share.

Writing a table and reading it again cuts lineage, gives the planner true sizes and survives a lost
executor. The folder is the session's `spark.checkpoint.dir`; only on one machine, where that is unset, a
folder of our own is made.
"""

from __future__ import annotations

import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
#: Folders of written tables, in order, by application; and of those that are still held.
_WRITTEN: dict[str, list[str]] = {}
_FOLDER: WeakKeyDictionary = WeakKeyDictionary()
#: Pixels that a task sorts, about.
PIXELS = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables. On a cluster it must be named: a folder of one machine has holes there."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return _OWN[app]


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of the shared one that nothing has written to yet."""
    path = f"{shared_dir(spark)}/rastermill-{name}-{uuid.uuid4().hex}"
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def save(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to the shared folder and return the written table."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _FOLDER[out] = path
    return out


def tasks_for(pixels: DataFrame) -> int:
    """How many tasks `pixels` need, so that each sorts about PIXELS of them, at least as many as the session has: with a
    fixed number each would sort ever more. They are counted, which for a written table reads no rows."""
    few = int(pixels.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(few, -(-pixels.count() // PIXELS))


def dealt(pixels: DataFrame) -> DataFrame:
    """`pixels` by whole images, for windows within them."""
    return pixels.repartition(tasks_for(pixels), "image_id")


def folder_of(table: DataFrame) -> str | None:
    """Where `save` wrote a table."""
    return _FOLDER.get(table)


def drop(*tables: DataFrame) -> None:
    """Delete tables that `save` returned and that nothing will read again."""
    for t in tables:
        if path := _FOLDER.pop(t, None):
            drop_folder(t.sparkSession, path)


def drop_folder(spark: SparkSession, path: str) -> None:
    written = _WRITTEN.get(spark.sparkContext.applicationId, [])
    if path in written:  # never a folder that isn't ours
        written.remove(path)
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def written(spark: SparkSession) -> int:
    """How many folders there are by now: a mark for `drop_since`."""
    return len(_WRITTEN.get(spark.sparkContext.applicationId, []))


def drop_since(spark: SparkSession, mark: int, keep: DataFrame) -> None:
    """Delete what was written since a mark, but for the table `keep`: all that it was made of."""
    for path in _WRITTEN.get(spark.sparkContext.applicationId, [])[mark:]:
        if path != _FOLDER.get(keep):
            drop_folder(spark, path)

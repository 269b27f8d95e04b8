"""Where intermediate tables and streaming checkpoints go."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"
_local: dict[str, str] = {}
_paths: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()
_recording: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """Folder named by the cluster; a private one only in a local session that names none."""
    base = spark.conf.get(SETTING, None) or spark.sparkContext.getConf().get(SETTING)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {SETTING} to a folder all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local:
        _local[app] = tempfile.mkdtemp(prefix="leadlake-")
    return _local[app]


def new_dir(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write and read back, so a lost executor re-reads a table instead of replaying the plan."""
    path = new_dir(df.sparkSession, name)
    df.write.parquet(path)
    for made in _recording:
        made.append(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


def remove(spark: SparkSession, *paths: str) -> None:
    """Delete tables of this module that nothing reads any more."""
    context = spark.sparkContext
    for path in paths:
        where = context._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True)


def drop(*tables: DataFrame) -> None:
    """Delete tables that ``cut`` returned, once all that is read from them is written elsewhere."""
    for df in tables:
        remove(df.sparkSession, _paths.pop(df))


@contextmanager
def recorded() -> Iterator[list[str]]:
    """The folders of the tables that ``cut`` writes inside."""
    made: list[str] = []
    _recording.append(made)
    try:
        yield made
    finally:
        _recording.remove(made)

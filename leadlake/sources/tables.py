"""Typed tables on disk: read with a declared schema, write partition-friendly parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadlake.schemas import DDL, schema


def load(spark: SparkSession, root: str, names: list[str] | None = None) -> dict[str, DataFrame]:
    """Lazy DataFrames for the stored tables; no schema inference, so no footer scan."""
    return {n: spark.read.schema(DDL[n]).parquet(f"{root}/{n}") for n in (names or DDL)}


def conform(df: DataFrame, name: str) -> DataFrame:
    """Project to a declared schema: missing columns become null, others are cast."""
    have = set(df.columns)
    return df.select(*[
        (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in schema(name).fields
    ])


def save(df: DataFrame, root: str, name: str, mode: str = "overwrite") -> str:
    path = f"{root}/{name}"
    conform(df, name).write.mode(mode).parquet(path)
    return path


#: Buckets of a stored table; a bucket of the largest table should fit into a task.
BUCKETS = 64


def _typed(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def save_bucketed(df: DataFrame, path: str, name: str, by: list[str], buckets: int = BUCKETS) -> DataFrame:
    """Write a table hashed into buckets of ``by`` and sorted by it inside, and return it read back.

    Tables of one number of buckets whose columns name the same thing, in the same order, join on them without a shuffle; with
    one column, a filter that fixes it reads one bucket. ``by`` should hold the tenant and the row's own id: a tenant alone
    may be a third of the rows, which no bucket should hold. Rows are dealt out by the bucket first, so a bucket is one file.
    """
    spark = df.sparkSession
    dealt = df.repartition(buckets, *by)
    dealt.write.bucketBy(buckets, *by).sortBy(*by).option("path", path).mode("overwrite").saveAsTable(name)
    return spark.table(name)


def open_bucketed(spark: SparkSession, like: DataFrame, path: str, name: str, by: list[str], buckets: int = BUCKETS) -> DataFrame:
    """Such a table in another session, of the columns of ``like``."""
    cols = ", ".join(f"`{c}`" for c in by)
    spark.sql(f"CREATE TABLE IF NOT EXISTS `{name}` ({_typed(like)}) USING parquet CLUSTERED BY ({cols}) SORTED BY ({cols}) INTO {buckets} BUCKETS LOCATION '{path}'")
    return spark.table(name)

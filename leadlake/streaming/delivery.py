"""At-least-once handling with a delivery budget: failed rows come again with the next batch, and end as dead letters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from leadlake.streaming.appliers import BATCH, start

ROUND = "__round"
BUDGET = 5
DONE, RETRY, DEAD = "done", "retry", "dead"

#: Takes rows with their ``attempt`` (from 1) and returns them with ``error``, null where they are dealt with.
Handler = Callable[[DataFrame], DataFrame]


def _ledger(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    return spark.read.option("basePath", path).schema(f"{kinds}, attempt int, error string, {BATCH} bigint, {ROUND} int, outcome string").parquet(path)


def _waiting(spark: SparkSession, path: str, schema: StructType, batch: int, before: int | None = None) -> tuple[DataFrame, int]:
    """Rows of a batch that failed last, and the round in which they did."""
    ledger = _ledger(spark, path, schema).filter((F.col(BATCH) == batch) & (F.lit(True) if before is None else F.col(ROUND) < before))
    last = ledger.agg(F.max(ROUND)).first()[0] or 0
    return ledger.filter((F.col(ROUND) == last) & (F.col("outcome") == RETRY)).drop("error", BATCH, ROUND, "outcome"), last


def _handle(rows: DataFrame, path: str, batch: int, turn: int, handle: Handler, budget: int) -> None:
    failed = F.col("error").isNotNull()
    outcome = F.when(~failed, DONE).when(F.col("attempt") < budget, RETRY).otherwise(DEAD)
    handled = handle(rows).withColumn("outcome", outcome)
    handled.write.mode("overwrite").partitionBy("outcome").parquet(f"{path}/{BATCH}={batch}/{ROUND}={turn}")


def deliver(stream: DataFrame, key: list[str], handle: Handler, checkpoint: str, path: str, budget: int = BUDGET) -> StreamingQuery:
    """Hand every row to ``handle`` until it succeeds, ``budget`` times at most, counting attempts by key.

    A batch takes the new rows (first attempt) and those that failed in the batch before, with one attempt
    more; a new row whose key is waiting counts as its next delivery, and copies of a key within a
    batch are one. All outcomes of a batch are one write of its own folder, and a batch reads only the
    folder of the batch before, so a replayed batch writes the same rows again.
    """
    schema = stream.schema

    def each(df: DataFrame, batch: int) -> None:
        rows = df.withColumn("attempt", F.lit(0))
        if batch:
            rows = rows.unionByName(_waiting(df.sparkSession, path, schema, batch - 1)[0])
        rest = [c for c in df.columns if c not in key]
        latest = rows.groupBy(*key).agg(F.max(F.struct("attempt", *rest)).alias("__r"))
        rows = latest.select(*key, "__r.*").withColumn("attempt", F.col("attempt") + 1).select(*df.columns, "attempt")
        _handle(rows, path, batch, 0, handle, budget)

    return start(stream, checkpoint, each)


def redeliver(spark: SparkSession, schema: StructType, handle: Handler, path: str, budget: int = BUDGET) -> None:
    """While the stream stands still: deliver waiting rows again, in rounds of the last batch, until none waits.

    The stream goes on from what the last round left.
    """
    batch = _ledger(spark, path, schema).agg(F.max(BATCH)).first()[0]
    for _ in range(budget - 1 if batch is not None else 0):
        rows, last = _waiting(spark, path, schema, batch)
        if rows.isEmpty():
            return
        _handle(rows.withColumn("attempt", F.col("attempt") + 1), path, batch, last + 1, handle, budget)


def delivered(spark: SparkSession, schema: StructType, path: str) -> tuple[DataFrame, DataFrame]:
    """Rows dealt with, and dead letters with their last error; both with the attempts they took."""
    ledger = _ledger(spark, path, schema).drop(BATCH, ROUND)
    return ledger.filter(F.col("outcome") == DONE).drop("outcome", "error"), ledger.filter(F.col("outcome") == DEAD).drop("outcome")

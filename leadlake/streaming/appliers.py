"""Streaming forms of the batch operators.

Folds (minima and maxima of time-stamped values) need no state store: every micro-batch appends
its partial fold under its batch number and readers merge the partials. A retried batch rewrites
its own folder, so the result is exactly once; duplicates and late rows cannot change a fold.
Every so many batches the partials are merged into the base of the next generation, so readers
never merge more than one base and those batches. Only repeats within a window of time keep state
(``dedupe_by_time``), since rows have to wait for earlier ones there.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState

from leadlake.operators.fold import Fold
from leadlake.sources.payloads import advance_cursors, explode_mailbox
from leadlake.streaming.waiting import STATE as WAITING
from leadlake.streaming.waiting import bucket_of, take_due

BATCH = "__batch"
GENERATION = "__generation"
BATCHES_PER_GENERATION = 50


def start(stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Process what is there now, batch by batch, and stop."""
    return (stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def append_batches(stream: DataFrame, checkpoint: str, path: str,
                   shape: Callable[[DataFrame], DataFrame] = lambda df: df) -> StreamingQuery:
    """Write each batch to its own folder; a replay overwrites the same folder."""
    def each(df: DataFrame, batch_id: int) -> None:
        shape(df).write.mode("overwrite").parquet(f"{path}/{BATCH}={batch_id}")

    return start(stream, checkpoint, each)


def fold_stream(stream: DataFrame, fold: Fold, checkpoint: str, path: str,
                every: int = BATCHES_PER_GENERATION) -> StreamingQuery:
    """Append the partial fold of every batch; after ``every`` batches start a merged generation.

    Generation and folder follow from the batch number, so a replay writes the same files. Older
    generations are not read again and may be removed.
    """
    def each(df: DataFrame, batch_id: int) -> None:
        current = batch_id // every
        fold.partial(df).write.mode("overwrite").parquet(f"{path}/{GENERATION}={current}/{BATCH}={batch_id}")
        if (batch_id + 1) % every == 0:
            partials = df.sparkSession.read.parquet(f"{path}/{GENERATION}={current}").drop(BATCH)
            fold.merge(partials).write.mode("overwrite").parquet(f"{path}/{GENERATION}={current + 1}/{BATCH}=-1")

    return start(stream, checkpoint, each)


def read_batches(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("basePath", path).parquet(path).drop(BATCH)


def read_fold(spark: SparkSession, path: str, fold: Fold) -> DataFrame:
    """Current fold over all batches written so far, read from the newest generation."""
    log = spark.read.option("basePath", path).parquet(path)
    newest = log.agg(F.max(GENERATION)).scalar()
    return fold.merge(log.filter(F.col(GENERATION) == newest).drop(BATCH, GENERATION))


def dedupe_stream(stream: DataFrame, keys: list[str], window: str, arrived: str = "arrived_at") -> DataFrame:
    """Ignore repeats of a key that arrive within the window after the first, as a broker does.

    The window runs on arrival time: no row is ever too late, and the state of a key is dropped once the
    window has passed, but the answer depends on how fast rows come; :func:`dedupe_by_time` does not.
    """
    return (stream.withColumn(arrived, F.current_timestamp()).withWatermark(arrived, window)
            .dropDuplicatesWithinWatermark(keys))


def dedupe_by_time(stream: DataFrame, keys: list[str], at: str, window: str, delay: str) -> DataFrame:
    """Ignore repeats of a key whose own time is less than ``window`` after that of the last row let through.

    Rows wait until the watermark, ``delay`` behind the newest time seen, has passed their time, and are
    judged in order of time then; so the answer does not depend on how the rows are dealt to batches nor on how
    slowly they come. Rows that come when the watermark has passed them are dropped, as are rows without a
    time; of rows of equal key and time the first in column order stays. The state of a key is
    dropped when its window has passed.

    The keys fall into groups that share a state (``waiting.BUCKETS``), so Python is called for groups and not for keys.
    """
    rest = F.to_json(F.struct(*stream.columns), {"ignoreNullFields": "false"})
    micros = F.unix_micros(F.col(at).cast("timestamp"))
    rows = stream.withColumn("__at", F.col(at).cast("timestamp")).filter("__at IS NOT NULL").withWatermark("__at", delay)
    rows = rows.select(F.to_json(F.struct(*keys)).alias("key"), "__at", micros.alias("t"), rest.alias("row"))
    wide = int(stream.sparkSession.sql(f"SELECT unix_micros(TIMESTAMP'1970-01-01 00:00:00Z' + INTERVAL {window})").first()[0])

    def judge(_, frames, state: GroupState):
        keys, times, waiting, soonest = state.get if state.exists else ([], [], [], None)
        opened, passed, let = dict(zip(keys, times)), state.getCurrentWatermarkMs() * 1000, {}
        due, waiting, soonest = take_due(frames, ["key", "t", "row"], waiting, soonest, passed)
        if due is not None:
            due = due.sort_values("t")
            for key, t, row in zip(due["key"], due["t"].tolist(), due["row"]):
                last = opened.get(key)
                if last is None or t >= last + wide:
                    opened[key] = t
                    let[key, t] = row
                elif t == last and (key, t) in let and row < let[key, t]:
                    let[key, t] = row
        opened = {k: t for k, t in opened.items() if t + wide > passed}
        if waiting or opened:
            state.update((list(opened), list(opened.values()), waiting, soonest))
            next_due = min([t + wide for t in opened.values()] + ([] if soonest is None else [soonest]))
            state.setTimeoutTimestamp(max(next_due, passed) // 1000 + 1)
        else:
            state.remove()
        if let:
            yield pd.DataFrame({"row": list(let.values())})

    kept = rows.withColumn("bucket", bucket_of("key")).groupBy("bucket").applyInPandasWithState(
        judge, "row string", f"keys array<string>, opened array<long>, {WAITING}", "append", "EventTimeTimeout")
    return kept.select(F.from_json("row", stream.schema).alias("r")).select("r.*")


def write_rows(stream: DataFrame, checkpoint: str, path: str) -> StreamingQuery:
    """Append rows with the file sink, which commits each batch once."""
    return (stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
            .outputMode("append").trigger(availableNow=True).start())


def write_routes(stream: DataFrame, checkpoint: str, path: str, routes: list[str]) -> StreamingQuery:
    """One folder per route and batch; a batch is read once and split while writing."""
    def each(df: DataFrame, batch_id: int) -> None:
        kept = df.filter(df["route"].isin(routes))
        kept.write.mode("overwrite").partitionBy("route").parquet(f"{path}/{BATCH}={batch_id}")

    return start(stream, checkpoint, each)


HISTORY, CURSOR, SEEN = "message", "cursor", "seen"


def mailbox_stream(changes: DataFrame, cursors: DataFrame, checkpoint: str, path: str) -> StreamingQuery:
    """Messages of mailbox changes past each account's cursor, with the cursors moving in the same write.

    A change is passed over if it is not past the stored cursor (``cursors``: account_id, last_history_id, as
    they were before the first batch) or if an earlier batch had it; so changes may come in any order and more than
    once. A batch reads the folders of earlier batches only and writes messages, seen changes and new
    cursors as one folder of its own, so a replayed batch writes the same rows again.
    """
    def each(df: DataFrame, batch: int) -> None:
        spark = df.sparkSession
        rows = df.join(cursors, "account_id", "left").filter("last_history_id IS NULL OR history_id > last_history_id").drop("last_history_id")
        if batch:
            log = _mailbox_log(spark, path).filter(F.col(BATCH) < batch)
            reached = log.filter(F.col("part") == CURSOR).groupBy("account_id").agg(F.max("history_id").alias("__reached"))
            rows = rows.join(reached, "account_id", "left").withColumn("__back", F.coalesce(F.col("history_id") <= F.col("__reached"), F.lit(False)))
            back = rows.filter("__back").join(log.filter(F.col("part") == SEEN).select("account_id", "history_id"), ["account_id", "history_id"], "left_anti")
            rows = rows.filter("NOT __back").unionByName(back).drop("__reached", "__back")
        rows = rows.groupBy("account_id", "history_id").agg(F.min("messages").alias("messages"))
        seen = rows.select("account_id", "history_id", F.lit(None).cast("string").alias("kind"), F.lit(None).cast("string").alias("message_id"))
        moved = seen.groupBy("account_id").agg(F.max("history_id").alias("history_id"))
        out = (explode_mailbox(rows).withColumn("part", F.lit(HISTORY)).unionByName(seen.withColumn("part", F.lit(SEEN)))
               .unionByName(moved.withColumn("part", F.lit(CURSOR)), allowMissingColumns=True))
        out.write.mode("overwrite").partitionBy("part").parquet(f"{path}/{BATCH}={batch}")

    return start(changes, checkpoint, each)


def _mailbox_log(spark: SparkSession, path: str) -> DataFrame:
    return (spark.read.option("basePath", path).schema(f"account_id bigint, history_id bigint, kind string, message_id string, {BATCH} bigint, part string")
            .parquet(path))


def read_mailbox(spark: SparkSession, cursors: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """Messages written so far, and the cursors they leave."""
    log = _mailbox_log(spark, path)
    moved = log.filter(F.col("part") == CURSOR).select("account_id", "history_id")
    return log.filter(F.col("part") == HISTORY).select("account_id", "history_id", "kind", "message_id"), advance_cursors(cursors, moved)

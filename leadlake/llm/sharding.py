"""Balanced shards by longest-processing-time scheduling of groups that must stay together."""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leadlake.plans.scratch import cut

SHARDS = 24
ROW_BYTES = 8
STEPS = 256
SLOT_ROWS = 256
MOST_GROUPS = 1 << 14


def lpt(classes: list[tuple[int, int, int]], shards: int) -> dict[int, list[int]]:
    """How many groups of each size class go to each shard.

    ``classes`` holds (class, groups, total size). Classes go from the largest groups to the smallest;
    the heap holds (load, shard). A class whose groups would go round the shards more than twice is
    poured in at once: the level is found at which shards filled up to it by equal groups take all but
    fewer groups than there are shards, and the heap takes those.
    """
    loads, out = [0.0] * shards, {}
    for c, n, total in sorted(classes, key=lambda x: (-x[2] / x[1], x[0])):
        size, given = total / n, [0] * shards
        if n > 2 * shards:
            low, high = min(loads), max(loads) + size * (n / shards + 2)
            for _ in range(100):
                level = (low + high) / 2
                fits = sum(max(0, int((level - x) / size)) for x in loads)
                low, high = (level, high) if fits <= n else (low, level)
            given = [max(0, int((low - x) / size)) for x in loads]
        heap = [(loads[j] + given[j] * size, j) for j in range(shards)]
        heapq.heapify(heap)
        for _ in range(n - sum(given)):
            load, j = heap[0]
            given[j] += 1
            heapq.heapreplace(heap, (load + size, j))
        loads = [loads[j] + given[j] * size for j in range(shards)]
        out[c] = given
    return out


def shard(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", row_bytes: int = ROW_BYTES) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard), one row per input row; law is ``bytes``.

    Documents of equal text form one group and stay in one shard. Groups are summed by the MD5 of
    their text. Their sizes fall into classes 1/256 of an octave wide; the driver sees one row of
    totals per class (at most 16,384 whatever the data) and schedules classes by longest processing
    time. Inside a class, groups are numbered in hash order and dealt by the scheduled counts. Slots
    number the rows of a shard without gaps, also from counts per hash range.

    A null text counts 0 bytes, has a null checksum and is a group of its own kind; an empty text is
    another. Repeated rows are kept and get slots of their own. An empty table gives no rows.
    """
    spark = docs.sparkSession
    size = F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long") + row_bytes
    rows = cut(docs.select(F.col(id_col).alias("doc_id"), size.alias("size"), F.crc32(F.col(text_col).cast("binary")).alias("text_crc32"),
                           F.coalesce(F.unhex(F.md5(F.col(text_col).cast("binary"))), F.lit(b"")).alias("h")), "shard-rows")
    octave = F.floor(F.log2(F.col("bytes") + 0.5)).cast("long")
    cls = octave * STEPS + F.floor((F.col("bytes") / F.pow(F.lit(2.0), octave) - 1) * STEPS).cast("long")
    groups = rows.groupBy("h").agg(F.sum("size").alias("bytes")).withColumn("c", cls)
    groups = cut(groups.withColumn("u", F.pmod(F.xxhash64("h"), F.lit(MOST_GROUPS)).cast("int")), "shard-groups")
    n = groups.count()
    ranges = min(MOST_GROUPS, max(1, n // SLOT_ROWS))
    groups = groups.withColumn("r", F.pmod(F.col("u"), F.lit(ranges)))
    parts = groups.groupBy("c", "r").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
    classes = parts.groupBy("c").agg(F.sum("n"), F.sum("bytes")).collect()  # at most 64 octaves x 256
    plan = lpt([(r[0], r[1], r[2]) for r in classes], shards)
    ends = []
    for c, given in plan.items():
        upto = 0
        for j, k in enumerate(given):
            if k:
                ends.append((c, j, upto, upto + k))
                upto += k
    steps = spark.createDataFrame(ends, "c long, shard int, low long, high long")
    steps = steps.groupBy("c").agg(F.sort_array(F.collect_list(F.struct("high", "shard"))).alias("steps"))  # at most one per shard
    before = Window.partitionBy("c").orderBy("r").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("c", "r", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset")).join(F.broadcast(steps), "c")
    own = Window.partitionBy("c", "r").orderBy("h")
    at = F.row_number().over(own) - 1 + F.col("offset")
    placed = groups.join(offsets, ["c", "r"]).withColumn("at", at)
    placed = placed.select("h", F.expr("element_at(filter(steps, s -> s.high > at), 1).shard").alias("shard"))
    rows = rows.join(placed, "h").withColumn("u", F.pmod(F.xxhash64("doc_id", "h", "size"), F.lit(MOST_GROUPS)).cast("int"))
    rows = cut(rows.drop("h"), "shard-placed")
    ranges = min(MOST_GROUPS, max(1, rows.count() // (SLOT_ROWS * shards)))
    rows = rows.withColumn("r", F.pmod(F.col("u"), F.lit(ranges)))
    before = Window.partitionBy("shard").orderBy("r").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("shard", "r").agg(F.count("*").alias("n"))
    offsets = offsets.select("shard", "r", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    own = Window.partitionBy("shard", "r").orderBy("u", "doc_id", "text_crc32", "size")
    slot = F.row_number().over(own) - 1 + F.col("offset")
    return rows.join(offsets, ["shard", "r"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int"), slot.cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"))

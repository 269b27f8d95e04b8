"""Mix sources to target weights by cutting each source, in hash-random order, at an exact word budget."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leadlake.llm.common import WORD, shuffle_parts
from leadlake.plans.scratch import cut

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_EPOCHS = 2
SEED = "mix-1"
GROUPS = 1 << 14
GROUP_ROWS = 256


def running(df: DataFrame, order: list, sums: list[str], name: str) -> DataFrame:
    """Adds ``rank`` (from 0) and ``before_x``, the sum of x over all earlier rows, in a total order.

    Rows are range-sorted into partitions and written; only one row of totals per partition meets
    in one task.
    """
    ranged = cut(df.repartitionByRange(shuffle_parts(df.sparkSession), *order).withColumn("_p", F.spark_partition_id()), name)
    upto = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("_p").agg(F.count("*").alias("_n"), *(F.sum(c).alias(f"_{c}") for c in sums))
    totals = totals.select("_p", *(F.coalesce(F.sum(c).over(upto), F.lit(0)).alias(f"{c}_0") for c in ["_n", *(f"_{c}" for c in sums)]))
    own = Window.partitionBy("_p").orderBy(*order)
    here = own.rowsBetween(Window.unboundedPreceding, -1)
    out = ranged.select("*", (F.row_number().over(own) - 1).alias("_r"),
                        *(F.coalesce(F.sum(c).over(here), F.lit(0)).alias(f"_b_{c}") for c in sums))
    out = out.join(F.broadcast(totals), "_p")  # one row per partition
    return out.select(*df.columns, (F.col("_r") + F.col("_n_0")).alias("rank"),
                      *((F.col(f"_b_{c}") + F.col(f"_{c}_0")).alias(f"before_{c}") for c in sums))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST_EPOCHS) -> DataFrame:
    """(sk, source_size, target) from (sk, source_size), sources in the order of sk.

    Every source gets level x weight words, ``most`` times its size at the utmost, with the level at
    which the targets add up to the share of all words. Sources are taken by size per weight: those
    before the first that stays below its own limit are full, and what they leave fixes the level.
    """
    ranked = running(sizes, [F.col("sk")], ["source_size"], "mix-sources")
    which = F.col("rank") % len(weights)
    weight = F.element_at(F.array(*(F.lit(w) for w in weights)), (which + 1).cast("int"))
    ranked = ranked.select("sk", "source_size", weight.cast("long").alias("w"))
    ranked = ranked.withColumn("limit", F.lit(float(most)) * F.col("source_size") / F.col("w"))
    total, all_w = ranked.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("w"), F.lit(0))).first()
    levels = running(ranked, [F.col("limit"), F.col("sk")], ["source_size", "w"], "mix-levels")
    level = (F.lit(share * total) - F.lit(float(most)) * F.col("before_source_size")) / (F.lit(all_w) - F.col("before_w"))
    first = levels.withColumn("level", level).filter("limit >= level").orderBy("rank").select("level").first()
    level = float(first.level) if first else 0.0
    return ranked.select("sk", "source_size", F.least(F.lit(float(most)) * F.col("source_size"), F.col("w") * F.lit(level)).alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", carry: list | None = None,
        weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST_EPOCHS, seed: str = SEED) -> DataFrame:
    """(doc_id, size, source_size, target, taken), one row per input row, and any ``carry`` expressions.

    A document's place is the MD5 of the seed and its id. Within a source, rows are dealt by the
    leading bits of that key, which is a range partitioning as keys are uniform; sums per range give
    each range its starting offset, and a running sum inside the range places every row. The target,
    rounded to words, buys whole epochs of the source, and the rest is cut exactly: the document on
    the cut gives only its first words.

    Null texts have size 0 and are never taken; null sources form one source, last; a null id has
    the key of an empty id; rows equal in id share a place and split the cut by size; an empty table
    gives no rows. Other columns are not looked at.
    """
    sk = F.when(F.col(source_col).isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col(source_col).cast("string")))
    rows = cut(docs.select(
        F.col(id_col).alias("doc_id"), sk.alias("sk"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.md5(F.concat(F.lit(seed + "|"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary")).alias("key"),
        *(carry or [])), "mix-rows")
    n = rows.count()
    bits = min(max(0, math.ceil(math.log2(max(n, 1) / GROUP_ROWS))), int(math.log2(GROUPS)))
    rows = rows.withColumn("b", F.shiftright(F.conv(F.substring("key", 1, 4), 16, 10).cast("int"), 16 - bits))
    ranges = cut(rows.groupBy("sk", "b").agg(F.sum("size").alias("words")), "mix-ranges")
    upto = Window.partitionBy("sk").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    goal = targets(ranges.groupBy("sk").agg(F.sum("words").alias("source_size")), weights, share, most)
    budget = F.floor(F.col("target") + 0.5).cast("long")
    ranges = (ranges.withColumn("offset", F.coalesce(F.sum("words").over(upto), F.lit(0)))
              .join(goal, "sk").withColumn("budget", budget)
              .withColumn("epochs", F.when(F.col("source_size") > 0, F.expr("budget div source_size")).otherwise(F.lit(0)))
              .select("sk", "b", "offset", "source_size", "target", "epochs",
                      (F.col("budget") - F.col("epochs") * F.col("source_size")).alias("rest")))
    inside = Window.partitionBy("sk", "b").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.join(ranges, ["sk", "b"]).withColumn("before", F.col("offset") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("before")))
    extra = [c for c in rows.columns if c not in ("doc_id", "sk", "size", "key", "b")]
    return placed.select("doc_id", "size", "source_size", "target", (F.col("epochs") * F.col("size") + part).cast("long").alias("taken"), *extra)


def take(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The mixed documents with their own columns: a row per epoch, the row on the cut with only the words taken of it.

    Rows are matched back by id and text, so repeated ids stay apart; equal rows share what they get.
    """
    same = F.xxhash64(F.col(id_col), F.col(source_col), F.col(text_col))
    plan = mix(docs, id_col, text_col, source_col, carry=[same.alias("_k")], **how)
    plan = plan.filter("taken > 0").groupBy("_k").agg(F.max("size").alias("_size"), F.collect_list("taken").alias("_taken"))
    first = F.array_join(F.slice(F.regexp_extract_all(F.col(text_col), F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0)), F.lit(1), F.col("_n").cast("int")), "")
    shares = F.expr("flatten(transform(_taken, t -> concat(array_repeat(_size, cast(t div _size as int)), filter(array(t % _size), x -> x > 0))))")
    rows = docs.dropDuplicates([id_col, source_col, text_col]).withColumn("_k", same).join(plan, "_k").withColumn("_n", F.explode(shares))
    text = F.when(F.col("_n") == F.col("_size"), F.col(text_col)).otherwise(first)
    out = rows.withColumn(text_col, text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length(text_col).cast(dict(docs.dtypes)["n_chars"]))
    return out.select(*docs.columns)

"""Group-wise building blocks that keep tasks bounded when one key holds a large share of rows.

Plain windows put a whole group into one task. These helpers instead aggregate before the
shuffle, split a group by time or by hash, or bound what a final task sees by the number of
map tasks times k.
"""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MINUTE = 60_000_000
DAY = 86_400_000_000
HOT_KEYS = 20_000
HOT_ROWS = 1_000_000


def row_counts(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))


def hot_keys(counts: DataFrame, keys: list[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Crowded keys and their salts, one for every ``hot_rows`` rows (``counts``: keys, __n).

    Only the HOT_KEYS largest keys are taken, which bounds the list for a broadcast; any key
    beyond them holds less than one row in HOT_KEYS.
    """
    return (counts.filter(F.col("__n") > hot_rows).orderBy(F.col("__n").desc(), *keys).limit(HOT_KEYS)
            .select(*keys, F.ceil(F.col("__n") / F.lit(hot_rows)).cast("int").alias("__salts")))


def _spread_join(left: DataFrame, right: DataFrame, keys: list[str], how: str, counts: DataFrame,
                 hot_rows: int) -> DataFrame:
    """Join after salting the crowded keys of ``left``.

    Their rows spread over as many salts as their count asks for, and their right-hand rows are
    copied to each. Rows with a null key match nothing and spread over all tasks.
    """
    hot = F.broadcast(hot_keys(counts.dropna(subset=keys), keys, hot_rows))
    no_key = F.lit(False)
    for k in keys:
        no_key = no_key | F.col(k).isNull()
    plain = [n for n, t in left.dtypes if not t.startswith(("map", "variant"))]
    row = F.xxhash64(*plain)
    salt = F.when(no_key, F.pmod(row, F.lit(HOT_KEYS))).otherwise(
        F.coalesce(F.pmod(row, F.col("__salts")), F.lit(0)))
    copies = F.sequence(F.lit(0), F.coalesce("__salts", F.lit(1)) - 1)
    salted = left.join(hot, keys, "left").withColumn("__salt", salt.cast("int")).drop("__salts")
    copied = right.join(hot, keys, "left").withColumn("__salt", F.explode(copies)).drop("__salts")
    return salted.join(copied, [*keys, "__salt"], how).drop("__salt")


def join_hot(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left",
             counts: DataFrame | None = None, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Join a large side, any key of which may be crowded, with a side of few rows per key.

    Crowded keys are salted, as AQE cannot split them where the right side is an aggregate or a
    chain of joins on one key. Rows are counted per key; ``counts`` (keys, __n) may name a cheaper
    table that has the same crowded keys.
    """
    return _spread_join(left, right, keys, how, row_counts(left, keys) if counts is None else counts, hot_rows)


def with_totals(df: DataFrame, keys: list[str], hot_rows: int = HOT_ROWS, **aggs: Column) -> DataFrame:
    """Attach group aggregates: partial aggregation, then a join that spreads crowded keys."""
    totals = df.groupBy(*keys).agg(*[e.alias(n) for n, e in aggs.items()], F.count(F.lit(1)).alias("__n"))
    return _spread_join(df, totals.drop("__n"), keys, "left", totals.select(*keys, "__n"), hot_rows)


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank",
          spread: bool = False) -> DataFrame:
    """First k rows of each group with their rank.

    The rank filter becomes a group limit inside every map task, so a hot group sends at most
    k rows per task. With ``spread`` a round by groups of map tasks, about the root of the shuffle
    partitions in number, cuts that to k rows per group of tasks before the final one.
    """
    if spread:
        rounds = isqrt(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))) + 1
        local = Window.partitionBy(*keys, "__salt").orderBy(*order)
        df = (df.withColumn("__salt", F.pmod(F.spark_partition_id(), F.lit(rounds)))
              .withColumn("__r", F.row_number().over(local))
              .filter(F.col("__r") <= k).drop("__r", "__salt"))
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def first_row(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the first in order; copies are dropped map-side."""
    return top_k(df, keys, order, 1, "__rank").drop("__rank")


def running_before(df: DataFrame, keys: list[str], at: str, scope: str, sums: list[str], real: str | None = None,
                   across: bool = True) -> DataFrame:
    """For every (keys, instant): sums over strictly earlier instants, and the latest such instant.

    ``at`` is microseconds since the epoch and ``scope`` a coarser bucket that grows with it,
    such as a day. Rows of one instant collapse first; then prefixes are built inside a minute,
    over the minutes of a scope and, with ``across``, over scopes. No task sees more than the
    distinct instants of one minute, the minutes of one scope or the scopes of one key. With
    ``real`` (boolean) only instants having such a row count as the latest one.

    Output: keys, scope, at, ``<sum>_in_scope`` and, with ``across``, ``<sum>_before`` and previous_at.
    """
    mark = F.max(F.when(F.col(real), F.col(at))) if real else F.max(at)
    base = (df.groupBy(*keys, scope, at).agg(*[F.sum(c).alias(c) for c in sums], mark.alias("__p"))
            .withColumn("__slot", F.floor(F.col(at) / F.lit(MINUTE)).cast("long")))

    def before(partition, order):
        w = Window.partitionBy(*partition).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return {**{c: F.coalesce(F.sum(c).over(w), F.lit(0)).cast("long") for c in sums}, "__p": F.max("__p").over(w)}

    def totals(rows, by):
        return rows.groupBy(*by).agg(*[F.sum(c).alias(c) for c in sums], F.max("__p").alias("__p"))

    slot = [*keys, scope, "__slot"]
    slots = totals(base, slot)
    inner = base.select(*slot, at, *[e.alias(f"{n}0") for n, e in before(slot, at).items()])
    carry = slots.select(*slot, *[e.alias(f"{n}1") for n, e in before([*keys, scope], "__slot").items()])
    if across:
        scopes = totals(slots, [*keys, scope])
        far = scopes.select(*keys, scope, *[e.alias(f"{n}2") for n, e in before(keys, scope).items()])
        carry = carry.join(far, [*keys, scope])
    out = inner.join(carry, slot)
    cols = [(F.col(f"{c}0") + F.col(f"{c}1")).alias(f"{c}_in_scope") for c in sums]
    if across:
        cols += [(F.col(f"{c}0") + F.col(f"{c}1") + F.col(f"{c}2")).alias(f"{c}_before") for c in sums]
        cols.append(F.greatest("__p0", "__p1", "__p2").alias("previous_at"))
    return out.select(*keys, scope, at, *cols)


def running_number(df: DataFrame, keys: list[str], order: list[str], number: str, blocks: Column) -> DataFrame:
    """Consecutive numbers per group along ``order``, numbering block by block.

    ``blocks`` must be an order-preserving bucket of the first order column. Rows are numbered
    inside a block and shifted by the sizes of the earlier blocks of the same group.
    """
    df = df.withColumn("__block", blocks)
    inside = Window.partitionBy(*keys, "__block").orderBy(*order)
    sizes = df.groupBy(*keys, "__block").agg(F.count(F.lit(1)).alias("__n"))
    earlier = Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    shift = sizes.select(*keys, "__block", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__shift"))
    return (df.withColumn("__i", F.row_number().over(inside))
            .join(shift, [*keys, "__block"])
            .withColumn(number, F.col("__i") + F.col("__shift"))
            .drop("__block", "__i", "__shift"))


def previous_value(df: DataFrame, keys: list[str], order: list[str], value: str, out: str, blocks: Column) -> DataFrame:
    """Value of the preceding row of the group, looked up inside a block, else from the block before.

    ``blocks`` is an order-preserving bucket of the first order column; ``value`` is never null.
    """
    df = df.withColumn("__block", blocks)
    inside = Window.partitionBy(*keys, "__block").orderBy(*order)
    lasts = df.groupBy(*keys, "__block").agg(F.max_by(value, F.struct(*order)).alias("__last"))
    across = Window.partitionBy(*keys).orderBy("__block")
    carry = lasts.select(*keys, "__block", F.lag("__last").over(across).alias("__carry"))
    return (df.withColumn("__in", F.lag(value).over(inside))
            .join(carry, [*keys, "__block"])
            .withColumn(out, F.coalesce("__in", "__carry"))
            .drop("__block", "__in", "__carry"))


def attach_rows(parents: DataFrame, children: DataFrame, keys: list[str]) -> DataFrame:
    """Left join of parents (unique per key) to many children.

    Written as an inner join, whose crowded child side AQE may split, plus the childless
    parents; a left outer join could only split the parent side.
    """
    matched = parents.join(children, keys)
    childless = parents.join(children.select(*keys).distinct(), keys, "left_anti")
    return matched.unionByName(childless, allowMissingColumns=True)

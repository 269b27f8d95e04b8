"""Keyed writes over immutable files: compute the new table state, write it as a new version."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leadlake.functions.columns import present
from leadlake.plans.scratch import new_dir

MODES = ("overwrite", "non_null_overwrite", "fill_missing", "keep_first")


def upsert(target: DataFrame, updates: DataFrame, keys: list[str], set_cols: list[str] | None = None,
           mode: str = "overwrite") -> DataFrame:
    """Target after inserting new keys and changing ``set_cols`` of matched ones.

    overwrite: take the update. non_null_overwrite: take it unless null or blank. fill_missing:
    take it only where the target is null or blank. keep_first: leave matched rows alone.
    ``updates`` holds at most one row per key.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    set_cols = [c for c in (set_cols or updates.columns) if c not in keys and c in updates.columns]
    u = updates.select(*keys, *[F.col(c).alias(f"__u_{c}") for c in updates.columns if c not in keys],
                       F.lit(True).alias("__in_u"))
    joined = target.withColumn("__in_t", F.lit(True)).join(u, keys, "full")
    matched = F.col("__in_t") & F.col("__in_u")

    def blank_aware(c, name):
        return present(c) if dict(target.dtypes)[name] == "string" else F.col(c)

    def value(name):
        if name in keys:
            return F.col(name)
        old = F.col(name)
        if name not in updates.columns:
            return old
        new = F.col(f"__u_{name}")
        inserted = F.when(F.col("__in_t").isNull(), new)
        if name not in set_cols or mode == "keep_first":
            return inserted.otherwise(old).alias(name)
        if mode == "overwrite":
            changed = new
        elif mode == "non_null_overwrite":
            changed = F.coalesce(blank_aware(f"__u_{name}", name), old)
        else:
            changed = F.coalesce(blank_aware(name, name), new)
        return inserted.when(matched, changed).otherwise(old).alias(name)

    return joined.select(*[value(c) for c in target.columns])


def fold_updates(updates: DataFrame, keys: list[str], order: list[str], mode: str = "overwrite") -> DataFrame:
    """Several updates of a key as one that has their effect in ``order`` (unique per key).

    overwrite: the last one. non_null_overwrite: the last value of each column that is not null or blank. fill_missing: the
    first such value. keep_first: the first one.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    rest = [c for c in updates.columns if c not in keys]
    pick = F.max if mode in ("overwrite", "non_null_overwrite") else F.min
    if mode in ("overwrite", "keep_first"):
        whole = updates.groupBy(*keys).agg(pick(F.struct(*order, F.struct(*rest).alias("__row"))).alias("__u"))
        return whole.select(*keys, "__u.__row.*").select(updates.columns)
    known = lambda c: present(c) if dict(updates.dtypes)[c] == "string" else F.col(c)
    cols = [pick(F.when(known(c).isNotNull(), F.struct(*order, F.col(c).alias("__v")))).alias(c) for c in rest]
    return updates.groupBy(*keys).agg(*cols).select(*keys, *[F.col(f"{c}.__v").alias(c) for c in rest]).select(updates.columns)


BUCKET, BUCKETS = "__bucket", 64


def _bucket(tenant: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(tenant), F.lit(buckets)).cast("int")


def create_table(df: DataFrame, path: str, tenant: str, buckets: int = BUCKETS) -> None:
    """Store a table by buckets of its tenant, sorted by tenant, so that later writes touch only the tenants they name."""
    (df.withColumn(BUCKET, _bucket(tenant, buckets)).repartition(BUCKET, F.pmod(F.xxhash64(*df.columns), F.lit(8)))
     .sortWithinPartitions(BUCKET, tenant).write.partitionBy(BUCKET).parquet(path))


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop(BUCKET)


def _rewrite(spark: SparkSession, path: str, touched: DataFrame, tenant: str, buckets: int, change) -> None:
    """Replace the buckets of the touched tenants by what ``change`` makes of their rows; other files stay."""
    named = [r[0] for r in touched.select(_bucket(tenant, buckets).alias("b")).distinct().collect()]  # at most ``buckets``
    old = spark.read.parquet(path).filter(F.col(BUCKET).isin(named))
    new = change(old.drop(BUCKET))
    # Written elsewhere first, as the old files are read while the new rows are made. A bucket left without rows keeps an empty file.
    staged = write_version(new.withColumn(BUCKET, _bucket(tenant, buckets)), "staged")
    (staged.sortWithinPartitions(BUCKET, tenant).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(path))
    left = {r[0] for r in staged.select(BUCKET).distinct().collect()}  # at most ``buckets``
    for gone in sorted(set(named) - left):
        staged.drop(BUCKET).limit(0).write.mode("overwrite").parquet(f"{path}/{BUCKET}={gone}")


def upsert_into(spark: SparkSession, path: str, updates: DataFrame, keys: list[str], tenant: str, order: list[str], mode: str = "overwrite",
                buckets: int = BUCKETS) -> None:
    """:func:`upsert` into a table of :func:`create_table`; ``keys`` include the tenant. Updates may name a key several times."""
    folded = fold_updates(updates, keys, order, mode)
    set_cols = [c for c in updates.columns if c not in keys and c not in order]
    _rewrite(spark, path, updates, tenant, buckets, lambda old: upsert(old, folded.select(*keys, *set_cols), keys, mode=mode))


def delete_from(spark: SparkSession, path: str, gone: DataFrame, tenant: str, buckets: int = BUCKETS) -> None:
    """:func:`bulk_delete` from such a table; the columns of ``gone`` include the tenant."""
    _rewrite(spark, path, gone, tenant, buckets, lambda old: bulk_delete(old, gone)[0])


def move_in(spark: SparkSession, path: str, ids: DataFrame, status: str, buckets: int = BUCKETS) -> None:
    """:func:`bulk_move` in such a table of prospects."""
    _rewrite(spark, path, ids, "org_id", buckets, lambda old: bulk_move(old, ids, status)[0])


def write_version(df: DataFrame, name: str) -> DataFrame:
    """Store a new immutable version and return it read back."""
    spark: SparkSession = df.sparkSession
    path = new_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bulk_move(prospects: DataFrame, ids: DataFrame, status: str) -> tuple[DataFrame, DataFrame]:
    """Set the stage of listed (org_id, id) pairs; also rows affected per tenant."""
    if status not in ("lead", "prospect", "qualified", "closed"):
        raise ValueError(f"unknown stage {status!r}")
    listed = ids.select("org_id", "id").distinct().withColumn("__hit", F.lit(True))
    moved = prospects.join(listed, ["org_id", "id"], "left")
    after = moved.withColumn("status", F.when(F.col("__hit"), F.lit(status)).otherwise(F.col("status"))).drop("__hit")
    counts = (prospects.join(listed, ["org_id", "id"], "left_semi")
              .groupBy("org_id").agg(F.count(F.lit(1)).alias("affected")))
    return after.select(*prospects.columns), counts


def bulk_delete(table: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows left after removing the listed keys, and the rows removed."""
    on = keys.columns
    return table.join(keys, on, "left_anti"), table.join(keys, on, "left_semi")

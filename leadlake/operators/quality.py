"""Audits of keys, references and vocabularies."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def unique_key_audit(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys held by more than one row; rows with a null in the key are not compared."""
    keyed = df.dropna(subset=keys)
    return keyed.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).filter(F.col("copies") > 1)


def unique_keys_audit(tables: dict[str, DataFrame], rules: dict[str, list[list[str]]]) -> DataFrame:
    """Repeated keys of every table that is given: table_name, key_columns, key_value, copies."""
    parts = [unique_key_audit(tables[name], keys).select(
        F.lit(name).alias("table_name"), F.lit(",".join(keys)).alias("key_columns"),
        F.concat_ws("|", *[F.col(k).cast("string") for k in keys]).alias("key_value"), "copies")
        for name in tables for keys in rules.get(name, [])]
    return reduce(DataFrame.unionAll, parts)


def cascade_delete(tables: dict[str, DataFrame], deleted: DataFrame, parent: str,
                   rules: list[tuple[str, str, str, str]]) -> dict[str, DataFrame]:
    """Tables after deleting ``deleted`` ids of ``parent``.

    Rules (child, column, parent table, action) apply in order; action is cascade or set_null. Rules
    of tables that are not given are skipped. A null reference keeps its row.
    """
    gone = {parent: deleted.select(F.col(deleted.columns[0]).alias("id")).distinct()}
    out = dict(tables)
    out[parent] = tables[parent].join(gone[parent], "id", "left_anti")
    for child, column, owner, action in rules:
        if owner not in gone or child not in out:
            continue
        ids = gone[owner].select(F.col("id").alias(column)).distinct()
        before = out[child]
        if action == "cascade":
            lost = before.join(ids, column, "left_semi").select("id")
            gone[child] = lost if child not in gone else gone[child].unionByName(lost)
            out[child] = before.join(ids, column, "left_anti").select(*before.columns)
        else:
            hit = before.join(ids.withColumn("__gone", F.lit(True)), column, "left")
            out[child] = hit.withColumn(column, F.when(F.col("__gone").isNull(), F.col(column))).select(*before.columns)
    return out


def enum_audit(df: DataFrame, column: str, allowed: list[str]) -> DataFrame:
    """Values outside the vocabulary with their row counts; null counts as outside."""
    bad = ~F.coalesce(F.col(column).isin(allowed), F.lit(False))
    return df.filter(bad).groupBy(column).agg(F.count(F.lit(1)).alias("rows"))

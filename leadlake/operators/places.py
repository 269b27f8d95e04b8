"""Municipality lookup and ranked fuzzy matching."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadlake.functions.columns import place_key
from leadlake.plans.balance import join_hot, top_k
from leadlake.plans.textmatch import near_pairs


def location_resolve(labels: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """Exact match of a label ``City, UF`` or a numeric code, accents and case ignored."""
    by_label = gazetteer.select("code", place_key(F.concat("n", F.lit(", "), "uf")).alias("key"))
    by_code = gazetteer.select("code", F.col("code").cast("string").alias("key"))
    keys = by_label.unionByName(by_code).groupBy("key").agg(F.min("code").alias("code"))
    return join_hot(labels.withColumn("key", place_key("label")), keys, ["key"]).drop("key")


def location_fuzzy(queries: DataFrame, gazetteer: DataFrame, k: int = 8) -> DataFrame:
    """Best k places per query (qid, q): prefix hits, else near spellings."""
    asked = queries.withColumn("__q", place_key("q")).filter(F.col("__q") != "")
    distinct = asked.select("__q").distinct().withColumn("__terms", F.split("__q", r"\s+"))
    places = gazetteer.withColumn("__search", F.concat("n", F.lit(" "), F.lower("uf")))
    buckets = places.withColumn("__b", F.explode(F.array_distinct(F.array(*[
        F.substring("__search", 1, i) for i in (1, 2, 3)]))))
    probe = distinct.withColumn("__b", F.substring(F.element_at("__terms", 1), 1, 3))
    all_prefix = F.forall("__terms", lambda t: F.startswith(F.col("__search"), t) | F.exists(
        F.split("__search", " "), lambda tok: F.startswith(tok, t)))
    q = F.col("__q")
    boost = (F.when(F.col("n") == q, 100_000).when(F.startswith(F.col("__search"), q), 20_000)
             .when(F.startswith(F.col("n"), q), 10_000).otherwise(0))
    state_hit = F.exists("__terms", lambda t: (F.length(t) == 2) & (t == F.lower(F.col("uf"))))
    prefix_hits = (probe.join(buckets, "__b").filter(all_prefix)
                   .withColumn("score", F.col("importance") + boost + F.when(state_hit, 2_000).otherwise(0) - F.length("n"))
                   .select("__q", "code", "score", F.lit(0).alias("distance")))
    lost = distinct.join(prefix_hits, "__q", "left_anti").withColumn(
        "__max", F.when(F.length("__q") <= 4, 1).when(F.length("__q") <= 8, 2).otherwise(3))
    texts = gazetteer.select("code", F.col("n").alias("text")).unionByName(
        places.select("code", F.col("__search").alias("text")))
    near = (near_pairs(lost, "__q", "__max", texts, "text", ["code"], 3)
            .groupBy("__q", "code").agg(F.min("distance").alias("distance")))
    near_hits = near.join(gazetteer, "code").withColumn(
        "score", F.col("importance") + 10_000 - F.col("distance") * 1_000 - F.length("n")
    ).select("__q", "code", "score", "distance")
    ranked = top_k(prefix_hits.unionByName(near_hits), ["__q"],
                   [(F.col("distance") > 0), F.col("score").desc(), F.col("code")], k)
    return join_hot(asked.select("qid", "q", "__q"), ranked, ["__q"], "inner").drop("__q")

"""Substring and edit-distance joins built from equi-joins, so no pair is tried blindly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRAM = 3


def _with_grams(df: DataFrame, text: str, sizes: list[int]) -> DataFrame:
    """One row per distinct piece of the given sizes, in ``__gram``.

    A piece counts where it first occurs, which drops repeats without a shuffle.
    """
    t, at = F.col(text), F.col("__at")
    spots = df.withColumn("__at", F.explode(F.when(F.length(t) > 0, F.sequence(F.lit(1), F.length(t)))))
    pieces = spots.withColumn("__gram", F.explode(F.array(*[
        F.when(at + (n - 1) <= F.length(t), F.substr(t, at, F.lit(n))) for n in sizes])))
    return pieces.filter(F.instr(t, F.col("__gram")) == at).drop("__at")


def substring_pairs(needles: DataFrame, needle: str, texts: DataFrame, text: str,
                    scope: list[str], text_id: list[str]) -> DataFrame:
    """Pairs (scope, needle, text_id) where the text contains the needle. Exact.

    Texts are indexed by the pieces of up to three characters that some needle uses. Each
    distinct needle probes with its rarest piece only (a shorter needle is its own piece) and
    the match is verified, so a piece shared by most texts is not what drives the join.
    """
    wanted = needles.select(*scope, needle).filter(F.length(needle) > 0).distinct()
    probes = _with_grams(wanted, needle, [1, 2, 3]).filter(F.length("__gram") == F.least(F.lit(GRAM), F.length(needle)))
    index = (_with_grams(texts.select(*scope, *text_id, F.col(text).alias("__text")), "__text", [1, 2, 3])
             .join(probes.select(*scope, "__gram").distinct(), [*scope, "__gram"], "left_semi"))
    weights = index.groupBy(*scope, "__gram").agg(F.count(F.lit(1)).alias("__df"))
    rarest = (probes.join(weights, [*scope, "__gram"], "left")
              .groupBy(*scope, needle)
              .agg(F.min(F.struct(F.coalesce("__df", F.lit(0)).alias("df"), F.col("__gram").alias("gram"))).alias("__best"))
              .filter(F.col("__best.df") > 0)
              .select(*scope, needle, F.col("__best.gram").alias("__gram")))
    return (rarest.join(index, [*scope, "__gram"])
            .filter(F.contains(F.col("__text"), F.col(needle)))
            .select(*scope, needle, *text_id))


def _cuts(length: Column, parts: int, i: int) -> tuple[Column, Column]:
    """Start (1-based) and size of the i-th of ``parts`` near-equal pieces of a string."""
    start = F.floor(length * i / parts).cast("int")
    end = F.floor(length * (i + 1) / parts).cast("int")
    return start + 1, end - start


def near_pairs(queries: DataFrame, query: str, limit: str, names: DataFrame, name: str,
               name_id: list[str], max_limit: int) -> DataFrame:
    """Pairs (query, name_id, distance) with edit distance <= the query's own limit.

    A string within distance d of a name must contain one of the name's d+1 pieces, shifted by
    at most d (Li et al., Pass-Join, 2011). Names are indexed by (d, length, piece number,
    piece); queries probe the few substrings that can line up. Exact.
    """
    q = queries.select(query, limit).filter(F.length(query) > 0).distinct()
    indexed = None
    for d in range(1, max_limit + 1):
        for i in range(d + 1):
            start, size = _cuts(F.length(name), d + 1, i)
            part = names.select(*name_id, F.col(name).alias("__name"), F.lit(d).alias("__d"),
                                F.length(name).alias("__len"), F.lit(i).alias("__i"),
                                F.substr(F.col(name), start, size).alias("__piece"))
            indexed = part if indexed is None else indexed.unionByName(part)
    lens = (q.withColumn("__len", F.explode(F.sequence(F.greatest(F.length(query) - F.col(limit), F.lit(1)),
                                                        F.length(query) + F.col(limit))))
            .withColumn("__i", F.explode(F.sequence(F.lit(0), F.col(limit))))
            .withColumn("__s", (F.floor(F.col("__len") * F.col("__i") / (F.col(limit) + 1)) + 1).cast("int"))
            .withColumn("__n", (F.floor(F.col("__len") * (F.col("__i") + 1) / (F.col(limit) + 1)) + 1 - F.col("__s")).cast("int"))
            .withColumn("__at", F.explode(F.sequence(F.greatest(F.col("__s") - F.col(limit), F.lit(1)),
                                                      F.greatest(F.col("__s") + F.col(limit), F.lit(1))))))
    probes = (lens.withColumn("__piece", F.substr(F.col(query), F.col("__at"), F.col("__n")))
              .filter(F.length("__piece") == F.col("__n"))
              .select(query, F.col(limit).alias("__d"), "__len", "__i", "__piece").distinct())
    return (probes.join(indexed, ["__d", "__len", "__i", "__piece"])
            .select(query, *name_id, "__name", "__d").distinct()
            .withColumn("distance", F.levenshtein(F.col(query), F.col("__name")))
            .filter(F.col("distance") <= F.col("__d"))
            .select(query, *name_id, "distance"))

"""Activity classification: section -> division -> activity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leadlake.plans.scratch import cut
from leadlake.plans.textmatch import substring_pairs

TREE = (
    "secao string, nome string, oficial string, categorias array<struct<divisao:string,nome:string,"
    "atividades:array<struct<codigo:string,cnae:string,atividade:string>>>>"
)


def taxonomy_flatten(tree: DataFrame, body: str = "body") -> DataFrame:
    """Tree documents (whole or in fragments) -> one row per activity."""
    t = tree.select(F.from_json(body, TREE).alias("t")).select("t.*")
    divisions = t.select("secao", "nome", "oficial", F.explode("categorias").alias("c"))
    return divisions.select(
        F.col("secao").alias("section"), F.col("nome").alias("section_name"), F.col("oficial").alias("section_official"),
        F.col("c.divisao").alias("division"), F.col("c.nome").alias("division_name"),
        F.explode("c.atividades").alias("a"),
    ).select("section", "section_name", "section_official", "division", "division_name",
             F.col("a.codigo").alias("code"), F.col("a.cnae").alias("dotted"), F.col("a.atividade").alias("activity"))


def taxonomy_counts(flat: DataFrame) -> DataFrame:
    """Distinct activity codes and divisions per section, with a grand total row."""
    return flat.rollup("section").agg(
        F.countDistinct("code").alias("codes"), F.countDistinct("division").alias("divisions"))


def taxonomy_numbers(flat: DataFrame) -> DataFrame:
    """(section, division, code, place, and low and high of its section and division): nested-set numbers of the tree.

    Activities are numbered from 1 in order of section, division and code, so a section or division is an interval. Numbers
    run inside a division; divisions are shifted by the sizes of those before.
    """
    leaves = flat.select("section", "division", "code").distinct()
    sizes = leaves.groupBy("section", "division").agg(F.count(F.lit(1)).alias("n"))
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sections = sizes.groupBy("section").agg(F.sum("n").alias("n"))  # sections are letters: a short list
    sections = sections.select("section", before(Window.orderBy("section")).alias("s_before"), F.col("n").alias("s_n"))
    divisions = sizes.withColumn("d_before", before(Window.partitionBy("section").orderBy("division"))).withColumnRenamed("n", "d_n")
    shifts = divisions.join(F.broadcast(sections), "section")
    place = F.row_number().over(Window.partitionBy("section", "division").orderBy("code"))
    low = F.col("s_before") + F.col("d_before")
    return leaves.withColumn("at", place).join(shifts, ["section", "division"]).select(
        "section", "division", "code", (low + F.col("at")).alias("place"), (F.col("s_before") + 1).alias("s_low"), (F.col("s_before") + F.col("s_n")).alias("s_high"),
        (low + 1).alias("d_low"), (low + F.col("d_n")).alias("d_high"))


def taxonomy_match(queries: DataFrame, flat: DataFrame, numbers: DataFrame | None = None) -> DataFrame:
    """What each query keeps, as intervals of places (:func:`taxonomy_numbers`): q, level, section, division, code, low, high.

    A matching section is one row, else a matching division one row, else a matching activity; so the answer does not grow
    with the size of what matched. A blank query matches every section.
    """
    numbers = taxonomy_numbers(flat) if numbers is None else numbers
    q = queries.select(F.lower(F.trim("q")).alias("q")).distinct()
    null = F.lit(None).cast("string")

    def texts(level, by, cols, division=null, code=null):
        """Each distinct text of a level once."""
        rows = flat.select(*by, F.explode(F.array(*[F.lower(c) for c in cols])).alias("t"))
        return rows.distinct().select(F.lit(level).alias("level"), "section", division.alias("division"), code.alias("code"), "t")

    d, c = F.col("division"), F.col("code")
    searched = (texts("section", ["section"], ["section_name", "section_official"])
                .unionByName(texts("division", ["section", "division"], ["division_name"], d))
                .unionByName(texts("activity", ["section", "division", "code"], ["activity", "dotted", "code"], d, c)))
    hits = substring_pairs(q, "q", searched, "t", [], ["level", "section", "division", "code"]).distinct()
    sections = numbers.select("section", F.col("s_low").alias("low"), F.col("s_high").alias("high")).distinct()
    divisions = numbers.select("section", "division", F.col("d_low").alias("low"), F.col("d_high").alias("high")).distinct()
    named = sections.select(F.explode(F.array(F.lower("section"), F.lit(""))).alias("q"), "section").join(q, "q", "left_semi")
    s_hit = hits.filter("level = 'section'").select("q", "section").unionByName(named).distinct()
    coded = divisions.select(F.col("division").alias("q"), "section", "division").join(q, "q", "left_semi")
    d_hit = (hits.filter("level = 'division'").select("q", "section", "division").unionByName(coded).distinct()
             .join(s_hit, ["q", "section"], "left_anti"))
    a_hit = (hits.filter("level = 'activity'").select("q", "section", "division", "code").distinct()
             .join(s_hit, ["q", "section"], "left_anti").join(d_hit, ["q", "section", "division"], "left_anti"))
    cols = ["q", "level", "section", "division", "code", "low", "high"]
    place = numbers.select("section", "division", "code", F.col("place").alias("low"), F.col("place").alias("high"))
    return (s_hit.join(sections, "section").withColumns({"level": F.lit("section"), "division": null, "code": null}).select(*cols)
            .unionByName(d_hit.join(divisions, ["section", "division"]).withColumns({"level": F.lit("division"), "code": null}).select(*cols))
            .unionByName(a_hit.join(place, ["section", "division", "code"]).withColumn("level", F.lit("activity")).select(*cols)))


def taxonomy_search(queries: DataFrame, flat: DataFrame) -> DataFrame:
    """Activities kept for each query: all of a matching section, else of a matching division,
    else only the matching ones. A blank query keeps everything. One row per query and activity;
    :func:`taxonomy_match` has the same answer as intervals.
    """
    numbers = cut(taxonomy_numbers(flat), "taxonomy-numbers")
    found = cut(taxonomy_match(queries, flat, numbers), "taxonomy-match")
    leaves, cols = numbers.select("section", "division", "code"), ["q", "section", "division", "code"]
    whole = lambda level, by: found.filter(F.col("level") == level).select("q", *by).join(leaves, by).select(*cols)
    return (whole("section", ["section"]).unionByName(whole("division", ["section", "division"]))
            .unionByName(found.filter("level = 'activity'").select(*cols)))

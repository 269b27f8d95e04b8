"""Company graph: latest snapshot, drawn neighbourhood, fact display values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadlake.functions.columns import half_up
from leadlake.plans.balance import attach_rows, first_row, join_hot, top_k

MAX_EDGES = 16
MAX_NODES = 8


def company_graph_latest(snapshots: DataFrame, facts: DataFrame) -> DataFrame:
    """Facts of each company's latest snapshot with a confidence label.

    ``snapshots``: company_key, version, enriched_at. ``facts``: company_key, version and
    confidence. Companies whose latest snapshot has no fact keep one row.
    """
    latest = first_row(snapshots, ["company_key"], [F.col("enriched_at").desc_nulls_last(), F.col("version").desc()])
    label = (F.when(F.col("confidence") >= 0.85, "alta").when(F.col("confidence") >= 0.65, "média")
             .when(F.col("confidence").isNotNull(), "baixa"))
    return attach_rows(latest, facts, ["company_key", "version"]).withColumn("confidence_label", label)


def graph_neighbourhood(nodes: DataFrame, edges: DataFrame, max_edges: int = MAX_EDGES, max_nodes: int = MAX_NODES) -> DataFrame:
    """Drawable edges of each company: the first ``max_edges``, endpoints resolved, dangling ones dropped.

    ``nodes``: company_key, pos, id, type. ``edges``: company_key, pos, source_id, target_id,
    type. Adds the number of visible nodes.
    """
    company = (nodes.filter(F.col("type") == "COMPANY").groupBy("company_key")
               .agg(F.min_by("id", "pos").alias("__company")))
    shown = join_hot(nodes, company, ["company_key"])
    with_company = shown.filter(F.col("__company").isNotNull() & (F.col("id") != F.col("__company")))
    without = top_k(shown.filter(F.col("__company").isNull()), ["company_key"], [F.col("pos")], max_nodes, "__r").drop("__r")
    visible = with_company.unionByName(without).groupBy("company_key", "id").agg(F.count(F.lit(1)).alias("__n"))
    counts = visible.groupBy("company_key").agg(F.sum("__n").alias("visible_nodes"))
    drawn = top_k(edges, ["company_key"], [F.col("pos")], max_edges, "edge_rank").join(company, "company_key", "left")
    is_company = {"source": F.coalesce(F.col("source_id") == F.col("__company"), F.lit(False)) | (F.col("source_id") == "source"),
                  "target": F.coalesce(F.col("target_id") == F.col("__company"), F.lit(False))}
    ends = F.array(*[F.struct(F.lit(e).alias("end"), F.col(f"{e}_id").alias("id"), c.alias("here")) for e, c in is_company.items()])
    placed = (drawn.select("company_key", "edge_rank", "type", F.inline(ends))
              .join(visible.select("company_key", "id", F.lit(True).alias("__seen")), ["company_key", "id"], "left")
              .withColumn("place", F.when(F.col("here"), F.lit("__company__")).when(F.col("__seen"), F.col("id"))))
    edges_out = placed.groupBy("company_key", "edge_rank", "type").agg(
        F.max(F.when(F.col("end") == "source", F.col("place"))).alias("source"),
        F.max(F.when(F.col("end") == "target", F.col("place"))).alias("target"))
    return (edges_out.filter(F.col("source").isNotNull() & F.col("target").isNotNull())
            .join(counts, "company_key", "left")
            .withColumn("visible_nodes", F.coalesce("visible_nodes", F.lit(0)).cast("long")))


def graph_value_extract(facts: DataFrame, value: str = "value_json") -> DataFrame:
    """Display text of a JSON fact value and its confidence in whole percent."""
    v, kind = F.col("__v"), F.col("__kind")
    members = [F.try_variant_get(v, f"$.{m}", "string") for m in ("value", "url", "domain", "name", "label")]
    shown = (F.when(kind.isNull() | (kind == "VOID"), F.lit("—"))
             .when(kind.startswith("OBJECT"), F.coalesce(*members, F.to_json(v)))
             .otherwise(F.coalesce(F.try_variant_get(v, "$", "string"), F.to_json(v))))
    return (facts.withColumn("__v", F.try_parse_json(value)).withColumn("__kind", F.schema_of_variant("__v"))
            .withColumns({"display": shown, "percent": half_up(F.col("confidence") * 100).cast("int")}).drop("__v", "__kind"))

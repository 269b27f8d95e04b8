"""Shapes the physical plans must keep."""

import pytest

from leadlake.catalog import QUERIES

DIR = "/root/testdata/sf0.001"
SAMPLE = ["portfolio_kpis", "top_leads", "company_name_resolve", "taxonomy_search", "location_fuzzy", "sequence_decide",
          "discovery_candidates", "email_rate_audit", "graph_neighbourhood", "enrichment_apply", "recipient_pick_documents"]


def plan(spark, name):
    return QUERIES[name](spark, DIR)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", SAMPLE)
def test_no_pairwise_joins_or_python(spark, name):
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(spark, name)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython"):
        assert bad not in text, bad


def test_ranked_queries_limit_groups_early(spark):
    for name in ("top_leads", "enrichment_latest"):
        assert "WindowGroupLimit" in plan(spark, name)


def test_filters_reach_the_scan(spark):
    text = plan(spark, "reply_stats")
    schema = text.split("ReadSchema:")[1].split("\n")[0]
    assert "event_type" in schema and "value" not in schema and "props" not in schema
    text = QUERIES["registry_filter"](spark, DIR)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(r_name,ASIA)" in text

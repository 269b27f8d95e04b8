"""Registry joins, enrichment results, company graph, similarity search."""

from pyspark.sql import functions as F

from leadlake.plans.scratch import cut
from leadlake.catalog.core import query, values
from leadlake.functions import fixed
from leadlake.operators import enrich as E
from leadlake.operators import graph as G
from leadlake.operators import vectors as V

NOW = "2007-01-01 00:00:00"

# Leads with some unusable keys.
LEADS = """
SELECT id, org_id, CASE WHEN industry IS NULL THEN '123' WHEN id % 2 = 0 THEN concat(substr(cnpj, 1, 8), '/', substr(cnpj, 9)) ELSE cnpj END AS cnpj,
  company_name, trade_name, industry, CASE WHEN id % 3 = 0 THEN '' ELSE city END AS city, state, cnpj_email, enrichment_status, enriched_at
FROM {fx_prospect} p
"""
J = f"""SELECT l.*, regexp_replace(l.cnpj, '[^0-9]', '', 'g') AS d, r.cnpj AS rk, r.legal_name, r.trade_name AS r_trade, r.cnae_description, r.city AS r_city,
  r.state AS r_state, r.email FROM ({LEADS}) l LEFT JOIN {{fx_registry}} r ON r.cnpj = regexp_replace(l.cnpj, '[^0-9]', '', 'g')"""


@query("enrich_from_registry", f"""
SELECT id, org_id, cnpj, coalesce(nullif(legal_name, ''), company_name) AS company_name, coalesce(nullif(r_trade, ''), trade_name) AS trade_name,
  coalesce(cnae_description, industry) AS industry, coalesce(email, cnpj_email) AS cnpj_email,
  CASE WHEN length(d) <> 14 THEN 'error' WHEN rk IS NOT NULL THEN 'enriched' ELSE 'unavailable' END AS enrichment_status,
  CASE WHEN length(d) <> 14 THEN 'Invalid CNPJ. Expected 14 digits.' WHEN rk IS NULL THEN 'CNPJ not found in registry' END AS enrichment_error,
  'brasilapi.cnpj.v1' AS enrichment_source, TIMESTAMP '{NOW}' AS enriched_at FROM ({J})""")
def _(fx):
    return E.enrich_from_registry(fx.sql(LEADS), fx("registry"), NOW).drop("city", "state")


@query("hydrate_firmographics", f"""
SELECT id, cnpj, enrichment_status, coalesce(nullif(company_name, ''), legal_name) AS company_name, coalesce(trade_name, nullif(r_trade, '')) AS trade_name,
  coalesce(industry, cnae_description) AS industry, coalesce(nullif(city, ''), r_city) AS city, state, coalesce(cnpj_email, email) AS cnpj_email FROM ({J})""")
def _(fx):
    return E.hydrate_firmographics(fx.sql(LEADS), fx("registry")).drop("org_id", "enriched_at")


@query("enrich_registry_overwrite", f"""
SELECT id, cnpj, coalesce(legal_name, company_name) AS company_name, coalesce(nullif(r_trade, ''), trade_name) AS trade_name,
  coalesce(cnae_description, industry) AS industry, coalesce(r_city, city) AS city, coalesce(r_state, state) AS state, coalesce(email, cnpj_email) AS cnpj_email,
  CASE WHEN rk IS NOT NULL THEN 'enriched' ELSE enrichment_status END AS enrichment_status,
  CASE WHEN rk IS NOT NULL THEN TIMESTAMP '{NOW}' ELSE enriched_at END AS enriched_at FROM ({J})""")
def _(fx):
    return E.enrich_registry_overwrite(fx.sql(LEADS), fx("registry"), NOW).drop("org_id")


@query("registry_filter", f"""
SELECT cnpj, legal_name, state, cnae FROM {{fx_registry}} r
WHERE city = 'ASIA' AND upper(registration_status) IN ('ATIVA', 'ATIVO', 'ACTIVE') AND lower(legal_name) LIKE '%1%'
  AND coalesce(is_active, upper(registration_status) IN ({values(fixed.ACTIVE_REGISTRATIONS)})) """)
def _(fx):
    return E.registry_filter(fx("registry"), city="ASIA", status="ativo", name="1", is_active=True).select(
        "cnpj", "legal_name", "state", "cnae")


KEYS = """
SELECT CASE WHEN employees > 300 THEN concat(substr(cnpj, 1, 8), '/', substr(cnpj, 9)) WHEN employees IS NULL THEN substr(cnpj, 3) ELSE concat('77', substr(cnpj, 3)) END AS cnpj FROM {fx_prospect} p
UNION ALL SELECT CASE WHEN employees > 600 THEN concat('9', substr(cnpj, 2)) ELSE '' END FROM {fx_prospect} q"""
# The registry with rows that have no whole key, and with second rows of some keys.
REGISTRY = """
SELECT cnpj, legal_name, email FROM {fx_registry} a UNION ALL SELECT CASE WHEN email IS NULL THEN '' ELSE substr(cnpj, 3) END, legal_name, email FROM {fx_registry} b
UNION ALL SELECT concat(substr(cnpj, 1, 8), '/', substr(cnpj, 9)), concat('~', legal_name), NULL FROM {fx_registry} c WHERE cnae < '1020'"""


@query("registry_lookup", f"""
SELECT k.d AS cnpj_digits, r.legal_name, r.email FROM (SELECT DISTINCT regexp_replace(cnpj, '[^0-9]', '', 'g') AS d FROM ({KEYS})) k
LEFT JOIN {{fx_registry}} r ON r.cnpj = k.d""")
def _(fx):
    return E.registry_lookup(fx.sql(KEYS), fx.sql(REGISTRY)).select("cnpj_digits", "legal_name", "email")


STATUS = "CASE WHEN upper(registration_status) IN ('ATIVA', 'ATIVO', 'ACTIVE') THEN 'ATIVA' ELSE 'BAIXADA' END"


STATS = f"""
SELECT state, status, cnae, cast(grouping(state, status, cnae) AS int) AS level, count(*) AS companies, count(DISTINCT city) AS cities
FROM (SELECT state, {STATUS} AS status, cnae, city FROM {{fx_registry}} r) GROUP BY ROLLUP (state, status, cnae)"""


@query("registry_stats", STATS)
def _(fx):
    return E.registry_stats(fx("registry"), exact=True)


@query("registry_stats in increments", STATS)  # sketches are exact for so few cities
def _(fx):
    late = F.pmod(F.xxhash64("cnpj"), F.lit(3)) == 0
    stored = cut(E.registry_stats_leaves(fx("registry").filter(~late)), "stats")
    stored = cut(E.registry_stats_merge(stored, E.registry_stats_leaves(fx("registry").filter(late))), "stats")
    return E.registry_stats_report(stored)


NAMES = """
SELECT o_orderkey AS name_id, concat('org_', cast(o_custkey % 20 AS string)) AS org_id,
  CASE o_orderkey % 5 WHEN 0 THEN concat(' customer#', lpad(cast(o_custkey AS string), 9, '0')) WHEN 1 THEN concat('#', lpad(cast(o_custkey AS string), 9, '0'))
    WHEN 2 THEN 'nobody' WHEN 3 THEN cast(o_custkey AS string) ELSE 'TRADE customer' END AS name
FROM {orders}
"""


@query("company_name_resolve", f"""
WITH asked AS (SELECT *, lower(trim(name)) AS k FROM ({NAMES})), w AS (SELECT DISTINCT org_id, k FROM asked), p AS (SELECT * FROM {{fx_prospect}} x),
hits AS (SELECT w.org_id, w.k, 0 AS tier, p.id FROM w JOIN p ON p.org_id = w.org_id AND lower(p.company_name) = w.k
  UNION ALL SELECT w.org_id, w.k, 1, p.id FROM w JOIN p ON p.org_id = w.org_id AND (contains(lower(p.company_name), w.k) OR contains(lower(p.trade_name), w.k))),
best AS (SELECT org_id, k, tier, id FROM (SELECT *, row_number() OVER (PARTITION BY org_id, k ORDER BY tier, id) AS rn FROM hits) WHERE rn = 1)
SELECT a.name_id, a.org_id, b.id AS prospect_id, b.tier FROM asked a LEFT JOIN best b ON b.org_id = a.org_id AND b.k = a.k""")
def _(fx):
    return E.company_name_resolve(fx.sql(NAMES), fx("prospect"))


KEPT = """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cnpj, enrichment_version ORDER BY status = 'COMPLETED' DESC, event_ts, event_id) AS rn
  FROM {fx_enrichment_result} r) WHERE rn = 1 AND status <> 'DISCARDED'"""


@query("enrichment_latest", f"""
SELECT cnpj, enrichment_version, status, commercial_potential, event_id FROM (
  SELECT *, row_number() OVER (PARTITION BY cnpj ORDER BY enrichment_version DESC) AS k FROM ({KEPT})) WHERE k = 1""")
def _(fx):
    return E.enrichment_latest(fx("enrichment_result")).select("cnpj", "enrichment_version", "status", "commercial_potential", "event_id")


@query("enrichment_history", """
SELECT p.id AS prospect_id, p.org_id, p.cnpj, r.enrichment_version, r.status AS result_status, r.commercial_potential, r.event_ts, r.event_id
FROM {fx_prospect} p LEFT JOIN {fx_enrichment_result} r ON r.cnpj = p.cnpj""")
def _(fx):
    return E.enrichment_history(fx("prospect"), fx("enrichment_result"))


APPLY = f"""
SELECT p.id, p.org_id, CASE o.status WHEN 'COMPLETED' THEN 'enriched' WHEN 'PARTIAL' THEN 'partial' WHEN 'FAILED' THEN 'error' ELSE p.enrichment_status END AS enrichment_status,
  coalesce(o.score, p.opportunity_score) AS opportunity_score, coalesce(o.v, 0) AS enrichment_version
FROM {{fx_prospect}} p LEFT JOIN (
  SELECT cnpj, max(enrichment_version) AS v, arg_max(status, enrichment_version) AS status,
    arg_max(commercial_potential, enrichment_version) FILTER (WHERE status IN ('COMPLETED', 'PARTIAL') AND commercial_potential IS NOT NULL) AS score
  FROM ({KEPT}) GROUP BY 1) o ON o.cnpj = p.cnpj"""


@query("enrichment_apply", APPLY)
def _(fx):
    return E.enrichment_apply(fx("prospect"), fx("enrichment_result")).select(
        "id", "org_id", "enrichment_status", "opportunity_score", "enrichment_version")


ENTRY = """SELECT * FROM (SELECT *, lag(status) OVER (PARTITION BY prospect_id ORDER BY changed_at, change_id) AS previous FROM {fx_stage_change} s)
WHERE status = 'prospect' AND coalesce(previous, '') <> 'prospect'"""


@query("stage_entry", ENTRY)
def _(fx):
    return E.stage_entry(fx("stage_change"))


# --- graph ----------------------------------------------------------------------------------

@query("company_graph_latest", """
WITH s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY company_key ORDER BY enriched_at DESC NULLS LAST, version DESC) AS rn FROM {fx_snapshot} x) WHERE rn = 1)
SELECT s.company_key, s.version, s.enriched_at, f.fact_key, f.value, f.confidence,
  CASE WHEN f.confidence >= 0.85 THEN 'alta' WHEN f.confidence >= 0.65 THEN 'média' WHEN f.confidence IS NOT NULL THEN 'baixa' END AS confidence_label
FROM s LEFT JOIN {fx_fact} f ON f.company_key = s.company_key AND f.version = s.version""")
def _(fx):
    return G.company_graph_latest(fx("snapshot"), fx("fact"))


@query("graph_neighbourhood", """
WITH n AS (SELECT * FROM {fx_node} x), co AS (SELECT company_key, id AS cid FROM n WHERE type = 'COMPANY'),
vis AS (SELECT n.company_key, n.id FROM n JOIN co ON co.company_key = n.company_key WHERE n.id <> cid
  UNION ALL SELECT company_key, id FROM (SELECT n.*, row_number() OVER (PARTITION BY n.company_key ORDER BY pos) AS rn FROM n
    WHERE NOT EXISTS (SELECT 1 FROM co WHERE co.company_key = n.company_key)) WHERE rn <= 8),
e AS (SELECT * FROM (SELECT *, cast(row_number() OVER (PARTITION BY company_key ORDER BY pos) AS int) AS edge_rank FROM {fx_edge} y) WHERE edge_rank <= 16)
SELECT e.company_key, edge_rank, CASE WHEN e.source_id = 'source' OR coalesce(e.source_id = cid, FALSE) THEN '__company__' ELSE e.source_id END AS source,
  CASE WHEN coalesce(e.target_id = cid, FALSE) THEN '__company__' ELSE e.target_id END AS target, e.type,
  (SELECT count(*) FROM vis WHERE vis.company_key = e.company_key) AS visible_nodes
FROM e LEFT JOIN co ON co.company_key = e.company_key
WHERE (e.source_id = 'source' OR coalesce(e.source_id = cid, FALSE) OR EXISTS (SELECT 1 FROM vis WHERE vis.company_key = e.company_key AND vis.id = e.source_id))
  AND (coalesce(e.target_id = cid, FALSE) OR EXISTS (SELECT 1 FROM vis WHERE vis.company_key = e.company_key AND vis.id = e.target_id))""")
def _(fx):
    return G.graph_neighbourhood(fx("node"), fx("edge"))


FACT_JSON = """
SELECT l_orderkey AS company_key, l_linenumber AS fact_no, (50 + 5 * cast(round(l_discount * 100) AS int)) / cast(100 AS double) AS confidence,
  CASE l_partkey % 8 WHEN 0 THEN concat('"text ', cast(l_partkey AS string), '"') WHEN 1 THEN cast(l_partkey AS string)
    WHEN 2 THEN concat('{"value":', cast(l_partkey AS string), '}') WHEN 3 THEN concat('{"label":"l","url":"http://x/', cast(l_partkey AS string), '"}')
    WHEN 4 THEN '{"other":1}' WHEN 5 THEN 'true' WHEN 6 THEN NULL ELSE '{"value":null,"name":"n"}' END AS value_json
FROM {lineitem}
"""


@query("graph_value_extract", f"""
SELECT company_key, fact_no, confidence, value_json, cast(floor(confidence * 100 + 0.5) AS int) AS percent,
  CASE WHEN value_json IS NULL THEN '—' WHEN value_json LIKE '{{%' THEN coalesce(value_json->>'$.value', value_json->>'$.url', value_json->>'$.domain',
    value_json->>'$.name', value_json->>'$.label', value_json) ELSE value_json->>'$' END AS display FROM ({FACT_JSON})""")
def _(fx):
    return G.graph_value_extract(fx.sql(FACT_JSON))


# --- similarity -----------------------------------------------------------------------------

@query("registry_search", """
WITH q AS (SELECT label AS query_id, arg_min(embedding, vec_id) AS e FROM {embeddings} GROUP BY label),
s AS (SELECT q.query_id, v.vec_id, list_cosine_similarity(cast(q.e AS double[]), cast(v.embedding AS double[])) AS sim FROM q CROSS JOIN {embeddings} v)
SELECT query_id, vec_id, rank FROM (SELECT *, cast(row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, vec_id) AS int) AS rank FROM s) WHERE rank <= 20""")
def _(fx):
    v = fx.table("embeddings")
    q = v.groupBy(F.col("label").alias("query_id")).agg(F.min_by("embedding", "vec_id").alias("embedding"))
    return V.registry_search(q, v, 20).select("query_id", "vec_id", "rank")


@query("registry_search filtered", """
WITH v AS (SELECT *, concat('S', cast(vec_id % 5 AS varchar)) AS state, CASE WHEN vec_id % 7 > 0 THEN concat('C', cast(vec_id % 3 AS varchar)) END AS city, vec_id % 4 AS code FROM {embeddings}),
q AS (SELECT label AS query_id, arg_min(embedding, vec_id) AS e, CASE WHEN label % 2 = 0 THEN concat('S', cast(label % 5 AS varchar)) END AS state,
  CASE WHEN label % 3 = 0 THEN 'C1' END AS city, CASE WHEN label % 5 = 1 THEN cast(2 AS bigint) END AS code FROM {embeddings} GROUP BY label),
s AS (SELECT q.query_id, v.vec_id, list_cosine_similarity(cast(q.e AS double[]), cast(v.embedding AS double[])) AS sim FROM q JOIN v
  ON coalesce(q.state = v.state, q.state IS NULL) AND (q.city IS NULL OR coalesce(q.city = v.city, FALSE)) AND (q.code IS NULL OR q.code = v.code))
SELECT query_id, vec_id, rank FROM (SELECT *, cast(row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, vec_id) AS int) AS rank FROM s) WHERE rank <= 20""")
def _(fx):
    number = lambda name, c, by: F.concat(F.lit(name), (F.col(c) % by).cast("string"))
    v = fx.table("embeddings")
    q = v.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("embedding")).select(
        F.col("label").alias("query_id"), "embedding", F.when(F.col("label") % 2 == 0, number("S", "label", 5)).alias("state"),
        F.when(F.col("label") % 3 == 0, F.lit("C1")).alias("city"), F.when(F.col("label") % 5 == 1, F.lit(2).cast("long")).alias("code"))
    firms = v.select("vec_id", "embedding", number("S", "vec_id", 5).alias("state"), F.when(F.col("vec_id") % 7 > 0, number("C", "vec_id", 3)).alias("city"),
                     (F.col("vec_id") % 4).alias("code"))
    return V.registry_search(q, firms, 20).select("query_id", "vec_id", "rank")


def _twentieth(v):
    """As queries every vector whose id is divisible by 20."""
    return v.filter(F.col("vec_id") % 20 == 0).withColumnRenamed("vec_id", "query_id")


@query("registry_search every 20th")  # against brute force in tests/test_search_all.py, as the pairs are too many for SQL
def _(fx):
    v = fx.table("embeddings").select("vec_id", "embedding")
    return V.registry_search(_twentieth(v), v, 20).select("query_id", "vec_id", "rank")


@query("registry_search filtered every 20th")
def _(fx):
    number = lambda name, c, by: F.concat(F.lit(name), (F.col(c) % by).cast("string"))
    v = fx.table("embeddings").select("vec_id", "embedding", number("S", "vec_id", 5).alias("state"), F.when(F.col("vec_id") % 7 > 0, number("C", "vec_id", 3)).alias("city"))
    asked = _twentieth(v).withColumn("state", F.when(F.col("query_id") % 40 == 0, F.col("state")))
    return V.registry_search(asked, v, 20).select("query_id", "vec_id", "rank")

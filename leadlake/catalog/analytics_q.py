"""Pipeline analytics, listings and scores."""

from pyspark.sql import functions as F

from leadlake.catalog.core import query, values
from leadlake.functions import fixed
from leadlake.operators import analytics as A
from leadlake.operators import listing as L
from leadlake.operators import scoring as S

AS_OF = "2007-01-01"

SUMMARY = """
SELECT org_id, count(*) AS total, count(*) FILTER (WHERE status = 'qualified') AS qualified,
  count(*) FILTER (WHERE status = 'prospect') AS prospects, count(*) FILTER (WHERE status = 'lead') AS leads
FROM {fx_prospect} p GROUP BY org_id
"""
FORECAST = """
SELECT org_id, qualified, this_month, next_month, (this_month * 25 + 5) // 10 AS quarter, (next_month * 25 + 5) // 10 AS quarter_compounded
FROM (SELECT *, (this_month * 115 + 50) // 100 AS next_month
  FROM (SELECT org_id, count(*) FILTER (WHERE status = 'qualified') AS qualified,
    count(*) FILTER (WHERE status = 'qualified') * 15000 AS this_month FROM {fx_prospect} p GROUP BY org_id))
"""
DEALS = f"""
SELECT p.*, p.revenue_estimate > 0 IS TRUE AS is_stated,
  CASE WHEN p.revenue_estimate > 0 THEN cast(p.revenue_estimate AS double)
    ELSE cast(coalesce(nullif(f.quarter, 0), nullif(f.next_month, 0), nullif(f.this_month, 0), 0) AS double) * cast(greatest(1, coalesce(p.opportunity_score, 0)) AS double)
      / cast(sum(greatest(1, coalesce(p.opportunity_score, 0))) OVER (PARTITION BY p.org_id) AS double) END AS deal_value
FROM {{fx_prospect}} p JOIN ({FORECAST}) f ON p.org_id = f.org_id
"""
# Group values in cents: stated revenue plus the group's share of the tenant's forecast.
MIX = f"""
SELECT org_id, status, industry, count, high_intent, stated * 100 + cast(floor(cast(pool AS double) * cast(open AS double) / cast(total AS double) * 100 + 0.5) AS hugeint) AS cents FROM (
  SELECT g.*, f.quarter AS pool, sum(g.weight) OVER (PARTITION BY g.org_id) AS total FROM (
    SELECT org_id, status, coalesce(industry, 'Não classificado') AS industry, count(*) AS count, count(*) FILTER (WHERE opportunity_score >= 75) AS high_intent,
      sum(CASE WHEN revenue_estimate > 0 THEN revenue_estimate ELSE 0 END) AS stated, sum(greatest(1, coalesce(opportunity_score, 0))) AS weight,
      sum(CASE WHEN revenue_estimate > 0 THEN 0 ELSE greatest(1, coalesce(opportunity_score, 0)) END) AS open
    FROM {{fx_prospect}} p GROUP BY 1, 2, 3) g JOIN ({FORECAST}) f ON f.org_id = g.org_id)
"""


@query("pipeline_summary", f"""
SELECT *, cast(qualified AS double) / cast(total AS double) AS qualification_rate,
  (200 * qualified + total) // (2 * total) AS qualification_pct, (17000 * qualified + 100 * total) // (200 * total) AS closure_pct
FROM ({SUMMARY})""")
def _(fx):
    return A.pipeline_summary(fx("prospect"))


@query("status_counts", """
SELECT org_id, count(*) FILTER (WHERE status = 'qualified') AS qualified, count(*) FILTER (WHERE status = 'prospect') AS prospect,
  count(*) FILTER (WHERE status = 'lead') AS lead, count(*) FILTER (WHERE status = 'contacted') AS contacted,
  count(*) FILTER (WHERE status = 'proposal') AS proposal, count(*) FILTER (WHERE status = 'closed') AS closed,
  count(*) FILTER (WHERE status NOT IN ('qualified', 'prospect', 'lead', 'contacted', 'proposal', 'closed')) AS other, count(*) AS total
FROM {fx_prospect} p GROUP BY org_id""")
def _(fx):
    return A.status_counts(fx("prospect"))


@query("status_breakdown", """
SELECT org_id, status, count(*) AS count, cast(floor(avg(opportunity_score) + 0.5) AS bigint) AS avg_score
FROM {fx_prospect} p GROUP BY org_id, status""")
def _(fx):
    return A.status_breakdown(fx("prospect"))


@query("revenue_forecast", f"SELECT org_id, qualified, this_month, next_month, quarter FROM ({FORECAST})")
def _(fx):
    return A.revenue_forecast(fx("prospect"))


@query("revenue_forecast_compounded", f"SELECT org_id, qualified, this_month, next_month, quarter_compounded AS quarter FROM ({FORECAST})")
def _(fx):
    return A.revenue_forecast_compounded(fx("prospect"))


@query("plan_usage", """
SELECT coalesce(o.id, c.org_id) AS org_id, CASE WHEN plan = 'premium' THEN 'premium' ELSE 'trial' END AS plan, coalesce(n, 0) AS leads,
  CASE WHEN plan = 'premium' THEN NULL ELSE 10 END AS lead_limit,
  CASE WHEN plan = 'premium' THEN NULL ELSE greatest(0, 10 - coalesce(n, 0)) END AS remaining,
  coalesce(plan, '') <> 'premium' AND coalesce(n, 0) >= 10 AS at_limit, coalesce(plan, '') = 'premium' AS can_export
FROM {fx_organization} o FULL JOIN (SELECT org_id, count(*) AS n FROM {fx_prospect} p GROUP BY org_id) c ON o.id = c.org_id""")
def _(fx):
    return A.plan_usage(fx("organization"), fx("prospect"))


@query("deal_value_impute", f"SELECT org_id, id, is_stated, deal_value FROM ({DEALS})")
def _(fx):
    return A.deal_value_impute(fx("prospect")).select("org_id", "id", "is_stated", "deal_value")


def mix(fx):
    return A.deal_mix(fx("prospect"))


@query("industry_breakdown", f"""
SELECT org_id, industry, count, value_cents, rank FROM (
  SELECT *, cast(row_number() OVER (PARTITION BY org_id ORDER BY count DESC, industry) AS int) AS rank FROM (
    SELECT org_id, industry, cast(sum(count) AS bigint) AS count, cast(sum(cents) AS bigint) AS value_cents FROM ({MIX}) GROUP BY 1, 2)) WHERE rank <= 4""")
def _(fx):
    return A.industry_breakdown(mix(fx))


STAGE_ROWS = ", ".join(f"('{s}', '{label}', {w})" for s, (label, w) in fixed.STAGES.items())


@query("pipeline_stages", f"""
WITH per AS (SELECT org_id, status, cast(sum(count) AS bigint) AS n, cast(sum(cents) AS bigint) AS v FROM ({MIX}) GROUP BY 1, 2),
 tot AS (SELECT org_id, sum(n) AS total FROM per GROUP BY 1), st(status, label, w) AS (VALUES {STAGE_ROWS})
SELECT tot.org_id, st.status, st.label, coalesce(per.n, 0) AS count, coalesce(per.v, 0) AS value_cents,
  cast((200 * coalesce(per.n, 0) + total) // (2 * total) AS bigint) AS pct
FROM tot CROSS JOIN st LEFT JOIN per ON per.org_id = tot.org_id AND per.status = st.status
WHERE coalesce(per.n, 0) > 0 OR st.status IN ('qualified', 'prospect', 'lead')""")
def _(fx):
    return A.pipeline_stages(mix(fx))


@query("portfolio_kpis", f"""
WITH st(status, label, w) AS (VALUES {STAGE_ROWS}), s AS ({SUMMARY}),
k AS (SELECT m.org_id, cast(sum(count) AS bigint) AS deals, cast(sum(cents) AS bigint) AS total_cents, cast(sum(cents * coalesce(w, 38)) AS bigint) AS weighted,
  cast(sum(high_intent) AS bigint) AS high_intent FROM ({MIX}) m LEFT JOIN st ON st.status = m.status GROUP BY m.org_id)
SELECT k.org_id, deals, total_cents, cast(total_cents AS double) / cast(deals AS double) AS avg_ticket_cents, weighted, high_intent,
  least(100, (200 * s.qualified + s.total) // (2 * s.total)) AS target_progress, (200 * s.qualified + s.total) // (2 * s.total) AS rate_pct
FROM k JOIN s ON s.org_id = k.org_id""")
def _(fx):
    return A.portfolio_kpis(mix(fx))


@query("revenue_series", f"""
WITH f AS ({FORECAST}), s AS ({SUMMARY}), k AS (SELECT org_id, cast(sum(count) AS bigint) AS deals, cast(sum(cents) AS bigint) AS total_cents FROM ({MIX}) GROUP BY 1),
j AS (SELECT k.*, f.this_month, f.next_month, f.quarter, s.qualified, s.prospects, s.leads FROM k JOIN f USING (org_id) JOIN s USING (org_id))
SELECT org_id, 0 AS pos, 'Hoje' AS label, total_cents AS value_cents, deals FROM j
UNION ALL SELECT org_id, 1, 'Mês atual', this_month * 100, greatest(qualified, 1) FROM j
UNION ALL SELECT org_id, 2, 'Próx. mês', next_month * 100, greatest(qualified + prospects, 1) FROM j
UNION ALL SELECT org_id, 3, 'Q3', quarter * 100, greatest(deals + leads, 1) FROM j""")
def _(fx):
    return A.revenue_series(mix(fx))


@query("kanban_totals", """
SELECT o.org_id, st.status, count(p.id) AS count, cast(coalesce(sum(p.revenue_estimate), 0) AS bigint) AS revenue
FROM (SELECT DISTINCT org_id FROM {fx_prospect} x) o CROSS JOIN (VALUES ('lead'), ('prospect'), ('qualified'), ('closed')) st(status)
LEFT JOIN {fx_prospect} p ON p.org_id = o.org_id AND p.status = st.status GROUP BY 1, 2""")
def _(fx):
    return A.kanban_totals(fx("prospect"))


@query("contact_coverage", """
SELECT p.org_id, cast(sum(coalesce(a.n, 0)) AS bigint) AS partners, count(*) FILTER (WHERE cnpj_email IS NOT NULL) AS with_email,
  cast(sum(coalesce(b.n, 0)) AS bigint) AS phones
FROM {fx_prospect} p LEFT JOIN (SELECT prospect_id, count(*) n FROM {fx_partner} x GROUP BY 1) a ON a.prospect_id = p.id
LEFT JOIN (SELECT prospect_id, count(*) n FROM {fx_phone} x GROUP BY 1) b ON b.prospect_id = p.id GROUP BY 1""")
def _(fx):
    return A.contact_coverage(fx("prospect").withColumnRenamed("cnpj_email", "email"), fx("phone"), fx("partner"))


@query("industry_distinct", "SELECT DISTINCT org_id, industry FROM {fx_prospect} p WHERE industry IS NOT NULL")
def _(fx):
    return A.industry_distinct(fx("prospect"))


TOP = """SELECT *, cast(row_number() OVER (PARTITION BY org_id ORDER BY opportunity_score DESC, id) AS int) AS rank FROM {fx_prospect} p"""


@query("top_leads", f"SELECT org_id, id, opportunity_score, rank FROM ({TOP}) WHERE rank <= 5")
def _(fx):
    return A.top_leads(fx("prospect")).select("org_id", "id", "opportunity_score", "rank")


@query("priority_tasks", f"""
SELECT org_id, rank, id AS prospect_id,
  (CASE rank WHEN 1 THEN 'Retomar conversa com ' WHEN 2 THEN 'Preparar proposta para ' ELSE 'Confirmar informações de ' END) || company_name AS title,
  coalesce(industry, 'Lead') || ' · Potencial ' || opportunity_score || '/100' AS subtitle,
  CASE rank WHEN 1 THEN 'Alta' WHEN 2 THEN 'Média' ELSE 'Baixa' END AS priority,
  CASE rank WHEN 1 THEN 'Hoje' WHEN 2 THEN 'Amanhã' ELSE 'Esta semana' END AS due FROM ({TOP}) WHERE rank <= 3""")
def _(fx):
    return A.priority_tasks(fx("prospect"))


# --- listings -------------------------------------------------------------------------------

@query("prospect_list", "SELECT *, count(*) OVER (PARTITION BY org_id) AS total FROM {fx_prospect} p")
def _(fx):
    return L.prospect_list(fx("prospect"))


@query("prospect_list_by_score", """
SELECT org_id, id, cnpj, company_name, status, opportunity_score, revenue_estimate, employees, industry, created_at FROM {fx_prospect} p""")
def _(fx):
    return L.prospect_list_by_score(fx("prospect"))


@query("list_recent", """
SELECT tenant_id, id, campaign_id, status, created_at, count(*) OVER (PARTITION BY tenant_id) AS total FROM {fx_outreach_contact} c""")
def _(fx):
    return L.list_recent(fx("outreach_contact"), "tenant_id", "created_at", ["id", "campaign_id", "status"])


@query("plan_redact", """
SELECT p.org_id, p.id, p.company_name, CASE WHEN o.plan = 'premium' THEN p.cnpj_email END AS cnpj_email,
  CASE WHEN o.plan = 'premium' THEN p.cnpj_opened_at END AS cnpj_opened_at,
  CASE WHEN o.plan = 'premium' THEN p.cnpj_legal_nature END AS cnpj_legal_nature, coalesce(o.plan, '') <> 'premium' AS data_restricted
FROM {fx_prospect} p LEFT JOIN {fx_organization} o ON o.id = p.org_id""")
def _(fx):
    cols = ["org_id", "id", "company_name", "cnpj_email", "cnpj_opened_at", "cnpj_legal_nature"]
    return L.plan_redact(fx("prospect").select(*cols), fx("organization"))


@query("enriched_contact_list", """
SELECT org_id, id, cnpj, company_name, trade_name, industry, status, opportunity_score, cnpj_email AS email, cnpj_opened_at AS opened_at,
  cnpj_legal_nature AS legal_nature, enrichment_status, enriched_at, created_at
FROM {fx_prospect} p WHERE enriched_at >= TIMESTAMP '2000-06-01 00:00:00' AND enriched_at <= TIMESTAMP '2001-06-30 23:59:59.999' AND enrichment_status = 'enriched'""")
def _(fx):
    return L.enriched_contact_list(fx("prospect"), "2000-06-01", "2001-06-30", "enriched")


@query("enrichment_backlog", """
SELECT org_id, id, enrichment_status, created_at, rank FROM (
  SELECT *, cast(row_number() OVER (PARTITION BY org_id ORDER BY created_at DESC NULLS FIRST, id) AS int) AS rank FROM {fx_prospect} p
  WHERE created_at >= TIMESTAMP '1995-01-01 00:00:00' AND (enrichment_status IN ('pending', 'error', 'unavailable') OR enriched_at IS NULL)) WHERE rank <= 40""")
def _(fx):
    return L.enrichment_backlog(fx("prospect"), frm="1995-01-01", limit=40).select("org_id", "id", "enrichment_status", "created_at", "rank")


@query("prospect_facets", """
SELECT org_id, id, company_name FROM {fx_prospect} p
WHERE lower(concat_ws(' ', company_name, industry, trade_name)) LIKE '%mach%' AND lower(concat_ws(' ', city, state)) LIKE '%asia%'
  AND coalesce(employees, 0) > 50 AND coalesce(employees, 0) <= 250 AND 2007 - year(created_at) > 10""")
def _(fx):
    return L.prospect_facets(fx("prospect"), AS_OF, text="Mach", location="Asia", size="medium", age="established").select(
        "org_id", "id", "company_name")


@query("contact_search", """
SELECT id, cnpj, company_name FROM {fx_lead} l JOIN (SELECT id AS i, cnpj, cnpj_email FROM {fx_prospect} q) p ON p.i = l.id
WHERE lower(company_name) LIKE '%12%' OR cnpj LIKE '%12%' OR lower(coalesce(cnpj_email, '')) LIKE '%12%' OR lower(coalesce(partner_name, '')) LIKE '%12%'""")
def _(fx):
    partner = F.array(F.struct(F.col("partner_name").alias("name"), F.col("partner_role").alias("qualification")))
    leads = fx("lead").select("id", partner.alias("partners"))
    p = fx("prospect").select("id", "cnpj", "company_name", F.col("cnpj_email").alias("email")).join(leads, "id")
    return L.contact_search(p, "12").select("id", "cnpj", "company_name")


# --- scores ---------------------------------------------------------------------------------

@query("credit_risk_score", """
WITH b AS (SELECT p.*, EXISTS (SELECT 1 FROM {fx_phone} f WHERE f.prospect_id = p.id) AS has_phone,
    epoch_us(TIMESTAMP '2007-01-01 00:00:00') - epoch_us(cast(cnpj_opened_at AS timestamp)) AS age FROM {fx_prospect} p),
s AS (SELECT *, 50 + cast(floor(coalesce(opportunity_score, 0) * 35 / 100.0 + 0.5) AS int)
  + CASE WHEN employees >= 500 THEN 15 WHEN employees >= 100 THEN 12 WHEN employees >= 20 THEN 8 WHEN employees >= 5 THEN 4 ELSE 0 END
  + CASE WHEN revenue_estimate >= 5000000 THEN 20 WHEN revenue_estimate >= 1000000 THEN 15 WHEN revenue_estimate >= 250000 THEN 10 WHEN revenue_estimate >= 50000 THEN 5 ELSE 0 END
  + CASE WHEN age IS NULL OR age < 0 THEN 0 WHEN age >= 315576000000000 THEN 30 WHEN age >= 157788000000000 THEN 24 WHEN age >= 63115200000000 THEN 16 WHEN age >= 31557600000000 THEN 8 ELSE 2 END
  + CASE WHEN enrichment_status = 'enriched' THEN 10 ELSE 0 END + CASE WHEN cnpj_email IS NOT NULL THEN 5 ELSE 0 END + CASE WHEN has_phone THEN 5 ELSE 0 END AS raw FROM b)
SELECT org_id, id, cast(least(100, greatest(0, raw)) AS int) AS risk_score,
  CASE WHEN raw >= 70 THEN 'low' WHEN raw >= 40 THEN 'medium' ELSE 'high' END AS risk_level,
  concat_ws(',', CASE WHEN age IS NULL THEN 'company_age_unknown' WHEN age >= 315576000000000 THEN 'company_longevity' WHEN age >= 63115200000000 THEN 'company_age' ELSE 'company_recent' END,
    CASE WHEN cnpj_email IS NOT NULL THEN 'corporate_email_present' END, CASE WHEN has_phone THEN 'phone_present' END,
    CASE WHEN enrichment_status = 'enriched' THEN 'officially_enriched' END, CASE WHEN employees >= 100 THEN 'company_size' END,
    CASE WHEN revenue_estimate >= 1000000 THEN 'revenue_potential' END) AS factors,
  CASE WHEN age > 0 THEN cast(floor(cast(age AS double) * 10 / 31557600000000.0 + 0.5) AS bigint) END AS age_tenths FROM s""")
def _(fx):
    phoned = fx("phone").select(F.col("prospect_id").alias("id")).distinct().withColumn("has_phone", F.lit(True))
    scored = S.credit_risk_score(fx("prospect").join(phoned, "id", "left"), AS_OF)
    return scored.select("org_id", "id", "risk_score", "risk_level", F.array_join("factors", ",").alias("factors"), "age_tenths")


@query("lead_qualify", """
SELECT org_id, id, least(100, greatest(0, opportunity_score)) AS score,
  CASE WHEN opportunity_score >= 70 THEN 'qualified' WHEN opportunity_score >= 40 THEN 'prospect' ELSE 'lead' END AS level,
  CASE WHEN enrichment_status = 'enriched' THEN '0.90' WHEN cnpj_email IS NOT NULL OR cnpj_legal_nature IS NOT NULL THEN '0.65' ELSE '0.50' END AS confidence
FROM {fx_prospect} p""")
def _(fx):
    return S.lead_qualify(fx("prospect")).select("org_id", "id", "score", "level", "confidence")


@query("icp_qualify", f"""
SELECT org_id, id, cast(least(100, s) AS int) AS icp_score, CASE WHEN s >= 75 THEN 'qualified' WHEN s >= 50 THEN 'prospect' ELSE 'lead' END AS icp_level
FROM (SELECT *, 50 + CASE WHEN industry IN ({values(fixed.TECH_SEGMENTS)}) THEN 20 ELSE 0 END + CASE WHEN employees >= 100 THEN 15 ELSE 0 END
  + CASE WHEN employees >= 500 THEN 10 ELSE 0 END + CASE WHEN revenue_estimate >= 1000000 THEN 15 ELSE 0 END
  + CASE WHEN revenue_estimate >= 5000000 THEN 10 ELSE 0 END AS s
  FROM (SELECT org_id, id, CASE industry WHEN 'MACHINERY' THEN 'Technology' ELSE industry END AS industry, employees, revenue_estimate FROM {{fx_prospect}} p))""")
def _(fx):
    tech = F.when(F.col("industry") == "MACHINERY", "Technology").otherwise(F.col("industry"))
    return S.icp_qualify(fx("prospect").withColumn("industry", tech)).select("org_id", "id", "icp_score", "icp_level")

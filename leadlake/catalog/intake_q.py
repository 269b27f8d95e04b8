"""Identifiers, phones, profiles, intake and keyed writes."""

from pyspark.sql import functions as F

from leadlake.catalog.core import query, values
from leadlake.functions import fixed
from leadlake.operators import intake as I
from leadlake.sources import upsert as U


@query("org_scope", """
SELECT p.id, p.org_id, p.company_name FROM {fx_prospect} p WHERE org_id IN (SELECT id FROM {fx_organization} o WHERE plan = 'premium')""")
def _(fx):
    orgs = fx("organization").filter("plan = 'premium'").select("id")
    return I.org_scope(fx("prospect"), orgs).select("id", "org_id", "company_name")


REQUESTS = """
SELECT o_orderkey AS request_id, concat('org_', cast(o_custkey % 20 AS string)) AS org_id, o_custkey AS prospect_id, 0 AS pos FROM {orders} a
UNION ALL SELECT o_orderkey, concat('org_', cast(o_custkey % 20 AS string)), o_custkey + 20, 1 FROM {orders} b
UNION ALL SELECT o_orderkey, concat('org_', cast(o_custkey % 20 AS string)), o_custkey + 1, 2 FROM {orders} c WHERE o_orderpriority = '2-HIGH'
"""


@query("owned_ids_check", f"""
SELECT request_id, org_id, count(*) AS requested, count(own) AS owned, count(*) = count(own) AS valid
FROM (SELECT DISTINCT r.request_id, r.org_id, r.prospect_id, p.id AS own FROM ({REQUESTS}) r
  LEFT JOIN {{fx_prospect}} p ON p.id = r.prospect_id AND p.org_id = r.org_id) GROUP BY 1, 2""")
def _(fx):
    return I.owned_ids_check(fx.sql(REQUESTS), fx("prospect"))


CNPJS = """
SELECT id, CASE WHEN id % 10 = 3 THEN concat(' ', substr(cnpj, 4)) WHEN id % 10 = 4 THEN NULL
  WHEN id % 2 = 0 THEN concat(substr(cnpj, 1, 8), '/', substr(cnpj, 9)) ELSE concat(substr(cnpj, 7, 8), '000199') END AS cnpj FROM {fx_prospect} p
"""


@query("cnpj_standardise", f"""
SELECT id, cnpj, d AS cnpj_digits, length(d) = 14 AS cnpj_valid, f AS cnpj_formatted, contains(f, '/0001-') AS is_headquarters
FROM (SELECT *, CASE WHEN length(d) = 14 THEN substr(d, 1, 2) || '.' || substr(d, 3, 3) || '.' || substr(d, 6, 3) || '/' || substr(d, 9, 4) || '-' || substr(d, 13, 2)
  ELSE coalesce(cnpj, '') END AS f FROM (SELECT *, regexp_replace(coalesce(cnpj, ''), '[^0-9]', '', 'g') AS d FROM ({CNPJS})))""")
def _(fx):
    return I.cnpj_standardise(fx.sql(CNPJS))


PHONES = """
SELECT *, CASE WHEN d = '' THEN NULL WHEN length(nat) BETWEEN 10 AND 11 THEN '55' || nat ELSE nat END AS phone,
  length(d) BETWEEN 10 AND 11 OR (length(d) BETWEEN 12 AND 13 AND d LIKE '55%') AS strict
FROM (SELECT *, CASE WHEN d LIKE '55%' AND length(d) >= 12 THEN substr(d, 3) ELSE d END AS nat
  FROM (SELECT *, regexp_replace(raw_phone, '[^0-9]', '', 'g') AS d FROM {fx_phone} p))
"""


@query("phone_standardise", f"""
SELECT org_id, prospect_id, phone, min(pos) AS pos, bool_or(strict) AS is_strict, phone || '@c.us' AS chat_id, phone AS phone_back
FROM ({PHONES}) WHERE phone IS NOT NULL GROUP BY 1, 2, 3""")
def _(fx):
    return I.phone_standardise(fx("phone"))


MAILS = """
SELECT id, CASE id % 9 WHEN 0 THEN 'nobody' WHEN 1 THEN '@half.com' WHEN 2 THEN 'half@' WHEN 3 THEN ' Ana@Hotmail.com '
  WHEN 4 THEN 'x@partner.com.br' ELSE cnpj_email END AS email FROM {fx_prospect} p
"""


@query("email_domain_gate", f"""
SELECT id, email, CASE WHEN NOT bad THEN domain END AS domain,
  CASE WHEN bad THEN 'malformed' WHEN domain IN ({values(fixed.FREE_EMAIL_DOMAINS)}) THEN 'free' ELSE 'corporate' END AS verdict
FROM (SELECT *, domain = '' OR length(domain) + 1 >= length(e) AS bad FROM (SELECT *, split_part(e, '@', -1) AS domain
  FROM (SELECT *, lower(trim(coalesce(email, ''))) AS e FROM ({MAILS}))))""")
def _(fx):
    return I.email_domain_gate(fx.sql(MAILS))


PLACES = """
SELECT id, CASE id % 5 WHEN 0 THEN concat(city, ' (sp)') WHEN 1 THEN concat(' ', city, ', Rj ') WHEN 2 THEN 'mg' WHEN 3 THEN NULL ELSE city END AS location
FROM {fx_prospect} p
"""


@query("location_parse", f"""
SELECT id, location, nullif(CASE WHEN bare THEN '' WHEN a <> '' THEN trim(regexp_replace(raw, '\\([A-Za-z]{{2}}\\)', ''))
   WHEN b <> '' THEN trim(regexp_replace(raw, ',\\s*[A-Za-z]{{2}}\\s*$', '')) ELSE raw END, '') AS city,
  CASE WHEN bare THEN upper(raw) WHEN a <> '' THEN upper(a) WHEN b <> '' THEN upper(b) END AS state
FROM (SELECT *, regexp_matches(raw, '^[A-Za-z]{{2}}$') AS bare, regexp_extract(raw, '\\(([A-Za-z]{{2}})\\)', 1) AS a,
  regexp_extract(raw, ',\\s*([A-Za-z]{{2}})\\s*$', 1) AS b FROM (SELECT *, trim(coalesce(location, '')) AS raw FROM ({PLACES})))""")
def _(fx):
    return I.location_parse(fx.sql(PLACES))


RAW_PROFILE = """
SELECT c_custkey AS pid, CASE c_custkey % 3 WHEN 0 THEN '  ' WHEN 1 THEN NULL ELSE concat(' ', c_name) END AS company_name,
  CASE c_custkey % 4 WHEN 0 THEN '' WHEN 1 THEN concat(c_mktsegment, ', ,retail ') ELSE 'a,b' END AS target_segments,
  CASE c_custkey % 2 WHEN 0 THEN '' ELSE ' active, inactive' END AS company_statuses,
  CASE c_custkey % 5 WHEN 0 THEN 'x' WHEN 1 THEN '-2' WHEN 2 THEN '2.7' WHEN 3 THEN '9' END AS onboarding_step,
  CASE c_custkey % 4 WHEN 0 THEN '' WHEN 1 THEN '0' WHEN 2 THEN '1500.5' ELSE 'abc' END AS average_ticket
FROM {customer}
"""


@query("profile_normalise", f"""
SELECT pid, nullif(trim(company_name), '') AS company_name,
  array_to_string([trim(x) FOR x IN string_split(target_segments, ',') IF trim(x) <> ''], '|') AS target_segments,
  CASE WHEN trim(company_statuses) = '' THEN 'active' ELSE array_to_string([trim(x) FOR x IN string_split(company_statuses, ',')], '|') END AS company_statuses,
  cast(coalesce(greatest(0, least(4, floor(try_cast(onboarding_step AS double)))), 0) AS int) AS onboarding_step,
  nullif(try_cast(average_ticket AS double), 0) AS average_ticket FROM ({RAW_PROFILE})""")
def _(fx):
    p = I.profile_normalise(fx.sql(RAW_PROFILE))
    return p.withColumns({c: F.array_join(c, "|") for c in ("target_segments", "company_statuses")})


CUSTOMER_ORGS = "SELECT concat('org_', cast(c_custkey AS string)) AS id, c_name AS name FROM {customer}"
STORED_PROFILE = """
SELECT concat(CASE WHEN c_acctbal > 0 THEN 'org_' ELSE 'left_' END, cast(c_custkey AS string)) AS org_id, CASE c_custkey % 3 WHEN 0 THEN '' WHEN 1 THEN concat('Cia ', c_name) END AS company_name,
  CASE c_custkey % 2 WHEN 0 THEN '' ELSE 'active,inactive' END AS company_statuses, c_mktsegment AS target_segments, cast(c_custkey % 5 AS int) AS onboarding_step
FROM {customer}
"""


@query("profile_view", f"""
SELECT o.id AS org_id, coalesce(nullif(p.company_name, ''), o.name, '') AS company_name,
  CASE WHEN coalesce(company_statuses, '') = '' THEN 'active' ELSE replace(company_statuses, ',', '|') END AS company_statuses,
  coalesce(target_segments, '') AS target_segments, coalesce(onboarding_step, 0) AS onboarding_step
FROM ({CUSTOMER_ORGS}) o LEFT JOIN ({STORED_PROFILE}) p ON p.org_id = o.id""")
def _(fx):
    stored = fx.sql(STORED_PROFILE).withColumns({"company_statuses": I.tags("company_statuses"), "target_segments": I.tags("target_segments")})
    v = I.profile_view(fx.sql(CUSTOMER_ORGS), stored)
    return v.withColumns({c: F.array_join(c, "|") for c in ("target_segments", "company_statuses")})


TAGS = "SELECT concat('org_', cast(n_nationkey AS string)) AS org_id, concat('Machinery,building,', n_name) AS tags FROM {nation}"
DRAFTS = """
SELECT concat('org_', cast(c_nationkey AS string)) AS org_id, c_custkey AS draft_id, concat(' MACHINERY, ', c_mktsegment, ',', lower(c_mktsegment), ', x', cast(c_custkey % 90 AS string)) AS draft FROM {customer}
"""


@query("tag_merge", f"""
WITH u AS (
  SELECT org_id, 0 AS source, cast(0 AS bigint) AS draft_id, i - 1 AS pos, l[i] AS tag FROM (SELECT org_id, l, unnest(range(1, len(l) + 1)) AS i
    FROM (SELECT org_id, string_split(tags, ',') AS l FROM ({TAGS})))
  UNION ALL
  SELECT org_id, 1, draft_id, i - 1, l[i] FROM (SELECT org_id, draft_id, l, unnest(range(1, len(l) + 1)) AS i
    FROM (SELECT org_id, draft_id, [trim(x) FOR x IN string_split(draft, ',') IF trim(x) <> ''] AS l FROM ({DRAFTS}))))
SELECT org_id, lower(tag) AS tag_key, tag, source, draft_id, cast(pos AS int) AS pos FROM (
  SELECT *, row_number() OVER (PARTITION BY org_id, lower(tag) ORDER BY source, draft_id, pos) AS rn FROM u) WHERE rn = 1""")
def _(fx):
    stored = fx.sql(TAGS).withColumn("tags", I.tags("tags"))
    return I.tag_merge(stored, fx.sql(DRAFTS))


@query("profile_readiness", f"""
SELECT pid, 25 * (cast(n <> '' AS int) + cast(m AS int) + cast(l AS int) + 1) AS readiness, f AS first_incomplete,
  CASE WHEN st > 0 THEN st ELSE f END AS resume_step
FROM (SELECT *, CASE WHEN n IN ('', 'organização principal', 'organizacao principal') THEN 0 WHEN NOT m THEN 1 WHEN NOT l THEN 2 ELSE 3 END AS f
 FROM (SELECT pid, lower(trim(coalesce(company_name, ''))) AS n, replace(replace(target_segments, ',', ''), ' ', '') <> '' AS m, pid % 2 = 0 AS l,
  cast(coalesce(greatest(0, least(4, floor(try_cast(onboarding_step AS double)))), 0) AS int) AS st FROM ({RAW_PROFILE})))""")
def _(fx):
    p = I.profile_normalise(fx.sql(RAW_PROFILE)).withColumns({
        "target_cnaes": F.array().cast("array<string>"),
        "target_locations": F.when(F.col("pid") % 2 == 0, F.array(F.lit("SP"))).otherwise(F.array().cast("array<string>"))})
    return I.profile_readiness(p).select("pid", "readiness", "first_incomplete", "resume_step")


@query("idempotency_keys", """
SELECT id, substr(sha256(concat_ws('|', coalesce(cast(campaign_id AS string), ''), cast(prospect_id AS string), cast(step_index AS string))), 1, 32) AS step_key,
  substr(sha256(coalesce(phone_number, '')), 1, 16) AS session_key FROM {fx_wa_contact} c""")
def _(fx):
    return I.idempotency_keys(fx("wa_contact"), ["campaign_id", "prospect_id", "step_index"], "phone_number", "phone_number").select(
        "id", "step_key", "session_key")


HASH = "sha1(unhex('6f4c1a2e9b7d4e3a8c5f1d2e3a4b5c6d') || encode(coalesce(cnpj, '')))"


@query("company_ids", f"""
SELECT id, cnpj, concat(substr(h, 1, 8), '-', substr(h, 9, 4), '-5', substr(h, 14, 3), '-',
  substr('89ab', cast(cast(concat('0x', substr(h, 17, 1)) AS int) % 4 + 1 AS int), 1), substr(h, 18, 3), '-', substr(h, 21, 12)) AS company_id
FROM (SELECT id, cnpj, {HASH} AS h FROM {{fx_prospect}} p)""")
def _(fx):
    p = fx("prospect")
    return I.idempotency_keys(p, ["id"], "cnpj", "cnpj").select("id", "cnpj", "company_id")


INCOMING = """
SELECT o_orderkey AS arrival, concat('org_', cast(o_custkey % 25 AS string)) AS org_id,
  CASE WHEN o_orderkey % 50 = 0 THEN '' ELSE lpad(cast(o_custkey + (o_orderkey % 3) * 1000000 AS string), 14, '0') END AS cnpj,
  CASE WHEN o_orderkey % 31 = 0 THEN '  ' ELSE concat(' Lead ', cast(o_orderkey AS string)) END AS company_name,
  CASE o_orderkey % 2 WHEN 0 THEN 'manual' ELSE 'discovered' END AS kind,
  CASE o_orderstatus WHEN 'F' THEN 'active' WHEN 'O' THEN 'qualified' END AS status, o_orderpriority AS industry FROM {orders}
"""


@query("lead_intake", f"""
WITH inc AS (SELECT * FROM ({INCOMING}) WHERE cnpj <> '' AND trim(company_name) <> ''),
 new AS (SELECT * FROM (SELECT i.*, row_number() OVER (PARTITION BY i.org_id, i.cnpj ORDER BY arrival) AS rn FROM inc i
   WHERE NOT EXISTS (SELECT 1 FROM {{fx_prospect}} p WHERE p.org_id = i.org_id AND p.cnpj = i.cnpj)) WHERE rn = 1),
 used AS (SELECT org_id, count(*) AS n FROM {{fx_prospect}} p GROUP BY 1),
 r AS (SELECT new.*, o.plan, greatest(0, 10 - coalesce(used.n, 0)) AS room, row_number() OVER (PARTITION BY new.org_id ORDER BY arrival, cnpj) AS pos
   FROM new LEFT JOIN {{fx_organization}} o ON o.id = new.org_id LEFT JOIN used ON used.org_id = new.org_id)
SELECT org_id, cnpj, arrival, kind, trim(company_name) AS company_name,
  CASE WHEN kind = 'manual' THEN coalesce(status, 'prospect') WHEN status = 'active' THEN 'prospect' ELSE 'lead' END AS status,
  industry, CASE WHEN kind = 'manual' THEN 65 ELSE 60 END AS opportunity_score, 'pending' AS enrichment_status
FROM r WHERE plan = 'premium' OR pos <= room""")
def _(fx):
    return I.lead_intake(fx.sql(INCOMING), fx("prospect"), fx("organization"))


@query("shared_org_detect", "SELECT org_id, count(*) AS users FROM {fx_user} u GROUP BY 1 HAVING count(*) > 1")
def _(fx):
    return I.shared_org_detect(fx("user"))


@query("org_split", """
SELECT id AS user_id, org_id AS old_org_id, CASE WHEN rn = 1 THEN org_id ELSE 'org_' || id END AS new_org_id,
  CASE WHEN rn > 1 THEN coalesce(nullif(name, ''), split_part(email, '@', 1)) END AS new_org_name
FROM (SELECT *, row_number() OVER (PARTITION BY org_id ORDER BY created_at, id) AS rn FROM {fx_user} u)""")
def _(fx):
    return I.org_split(fx("user"))


# --- keyed writes ---------------------------------------------------------------------------

TARGET = "SELECT org_id, concat(CASE WHEN employees IS NULL THEN '8' ELSE '0' END, substr(cnpj, 2)) AS cnpj, company_name, trade_name, opportunity_score FROM {fx_prospect} p"
UPDATES = """
SELECT concat('org_', cast(c_custkey % 20 AS string)) AS org_id, concat(CASE WHEN c_acctbal > 2000 THEN '0' ELSE '7' END, lpad(cast(c_custkey AS string), 13, '0')) AS cnpj,
  CASE c_custkey % 3 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE concat('New ', c_name) END AS company_name, 'T' AS trade_name, 7 AS opportunity_score
FROM {customer}
"""


def _upsert_sql(company, score):
    return f"""
SELECT coalesce(t.org_id, u.org_id) AS org_id, coalesce(t.cnpj, u.cnpj) AS cnpj, {company} AS company_name,
  CASE WHEN t.cnpj IS NULL THEN u.trade_name ELSE t.trade_name END AS trade_name, {score} AS opportunity_score
FROM ({TARGET}) t FULL JOIN ({UPDATES}) u ON t.org_id = u.org_id AND t.cnpj = u.cnpj"""


def _modes(mode):
    def run(fx):
        out = U.upsert(fx.sql(TARGET), fx.sql(UPDATES), ["org_id", "cnpj"], ["company_name", "opportunity_score"], mode)
        return U.write_version(out, f"upsert-{mode}")
    return run


OLD, NEW = "t.cnpj IS NULL", "u.cnpj IS NOT NULL"
query("sink_upsert", _upsert_sql(f"CASE WHEN {NEW} THEN u.company_name ELSE t.company_name END",
                                 f"CASE WHEN {NEW} THEN u.opportunity_score ELSE t.opportunity_score END"))(_modes("overwrite"))
query("sink_upsert_non_null", _upsert_sql(
    f"CASE WHEN {OLD} THEN u.company_name ELSE coalesce(nullif(trim(u.company_name), ''), t.company_name) END",
    f"CASE WHEN {NEW} THEN u.opportunity_score ELSE t.opportunity_score END"))(_modes("non_null_overwrite"))
query("sink_upsert_fill", _upsert_sql(
    f"CASE WHEN {OLD} THEN u.company_name ELSE coalesce(t.company_name, u.company_name) END",
    "coalesce(t.opportunity_score, u.opportunity_score)"))(_modes("fill_missing"))
query("sink_upsert_keep_first", _upsert_sql(
    f"CASE WHEN {OLD} THEN u.company_name ELSE t.company_name END",
    f"CASE WHEN {OLD} THEN u.opportunity_score ELSE t.opportunity_score END"))(_modes("keep_first"))

MOVE = "SELECT concat('org_', cast(o_custkey % 21 AS string)) AS org_id, CASE WHEN o_orderpriority = '1-URGENT' THEN o_custkey ELSE o_custkey + 1000000000 END AS id FROM {orders}"


@query("bulk_move", f"""
SELECT p.id, p.org_id, CASE WHEN m.id IS NOT NULL THEN 'closed' ELSE p.status END AS status
FROM {{fx_prospect}} p LEFT JOIN (SELECT DISTINCT * FROM ({MOVE})) m ON m.id = p.id AND m.org_id = p.org_id""")
def _(fx):
    return U.bulk_move(fx("prospect"), fx.sql(MOVE), "closed")[0].select("id", "org_id", "status")


@query("bulk_move_counts", f"""
SELECT org_id, count(*) AS affected FROM {{fx_prospect}} p WHERE (org_id, id) IN (SELECT org_id, id FROM ({MOVE})) GROUP BY 1""")
def _(fx):
    return U.bulk_move(fx("prospect"), fx.sql(MOVE), "closed")[1]


@query("bulk_delete", f"""
SELECT id, org_id, cnpj FROM {{fx_prospect}} p WHERE NOT EXISTS (SELECT 1 FROM ({MOVE}) m WHERE m.id = p.id AND m.org_id = p.org_id)""")
def _(fx):
    return U.bulk_delete(fx("prospect").select("id", "org_id", "cnpj"), fx.sql(MOVE))[0]

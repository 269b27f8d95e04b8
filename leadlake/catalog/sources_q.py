"""Payload mapping, routing, exports and stored tables."""

import uuid

from pyspark.sql import functions as F

from leadlake.catalog.core import query, values
from leadlake.functions import fixed
from leadlake.operators import listing as L
from leadlake.operators import outreach as O
from leadlake.plans.scratch import new_dir
from leadlake.sources import csv_sink as C
from leadlake.sources import payloads as P
from leadlake.sources import tables as T


@query("src_tables", """
SELECT p.id, p.cnpj, p.status, p.revenue_estimate, p.opportunity_score, o.name AS org_name
FROM (SELECT cast(id AS string) AS id, cnpj, status, cast(revenue_estimate AS bigint) AS revenue_estimate, opportunity_score, org_id FROM {fx_prospect} x) p
LEFT JOIN {fx_organization} o ON o.id = p.org_id""")
def _(fx):
    root = new_dir(fx.spark, "tables")
    T.save(fx("prospect"), root, "prospect")
    T.save(fx("organization"), root, "organization")
    t = T.load(fx.spark, root, ["prospect", "organization"])
    orgs = t["organization"].select(F.col("id").alias("org_id"), F.col("name").alias("org_name"))
    return t["prospect"].join(orgs, "org_id", "left").select("id", "cnpj", "status", "revenue_estimate", "opportunity_score", "org_name")


def bucketed(fx):
    """(leads, phones, places of leads in the messaging channel), bucketed by tenant and lead."""
    root, by, tag = new_dir(fx.spark, "buckets"), ["org_id", "prospect_id"], uuid.uuid4().hex[:8]
    leads = fx("prospect").withColumnRenamed("id", "prospect_id").select("org_id", "prospect_id", "company_name", "status")
    state = fx("channel_state").join(fx("prospect").select("org_id", F.col("id").alias("prospect_id")), "prospect_id").select("org_id", "prospect_id", F.col("status").alias("channel_status"))
    phones = fx("phone").select("org_id", "prospect_id", "pos", "raw_phone")
    return [T.save_bucketed(df, f"{root}/{n}", f"{n}_{tag}", by, 8) for n, df in (("leads", leads), ("phones", phones), ("state", state))]


@query("src_tables bucketed", """
SELECT p.org_id, p.id AS prospect_id, p.company_name, p.status, f.pos, f.raw_phone, s.status AS channel_status FROM {fx_prospect} p
LEFT JOIN {fx_phone} f ON f.org_id = p.org_id AND f.prospect_id = p.id LEFT JOIN {fx_channel_state} s ON s.prospect_id = p.id""")
def _(fx):
    leads, phones, state = bucketed(fx)
    by = ["org_id", "prospect_id"]
    return leads.join(phones.hint("merge"), by, "left").join(state.hint("merge"), by, "left")


JSON_COLUMNS = """
SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN NULL WHEN 1 THEN '{"a":1}' WHEN 2 THEN '[]' ELSE concat('["11 ', cast(c_custkey AS string), '","x"]') END AS cnpj_phones,
  CASE c_custkey % 3 WHEN 0 THEN 'oops' WHEN 1 THEN concat('[{"name":"', c_name, '","qualification":"Q"},{"name":"B"}]') END AS cnpj_partners FROM {customer}
"""


@query("src_json_hydrate", f"""
SELECT id, CASE WHEN id % 4 = 3 THEN array_to_string(from_json(cnpj_phones, '["VARCHAR"]'), '|') ELSE '' END AS phones,
  CASE WHEN id % 3 = 1 THEN concat_ws('|', cnpj_partners->>'$[0].name', cnpj_partners->>'$[1].name') ELSE '' END AS partners FROM ({JSON_COLUMNS})""")
def _(fx):
    h = P.hydrate(fx.sql(JSON_COLUMNS))
    return h.select("id", F.array_join("cnpj_phones", "|").alias("phones"),
                    F.array_join(F.transform("cnpj_partners", lambda p: p["name"]), "|").alias("partners"))


PAYLOAD = """
SELECT c_custkey AS id, concat('{"razao_social":', CASE c_custkey % 5 WHEN 0 THEN 'null' WHEN 1 THEN '""' ELSE concat('"', c_name, '"') END,
  ',"nome_fantasia":', CASE c_custkey % 7 WHEN 0 THEN '""' ELSE concat('"Fantasia ', c_name, '"') END,
  ',"cnae_fiscal_descricao":"', c_mktsegment, '","descricao_tipo_de_logradouro":"RUA","email":', CASE c_custkey % 2 WHEN 0 THEN 'null' ELSE '"a@b.com"' END,
  ',"data_inicio_atividade":"', CASE c_custkey % 3 WHEN 0 THEN '2001-13-45' ELSE '2001-03-04' END, '","natureza_juridica":"LTDA","municipio":"M","uf":"SP"',
  ',"ddd_telefone_1":" 11', cast(c_custkey AS string), '","ddd_telefone_2":', CASE c_custkey % 4 WHEN 0 THEN 'null' WHEN 1 THEN concat('"11', cast(c_custkey AS string), ' "') ELSE '"21"' END,
  ',"telefone":"","qsa":[{"nome_socio":"S', cast(c_custkey AS string), '","qualificacao_socio":"Socio"},{"nome":"N","qualificacao":"","pais":""},{"nome_representante_legal":"R"}]}') AS body
FROM {customer}
"""


@query("src_registry_payload", f"""
SELECT id, coalesce(nullif(body->>'$.razao_social', ''), nullif(body->>'$.nome_fantasia', '')) AS company_name, nullif(body->>'$.nome_fantasia', '') AS trade_name,
  body->>'$.cnae_fiscal_descricao' AS industry, body->>'$.email' AS cnpj_email, try_cast(body->>'$.data_inicio_atividade' AS date) AS cnpj_opened_at,
  'LTDA' AS cnpj_legal_nature, CASE WHEN id % 4 IN (0, 1) THEN '11' || id ELSE '11' || id || '|21' END AS phones FROM ({PAYLOAD})""")
def _(fx):
    return P.map_registry_payload(fx.sql(PAYLOAD)).select(
        "id", "company_name", "trade_name", "industry", "cnpj_email", "cnpj_opened_at", "cnpj_legal_nature",
        F.array_join("cnpj_phones", "|").alias("phones"))


@query("partners_standardise", f"""
SELECT id, 0 AS pos, body->>'$.qsa[0].nome_socio' AS name, body->>'$.qsa[0].qualificacao_socio' AS qualification, cast(NULL AS string) AS country FROM ({PAYLOAD})
UNION ALL SELECT id, 1, 'N', NULL, NULL FROM ({PAYLOAD}) UNION ALL SELECT id, 2, 'R', NULL, NULL FROM ({PAYLOAD})""")
def _(fx):
    m = P.map_registry_payload(fx.sql(PAYLOAD))
    return m.select("id", F.posexplode("cnpj_partners").alias("pos", "p")).select("id", "pos", "p.name", "p.qualification", "p.country")


@query("src_registry_company", f"""
SELECT CASE WHEN length(d) = 14 THEN substr(d, 1, 2) || '.' || substr(d, 3, 3) || '.' || substr(d, 6, 3) || '/' || substr(d, 9, 4) || '-' || substr(d, 13, 2) ELSE d END AS cnpj,
  coalesce(nullif(legal_name, ''), nullif(trade_name, ''), '') AS legal_name, nullif(trade_name, '') AS trade_name, cnae_description AS industry,
  CASE WHEN act THEN 'active' ELSE 'inactive' END AS status, city, state, email, act AS is_active, TRUE AS is_headquarters, 'mcp.cnpj' AS source
FROM (SELECT *, regexp_replace(cnpj, '[^0-9]', '', 'g') AS d, coalesce(is_active, upper(registration_status) IN ({values(fixed.ACTIVE_REGISTRATIONS)})) AS act FROM {{fx_registry}} r)""")
def _(fx):
    r = fx("registry").withColumnsRenamed({"cnae_description": "main_cnae_description", "city": "city_name"}).withColumns({
        "opening_date": F.lit(None).cast("date"), "legal_nature_description": F.lit(None).cast("string"), "is_headquarters": F.lit(None).cast("boolean"),
        "company_size_code": F.lit(None).cast("string"), "share_capital": F.lit(None).cast("double")})
    return P.map_registry_company(r).drop("opening_date", "legal_nature", "company_size", "share_capital")


RESPONSES = r"""
SELECT id, CASE id % 6
  WHEN 0 THEN concat('event: message', chr(10), 'data: not json', chr(10), 'data: {"result":{"structuredContent":{"result":', cast(id AS string), '}}}')
  WHEN 1 THEN concat('{"result":{"structuredContent":{"total":', cast(id AS string), '}}}')
  WHEN 2 THEN concat('{"content":[{"type":"image"},{"type":"text","text":"{\"n\":', cast(id AS string), '}"}]}')
  WHEN 3 THEN 'garbage' WHEN 4 THEN concat('{"result":{"content":[{"type":"text","text":"plain ', cast(id AS string), '"}]}}')
  ELSE concat(chr(10), 'data: {"structuredContent":{"result":["', cnpj, '"]}}', chr(10), 'data: {"structuredContent":{"result":1}}') END AS body
FROM {fx_prospect} p
"""


@query("src_tool_response", """
SELECT id, CASE id % 6 WHEN 0 THEN cast(id AS string) WHEN 1 THEN '{"total":' || id || '}' WHEN 2 THEN '{"n":' || id || '}'
  WHEN 4 THEN 'plain ' || id WHEN 5 THEN CASE WHEN id % 6 = 5 THEN '["' || cnpj || '"]' END END AS result FROM {fx_prospect} p""")
def _(fx):
    body = fx.sql(RESPONSES.replace(r'\"', r'\\"'))
    return P.unwrap_tool_response(body).select("id", "result")


WA_RAW = """
SELECT event_id, ts, concat('{"event":"', CASE event_type WHEN 'view' THEN 'message' WHEN 'click' THEN 'message.ack' WHEN 'signup' THEN 'session.status' ELSE 'presence' END,
  '","session":"sess_', cast(user_id % 30 AS string), '","payload":{"id":"m', cast(event_id AS string), '","from":"5511', cast(900000000 + user_id AS string), '@c.us","fromMe":',
  CASE event_id % 5 WHEN 0 THEN 'true' ELSE 'false' END, ',"body":"hello","type":"', CASE event_id % 3 WHEN 0 THEN 'ptt' WHEN 1 THEN 'chat' ELSE 'image' END,
  '","ack":', cast(event_id % 4 AS string), ',"status":"', CASE event_id % 4 WHEN 0 THEN 'WORKING' WHEN 1 THEN 'STOPPED' WHEN 2 THEN 'SCAN_QR_CODE' ELSE 'WEIRD' END, '"}}') AS body
FROM {events}
"""


@query("event_route", f"""
SELECT w.event_id, body->>'$.event' AS event, body->>'$.session' AS session, a.org_id, a.id AS account_id,
  CASE body->>'$.event' WHEN 'message' THEN 'message' WHEN 'message.ack' THEN 'ack' WHEN 'session.status' THEN 'session' ELSE 'other' END AS route,
  CASE body->>'$.payload.type' WHEN 'ptt' THEN 'AUDIO' WHEN 'image' THEN 'IMAGE' ELSE 'TEXT' END AS media_type,
  body->>'$.payload.from' AS chat_id, body->>'$.payload.fromMe' = 'true' AS from_me, cast(body->>'$.payload.ack' AS int) AS ack
FROM ({WA_RAW}) w JOIN {{fx_wa_account}} a ON a.session_name = body->>'$.session'""")
def _(fx):
    e = P.parse_wa_events(fx.sql(WA_RAW))
    return P.route_events(e, fx("wa_account")).select(
        "event_id", "event", "session", "org_id", "account_id", "route", "media_type", "chat_id", "from_me", "ack")


RESULT_RAW = """
SELECT event_id AS raw_id, CASE event_id % 10 WHEN 0 THEN concat('{"cnpj":', cast(event_id AS string)) WHEN 1 THEN '{"cnpj":"12"}'
  ELSE concat('{"cnpj":"', substr(cnpj, 1, 8), '/', substr(cnpj, 9), '","', CASE event_id % 2 WHEN 0 THEN 'enrichment_version":' ELSE 'version":"' END, cast(enrichment_version AS string),
    CASE event_id % 2 WHEN 0 THEN '' ELSE '"' END, CASE event_id % 3 WHEN 0 THEN '' ELSE concat(',"status":"', lower(status), '"') END,
    ',"summary":{"domain":"d', cast(event_id AS string), '.com","website_active":', CASE event_id % 3 WHEN 0 THEN 'null' WHEN 1 THEN 'true' ELSE 'false' END,
    ',"commercial_potential":', coalesce(cast(commercial_potential AS string), '""'), ',"tech_count":"', CASE event_id % 4 WHEN 0 THEN 'x' ELSE concat(cast(event_id % 9 AS string), '.5') END, '"}}') END AS body
FROM {fx_result_once} r
"""


DEAD = f"""
SELECT raw_id, body, CASE WHEN raw_id % 10 = 0 THEN 'malformed_json' ELSE 'invalid_cnpj' END AS reason FROM ({RESULT_RAW}) WHERE raw_id % 10 <= 1"""


@query("dlq_split", DEAD)
def _(fx):
    return P.dlq_split(fx.sql(RESULT_RAW))[1]


GOOD = f"""
SELECT raw_id, regexp_replace(body->>'$.cnpj', '[^0-9]', '', 'g') AS cnpj, cast(coalesce(body->>'$.enrichment_version', body->>'$.version') AS int) AS enrichment_version,
  upper(coalesce(body->>'$.status', 'COMPLETED')) AS status, body FROM ({RESULT_RAW}) WHERE raw_id % 10 > 1"""


@query("dlq_split_good", f"SELECT raw_id, cnpj, enrichment_version, status FROM ({GOOD})")
def _(fx):
    return P.dlq_split(fx.sql(RESULT_RAW))[0].select("raw_id", "cnpj", "enrichment_version", "status")


@query("summary_normalise", f"""
SELECT raw_id, body->>'$.summary.domain' AS domain, CASE raw_id % 3 WHEN 1 THEN TRUE WHEN 2 THEN FALSE END AS website_active, cast(NULL AS boolean) AS corporate_email,
  try_cast(body->>'$.summary.commercial_potential' AS double) AS commercial_potential,
  cast(floor(try_cast(body->>'$.summary.tech_count' AS double) + 0.5) AS int) AS tech_count FROM ({GOOD})""")
def _(fx):
    good, _ = P.dlq_split(fx.sql(RESULT_RAW))
    return P.summary_normalise(good).select("raw_id", "domain", "website_active", "corporate_email", "commercial_potential", "tech_count")


MAILBOX = """
SELECT user_id % 7 AS account_id, event_id AS history_id, CASE event_type
  WHEN 'view' THEN concat('{"added":[{"message":{"id":"a', cast(event_id AS string), '"}},{"message":{}}]}')
  WHEN 'click' THEN concat('{"updated":[{"message":{"id":"u', cast(event_id AS string), '"},"labelChanges":[{"labelsAdded":["X"]}]},{"message":{"id":"n"},"labelChanges":[]}]}')
  WHEN 'signup' THEN concat('{"added":[{"message":{"id":"b', cast(event_id AS string), '"}}],"updated":[{"message":{"id":"r', cast(event_id AS string), '"},"labelChanges":[{"labelsRemoved":["Y"]}]}]}')
  ELSE '{}' END AS messages FROM {events}
"""
CURSORS = "SELECT user_id % 7 AS account_id, CASE WHEN user_id % 7 < 5 THEN cast(min(event_id) + 500 AS bigint) END AS last_history_id FROM {events} GROUP BY user_id % 7"
FRESH = f"SELECT m.* FROM ({MAILBOX}) m LEFT JOIN ({CURSORS}) c ON c.account_id = m.account_id WHERE c.last_history_id IS NULL OR m.history_id > c.last_history_id"


MAILBOX_MESSAGES = f"""
SELECT account_id, history_id, 'added' AS kind, messages->>'$.added[0].message.id' AS message_id FROM ({FRESH}) WHERE messages LIKE '%"added"%'
UNION ALL SELECT account_id, history_id, 'updated', messages->>'$.updated[0].message.id' FROM ({FRESH}) WHERE messages LIKE '%"updated"%'"""
MAILBOX_CURSORS = f"""
SELECT coalesce(c.account_id, f.account_id) AS account_id, greatest(coalesce(c.last_history_id, 0), coalesce(f.h, 0)) AS last_history_id
FROM ({CURSORS}) c FULL JOIN (SELECT account_id, max(history_id) AS h FROM ({FRESH}) GROUP BY 1) f ON f.account_id = c.account_id"""


@query("mailbox_increment", MAILBOX_MESSAGES)
def _(fx):
    return P.mailbox_increment(fx.sql(MAILBOX), fx.sql(CURSORS))[0]


@query("mailbox_cursors", MAILBOX_CURSORS)
def _(fx):
    return P.mailbox_increment(fx.sql(MAILBOX), fx.sql(CURSORS))[1]


# --- exports --------------------------------------------------------------------------------

ODD_NAMES = "CASE WHEN id % 5 = 0 THEN concat('A, \"', company_name, '\" x') ELSE company_name END"


@query("sink_csv_prospects", f"""
SELECT org_id, cnpj, {ODD_NAMES} AS company_name, trade_name, status, industry, city, state, cnpj_email, employees, revenue_estimate, opportunity_score,
  strftime(created_at, '%Y-%m-%dT%H:%M:%S') || '.000Z' AS created_at
FROM {{fx_prospect}} p WHERE org_id IN (SELECT id FROM {{fx_organization}} o WHERE plan = 'premium')""")
def _(fx):
    path = new_dir(fx.spark, "csv-prospects")
    C.export_prospects(fx("prospect").withColumn("company_name", F.expr(ODD_NAMES)), fx("organization"), path)
    kinds = {"employees": "int", "revenue_estimate": "bigint", "opportunity_score": "int"}
    ddl = ", ".join(f"{c} {kinds.get(c, 'string')}" for c in C.PROSPECT_COLUMNS) + ", org_id string"
    return C.read_csv(fx.spark, path, ddl)


@query("sink_csv_contacts", """
SELECT p.cnpj, p.company_name, p.cnpj_email AS email, nullif(coalesce(f.phones, ''), '') AS phones,
  CASE WHEN p.id % 3 = 0 THEN 'Ana' || p.id || ' Silva (Diretora) | N/A (N/A)' END AS partners, p.enrichment_status,
  strftime(p.enriched_at, '%Y-%m-%dT%H:%M:%S') || '.000Z' AS enriched_at
FROM {fx_prospect} p LEFT JOIN (SELECT prospect_id, string_agg(raw_phone, ' | ' ORDER BY pos) AS phones FROM {fx_phone} x GROUP BY 1) f ON f.prospect_id = p.id""")
def _(fx):
    path = new_dir(fx.spark, "csv-contacts")
    two = fx("phone").groupBy(F.col("prospect_id").alias("id")).pivot("pos", [0, 1]).agg(F.first("raw_phone"))
    phones = two.select("id", F.array("0", "1").alias("phones"))
    name = F.when(F.col("id") % 3 == 0, F.concat(F.lit("Ana"), F.col("id").cast("string"), F.lit(" Silva")))
    shape = "array<struct<name:string,qualification:string>>"
    partners = F.when(name.isNotNull(), F.array(
        F.struct(name.alias("name"), F.lit("Diretora").alias("qualification")),
        F.struct(F.lit("").alias("name"), F.lit(None).cast("string").alias("qualification"))).cast(shape)).otherwise(F.array().cast(shape))
    c = fx("prospect").withColumnRenamed("cnpj_email", "email").join(phones, "id", "left").withColumns({
        "phones": F.coalesce("phones", F.array().cast("array<string>")), "partners": partners})
    C.export_contacts(c, path)
    return C.read_csv(fx.spark, path, "cnpj string, company_name string, email string, phones string, partners string, enrichment_status string, enriched_at string")


LABEL_CASES = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in fixed.EXPORT_STAGE_LABELS.items())


@query("sink_csv_opportunities", f"""
SELECT {ODD_NAMES} AS lead, coalesce(industry, 'Não classificado') AS segment, coalesce(employees, 0) AS employees, opportunity_score AS score,
  CASE status {LABEL_CASES} ELSE status END AS stage FROM {{fx_prospect}} p WHERE coalesce(employees, 0) <= 250 AND coalesce(employees, 0) > 50""")
def _(fx):
    path = new_dir(fx.spark, "csv-opportunities")
    rows = L.prospect_facets(fx("prospect").withColumn("company_name", F.expr(ODD_NAMES)), "2007-01-01", size="medium")
    C.export_opportunities(rows, path)
    return C.read_csv(fx.spark, path, "lead string, segment string, employees int, score int, stage string")


# --- mails ----------------------------------------------------------------------------------

MAIL_ROWS = """
SELECT event_id AS mail_id, CASE event_id % 4 WHEN 0 THEN 'In-Reply-To' WHEN 1 THEN 'REFERENCES' ELSE 'X-Other' END AS h1,
  CASE event_id % 8 WHEN 0 THEN '' ELSE concat('<', cast(event_id AS string), '>') END AS v1,
  CASE event_id % 5 WHEN 0 THEN 'Re: oi' WHEN 1 THEN 'res: oi' WHEN 2 THEN 'RE: oi' ELSE 'Oferta' END AS subject FROM {events}
"""


@query("reply_detect", f"""
SELECT mail_id, subject, (h1 <> 'X-Other' AND v1 <> '') OR subject LIKE 'Re:%' OR subject LIKE 'res:%' AS is_reply FROM ({MAIL_ROWS})""")
def _(fx):
    m = fx.sql(MAIL_ROWS).withColumn("headers", F.array(
        F.struct(F.col("h1").alias("name"), F.col("v1").alias("value")),
        F.struct(F.lit("Subject").alias("name"), F.col("subject").alias("value"))))
    return O.reply_detect(m).select("mail_id", "subject", "is_reply")

"""E-mail outreach: reporting, gates, results, replies, follow-ups and rate audits."""

from pyspark.sql import functions as F

from leadlake.catalog.core import query, values
from leadlake.functions import fixed
from leadlake.operators import outreach as O
from leadlake.operators import rates as R

TERMINAL = values(fixed.TERMINAL_OUTREACH)


@query("outreach_timeline", """
SELECT e.id AS event_id, e.contact_id, e.message_id, e.type, e.created_at, c.prospect_id, c.campaign_id, m.subject, m.status AS message_status
FROM {fx_outreach_event} e JOIN {fx_outreach_contact} c ON c.id = e.contact_id LEFT JOIN {fx_outreach_message} m ON m.id = e.message_id""")
def _(fx):
    return O.outreach_timeline(fx("outreach_event"), fx("outreach_contact"), fx("outreach_message"))


@query("outreach_messages", """
SELECT m.id AS message_id, c.id AS contact_id, c.prospect_id, c.campaign_id, g.name AS campaign_name, m.subject, m.status AS message_status, m.created_at
FROM {fx_outreach_message} m JOIN {fx_outreach_contact} c ON c.id = m.contact_id LEFT JOIN {fx_outreach_campaign} g ON g.id = c.campaign_id""")
def _(fx):
    return O.outreach_messages(fx("outreach_contact"), fx("outreach_campaign"), fx("outreach_message"))


@query("outreach_status", """
WITH e AS (SELECT *, cast(row_number() OVER (PARTITION BY contact_id ORDER BY created_at DESC, id DESC) AS int) AS event_rank, count(*) OVER (PARTITION BY contact_id) AS n FROM {fx_outreach_event} x)
SELECT c.id AS contact_id, c.prospect_id, c.campaign_id, c.status, k.name AS campaign_name, coalesce(m.n, 0) AS messages, e.n AS events,
  e.event_rank, e.id AS event_id, e.type, e.created_at
FROM {fx_outreach_contact} c LEFT JOIN {fx_outreach_campaign} k ON k.id = c.campaign_id
LEFT JOIN (SELECT contact_id, count(*) AS n FROM {fx_outreach_message} y GROUP BY 1) m ON m.contact_id = c.id
LEFT JOIN e ON e.contact_id = c.id AND event_rank <= 50""")
def _(fx):
    return O.outreach_status(fx("outreach_contact"), fx("outreach_campaign"), fx("outreach_message"), fx("outreach_event"))


OPENS = "SELECT concat('tok_', cast(message_id AS string)) AS tracking_token, created_at AS opened_at FROM {fx_outreach_event} e WHERE type = 'email_opened_inferred'"
FIRST_OPEN = f"""
SELECT f.contact_id, f.opened_at, f.message_id, CASE WHEN c.status IN ({values(fixed.OPENABLE)}) THEN 'OPENED_INFERRED' ELSE c.status END AS contact_status
FROM (SELECT * FROM (SELECT m.contact_id, m.id AS message_id, o.opened_at, row_number() OVER (PARTITION BY m.contact_id ORDER BY o.opened_at, m.id) AS rn
  FROM ({OPENS}) o JOIN {{fx_outreach_message}} m ON m.tracking_token = o.tracking_token) WHERE rn = 1) f LEFT JOIN {{fx_outreach_contact}} c ON c.id = f.contact_id"""


@query("first_open", FIRST_OPEN)
def _(fx):
    return O.first_open(fx.sql(OPENS), fx("outreach_message"), fx("outreach_contact"))


ATTRIBUTED = f"""
SELECT r.reply_id, r.account_id, r.thread_id, r.from_email, r.replied_at, t.contact_id
FROM {{fx_reply}} r LEFT JOIN {{fx_email_account}} a ON a.id = r.account_id
JOIN (SELECT m.thread_id, min(m.contact_id) AS contact_id FROM {{fx_outreach_message}} m JOIN {{fx_outreach_contact}} c ON c.id = m.contact_id
  WHERE c.status NOT IN ({TERMINAL}) GROUP BY 1) t ON t.thread_id = r.thread_id
WHERE a.email IS NULL OR NOT contains(r.from_email, a.email)"""


def attributed(fx):
    return O.reply_attribution(fx("reply"), fx("outreach_message"), fx("outreach_contact"), fx("email_account"))


@query("reply_attribution", ATTRIBUTED)
def _(fx):
    return attributed(fx)


@query("reply_stats", "SELECT contact_id, count(*) AS replies, max(created_at) AS last_reply_at FROM {fx_outreach_event} e WHERE type = 'email_replied' GROUP BY 1")
def _(fx):
    return O.reply_stats(fx("outreach_event").filter("type = 'email_replied'").withColumnRenamed("created_at", "replied_at"))


REPLIED = f"""
WITH a AS ({ATTRIBUTED}), s AS (SELECT contact_id, min(replied_at) AS at FROM a GROUP BY 1)
SELECT c.id, CASE WHEN s.at IS NOT NULL THEN 'REPLIED' ELSE c.status END AS status, coalesce(c.reply_count, 0) + CASE WHEN s.at IS NOT NULL THEN 1 ELSE 0 END AS reply_count,
  CASE WHEN s.at IS NULL THEN c.last_reply_at ELSE greatest(s.at, c.last_reply_at) END AS last_reply_at, CASE WHEN s.at IS NOT NULL THEN 'replied' ELSE c.cancel_reason END AS cancel_reason, c.sent_at
FROM {{fx_outreach_member}} c LEFT JOIN s ON s.contact_id = c.id AND c.status NOT IN ({TERMINAL})"""


@query("reply_apply", REPLIED)
def _(fx):
    out = O.reply_apply(attributed(fx), fx("outreach_member"), fx("outreach_message"))
    return out["contacts"].select("id", "status", "reply_count", "last_reply_at", "cancel_reason", "sent_at")


@query("reply_apply in two batches", REPLIED)
def _(fx):
    """The earlier half first; replies to contacts that it ended change nothing."""
    replies, half = attributed(fx), F.col("replied_at") < F.lit("2024-01-03 00:00:00").cast("timestamp_ntz")
    first = O.reply_apply(replies.filter(half), fx("outreach_member"), fx("outreach_message"))
    out = O.reply_apply(replies.filter(~half), first["contacts"], first["messages"])
    return out["contacts"].select("id", "status", "reply_count", "last_reply_at", "cancel_reason", "sent_at")


@query("reply_apply_messages", f"""
WITH a AS ({ATTRIBUTED}), s AS (SELECT contact_id, arg_min(thread_id, (replied_at, reply_id)) AS th FROM a GROUP BY 1),
 f AS (SELECT contact_id, arg_min(id, (created_at, id)) AS id FROM {{fx_outreach_message}} m WHERE status = 'SENT' GROUP BY 1)
SELECT m.id, m.contact_id, CASE WHEN f.id = m.id THEN coalesce(s.th, m.thread_id) ELSE m.thread_id END AS thread_id
FROM {{fx_outreach_message}} m LEFT JOIN f ON f.contact_id = m.contact_id LEFT JOIN s ON s.contact_id = m.contact_id""")
def _(fx):
    return O.reply_apply(attributed(fx), fx("outreach_contact"), fx("outreach_message"))["messages"].select("id", "contact_id", "thread_id")


SENT = "SELECT contact_id, created_at AS sent_at FROM {fx_outreach_event} e WHERE type = 'email_sent'"
PLAN = f"""
SELECT c.id AS contact_id, c.prospect_id, c.campaign_id, s.at AS last_sent_at, c.outreach_sequence + 1 AS next_sequence, ([3, 5, 7])[c.outreach_sequence] AS delay_days,
  s.at + to_days(([3, 5, 7])[c.outreach_sequence]) AS due_at
FROM {{fx_outreach_contact}} c JOIN (SELECT contact_id, max(sent_at) AS at FROM ({SENT}) GROUP BY 1) s ON s.contact_id = c.id
WHERE c.status NOT IN ({TERMINAL}) AND c.outreach_sequence < 4"""


@query("followup_plan", PLAN)
def _(fx):
    return O.followup_plan(fx("outreach_contact"), fx.sql(SENT))


@query("followup_cancel", f"""
SELECT contact_id, next_sequence, due_at FROM ({PLAN}) p WHERE contact_id NOT IN (SELECT contact_id FROM {{fx_outreach_event}} e WHERE type = 'email_replied' AND created_at < TIMESTAMP '2024-01-03 00:00:00')""")
def _(fx):
    replies = fx("outreach_event").filter("type = 'email_replied' AND created_at < TIMESTAMP_NTZ '2024-01-03 00:00:00'")
    plan = O.followup_plan(fx("outreach_contact"), fx.sql(SENT))
    return O.followup_cancel(plan, replies, fx("outreach_contact"))[0].select("contact_id", "next_sequence", "due_at")


@query("followup_cancel contacts", """
SELECT id, status, CASE WHEN id IN (SELECT contact_id FROM {fx_outreach_event} e WHERE type = 'email_replied' AND created_at < TIMESTAMP '2024-01-03 00:00:00') THEN 'replied' ELSE cancel_reason END AS cancel_reason
FROM {fx_outreach_member} c""")
def _(fx):
    replies = fx("outreach_event").filter("type = 'email_replied' AND created_at < TIMESTAMP_NTZ '2024-01-03 00:00:00'")
    return O.followup_cancel(O.followup_plan(fx("outreach_member"), fx.sql(SENT)), replies, fx("outreach_member"))[1].select("id", "status", "cancel_reason")


STATE = f"""
WITH e AS (SELECT contact_id, min(created_at) FILTER (WHERE type = 'email_replied') AS rep, max(created_at) FILTER (WHERE type = 'email_sent') AS sent,
  arg_max(type, (created_at, id)) FILTER (WHERE type IN ('email_scheduled', 'email_sent', 'email_opened_inferred')) AS last FROM {{fx_outreach_event}} x GROUP BY 1)
SELECT c.id AS contact_id, c.prospect_id, c.campaign_id, c.outreach_sequence,
  CASE WHEN c.status IN ({TERMINAL}) THEN c.status WHEN rep IS NOT NULL THEN 'REPLIED' WHEN last = 'email_scheduled' THEN 'SCHEDULED' WHEN last = 'email_sent' THEN 'SENT'
    WHEN last IS NOT NULL THEN 'OPENED_INFERRED' ELSE c.status END AS status, sent AS sent_at,
  CASE WHEN c.status NOT IN ({TERMINAL}) AND rep IS NOT NULL THEN 1 ELSE 0 END AS reply_count,
  CASE WHEN c.status NOT IN ({TERMINAL}) THEN rep END AS last_reply_at, CASE WHEN c.status NOT IN ({TERMINAL}) AND rep IS NOT NULL THEN 'replied' END AS cancel_reason
FROM {{fx_outreach_contact}} c LEFT JOIN e ON e.contact_id = c.id"""


@query("outreach_contact_state", STATE)
def _(fx):
    return O.outreach_contact_state(fx("outreach_contact"), fx("outreach_event"))


@query("campaign_stagger", "SELECT id, campaign_id, pos, pos * 500 AS delay_ms FROM (SELECT id, campaign_id, cast(floor(id / 25) AS bigint) AS pos FROM {fx_wa_contact} c)")
def _(fx):
    return O.campaign_stagger(fx.sql("SELECT id, campaign_id, cast(floor(id / 25) AS bigint) AS pos FROM {fx_wa_contact} c"), 500)


START = """
SELECT o_orderkey AS request_id, concat('org_', cast(o_custkey % 20 AS string)) AS org_id, o_custkey % 24 AS campaign_id, 0 AS pos, o_custkey AS prospect_id FROM {orders} a
UNION ALL SELECT o_orderkey, concat('org_', cast(o_custkey % 20 AS string)), o_custkey % 24, 1, o_custkey + CASE o_orderstatus WHEN 'F' THEN 20 ELSE 1 END FROM {orders} b WHERE o_orderstatus <> 'P'
"""
CAMPAIGNS = "SELECT cast(n_nationkey AS bigint) AS id, concat('org_', cast(n_nationkey % 20 AS string)) AS tenant_id, 'draft' AS status FROM {nation}"
STARTED = f"""
SELECT r.*, cast(r.pos * 500 AS bigint) AS delay_ms FROM ({START}) r JOIN ({CAMPAIGNS}) k ON k.id = r.campaign_id AND k.tenant_id = r.org_id
WHERE r.request_id NOT IN (SELECT x.request_id FROM ({START}) x WHERE NOT EXISTS (SELECT 1 FROM {{fx_prospect}} p WHERE p.id = x.prospect_id AND p.org_id = x.org_id))"""


@query("outreach_campaign_start", STARTED)
def _(fx):
    return O.outreach_campaign_start(fx.sql(START), fx.sql(CAMPAIGNS), fx("prospect"))[0]


@query("outreach_campaign_start_status", f"""
SELECT k.id, k.tenant_id, CASE WHEN k.id IN (SELECT campaign_id FROM ({STARTED})) THEN 'active' ELSE k.status END AS status FROM ({CAMPAIGNS}) k""")
def _(fx):
    return O.outreach_campaign_start(fx.sql(START), fx.sql(CAMPAIGNS), fx("prospect"))[1]


DUE = """
SELECT id AS prospect_id, id % 6 AS campaign_id, id % 3 AS email_account_id, cast(1 + id % 4 AS int) AS sequence, TIMESTAMP '2007-01-01 00:00:00' AS due_at FROM {fx_prospect} p
"""
KNOWN = "SELECT min(id) AS id, prospect_id, campaign_id, min(status) AS status, max(outreach_sequence) AS outreach_sequence FROM {fx_outreach_contact} c GROUP BY prospect_id, campaign_id"
READY = f"""
SELECT d.*, coalesce(cast(c.id AS string), substr(sha256(d.prospect_id || '|' || d.campaign_id), 1, 32)) AS contact_id, greatest(coalesce(c.outreach_sequence, 0), d.sequence) AS nseq
FROM ({DUE}) d LEFT JOIN ({KNOWN}) c ON c.prospect_id = d.prospect_id AND c.campaign_id = d.campaign_id
WHERE (c.status IS NULL OR c.status NOT IN ({TERMINAL})) AND NOT coalesce(c.status = 'SENT' AND c.outreach_sequence >= d.sequence, FALSE)"""


def prepared(fx):
    return O.outreach_prepare(fx.sql(DUE), fx.sql(KNOWN), fx("prospect"))


@query("outreach_prepare", f"""
SELECT contact_id, prospect_id, campaign_id, email_account_id, 'SCHEDULED' AS status, nseq AS outreach_sequence, due_at + INTERVAL 1 MINUTE AS scheduled_at FROM ({READY})""")
def _(fx):
    return prepared(fx)["contacts"]


@query("outreach_prepare_messages", f"""
SELECT r.contact_id, 'Uma oportunidade para ' || p.company_name AS subject, 'SCHEDULED' AS status, substr(sha256(r.contact_id || '|' || r.nseq), 1, 32) AS tracking_token,
  'Referência a ' || p.company_name || '|Segmento: ' || coalesce(p.industry, 'geral') AS facts
FROM ({READY}) r JOIN {{fx_prospect}} p ON p.id = r.prospect_id""")
def _(fx):
    return prepared(fx)["messages"].select("contact_id", "subject", "status", "tracking_token", F.array_join("reasoning_facts", "|").alias("facts"))


@query("email_draft_render", """
SELECT id, 'Uma oportunidade para ' || company_name AS subject, 'Olá,' || chr(10) || chr(10) || 'Espero que esteja bem!' || chr(10) || chr(10) || 'Conheço a ' || company_name || ' e sei que empresas do segmento ' ||
  coalesce(industry, 'de negócios') || ' costumam enfrentar desafios na identificação de oportunidades.' || chr(10) || chr(10) || 'Nossa plataforma de inteligência de dados ajuda times comerciais a ' ||
  CASE WHEN s.org_id IS NOT NULL THEN 'vender ' || s.org_id ELSE 'encontrar e qualificar leads com mais eficiência' END || '.' || chr(10) || chr(10) ||
  'Gostaria de agendar uma conversa rápida de 15 min para apresentar como funciona?' || chr(10) || chr(10) || 'Abs.,' || chr(10) || 'Equipe comercial' AS body,
  substr(sha256(id || '|1'), 1, 32) AS tracking_token
FROM {fx_prospect} p LEFT JOIN (SELECT org_id FROM {fx_profile} x WHERE target_segments <> '') s ON s.org_id = p.org_id""")
def _(fx):
    settings = fx("profile").select("org_id", F.when(F.col("target_segments") != "", F.concat(F.lit("vender "), F.col("org_id"))).alias("value_proposition"))
    leads = fx("prospect").withColumns({"contact_id": F.col("id"), "sequence": F.lit(1)})
    return O.email_draft_render(leads, settings).select("id", "subject", "body", "tracking_token")


PICK = f"""
SELECT m.id, m.contact_id, coalesce(p.cnpj_email, nullif(regexp_extract(m.body, '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\\.[a-zA-Z]{{2,}}'), '')) AS recipient
FROM (SELECT *, contact_id * 7 AS prospect_id FROM {{fx_outreach_message}} x) m LEFT JOIN {{fx_prospect}} p ON p.id = m.prospect_id"""


@query("recipient_pick", f"SELECT *, CASE WHEN recipient IS NULL THEN 'No recipient email found' END AS error FROM ({PICK})")
def _(fx):
    m = fx("outreach_message").withColumn("prospect_id", F.col("contact_id") * 7)
    return O.recipient_pick(m, fx("prospect")).select("id", "contact_id", "recipient", "error")


@query("recipient_pick_documents", r"""
SELECT doc_id, coalesce(p.cnpj_email, nullif(regexp_extract(text, '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}'), '')) AS recipient
FROM {documents} d LEFT JOIN {fx_prospect} p ON p.id = 4 * d.doc_id""")
def _(fx):
    docs = fx.table("documents").select("doc_id", F.col("text").alias("body"), (F.col("doc_id") * 4).alias("prospect_id"))
    return O.recipient_pick(docs, fx("prospect")).select("doc_id", "recipient")


RATE = "SELECT cast(user_id % 3 AS bigint) AS account_id, user_id % 3 <> 1 AS allowed, cast(60000 AS bigint) AS retry_ms FROM {events} GROUP BY user_id % 3"


@query("email_send_gate", f"""
WITH b AS (SELECT m.id, m.contact_id, c.status AS ct, c.email_account_id AS account_id, c.tenant_id, r.allowed,
  coalesce(p.cnpj_email, nullif(regexp_extract(m.body, '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\\.[a-zA-Z]{{2,}}'), '')) AS recipient
  FROM {{fx_outreach_message}} m LEFT JOIN {{fx_outreach_contact}} c ON c.id = m.contact_id LEFT JOIN ({RATE}) r ON r.account_id = c.email_account_id LEFT JOIN {{fx_prospect}} p ON p.id = c.prospect_id),
o AS (SELECT b.*, EXISTS (SELECT 1 FROM {{fx_suppression}} s WHERE s.tenant_id = b.tenant_id AND lower(s.email) = lower(b.recipient)) AS stop FROM b)
SELECT id, contact_id, recipient, CASE WHEN ct IN ({TERMINAL}) THEN 'cancelled' WHEN account_id IS NULL THEN 'error' WHEN NOT coalesce(allowed, TRUE) THEN 'retry' WHEN recipient IS NULL THEN 'failed'
  WHEN stop THEN 'cancelled' ELSE 'send' END AS outcome,
  CASE WHEN ct IN ({TERMINAL}) THEN ct WHEN account_id IS NULL THEN 'no_account' WHEN NOT coalesce(allowed, TRUE) THEN 'rate_limited' WHEN recipient IS NULL THEN 'No recipient email found'
  WHEN stop THEN 'suppressed' END AS reason,
  CASE WHEN NOT (ct IN ({TERMINAL})) AND account_id IS NOT NULL AND NOT coalesce(allowed, TRUE) THEN 60000 END AS retry_ms FROM o""")
def _(fx):
    g = O.email_send_gate(fx("outreach_message"), fx("outreach_contact"), fx.sql(RATE), fx("prospect"), fx("suppression"))
    return g.select("id", "contact_id", "recipient", "outcome", "reason", "retry_ms")


RESULTS = """
SELECT id AS message_id, concat('g', cast(id AS string)) AS provider_message_id, concat('nt', cast(id AS string)) AS thread_id, created_at + INTERVAL 1 DAY AS sent_at FROM {fx_outreach_message} m WHERE id % 5 <> 4
UNION ALL SELECT id, concat('again', cast(id AS string)), NULL, created_at + INTERVAL 2 DAY FROM {fx_outreach_message} n WHERE id % 4 = 0
"""
MAILED = f"""
r AS (SELECT message_id, min(sent_at) AS went, arg_min(provider_message_id, sent_at) AS pid, arg_min(coalesce(thread_id, '-'), sent_at) AS th FROM ({RESULTS}) GROUP BY 1),
m AS (SELECT w.*, r.went, r.pid, nullif(r.th, '-') AS th FROM {{fx_outreach_mail}} w LEFT JOIN r ON r.message_id = w.id AND w.status <> 'SENT')"""


def mailed(fx, *parts):
    state = [fx("outreach_mail"), fx("outreach_member")]
    for part in parts or [F.lit(True)]:
        out = O.email_send_apply(fx.sql(RESULTS).filter(part), *state)
        state = [out["messages"], out["contacts"]]
    return out


@query("email_send_apply", f"""
WITH {MAILED} SELECT m.contact_id, m.id AS message_id, m.went AS created_at, k.type, k.status FROM m
CROSS JOIN (VALUES ('email_sent', 'sent'), ('email_delivered_inferred', 'delivered')) k(type, status) WHERE m.went IS NOT NULL""")
def _(fx):
    return mailed(fx)["events"]


@query("email_send_apply messages", f"""
WITH {MAILED} SELECT id, CASE WHEN went IS NOT NULL THEN 'SENT' ELSE status END AS status, coalesce(pid, provider_message_id) AS provider_message_id, coalesce(th, thread_id) AS thread_id, coalesce(sent_at, went) AS sent_at FROM m""")
def _(fx):
    return mailed(fx)["messages"].select("id", "status", "provider_message_id", "thread_id", "sent_at")


MAILED_CONTACTS = f"""
WITH {MAILED} SELECT c.id, CASE WHEN s.went IS NOT NULL AND c.status NOT IN ({TERMINAL}) THEN 'SENT' ELSE c.status END AS status, CASE WHEN s.went IS NULL THEN c.sent_at ELSE greatest(s.went, c.sent_at) END AS sent_at,
  c.reply_count, c.cancel_reason FROM {{fx_outreach_member}} c LEFT JOIN (SELECT contact_id, max(went) AS went FROM m WHERE went IS NOT NULL GROUP BY 1) s ON s.contact_id = c.id"""


@query("email_send_apply_contacts", MAILED_CONTACTS)
def _(fx):
    return mailed(fx)["contacts"].select("id", "status", "sent_at", "reply_count", "cancel_reason")


@query("email_send_apply_contacts in two batches", MAILED_CONTACTS)
def _(fx):
    again = F.col("provider_message_id").startswith("again")
    return mailed(fx, ~again, again)["contacts"].select("id", "status", "sent_at", "reply_count", "cancel_reason")


@query("email_send_apply followups", f"""
WITH {MAILED} SELECT c.id AS contact_id, s.went AS last_sent_at, c.outreach_sequence + 1 AS next_sequence, s.went + to_days(([3, 5, 7])[c.outreach_sequence]) AS due_at FROM {{fx_outreach_member}} c
JOIN (SELECT contact_id, max(went) AS went FROM m WHERE went IS NOT NULL GROUP BY 1) s ON s.contact_id = c.id WHERE c.status NOT IN ({TERMINAL}) AND c.outreach_sequence < 4""")
def _(fx):
    return mailed(fx)["followups"].select("contact_id", "last_sent_at", "next_sequence", "due_at")


RECIPIENTS = "SELECT id, org_id AS tenant_id, cnpj_email AS email FROM {fx_prospect} p WHERE cnpj_email IS NOT NULL"


@query("suppression_exclude", f"""
SELECT r.* FROM ({RECIPIENTS}) r WHERE NOT EXISTS (SELECT 1 FROM {{fx_suppression}} s WHERE s.tenant_id = r.tenant_id AND lower(s.email) = lower(r.email))""")
def _(fx):
    return O.suppression_exclude(fx.sql(RECIPIENTS), fx("suppression"))


# --- rate audits ----------------------------------------------------------------------------

SENDS = "SELECT id AS send_id, account_id, contact_id AS recipient_id, created_at AS sent_at FROM {fx_outreach_event} e"


def audit_sql(cfg: R.RateConfig, account: str) -> str:
    rec = cfg.recipient_daily
    rec_rule = f"WHEN recipient_today >= {rec} THEN 'recipient'" if rec else ""
    rec_wait = "WHEN 'recipient' THEN 86400000" if rec else ""
    return f"""
WITH s AS (SELECT send_id, {account} AS account_id, recipient_id, sent_at, epoch_us(sent_at) AS t, sent_at - INTERVAL 3 HOUR AS loc FROM ({SENDS})),
a AS (SELECT *, cast(loc AS date) AS d, epoch_us(loc) - epoch_us(date_trunc('day', loc)) AS tod FROM s),
b AS (SELECT *,
  count(*) OVER (PARTITION BY account_id, d ORDER BY t RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS sent_today,
  count(*) OVER (PARTITION BY account_id ORDER BY t RANGE BETWEEN 3600000000 PRECEDING AND 1 PRECEDING) AS sent_last_hour,
  count(*) OVER (PARTITION BY recipient_id, d ORDER BY t RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS recipient_today,
  (t - max(t) OVER (PARTITION BY account_id ORDER BY t RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) // 1000 AS gap_ms,
  tod >= {cfg.opens * 3600000000} AND tod < {cfg.closes * 3600000000} AS in_hours FROM a),
c AS (SELECT *, CASE WHEN sent_today >= {min(cfg.daily, 5000)} THEN 'daily' WHEN sent_last_hour >= {cfg.hourly} THEN 'hourly' WHEN gap_ms < {cfg.min_gap * 1000} THEN 'gap' {rec_rule}
  WHEN NOT in_hours THEN 'hours' END AS rule FROM b)
SELECT send_id, account_id, sent_today, sent_last_hour, gap_ms, in_hours, rule, rule IS NULL AS allowed{', recipient_today' if rec else ''},
  cast(CASE rule WHEN 'daily' THEN 86400000 WHEN 'hourly' THEN 3600000 WHEN 'gap' THEN {cfg.min_gap * 1000} - gap_ms {rec_wait}
   WHEN 'hours' THEN (CASE WHEN tod < {cfg.opens * 3600000000} THEN {cfg.opens * 3600000000} - tod ELSE {(24 + cfg.opens) * 3600000000} - tod END) // 1000 END AS bigint) AS retry_ms FROM c"""


@query("email_rate_audit", audit_sql(R.EMAIL, "recipient_id"))
def _(fx):
    return R.email_rate_audit(fx.sql(SENDS).withColumn("account_id", F.col("recipient_id"))).drop("recipient_id", "sent_at")


@query("email_rate_audit_busy", audit_sql(R.EMAIL, "account_id"))
def _(fx):
    return R.email_rate_audit(fx.sql(SENDS)).drop("recipient_id", "sent_at")


@query("wa_rate_audit", audit_sql(R.MESSAGING, "recipient_id % 40"))
def _(fx):
    return R.wa_rate_audit(fx.sql(SENDS).withColumn("account_id", F.col("recipient_id") % 40)).drop("recipient_id", "sent_at")


@query("send_jitter", """
SELECT id AS message_id, contact_id,
  cast(floor(60 + cast(concat('0x', substr(md5(cast(id AS string)), 1, 8)) AS bigint) % 10000 / 10000.0::DOUBLE * 540 + 0.5) AS bigint) AS delay_seconds
FROM {fx_outreach_message} m""")
def _(fx):
    return R.send_jitter(fx("outreach_message").select(F.col("id").alias("message_id"), "contact_id"))

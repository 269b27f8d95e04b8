"""Messaging channel queries."""

from pyspark.sql import functions as F

from leadlake.catalog.core import query, values
from leadlake.functions import fixed
from leadlake.operators import intake as I
from leadlake.operators import messaging as M

ACTIVE, TERMINAL = values(fixed.ACTIVE_SEQUENCE), values(fixed.TERMINAL_SEQUENCE)


def optout_sql(c: str) -> str:
    t = f"upper(strip_accents(regexp_replace(coalesce({c}, ''), '^\\s+|\\s+$', '', 'g')))"
    singles = [k for k in fixed.OPT_OUT_KEYWORDS if " " not in k]
    phrases = [k for k in fixed.OPT_OUT_KEYWORDS if " " in k]
    marks = " OR ".join(f"starts_with({t}, '{k}!') OR starts_with({t}, '{k}.')" for k in singles)
    parts = " OR ".join(f"contains({t}, '{k}')" for k in phrases)
    return f"({t} <> '' AND (list_has_any(regexp_split_to_array({t}, '\\s+'), [{values(singles)}]) OR {marks} OR {parts}))"


@query("status_recode", f"""
SELECT o_orderkey, CASE o_orderkey % 9 WHEN 0 THEN 'CONNECTED' WHEN 1 THEN 'CONNECTED' WHEN 2 THEN 'STARTING' WHEN 3 THEN 'QR_REQUIRED' WHEN 4 THEN 'STOPPED' WHEN 5 THEN 'DISCONNECTED' WHEN 6 THEN 'ERROR' END AS session,
  CASE o_orderkey % 9 WHEN 0 THEN 'AUDIO' WHEN 1 THEN 'DOCUMENT' ELSE 'TEXT' END AS media, CASE o_orderkey % 9 WHEN 0 THEN 'ATIVA' WHEN 1 THEN 'BAIXADA' WHEN 2 THEN 'OUTRA' END AS registration FROM {{orders}}""")
def _(fx):
    raw = fx.table("orders").select("o_orderkey", F.col("o_orderkey").alias("k")).withColumn("k", F.col("k") % 9)
    words = {"s": ["working", "CONNECTED", "Starting", "scan_qr_code", "STOPPED", "DISCONNECTED", "failed", "odd", ""],
             "m": ["voice", "FILE", "chat", "", "x", "y", "z", "sticker", "TEXT"],
             "r": ["active", "NULA", "outra", "", "", "", "", "", ""]}
    for c, ws in words.items():
        raw = raw.withColumn(c, F.element_at(F.array(*[F.lit(w) for w in ws]), (F.col("k") + 1).cast("int")))
    out = M.status_recode(M.status_recode(M.status_recode(raw, "session", "s", "session"), "media", "m", "media"), "registration", "r", "registration")
    return out.select("o_orderkey", "session", "media", "registration")


@query("optout_detect", f"SELECT conversation_id, turn, {optout_sql('content')} AS is_opt_out FROM {{fx_wa_message}} m")
def _(fx):
    return M.optout_detect(fx("wa_message")).select("conversation_id", "turn", "is_opt_out")


@query("message_dedupe", "SELECT DISTINCT conversation_id, provider_message_id, turn, direction, content FROM {fx_wa_delivery} d")
def _(fx):
    return M.message_dedupe(fx("wa_delivery")).select("conversation_id", "provider_message_id", "turn", "direction", "content")


STATE = f"""
WITH m AS (SELECT *, CASE WHEN direction = 'INBOUND' THEN {optout_sql('content')} END AS stop FROM {{fx_wa_message}} x),
seq AS (SELECT m.*, coalesce(max(CASE WHEN direction = 'OUTBOUND' THEN 1 END) OVER (PARTITION BY conversation_id ORDER BY sent_epoch, turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS had_out FROM m),
nxt AS (SELECT seq.*, CASE WHEN direction = 'OUTBOUND' AND sent_by IS NOT NULL THEN 'ACTIVE' WHEN direction = 'INBOUND' AND stop THEN 'OPTED_OUT'
  WHEN direction = 'INBOUND' AND had_out = 1 AND prospect_id IS NOT NULL THEN 'HUMAN_HANDOFF' END AS ns FROM seq),
f AS (SELECT conversation_id, arg_max(ns, (sent_epoch, turn)) FILTER (WHERE ns IS NOT NULL) AS ns, bool_or(direction = 'INBOUND' AND NOT stop) AS plain,
  arg_max(sent_by, (sent_epoch, turn)) FILTER (WHERE direction = 'OUTBOUND' AND sent_by IS NOT NULL) AS assigned_to,
  max(sent_epoch) AS last_message_epoch, max(sent_epoch) FILTER (WHERE direction = 'INBOUND') AS last_inbound_epoch FROM nxt GROUP BY 1)
SELECT c.id AS conversation_id, c.org_id, c.prospect_id, coalesce(f.ns, CASE WHEN c.status = 'CLOSED' AND f.plain THEN 'ACTIVE' ELSE c.status END) AS status,
  f.assigned_to, f.last_message_epoch, f.last_inbound_epoch FROM {{fx_wa_conversation}} c LEFT JOIN f ON f.conversation_id = c.id"""


@query("conversation_state", STATE)
def _(fx):
    return M.conversation_state(fx("wa_conversation"), fx("wa_message"))


@query("inbox", """
SELECT c.id AS conversation_id, c.org_id, c.prospect_id, c.phone_number, c.status, c.wa_account_id, c.last_message_epoch, a.session_name, a.status AS account_status,
  p.company_name, coalesce(m.n, 0) AS messages FROM {fx_wa_conversation} c LEFT JOIN {fx_wa_account} a ON a.id = c.wa_account_id LEFT JOIN {fx_prospect} p ON p.id = c.prospect_id
LEFT JOIN (SELECT conversation_id, count(*) AS n FROM {fx_wa_message} x GROUP BY 1) m ON m.conversation_id = c.id""")
def _(fx):
    return M.inbox(fx("wa_conversation"), fx("wa_account"), fx("prospect"), fx("wa_message"))


@query("conversation_history", """
SELECT m.conversation_id, m.org_id, m.turn, m.direction, m.content, m.sent_epoch FROM {fx_wa_message} m
JOIN {fx_wa_conversation} c ON c.id = m.conversation_id AND c.org_id = m.org_id AND c.status = 'ACTIVE'""")
def _(fx):
    return M.conversation_history(fx("wa_conversation").filter("status = 'ACTIVE'"), fx("wa_message")).select(
        "conversation_id", "org_id", "turn", "direction", "content", "sent_epoch")


LEAD_PHONES = """
SELECT DISTINCT org_id, prospect_id, CASE WHEN length(nat) BETWEEN 10 AND 11 THEN '55' || nat ELSE nat END AS phone
FROM (SELECT *, CASE WHEN d LIKE '55%' AND length(d) >= 12 THEN substr(d, 3) ELSE d END AS nat FROM (SELECT *, regexp_replace(raw_phone, '[^0-9]', '', 'g') AS d FROM {fx_phone} p))
"""
ASKED = """
SELECT org_id, phone_number AS phone FROM {fx_wa_conversation} a
UNION ALL SELECT concat('org_', cast(c_custkey % 20 AS string)), concat('(11) 9', lpad(cast(c_custkey AS string), 8, '0')) FROM {customer}
UNION ALL SELECT org_id, raw_phone FROM {fx_phone} b UNION ALL SELECT org_id, '' FROM {fx_phone} c
"""


PHONE_OWNERS = """k AS (SELECT org_id, phone_number AS phone, prospect_id, 0 AS tier FROM {fx_wa_conversation} x WHERE prospect_id IS NOT NULL
  UNION ALL SELECT g.org_id, t.phone_number, t.prospect_id, 1 FROM {fx_wa_contact} t JOIN {fx_wa_campaign} g ON g.id = t.campaign_id WHERE t.phone_number IS NOT NULL
  UNION ALL SELECT org_id, phone, prospect_id, 2 FROM lp),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY org_id, phone ORDER BY tier, prospect_id) AS rn FROM k) WHERE rn = 1)
"""


@query("phone_resolve", f"""
WITH lp AS ({LEAD_PHONES}),
asked AS (SELECT DISTINCT org_id, CASE WHEN length(nat) BETWEEN 10 AND 11 THEN '55' || nat ELSE nat END AS phone
  FROM (SELECT *, CASE WHEN d LIKE '55%' AND length(d) >= 12 THEN substr(d, 3) ELSE d END AS nat FROM (SELECT *, regexp_replace(phone, '[^0-9]', '', 'g') AS d FROM ({ASKED}))) WHERE d <> ''),
{PHONE_OWNERS}
SELECT a.org_id, a.phone, b.prospect_id, b.tier FROM asked a LEFT JOIN b ON b.org_id = a.org_id AND b.phone = a.phone""")
def _(fx):
    lead_phones = I.phone_standardise(fx("phone")).select("org_id", "prospect_id", "phone")
    return M.phone_resolve(fx.sql(ASKED), fx("wa_conversation"), fx("wa_contact"), fx("wa_campaign"), lead_phones)


INBOUND = """
SELECT concat('org_', cast(conv_id % 20 AS string)) AS org_id, concat('55119', lpad(cast(conv_id + CASE WHEN turn > 4 THEN 3000 ELSE 0 END AS string), 8, '0')) AS phone_number,
  cast(conv_id % 4 AS int) AS wa_account_id, CASE WHEN turn < 2 THEN NULL ELSE conv_id + turn END AS prospect_id, cast(turn AS bigint) AS arrived FROM {conversations} WHERE role = 'user'
"""
STORED = "SELECT org_id, phone_number, CASE WHEN id % 2 = 0 THEN wa_account_id END AS wa_account_id, prospect_id, status FROM {fx_wa_conversation} c WHERE status = 'CLOSED' OR prospect_id IS NULL"


@query("conversation_upsert", f"""
WITH i AS (SELECT org_id, phone_number, arg_min(wa_account_id, (arrived, wa_account_id)) AS fa, arg_min(prospect_id, (arrived, prospect_id, wa_account_id)) FILTER (WHERE prospect_id IS NOT NULL) AS lp,
  arg_min(wa_account_id, (arrived, prospect_id, wa_account_id)) FILTER (WHERE prospect_id IS NOT NULL) AS la FROM ({INBOUND}) GROUP BY 1, 2), c AS ({STORED})
SELECT coalesce(c.org_id, i.org_id) AS org_id, coalesce(c.phone_number, i.phone_number) AS phone_number, coalesce(c.prospect_id, i.lp) AS prospect_id,
  CASE WHEN c.org_id IS NULL THEN i.fa WHEN c.prospect_id IS NULL AND i.lp IS NOT NULL THEN coalesce(c.wa_account_id, i.la) ELSE c.wa_account_id END AS wa_account_id,
  CASE WHEN c.org_id IS NULL THEN 'ACTIVE' ELSE c.status END AS status, c.org_id IS NOT NULL AS existed
FROM c FULL JOIN i ON i.org_id = c.org_id AND i.phone_number = c.phone_number""")
def _(fx):
    return M.conversation_upsert(fx.sql(STORED), fx.sql(INBOUND))


ECHO = "SELECT concat('sess_', cast(conv_id % 20 AS string)) AS session, concat('msg_', cast(conv_id AS string), '_', cast(turn AS string)) AS provider_message_id, cast(1704067200 + turn AS bigint) AS happened_at FROM {conversations} WHERE turn > 1"


@query("echo_match", f"""
SELECT m.provider_message_id, m.conversation_id, m.org_id, m.direction, CASE WHEN h AND status IN ('PENDING', 'FAILED') THEN 'SENT' ELSE status END AS status,
  CASE WHEN h THEN coalesce(m.sent_at, m.at) ELSE m.sent_at END AS sent_at, m.delivered_at, m.read_at
FROM (SELECT w.*, e.at, e.at IS NOT NULL AND w.direction = 'OUTBOUND' AS h FROM {{fx_wa_stored}} w
  LEFT JOIN (SELECT a.org_id, x.provider_message_id, min(x.happened_at) AS at FROM ({ECHO}) x JOIN {{fx_wa_account}} a ON a.session_name = x.session GROUP BY 1, 2) e
  ON e.org_id = w.org_id AND e.provider_message_id = w.provider_message_id) m""")
def _(fx):
    return M.echo_match(fx("wa_stored"), fx.sql(ECHO), fx("wa_account"))


ACKS = """
SELECT org_id, provider_message_id, ack, sent_epoch AS happened_at FROM {fx_wa_message} m
UNION ALL SELECT org_id, provider_message_id, cast((ack + 2) % 4 AS int), sent_epoch + 30 FROM {fx_wa_message} n WHERE turn > 1
UNION ALL SELECT org_id, provider_message_id, 1, sent_epoch + 60 FROM {fx_wa_message} o WHERE turn > 4
"""
DELIVERY = f"""
SELECT m.provider_message_id, m.conversation_id, CASE WHEN a.ack >= 3 THEN 'READ' WHEN a.ack >= 2 THEN 'DELIVERED' WHEN a.ack >= 1 THEN 'SENT' ELSE 'PENDING' END AS status, a.s AS sent_at, a.d AS delivered_at, a.r AS read_at
FROM {{fx_wa_message}} m LEFT JOIN (SELECT org_id, provider_message_id, max(ack) AS ack, min(happened_at) FILTER (WHERE ack >= 1) AS s, min(happened_at) FILTER (WHERE ack >= 2) AS d, min(happened_at) FILTER (WHERE ack >= 3) AS r
  FROM ({ACKS}) GROUP BY 1, 2) a ON a.org_id = m.org_id AND a.provider_message_id = m.provider_message_id"""


def pending(fx):
    return fx("wa_message").select("org_id", "provider_message_id", "conversation_id", F.lit("PENDING").alias("status"))


@query("delivery_status", DELIVERY)
def _(fx):
    return M.delivery_status(pending(fx), fx.sql(ACKS)).drop("org_id")


KEPT = f"""
WITH a AS (SELECT org_id, provider_message_id, max(ack) AS ack, min(happened_at) FILTER (WHERE ack >= 1) AS s, min(happened_at) FILTER (WHERE ack >= 2) AS d, min(happened_at) FILTER (WHERE ack >= 3) AS r FROM ({ACKS}) GROUP BY 1, 2)
SELECT m.provider_message_id, m.conversation_id, m.direction,
  CASE WHEN m.status = 'READ' OR a.ack >= 3 THEN 'READ' WHEN m.status = 'DELIVERED' OR a.ack >= 2 THEN 'DELIVERED' WHEN m.status = 'SENT' OR a.ack >= 1 THEN 'SENT' ELSE m.status END AS status,
  least(m.sent_at, a.s) AS sent_at, least(m.delivered_at, a.d) AS delivered_at, least(m.read_at, a.r) AS read_at
FROM {{fx_wa_stored}} m LEFT JOIN a ON a.org_id = m.org_id AND a.provider_message_id = m.provider_message_id"""


@query("delivery_status over stored messages", KEPT)
def _(fx):
    return M.delivery_status(fx("wa_stored"), fx.sql(ACKS)).drop("org_id")


@query("delivery_status in two batches", KEPT)
def _(fx):
    early = F.col("happened_at") % 7 < 3
    acks = fx.sql(ACKS)
    return M.delivery_status(M.delivery_status(fx("wa_stored"), acks.filter(~early)), acks.filter(early)).drop("org_id")


SESSION_EVENTS = """
SELECT concat('sess_', cast(user_id % 30 AS string)) AS session, event_id, ts AS happened_at, CASE event_id % 7 WHEN 0 THEN 'WORKING' WHEN 1 THEN 'Stopped' WHEN 2 THEN 'SCAN_QR_CODE' WHEN 3 THEN 'FAILED' WHEN 4 THEN 'DISCONNECTED' ELSE 'WEIRD' END AS raw_status,
  CASE WHEN event_type = 'view' THEN concat('55119', cast(event_id AS string), '@c.us') END AS me_id FROM {events}
"""
SESSIONS = f"""
WITH e AS (SELECT *, CASE upper(raw_status) WHEN 'WORKING' THEN 'CONNECTED' WHEN 'STOPPED' THEN 'STOPPED' WHEN 'SCAN_QR_CODE' THEN 'QR_REQUIRED' WHEN 'FAILED' THEN 'ERROR' WHEN 'DISCONNECTED' THEN 'DISCONNECTED' END AS mapped FROM ({SESSION_EVENTS})),
f AS (SELECT session, arg_max(mapped, (happened_at, event_id)) AS st, arg_max(raw_status, (happened_at, event_id)) AS raw, arg_max(split_part(me_id, '@', 1), (happened_at, event_id)) FILTER (WHERE me_id IS NOT NULL) AS phone FROM e WHERE mapped IS NOT NULL GROUP BY 1)
SELECT a.id, a.org_id, a.session_name, coalesce(f.st, a.status) AS new_status, f.raw AS raw_status, f.phone AS phone_number, coalesce(f.st, a.status) <> a.status AS changed
FROM {{fx_wa_account}} a LEFT JOIN f ON f.session = a.session_name"""


@query("session_status", SESSIONS)
def _(fx):
    return M.session_status(fx("wa_account"), fx.sql(SESSION_EVENTS))


# --- opt-outs -------------------------------------------------------------------------------

@query("contactable", """
SELECT l.id, l.org_id, coalesce(s.status, 'active') = 'active' AS contactable FROM {fx_lead} l LEFT JOIN {fx_channel_state} s ON s.prospect_id = l.id AND s.channel = 'whatsapp'""")
def _(fx):
    return M.contactable(fx("lead").select("id", "org_id"), fx("channel_state"))


OPTOUTS = """
SELECT concat('org_', cast(o_custkey % 20 AS string)) AS org_id, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE concat(missing, '55119', lpad(cast(o_custkey AS string), 8, '0')) END AS phone,
  CASE WHEN o_orderkey % 4 = 0 THEN NULL WHEN missing = '' THEN o_custkey ELSE o_custkey + 1000000000 END AS prospect_id
FROM (SELECT o_custkey, o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' AND o_orderstatus = 'F' THEN '' ELSE '00' END AS missing FROM {orders}) o
"""


def optouts(fx):
    lead_phones = I.phone_standardise(fx("phone")).select("org_id", "prospect_id", "phone")
    return M.optout_propagate(fx.sql(OPTOUTS), fx("channel_state"), fx("wa_conversation"), fx("wa_member"), fx("wa_campaign"), lead_phones)


@query("optout_propagate", f"""
WITH o AS ({OPTOUTS})
SELECT c.id, c.campaign_id, c.prospect_id, CASE WHEN h THEN 'OPTED_OUT' ELSE c.status END AS status, CASE WHEN h THEN 'opted_out' ELSE c.cancel_reason END AS cancel_reason, c.last_sent_at
FROM (SELECT c.*, c.status NOT IN ('COMPLETED', 'CANCELLED') AND (coalesce(c.phone_number IN (SELECT phone FROM o WHERE phone IS NOT NULL), FALSE)
  OR c.prospect_id IN (SELECT prospect_id FROM o WHERE phone IS NULL AND prospect_id IS NOT NULL)) AS h FROM {{fx_wa_member}} c) c""")
def _(fx):
    return optouts(fx)["contacts"].select("id", "campaign_id", "prospect_id", "status", "cancel_reason", "last_sent_at")


@query("optout_propagate_state", f"""
WITH lp AS ({LEAD_PHONES}),
{PHONE_OWNERS}, outs AS ({OPTOUTS}),
named AS (SELECT prospect_id FROM outs WHERE prospect_id IS NOT NULL
  UNION SELECT b.prospect_id FROM outs o JOIN b ON b.org_id = o.org_id AND b.phone = o.phone WHERE o.prospect_id IS NULL)
SELECT coalesce(s.prospect_id, o.prospect_id) AS prospect_id, 'whatsapp' AS channel, CASE WHEN o.prospect_id IS NOT NULL THEN 'opted_out' ELSE s.status END AS status
FROM {{fx_channel_state}} s FULL JOIN named o ON o.prospect_id = s.prospect_id""")
def _(fx):
    return optouts(fx)["state"]


@query("optout_propagate_conversations", f"""
SELECT c.id, CASE WHEN EXISTS (SELECT 1 FROM ({OPTOUTS}) o WHERE o.org_id = c.org_id AND o.phone = c.phone_number) THEN 'OPTED_OUT' ELSE c.status END AS status FROM {{fx_wa_conversation}} c""")
def _(fx):
    return optouts(fx)["conversations"].select("id", "status")


BLOCKS = "SELECT DISTINCT CASE WHEN o_orderpriority = '5-LOW' AND o_orderstatus = 'O' THEN o_custkey ELSE o_custkey + 1000000000 END AS prospect_id FROM {orders}"


@query("do_not_contact", f"""
SELECT id, campaign_id, CASE WHEN h THEN 'CANCELLED' ELSE status END AS status, CASE WHEN h THEN 'do_not_contact' ELSE cancel_reason END AS cancel_reason, last_sent_at
FROM (SELECT c.*, prospect_id IN ({BLOCKS}) AND status NOT IN ('COMPLETED', 'CANCELLED') AS h FROM {{fx_wa_member}} c)""")
def _(fx):
    return M.do_not_contact(fx.sql(BLOCKS), fx("channel_state"), fx("wa_member"))["contacts"].select("id", "campaign_id", "status", "cancel_reason", "last_sent_at")


STOPPED = f"""
SELECT id, campaign_id, CASE WHEN h THEN 'REPLIED' ELSE status END AS status, CASE WHEN h THEN 'replied' ELSE cancel_reason END AS cancel_reason, last_sent_at
FROM (SELECT c.*, prospect_id IN ({BLOCKS}) AND status IN ({ACTIVE}) AS h FROM {{fx_wa_member}} c)"""


@query("automation_stop", STOPPED)
def _(fx):
    return M.automation_stop(fx.sql(BLOCKS), fx("wa_member")).select("id", "campaign_id", "status", "cancel_reason", "last_sent_at")


@query("automation_stop in two batches", STOPPED)
def _(fx):
    blocks, odd = fx.sql(BLOCKS), F.col("prospect_id") % 2 == 1
    return M.automation_stop(blocks.filter(~odd), M.automation_stop(blocks.filter(odd), fx("wa_member"))).select(
        "id", "campaign_id", "status", "cancel_reason", "last_sent_at")


# --- campaigns ------------------------------------------------------------------------------

STEP_JSON = """
SELECT o_orderkey AS id, concat('[{"messageTemplate":"Hi {{firstName}}","delayMinutes":', CASE o_orderkey % 3 WHEN 0 THEN '"x"' WHEN 1 THEN '15' ELSE 'null' END, ',"conditions":["a"]},',
  '{"orderIndex":7,"messageTemplate":"  "},{"orderIndex":', CASE o_orderkey % 2 WHEN 0 THEN '"q"' ELSE '5' END, ',"messageTemplate":"', o_orderpriority, '","delayDays":1.5}]') AS steps FROM {orders}
"""


@query("campaign_steps_normalise", """
SELECT o_orderkey AS campaign_id, 0 AS order_index, CASE o_orderkey % 3 WHEN 1 THEN 15 ELSE 0 END AS delay_minutes, 'Hi {{firstName}}' AS message_template, '["a"]' AS conditions FROM {orders}
UNION ALL SELECT o_orderkey, CASE o_orderkey % 2 WHEN 0 THEN 2 ELSE 5 END, 2160, o_orderpriority, NULL FROM {orders}""")
def _(fx):
    return M.campaign_steps_normalise(fx.sql(STEP_JSON))


@query("campaign_list", """
SELECT c.id AS campaign_id, c.org_id, c.status, c.wa_account_id, a.session_name, a.status AS account_status, coalesce(n.n, 0) AS contacts, s.order_index, s.delay_minutes, s.message_template
FROM {fx_wa_campaign} c LEFT JOIN {fx_wa_account} a ON a.id = c.wa_account_id LEFT JOIN (SELECT campaign_id, count(*) AS n FROM {fx_wa_contact} x GROUP BY 1) n ON n.campaign_id = c.id
LEFT JOIN {fx_wa_step} s ON s.campaign_id = c.id""")
def _(fx):
    return M.campaign_list(fx("wa_campaign"), fx("wa_step"), fx("wa_account"), fx("wa_contact"))


@query("campaign_detail", """
SELECT t.id AS contact_id, t.campaign_id, t.prospect_id, t.phone_number, t.status, t.step_index, c.org_id, p.company_name, p.city
FROM {fx_wa_contact} t JOIN {fx_wa_campaign} c ON c.id = t.campaign_id LEFT JOIN {fx_prospect} p ON p.id = t.prospect_id""")
def _(fx):
    return M.campaign_detail(fx("wa_campaign"), fx("wa_contact"), fx("prospect"))


@query("campaign_completion", f"""
SELECT c.id AS campaign_id, c.org_id, coalesce(n.n, 0) AS active, coalesce(n.n, 0) = 0 AS complete FROM {{fx_wa_campaign}} c
LEFT JOIN (SELECT campaign_id, count(*) AS n FROM {{fx_wa_contact}} x WHERE status IN ({ACTIVE}) AND campaign_id % 3 <> 0 GROUP BY 1) n ON n.campaign_id = c.id""")
def _(fx):
    done = F.when(F.col("campaign_id") % 3 == 0, "COMPLETED").otherwise(F.col("status"))
    return M.campaign_completion(fx("wa_campaign"), fx("wa_contact").withColumn("status", done)).select("campaign_id", "org_id", "active", "complete")


COMMANDS = """
SELECT CASE WHEN o_orderstatus <> 'P' OR o_totalprice > 495000 THEN o_custkey % 25 ELSE o_custkey + 1000 END AS campaign_id, o_orderkey AS command_id, o_orderdate AS happened_at,
  CASE o_orderstatus WHEN 'F' THEN 'pause' WHEN 'O' THEN 'resume' ELSE 'cancel' END AS command FROM {orders}
"""


@query("campaign_transition", f"""
WITH l AS (SELECT campaign_id, arg_max(command, (happened_at, command_id)) AS cmd FROM ({COMMANDS}) GROUP BY 1)
SELECT c.id, c.org_id, coalesce(CASE l.cmd WHEN 'pause' THEN 'PAUSED' WHEN 'resume' THEN 'RUNNING' WHEN 'cancel' THEN 'CANCELLED' END, c.status) AS status FROM {{fx_wa_campaign}} c LEFT JOIN l ON l.campaign_id = c.id""")
def _(fx):
    return M.campaign_transition(fx("wa_campaign"), fx("wa_contact"), fx.sql(COMMANDS))["campaigns"].select("id", "org_id", "status")


@query("campaign_transition_contacts", f"""
SELECT id, campaign_id, CASE WHEN h THEN 'CANCELLED' ELSE status END AS status, CASE WHEN h THEN 'cancelled' ELSE cancel_reason END AS cancel_reason, last_sent_at
FROM (SELECT t.*, status IN ({ACTIVE}) AND campaign_id IN (SELECT campaign_id FROM ({COMMANDS}) WHERE command = 'cancel') AS h FROM {{fx_wa_member}} t)""")
def _(fx):
    return M.campaign_transition(fx("wa_campaign"), fx("wa_member"), fx.sql(COMMANDS))["contacts"].select("id", "campaign_id", "status", "cancel_reason", "last_sent_at")


SELECTION = """
SELECT c_custkey % 20 AS campaign_id, concat('org_', cast(c_custkey % 20 AS string)) AS org_id, c_custkey AS pos, c_custkey AS prospect_id FROM {customer} a
UNION ALL SELECT cast(c_nationkey AS bigint), concat('org_', cast(c_nationkey % 20 AS string)), c_custkey + 100000, c_custkey FROM {customer} b WHERE c_nationkey % 20 <> c_custkey % 20
"""


def started(fx):
    return M.campaign_start(fx("wa_campaign"), fx("wa_step"), fx("wa_account"), fx.sql(SELECTION), fx("phone"), fx("channel_state"), fx("prospect"))


CONTACTS = f"""
WITH ph AS (SELECT prospect_id, regexp_replace(raw_phone, '[^0-9]', '', 'g') AS d FROM {{fx_phone}} f WHERE pos = 0),
nm AS (SELECT prospect_id, CASE WHEN length(nat) BETWEEN 10 AND 11 THEN '55' || nat ELSE nat END AS phone FROM (SELECT *, CASE WHEN d LIKE '55%' AND length(d) >= 12 THEN substr(d, 3) ELSE d END AS nat FROM ph))
SELECT s.campaign_id, s.org_id, s.prospect_id, s.pos, nm.phone AS phone_number, CASE WHEN coalesce(cs.status, 'active') = 'active' AND nm.phone IS NOT NULL THEN 'QUEUED' ELSE 'CANCELLED' END AS status,
  CASE WHEN coalesce(cs.status, 'active') <> 'active' THEN 'do_not_contact' WHEN nm.phone IS NULL THEN 'no_phone' END AS cancel_reason,
  CASE WHEN coalesce(cs.status, 'active') = 'active' AND nm.phone IS NOT NULL THEN s.pos * 1000 END AS delay_ms
FROM ({SELECTION}) s JOIN {{fx_wa_campaign}} c ON c.id = s.campaign_id AND c.org_id = s.org_id JOIN {{fx_wa_account}} a ON a.id = c.wa_account_id AND a.status = 'CONNECTED'
JOIN {{fx_prospect}} p ON p.id = s.prospect_id AND p.org_id = s.org_id LEFT JOIN nm ON nm.prospect_id = s.prospect_id LEFT JOIN {{fx_channel_state}} cs ON cs.prospect_id = s.prospect_id"""


@query("campaign_start", CONTACTS)
def _(fx):
    return started(fx)["contacts"]


NEXT = "SELECT c.id AS contact_id, c.campaign_id, c.step_index, TIMESTAMP '2024-01-01 00:00:00' AS sent_at FROM {fx_wa_contact} c"


@query("sequence_next_step", f"""
SELECT n.contact_id, n.campaign_id, n.step_index, CASE WHEN s.campaign_id IS NOT NULL THEN n.step_index + 1 END AS next_step_index,
  CASE WHEN s.campaign_id IS NOT NULL THEN n.sent_at + to_seconds(greatest(1, s.delay_minutes * 60)) END AS due_at, s.campaign_id IS NULL AS complete
FROM ({NEXT}) n LEFT JOIN {{fx_wa_step}} s ON s.campaign_id = n.campaign_id AND s.order_index = n.step_index + 1""")
def _(fx):
    sent = fx.sql(NEXT.replace("TIMESTAMP '", "TIMESTAMP_NTZ '"))
    return M.sequence_next_step(sent, fx("wa_step"))


DUE = """
SELECT CASE WHEN c_acctbal < 0 THEN c_custkey + 1000000000 ELSE c_custkey END AS contact_id, cast(c_custkey % 4 AS int) AS step_index FROM {customer}
"""
LEADS = "SELECT CASE WHEN industry IS NULL THEN -id ELSE id END AS id, org_id, company_name, trade_name, city, industry, partner_name, partner_role FROM {fx_lead} l"
EXISTING = "SELECT CASE WHEN c_acctbal > 5000 THEN c_custkey ELSE -c_custkey END AS campaign_contact_id, cast(0 AS int) AS step_index FROM {customer}"
RATE = "SELECT c_custkey AS contact_id, c_acctbal < 8000 AS allowed, cast(45000 AS bigint) AS retry_ms FROM {customer}"
FIRST_NAME = "regexp_extract(coalesce(nullif(trim(l.partner_name), ''), nullif(trim(l.trade_name), ''), l.company_name), '^\\s*(\\S+)', 1)"
RENDERED = f"""trim(CASE WHEN s.message_template = '{{{{unknown}}}}' THEN '' ELSE 'Hi ' || {FIRST_NAME} || ' of ' || l.company_name || ' in ' || l.city || ' ' || coalesce(l.partner_role, '') END)"""
DECIDED = f"""
WITH b AS (SELECT d.*, c.id AS cid, c.campaign_id, c.prospect_id, c.status AS ct, c.phone_number, k.org_id, k.status AS ca, a.status AS ac, l.id AS lid, cs.status AS cst, r.allowed, e.campaign_contact_id AS ex, {RENDERED} AS content
  FROM ({DUE}) d LEFT JOIN {{fx_wa_contact}} c ON c.id = d.contact_id LEFT JOIN {{fx_wa_campaign}} k ON k.id = c.campaign_id LEFT JOIN {{fx_wa_account}} a ON a.id = k.wa_account_id
  LEFT JOIN ({LEADS}) l ON l.id = c.prospect_id LEFT JOIN {{fx_channel_state}} cs ON cs.prospect_id = c.prospect_id LEFT JOIN ({RATE}) r ON r.contact_id = d.contact_id
  LEFT JOIN ({EXISTING}) e ON e.campaign_contact_id = d.contact_id AND e.step_index = d.step_index LEFT JOIN {{fx_wa_step}} s ON s.campaign_id = c.campaign_id AND s.order_index = d.step_index),
o AS (SELECT *, CASE WHEN cid IS NULL THEN 'contact_not_found' WHEN lid IS NULL THEN 'prospect_not_found' WHEN ca = 'CANCELLED' THEN 'campaign_cancelled' WHEN ca = 'PAUSED' THEN 'paused'
  WHEN ca <> 'RUNNING' THEN 'campaign_' || ca WHEN ct IN ({TERMINAL}) THEN 'contact_' || ct WHEN coalesce(cst, 'active') <> 'active' THEN 'do_not_contact' WHEN coalesce(ac, '') <> 'CONNECTED' THEN 'account_not_connected'
  WHEN step_index >= 3 THEN 'completed' WHEN phone_number IS NULL THEN 'no_phone' WHEN ex IS NOT NULL THEN 'already_exists' WHEN NOT coalesce(allowed, TRUE) THEN 'rate_limited' WHEN content = '' THEN 'empty_template' ELSE 'send' END AS outcome FROM b)
SELECT contact_id, step_index, campaign_id, org_id, prospect_id, phone_number, outcome,
  CASE WHEN outcome IN ('campaign_cancelled', 'do_not_contact', 'no_phone', 'empty_template') THEN 'CANCELLED' WHEN outcome = 'completed' THEN 'COMPLETED' WHEN outcome = 'send' THEN 'SENDING' END AS contact_status,
  CASE WHEN outcome = 'campaign_cancelled' THEN 'cancelled' WHEN outcome IN ('do_not_contact', 'no_phone', 'empty_template') THEN outcome END AS reason,
  CASE outcome WHEN 'paused' THEN 60000 WHEN 'rate_limited' THEN 45000 END AS retry_ms, CASE WHEN outcome = 'send' THEN content END AS content FROM o"""


def decided(fx):
    return M.sequence_decide(fx.sql(DUE), fx("wa_contact"), fx("wa_campaign"), fx.sql(LEADS), fx("wa_account"), fx("wa_step"),
                             fx("channel_state"), fx.sql(EXISTING), fx.sql(RATE))


@query("sequence_decide", DECIDED)
def _(fx):
    return decided(fx)


@query("sequence_emit", f"""
SELECT contact_id AS campaign_contact_id, step_index, org_id, phone_number, 'OUTBOUND' AS direction, 'TEXT' AS type, content, 'PENDING' AS status FROM ({DECIDED}) WHERE outcome = 'send'""")
def _(fx):
    return M.sequence_emit(decided(fx), fx.sql(EXISTING))["messages"]


@query("template_render", f"""
SELECT l.id, c.campaign_id, s.order_index, {RENDERED} AS content FROM {{fx_lead}} l JOIN {{fx_wa_contact}} c ON c.prospect_id = l.id JOIN {{fx_wa_step}} s ON s.campaign_id = c.campaign_id""")
def _(fx):
    leads = fx("lead").join(fx("wa_contact").select(F.col("prospect_id").alias("id"), "campaign_id"), "id")
    return M.template_render(leads, fx("wa_step"), ["campaign_id"]).select("id", "campaign_id", "order_index", "content")


GATE = """
SELECT c.id AS message_id, c.id AS campaign_contact_id, cast(c.campaign_id AS int) AS wa_account_id, CASE c.id % 5 WHEN 0 THEN 'SENT' WHEN 1 THEN 'READ' ELSE 'PENDING' END AS status FROM {fx_wa_contact} c
"""


@query("wa_send_gate", f"""
SELECT message_id, status, outcome, CASE outcome WHEN 'failed' THEN 'contact_terminal_state' WHEN 'error' THEN 'account_not_connected' END AS error FROM (
SELECT g.message_id, g.status, CASE WHEN g.status IN ('SENT', 'DELIVERED', 'READ') THEN 'already_sent' WHEN coalesce(a.status, '') <> 'CONNECTED' THEN 'error'
  WHEN c.status IN ('REPLIED', 'OPTED_OUT', 'CANCELLED') THEN 'failed' ELSE 'send' END AS outcome
FROM ({GATE}) g LEFT JOIN {{fx_wa_contact}} c ON c.id = g.campaign_contact_id LEFT JOIN {{fx_wa_account}} a ON a.id = g.wa_account_id)""")
def _(fx):
    return M.wa_send_gate(fx.sql(GATE), fx("wa_contact"), fx("wa_account")).select("message_id", "status", "outcome", "error")


ANSWERS = """
SELECT CASE WHEN c_mktsegment = 'BUILDING' THEN -c_custkey ELSE c_custkey END AS message_id, c_acctbal > 0 AS ok, CASE WHEN c_acctbal > 0 THEN concat('p', cast(c_custkey AS string)) END AS provider_message_id,
  CASE WHEN c_acctbal <= 0 THEN 'boom' END AS error, TIMESTAMP '2024-01-01 00:00:00' AS happened_at FROM {customer} a
UNION ALL SELECT c_custkey, TRUE, concat('q', cast(c_custkey AS string)), NULL, TIMESTAMP '2024-01-01 01:00:00' FROM {customer} b WHERE c_custkey % 4 = 0
UNION ALL SELECT c_custkey, FALSE, NULL, 'busy', TIMESTAMP '2023-12-31 23:00:00' FROM {customer} c WHERE c_custkey % 5 = 0
"""
ANSWERED = f"""
r AS (SELECT message_id, min(happened_at) FILTER (WHERE ok) AS good_at, arg_min(provider_message_id, happened_at) FILTER (WHERE ok) AS pid,
  max(happened_at) FILTER (WHERE NOT ok) AS bad_at, arg_max(error, happened_at) FILTER (WHERE NOT ok) AS err FROM ({ANSWERS}) GROUP BY 1),
m AS (SELECT w.*, r.good_at, r.pid, r.bad_at, r.err, w.status NOT IN ('SENT', 'DELIVERED', 'READ') AND r.good_at IS NOT NULL AS sends,
  w.status NOT IN ('SENT', 'DELIVERED', 'READ') AND r.good_at IS NULL AND r.bad_at IS NOT NULL AS fails FROM {{fx_wa_outbox}} w LEFT JOIN r ON r.message_id = w.id),
n AS (SELECT m.*, s.order_index AS next_index, s.campaign_id IS NULL AS complete FROM m LEFT JOIN {{fx_wa_step}} s ON s.campaign_id = m.campaign_id AND s.order_index = m.step_index + 1 WHERE sends)"""


def applied(fx, keep=None):
    answers = fx.sql(ANSWERS.replace("TIMESTAMP '", "TIMESTAMP_NTZ '"))
    state = [fx("wa_outbox"), fx("wa_member"), fx("wa_conversation").withColumn("last_message_at", F.lit(None).cast("timestamp_ntz"))]
    for part in keep or [F.lit(True)]:
        out = M.wa_send_apply(answers.filter(part), *state, fx("wa_step"))
        state = [out["messages"], out["contacts"], out["conversations"]]
    return out


SENT_STATE = f"""
WITH {ANSWERED}
SELECT id, CASE WHEN sends THEN 'SENT' WHEN fails THEN 'FAILED' ELSE status END AS status, CASE WHEN sends THEN pid ELSE provider_message_id END AS provider_message_id,
  CASE WHEN sends THEN NULL WHEN fails THEN err ELSE error END AS error, CASE WHEN sends THEN good_at ELSE sent_at END AS sent_at,
  CASE WHEN sends OR fails THEN CASE WHEN bad_at IS NULL OR bad_at > good_at THEN failed_at ELSE bad_at END ELSE failed_at END AS failed_at FROM m"""


@query("wa_send_apply", SENT_STATE)
def _(fx):
    return applied(fx)["messages"].select("id", "status", "provider_message_id", "error", "sent_at", "failed_at")


@query("wa_send_apply in two batches", SENT_STATE)
def _(fx):
    late = F.col("happened_at") >= F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    return applied(fx, [~late, late])["messages"].select("id", "status", "provider_message_id", "error", "sent_at", "failed_at")


@query("wa_send_apply contacts", f"""
WITH {ANSWERED}
SELECT c.id, CASE WHEN c.status NOT IN ('QUEUED', 'SENDING', 'SENT') OR n.id IS NULL THEN c.status WHEN n.complete THEN 'COMPLETED' ELSE 'SENT' END AS status, c.cancel_reason,
  CASE WHEN n.id IS NULL THEN c.last_sent_at ELSE greatest(n.good_at, c.last_sent_at) END AS last_sent_at FROM {{fx_wa_member}} c LEFT JOIN n ON n.campaign_contact_id = c.id""")
def _(fx):
    return applied(fx)["contacts"].select("id", "status", "cancel_reason", "last_sent_at")


@query("wa_send_apply conversations", f"""
WITH {ANSWERED} SELECT c.id, s.at AS last_message_at FROM {{fx_wa_conversation}} c LEFT JOIN (SELECT conversation_id, max(good_at) AS at FROM n GROUP BY 1) s ON s.conversation_id = c.id""")
def _(fx):
    return applied(fx)["conversations"].select("id", "last_message_at")


@query("wa_send_apply_next", f"WITH {ANSWERED} SELECT campaign_contact_id AS contact_id, step_index, next_index AS next_step_index, complete FROM n")
def _(fx):
    return applied(fx)["next_steps"].select("contact_id", "step_index", "next_step_index", "complete")

"""Business views over the driver tables.

The statements are portable: Spark runs them over views of the parquet files and DuckDB as common
table expressions, so both sides start from the same rows. ``{name}`` is a driver table,
``{fx_name}`` another view.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame, SparkSession

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "pages", "benchmark", "labels", "conversations",
]

VIEWS: dict[str, str] = {}

VIEWS["fx_prospect"] = """
SELECT c.c_custkey AS id, lpad(cast(c.c_custkey AS string), 14, '0') AS cnpj, c.c_name AS company_name,
  CASE WHEN c.c_custkey % 4 = 0 THEN NULL ELSE concat('Trade ', c.c_name) END AS trade_name,
  CASE c.c_custkey % 7 WHEN 0 THEN 'lead' WHEN 1 THEN 'lead' WHEN 2 THEN 'prospect' WHEN 3 THEN 'prospect'
    WHEN 4 THEN 'qualified' WHEN 5 THEN 'closed' ELSE 'contacted' END AS status,
  cast((c.c_custkey * 37) % 101 AS int) AS opportunity_score,
  CASE c.c_custkey % 5 WHEN 0 THEN NULL WHEN 1 THEN o.rev_min WHEN 2 THEN o.rev_max
    WHEN 3 THEN o.rev_sum ELSE o.rev_sum * 5 END AS revenue_estimate,
  CASE WHEN c.c_custkey % 9 = 0 THEN NULL ELSE cast((c.c_custkey * 13) % 700 AS int) END AS employees,
  CASE WHEN c.c_custkey % 11 = 0 THEN NULL ELSE c.c_mktsegment END AS industry,
  r.r_name AS city, n.n_name AS state,
  CASE c.c_custkey % 4 WHEN 0 THEN NULL WHEN 1 THEN concat('c', cast(c.c_custkey AS string), '@gmail.com')
    ELSE concat('Contact@Co', cast(c.c_custkey AS string), '.com.br') END AS cnpj_email,
  CASE WHEN c.c_custkey % 3 = 0 THEN NULL ELSE 'LTDA' END AS cnpj_legal_nature,
  CASE WHEN c.c_custkey % 6 = 0 THEN NULL
    ELSE make_date(cast(1995 + c.c_custkey % 12 AS int), cast(1 + c.c_custkey % 12 AS int), 1) END AS cnpj_opened_at,
  CASE c.c_custkey % 5 WHEN 0 THEN 'pending' WHEN 1 THEN 'error' WHEN 2 THEN 'unavailable' ELSE 'enriched' END AS enrichment_status,
  CASE WHEN c.c_custkey % 5 = 0 THEN NULL ELSE o.last_ts END AS enriched_at,
  concat('org_', cast(c.c_custkey % 20 AS string)) AS org_id,
  coalesce(o.first_ts, TIMESTAMP '1995-01-01 00:00:00') AS created_at
FROM {customer} c JOIN {nation} n ON c.c_nationkey = n.n_nationkey JOIN {region} r ON n.n_regionkey = r.r_regionkey
LEFT JOIN (SELECT o_custkey, min(cast(floor(o_totalprice) AS bigint)) AS rev_min,
    max(cast(floor(o_totalprice) AS bigint)) AS rev_max, cast(sum(cast(floor(o_totalprice) AS bigint)) AS bigint) AS rev_sum,
    min(o_orderdate) AS first_ts, max(o_orderdate) AS last_ts FROM {orders} GROUP BY o_custkey) o
  ON c.c_custkey = o.o_custkey
"""

VIEWS["fx_organization"] = """
SELECT concat(CASE WHEN n_name = 'NATION_19' THEN 'left_' ELSE 'org_' END, cast(n_nationkey AS string)) AS id, concat('Org ', n_name) AS name,
  CASE n_nationkey % 3 WHEN 0 THEN 'premium' WHEN 1 THEN 'trial' ELSE NULL END AS plan
FROM {nation}
"""

VIEWS["fx_phone"] = """
SELECT CASE WHEN c_acctbal >= 0 THEN c_custkey ELSE -c_custkey END AS prospect_id, concat('org_', cast(c_custkey % 20 AS string)) AS org_id, cast(p AS int) AS pos,
  CASE c_custkey % 3
    WHEN 0 THEN concat('(', cast(11 + c_custkey % 80 AS string), ') 9', lpad(cast((c_custkey * 7919 + p) % 10000 AS string), 4, '0'), '-', lpad(cast((c_custkey * 104729) % 10000 AS string), 4, '0'))
    WHEN 1 THEN concat('+55 ', cast(11 + c_custkey % 80 AS string), ' 9', lpad(cast((c_custkey * 7919) % 10000 AS string), 4, '0'), lpad(cast((c_custkey * 104729) % 10000 AS string), 4, '0'))
    ELSE lpad(cast((c_custkey * 31 + p) % 1000 AS string), 3, '0') END AS raw_phone
FROM (SELECT c_custkey, c_acctbal, 0 AS p FROM {customer} UNION ALL SELECT c_custkey, c_acctbal, 1 AS p FROM {customer}) x
"""

VIEWS["fx_partner"] = """
SELECT s_suppkey % 50 AS prospect_id, cast(s_suppkey AS int) AS pos, s_name AS name,
  CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE 'Partner' END AS qualification
FROM {supplier}
"""

VIEWS["fx_registry"] = """
SELECT concat(CASE WHEN c_acctbal < 9000 THEN '0' ELSE '9' END, lpad(cast(c_custkey AS string), 13, '0')) AS cnpj, c_name AS legal_name,
  CASE WHEN c_custkey % 6 = 0 THEN '' ELSE concat('Reg ', c_name) END AS trade_name,
  cast(1000 + c_custkey % 50 AS string) AS cnae, c_mktsegment AS cnae_description,
  r.r_name AS city, n.n_name AS state,
  CASE c_custkey % 4 WHEN 0 THEN 'BAIXADA' WHEN 1 THEN 'ATIVA' WHEN 2 THEN 'ativo' ELSE 'SUSPENSA' END AS registration_status,
  CASE WHEN c_custkey % 3 = 0 THEN c_custkey % 2 = 0 ELSE NULL END AS is_active,
  CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE concat('reg', cast(c_custkey AS string), '@corp.com') END AS email
FROM {customer} c JOIN {nation} n ON c_nationkey = n.n_nationkey JOIN {region} r ON n.n_regionkey = r.r_regionkey
"""

VIEWS["fx_profile"] = """
SELECT concat('org_', cast(n_nationkey AS string)) AS org_id,
  CASE WHEN n_nationkey % 5 = 0 THEN '' ELSE concat('Company ', n_name) END AS company_name,
  CASE WHEN n_nationkey % 4 = 0 THEN '' ELSE concat(cast(1000 + n_nationkey AS string), ', ', cast(1025 + n_nationkey AS string), ',, 1000') END AS target_cnaes,
  CASE WHEN n_nationkey % 3 = 0 THEN 'machinery, MACHINERY ,Building' ELSE '' END AS target_segments,
  CASE n_nationkey % 4 WHEN 0 THEN concat('Asia (', 'SP', ')') WHEN 1 THEN 'America' WHEN 2 THEN 'Africa' ELSE '' END AS target_locations,
  CASE WHEN n_nationkey % 2 = 0 THEN 'active' ELSE '' END AS company_statuses, cast(n_nationkey - 3 AS int) AS onboarding_step
FROM {nation}
"""

VIEWS["fx_user"] = """
SELECT s_suppkey AS id, concat('org_', cast(s_suppkey % 40 AS string)) AS org_id, concat('user', cast(s_suppkey AS string), '@corp.com') AS email,
  CASE WHEN s_suppkey % 3 = 0 THEN '' WHEN s_suppkey % 3 = 1 THEN NULL ELSE s_name END AS name,
  cast(s_suppkey % 7 AS int) AS created_at
FROM {supplier}
"""

VIEWS["fx_result_once"] = """
SELECT o_custkey AS company_key, lpad(cast(o_custkey AS string), 14, '0') AS cnpj,
  cast(month(o_orderdate) AS int) AS enrichment_version,
  CASE o_orderstatus WHEN 'F' THEN 'COMPLETED' WHEN 'O' THEN 'PARTIAL' ELSE CASE WHEN o_orderkey % 4 = 0 THEN 'DISCARDED' ELSE 'FAILED' END END AS status,
  CASE WHEN o_orderkey % 8 = 0 THEN NULL ELSE cast((o_orderkey * 31) % 101 AS int) END AS commercial_potential,
  o_orderdate AS event_ts, o_orderkey AS event_id, o_orderpriority
FROM {orders}
"""

VIEWS["fx_enrichment_result"] = """
SELECT company_key, cnpj, enrichment_version, status, commercial_potential, event_ts, event_id FROM {fx_result_once} a
UNION ALL
SELECT company_key, cnpj, enrichment_version, status, commercial_potential, event_ts, event_id FROM {fx_result_once} b
WHERE o_orderpriority = '1-URGENT'
"""

VIEWS["fx_stage_change"] = """
SELECT o_custkey AS prospect_id, o_orderkey AS change_id,
  CASE o_orderstatus WHEN 'F' THEN 'qualified' WHEN 'O' THEN 'prospect' ELSE 'lead' END AS status, o_orderdate AS changed_at
FROM {orders}
"""

VIEWS["fx_outreach_event"] = """
SELECT event_id AS id, user_id AS contact_id, user_id % 40 AS prospect_id, cast(floor(event_id / 4) AS bigint) AS message_id,
  CASE event_type WHEN 'signup' THEN 'email_scheduled' WHEN 'click' THEN 'email_sent' WHEN 'view' THEN 'email_opened_inferred'
    WHEN 'purchase' THEN 'email_replied' ELSE 'email_failed' END AS type,
  ts AS created_at, user_id % 3 AS account_id
FROM {events}
"""

VIEWS["fx_outreach_contact"] = """
SELECT user_id AS id, user_id % 40 AS prospect_id, user_id % 6 AS campaign_id, concat('org_', cast(user_id % 20 AS string)) AS tenant_id,
  cast(1 + user_id % 4 AS int) AS outreach_sequence,
  CASE user_id % 8 WHEN 0 THEN 'REPLIED' WHEN 1 THEN 'UNSUBSCRIBED' WHEN 2 THEN 'CANCELLED' WHEN 3 THEN 'SCHEDULED' ELSE 'SENT' END AS status,
  CASE WHEN user_id % 9 = 0 THEN NULL ELSE user_id % 3 END AS email_account_id, min(ts) AS created_at
FROM {events} GROUP BY user_id
"""

VIEWS["fx_outreach_message"] = """
SELECT cast(floor(event_id / 4) AS bigint) AS id, min(user_id) AS contact_id, min(ts) AS created_at,
  concat('tok_', cast(cast(floor(event_id / 4) AS bigint) AS string)) AS tracking_token,
  concat('th_', cast(cast(floor(event_id / 4) AS bigint) % 997 AS string)) AS thread_id,
  CASE cast(floor(event_id / 4) AS bigint) % 3 WHEN 0 THEN 'SCHEDULED' ELSE 'SENT' END AS status,
  concat('Subject ', cast(cast(floor(event_id / 4) AS bigint) AS string)) AS subject,
  CASE cast(floor(event_id / 4) AS bigint) % 2 WHEN 0 THEN 'no address here'
    ELSE concat('write to lead', cast(min(user_id) AS string), '@corp.com.br now') END AS body
FROM {events} GROUP BY cast(floor(event_id / 4) AS bigint)
"""

VIEWS["fx_outreach_campaign"] = """
SELECT user_id % 6 AS id, concat('Campaign ', cast(user_id % 6 AS string)) AS name, 'draft' AS status, 'org_1' AS tenant_id
FROM {events} GROUP BY user_id % 6
"""

VIEWS["fx_email_account"] = """
SELECT user_id % 3 AS id, concat('sender', cast(user_id % 3 AS string), '@corp.com') AS email FROM {events} GROUP BY user_id % 3
"""

VIEWS["fx_reply"] = """
SELECT event_id AS reply_id, user_id % 3 AS account_id, concat('th_', cast(cast(floor(event_id / 4) AS bigint) % 997 AS string)) AS thread_id,
  CASE WHEN value > 90 THEN concat('Me <sender', cast(user_id % 3 AS string), '@corp.com>')
    ELSE concat('lead', cast(user_id AS string), '@corp.com.br') END AS from_email, ts AS replied_at
FROM {events} WHERE event_type = 'purchase'
"""

VIEWS["fx_suppression"] = """
SELECT DISTINCT concat('org_', cast(c_custkey % 20 AS string)) AS tenant_id,
  concat(CASE WHEN c_acctbal < 1000 THEN 'contact' ELSE 'office' END, '@co', cast(c_custkey AS string), '.com.br') AS email,
  CASE c_custkey % 3 WHEN 0 THEN 'unsubscribed' WHEN 1 THEN 'bounce' ELSE 'manual' END AS reason
FROM {customer}
"""

VIEWS["fx_wa_message"] = """
SELECT conv_id AS conversation_id, concat('org_', cast(conv_id % 20 AS string)) AS org_id,
  CASE WHEN conv_id % 5 = 0 THEN NULL ELSE conv_id % 50 END AS prospect_id, cast(turn AS int) AS turn,
  CASE role WHEN 'user' THEN 'INBOUND' ELSE 'OUTBOUND' END AS direction,
  CASE role WHEN 'system' THEN concat('agent_', cast(conv_id % 3 AS string)) END AS sent_by,
  CASE WHEN role = 'user' AND (conv_id + turn) % 17 = 0 THEN 'não quero mais'
    WHEN role = 'user' AND (conv_id + turn) % 19 = 0 THEN 'Por favor, STOP'
    WHEN role = 'user' AND (conv_id + turn) % 23 = 0 THEN ' sair! ' ELSE text END AS content,
  concat('msg_', cast(conv_id AS string), '_', cast(turn AS string)) AS provider_message_id,
  cast(1704067200 + conv_id * 3600 + turn * 600 AS bigint) AS sent_epoch, cast((conv_id + turn) % 4 AS int) AS ack
FROM {conversations}
"""

VIEWS["fx_wa_delivery"] = """
SELECT * FROM {fx_wa_message} a UNION ALL SELECT * FROM {fx_wa_message} b WHERE direction = 'INBOUND'
"""

VIEWS["fx_wa_conversation"] = """
SELECT conv_id AS id, concat('org_', cast(conv_id % 20 AS string)) AS org_id,
  CASE WHEN conv_id % 5 = 0 THEN NULL ELSE conv_id % 50 END AS prospect_id,
  concat('55119', lpad(cast(conv_id AS string), 8, '0')) AS phone_number,
  CASE WHEN conv_id % 3 = 0 THEN 'CLOSED' ELSE 'ACTIVE' END AS status,
  cast(conv_id % 25 AS int) AS wa_account_id,
  CASE WHEN conv_id % 7 = 0 THEN NULL ELSE cast(1704067200 + conv_id * 3600 AS bigint) END AS last_message_epoch
FROM {conversations} GROUP BY conv_id
"""

VIEWS["fx_wa_account"] = """
SELECT cast(n_nationkey + CASE WHEN n_name = 'NATION_24' THEN 1000 ELSE 0 END AS int) AS id, concat('org_', cast(n_nationkey % 20 AS string)) AS org_id,
  concat(CASE WHEN n_name = 'NATION_24' THEN 'spare_' ELSE 'sess_' END, cast(n_nationkey AS string)) AS session_name,
  CASE WHEN n_nationkey % 4 = 3 THEN 'DISCONNECTED' ELSE 'CONNECTED' END AS status
FROM {nation}
"""

VIEWS["fx_wa_campaign"] = """
SELECT cast(n_nationkey AS bigint) AS id, concat('org_', cast(n_nationkey % 20 AS string)) AS org_id,
  CASE n_nationkey % 6 WHEN 0 THEN 'PAUSED' WHEN 1 THEN 'CANCELLED' WHEN 2 THEN 'DRAFT' ELSE 'RUNNING' END AS status,
  cast(n_nationkey AS int) AS wa_account_id
FROM {nation}
"""

VIEWS["fx_wa_contact"] = """
SELECT c_custkey AS id, c_custkey % 25 AS campaign_id, c_custkey AS prospect_id,
  CASE WHEN c_mktsegment = 'FURNITURE' THEN NULL ELSE concat('55119', lpad(cast(c_custkey AS string), 8, '0')) END AS phone_number,
  CASE c_custkey % 9 WHEN 0 THEN 'SENDING' WHEN 1 THEN 'SENT' WHEN 2 THEN 'REPLIED' WHEN 3 THEN 'OPTED_OUT' WHEN 4 THEN 'CANCELLED'
    WHEN 5 THEN 'COMPLETED' ELSE 'QUEUED' END AS status, cast(c_custkey % 4 AS int) AS step_index
FROM {customer}
"""

VIEWS["fx_wa_member"] = """
SELECT id, campaign_id, prospect_id, phone_number, status, step_index,
  CASE status WHEN 'REPLIED' THEN 'replied' WHEN 'OPTED_OUT' THEN 'opted_out' WHEN 'CANCELLED' THEN 'no_phone' END AS cancel_reason,
  CASE WHEN status IN ('SENT', 'REPLIED', 'COMPLETED') THEN make_timestamp(2023, 12, cast(1 + id % 28 AS int), 9, 0, 0) END AS last_sent_at
FROM {fx_wa_contact} k
"""

VIEWS["fx_wa_stored"] = """
SELECT org_id, provider_message_id, conversation_id, direction,
  CASE (conversation_id + turn) % 6 WHEN 0 THEN 'PENDING' WHEN 1 THEN 'SENT' WHEN 2 THEN 'DELIVERED' WHEN 3 THEN 'READ' WHEN 4 THEN 'FAILED' ELSE 'SENT' END AS status,
  CASE WHEN (conversation_id + turn) % 6 IN (1, 2, 3) THEN sent_epoch - 50 END AS sent_at,
  CASE WHEN (conversation_id + turn) % 6 IN (2, 3) THEN sent_epoch - 40 END AS delivered_at,
  CASE WHEN (conversation_id + turn) % 6 = 3 THEN sent_epoch - 30 END AS read_at
FROM {fx_wa_message} w
"""

VIEWS["fx_wa_outbox"] = """
SELECT id, id AS campaign_contact_id, campaign_id, id % 97 AS conversation_id, step_index,
  CASE id % 7 WHEN 1 THEN 'SENT' WHEN 2 THEN 'READ' WHEN 3 THEN 'FAILED' ELSE 'PENDING' END AS status,
  CASE WHEN id % 7 IN (1, 2) THEN concat('old', cast(id AS string)) END AS provider_message_id,
  CASE WHEN id % 7 IN (1, 2) THEN make_timestamp(2023, 11, cast(1 + id % 28 AS int), 8, 0, 0) END AS sent_at,
  CASE id % 7 WHEN 3 THEN 'timeout' WHEN 4 THEN 'account_not_connected' END AS error,
  CASE WHEN id % 7 = 3 THEN make_timestamp(2023, 11, cast(1 + id % 28 AS int), 8, 30, 0) END AS failed_at
FROM {fx_wa_contact} k
"""

VIEWS["fx_outreach_member"] = """
SELECT id, prospect_id, campaign_id, tenant_id, outreach_sequence, status, email_account_id, created_at,
  CASE WHEN status = 'REPLIED' OR id % 5 = 0 THEN cast(1 + id % 3 AS int) END AS reply_count,
  CASE WHEN status = 'REPLIED' OR id % 5 = 0 THEN make_timestamp(2023, 10, cast(1 + id % 28 AS int), 8, 0, 0) END AS last_reply_at,
  CASE status WHEN 'REPLIED' THEN 'replied' WHEN 'CANCELLED' THEN 'manual' WHEN 'SCHEDULED' THEN 'moved' END AS cancel_reason,
  CASE WHEN status IN ('SENT', 'REPLIED') THEN make_timestamp(2023, 9, cast(1 + id % 28 AS int), 8, 0, 0) WHEN id % 11 = 3 THEN make_timestamp(2034, 1, 1, 0, 0, 0) END AS sent_at
FROM {fx_outreach_contact} o
"""

VIEWS["fx_outreach_mail"] = """
SELECT id, contact_id, created_at, tracking_token, thread_id, status, subject, body,
  CASE WHEN status = 'SENT' THEN concat('old', cast(id AS string)) END AS provider_message_id,
  CASE WHEN status = 'SENT' THEN created_at END AS sent_at
FROM {fx_outreach_message} o
"""

VIEWS["fx_wa_step"] = """
SELECT cast(n_nationkey AS bigint) AS campaign_id, i AS order_index, cast(i * 1440 AS int) AS delay_minutes,
  CASE WHEN i = 2 AND n_nationkey % 5 = 0 THEN '{{unknown}}' ELSE 'Hi {{firstName}} of {{ companyName }} in {{city}} {{jobTitle}}' END AS message_template
FROM (SELECT n_nationkey, 0 AS i FROM {nation} UNION ALL SELECT n_nationkey, 1 AS i FROM {nation} UNION ALL SELECT n_nationkey, 2 AS i FROM {nation}) s
"""

VIEWS["fx_channel_state"] = """
SELECT CASE WHEN c_mktsegment = 'BUILDING' THEN c_custkey ELSE -c_custkey END AS prospect_id, 'whatsapp' AS channel,
  CASE c_custkey % 3 WHEN 0 THEN 'active' WHEN 1 THEN 'opted_out' ELSE 'do_not_contact' END AS status
FROM {customer}
"""

VIEWS["fx_lead"] = """
SELECT id, org_id, company_name, trade_name, city, industry,
  CASE WHEN id % 3 = 0 THEN concat('Ana', cast(id AS string), ' Silva') END AS partner_name,
  CASE WHEN id % 3 = 0 THEN 'Diretora' END AS partner_role
FROM {fx_prospect} fp
"""

VIEWS["fx_snapshot"] = """
SELECT l_orderkey AS company_key, l_linenumber AS version, CASE WHEN l_linenumber = 3 THEN NULL ELSE max(l_shipdate) END AS enriched_at
FROM {lineitem} GROUP BY l_orderkey, l_linenumber
"""

VIEWS["fx_fact"] = """
SELECT l_orderkey AS company_key, l_linenumber AS version, l_returnflag AS fact_key, cast(l_quantity AS int) AS value,
  CASE WHEN l_tax = 0 THEN NULL ELSE (50 + 5 * cast(round(l_discount * 100) AS int)) / cast(100 AS double) END AS confidence
FROM {lineitem}
"""

VIEWS["fx_edge"] = """
SELECT l_suppkey AS company_key, l_orderkey * 10 + l_linenumber AS pos,
  CASE WHEN l_linenumber = 1 THEN 'source' ELSE concat('P', cast(l_partkey % 30 AS string)) END AS source_id,
  CASE WHEN l_partkey % 7 = 0 THEN 'MISSING' WHEN l_partkey % 7 = 1 THEN concat('C', cast(l_suppkey AS string))
    ELSE concat('P', cast((l_partkey + 1) % 30 AS string)) END AS target_id, l_linestatus AS type
FROM (SELECT l_suppkey, l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_linestatus) AS l_linestatus
  FROM {lineitem} GROUP BY l_suppkey, l_orderkey, l_linenumber) d
"""

VIEWS["fx_node"] = """
SELECT l_suppkey AS company_key, l_partkey % 30 AS pos, concat('P', cast(l_partkey % 30 AS string)) AS id, 'PART' AS type
FROM {lineitem} GROUP BY l_suppkey, l_partkey % 30
UNION ALL
SELECT s_suppkey, -1, concat('C', cast(s_suppkey AS string)), CASE WHEN s_acctbal >= 3000 THEN 'COMPANY' ELSE 'BRANCH' END FROM {supplier}
"""

VIEWS["fx_place"] = """
SELECT cast(n_nationkey AS int) AS code, lower(replace(n_name, '_', ' ')) AS n, concat('r', cast(n_regionkey AS string)) AS uf,
  CASE WHEN n_nationkey % 10 = 0 THEN 100000 WHEN n_nationkey % 7 = 0 THEN 50000 ELSE 0 END AS importance
FROM {nation}
"""

VIEWS["fx_place_query"] = """
SELECT c_custkey AS qid, CASE c_custkey % 6 WHEN 0 THEN concat('Nation ', cast(c_nationkey AS string))
  WHEN 1 THEN concat('nation ', cast(c_nationkey AS string), ' r', cast(c_nationkey % 5 AS string))
  WHEN 2 THEN concat('natoin ', cast(c_nationkey AS string)) WHEN 3 THEN 'nat' WHEN 4 THEN concat('zz', c_name)
  ELSE concat('Nátion', cast(c_nationkey AS string)) END AS q
FROM {customer}
"""

VIEWS["fx_tree"] = """
SELECT concat('{"secao":"', substr(p_type, 1, 1), '","nome":"', p_type, '","oficial":"Secao ', p_type, '","categorias":[{"divisao":"',
  replace(p_brand, 'Brand#', ''), '","nome":"Divisao ', p_brand, '","atividades":[{"codigo":"', lpad(cast(p_partkey AS string), 7, '0'),
  '","cnae":"', substr(lpad(cast(p_partkey AS string), 7, '0'), 1, 4), '-', substr(lpad(cast(p_partkey AS string), 7, '0'), 5, 3),
  '","atividade":"', p_name, ' ', cast(p_partkey AS string), '"}]}]}') AS body
FROM {part}
"""

VIEWS["fx_flat"] = """
SELECT substr(p_type, 1, 1) AS section, p_type AS section_name, concat('Secao ', p_type) AS section_official,
  replace(p_brand, 'Brand#', '') AS division, concat('Divisao ', p_brand) AS division_name,
  lpad(cast(p_partkey AS string), 7, '0') AS code,
  concat(substr(lpad(cast(p_partkey AS string), 7, '0'), 1, 4), '-', substr(lpad(cast(p_partkey AS string), 7, '0'), 5, 3)) AS dotted,
  concat(p_name, ' ', cast(p_partkey AS string)) AS activity
FROM {part}
"""

VIEWS["fx_tax_query"] = """
SELECT DISTINCT q FROM (
  SELECT lpad(cast(s_suppkey * 7 AS string), 7, '0') AS q FROM {supplier}
  UNION ALL SELECT replace(p_brand, 'Brand#', '') FROM {part}
  UNION ALL SELECT lower(p_type) FROM {part} WHERE p_type < 'MEDIUM'
  UNION ALL SELECT concat(upper(p_name), ' 1') FROM {part}
  UNION ALL SELECT concat('Divisao ', p_brand) FROM {part} WHERE p_brand < 'Brand#2') u
"""

PLACEHOLDER = re.compile(r"\{(fx_\w+|" + "|".join(TABLES) + r")\}")


def used_tables(sql: str) -> set[str]:
    """Driver tables a statement reads, directly or through views."""
    out: set[str] = set()
    for name in PLACEHOLDER.findall(sql):
        out |= used_tables(VIEWS[name]) if name in VIEWS else {name}
    return out


def view_sql(prefix: str, sql: str) -> str:
    """Statement over the temporary views named ``<prefix>_<table>``."""
    def fill(m):
        name = m.group(1)
        return f"({view_sql(prefix, VIEWS[name])})" if name in VIEWS else f"{prefix}_{name}"

    return PLACEHOLDER.sub(fill, sql)


def oracle_text(sql: str) -> str:
    """Statement for DuckDB: the views used become common table expressions."""
    order: list[str] = []

    def visit(text):
        for name in PLACEHOLDER.findall(text):
            if name in VIEWS and name not in order:
                visit(VIEWS[name])
                order.append(name)

    visit(sql)
    plain = lambda text: PLACEHOLDER.sub(lambda m: m.group(1), text)
    ctes = [f"{n} AS ({plain(VIEWS[n]).strip()})" for n in order]
    body = plain(sql).strip()
    if not ctes:
        return body
    if body.upper().startswith("WITH "):
        return "WITH " + ",\n".join(ctes) + ",\n" + body[5:]
    return "WITH " + ",\n".join(ctes) + "\n" + body


class Fixtures:
    """Access to tables and views of one data directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir.rstrip("/")

    @property
    def prefix(self) -> str:
        return "sf_" + hashlib.md5(self.dir.encode()).hexdigest()[:12]

    def table(self, name: str) -> DataFrame:
        """Driver table behind a temporary view, so its files are inspected once per session."""
        view = f"{self.prefix}_{name}"
        if not self.spark.catalog.tableExists(view):
            self.spark.read.parquet(f"{self.dir}/{name}.parquet").createOrReplaceTempView(view)
        return self.spark.table(view)

    def sql(self, text: str) -> DataFrame:
        for name in used_tables(text):
            self.table(name)
        return self.spark.sql(view_sql(self.prefix, text))

    def __call__(self, name: str) -> DataFrame:
        return self.sql(VIEWS[f"fx_{name}"])

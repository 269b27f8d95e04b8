"""Audits."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadlake.catalog.core import query, values
from leadlake.operators import quality as Q
from leadlake.schemas import DELETE_RULES, UNIQUE_KEYS, VOCABULARY

DOUBLED = """SELECT org_id, cnpj FROM {fx_prospect} a UNION ALL SELECT org_id, cnpj FROM {fx_prospect} b WHERE status = 'closed'
UNION ALL SELECT org_id, CASE WHEN employees > 0 THEN NULL END FROM {fx_prospect} c"""


@query("DQ-01 unique_key_audit", f"SELECT org_id, cnpj, count(*) AS copies FROM ({DOUBLED}) WHERE cnpj IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1")
def _(fx):
    return Q.unique_key_audit(fx.sql(DOUBLED), ["org_id", "cnpj"])


STORED = {
    "organization": "SELECT id, concat('11', id) AS cnpj FROM {fx_organization} a UNION ALL SELECT id, '11org_4' FROM {fx_organization} b WHERE plan IS NULL",
    "commercial_settings": "SELECT org_id FROM {fx_profile} a UNION ALL SELECT org_id FROM {fx_profile} b WHERE company_statuses = ''",
    "user": "SELECT email FROM {fx_user} a UNION ALL SELECT email FROM {fx_user} b WHERE name IS NULL",
    "prospect": DOUBLED,
    "cnpj_enrichment": "SELECT company_key AS company_id, enrichment_version FROM {fx_enrichment_result} a",
    "outreach_contact": "SELECT prospect_id, campaign_id FROM {fx_outreach_contact} a",
    "suppression_list": "SELECT tenant_id, email FROM {fx_suppression} a UNION ALL SELECT tenant_id, email FROM {fx_suppression} b WHERE reason = 'bounce'",
    "wa_account": "SELECT CASE WHEN status = 'CONNECTED' THEN org_id END AS session_name FROM {fx_wa_account} a",
    "wa_step": "SELECT campaign_id, least(order_index, 1) AS order_index FROM {fx_wa_step} a",
    "wa_campaign_contact": "SELECT campaign_id, cast(floor(prospect_id / 50) AS bigint) AS prospect_id FROM {fx_wa_contact} a",
    "wa_conversation": "SELECT org_id, phone_number FROM {fx_wa_conversation} a UNION ALL SELECT org_id, phone_number FROM {fx_wa_conversation} b WHERE status = 'CLOSED'",
    "wa_message": "SELECT conversation_id, provider_message_id, prospect_id AS campaign_contact_id, turn AS step_index FROM {fx_wa_delivery} a",
    "lead_channel_state": "SELECT prospect_id, channel FROM {fx_channel_state} a UNION ALL SELECT prospect_id, channel FROM {fx_channel_state} b WHERE status = 'active'",
}


def repeated(name: str, keys: list[str]) -> str:
    cols, held = ", ".join(keys), " AND ".join(f"{k} IS NOT NULL" for k in keys)
    text = ", ".join(f"cast({k} AS varchar)" for k in keys)
    return (f"SELECT '{name}' AS table_name, '{','.join(keys)}' AS key_columns, concat_ws('|', {text}) AS key_value, count(*) AS copies "
            f"FROM ({STORED[name]}) WHERE {held} GROUP BY {cols} HAVING count(*) > 1")


@query("DQ-01 unique_keys", " UNION ALL ".join(repeated(n, k) for n in STORED for k in UNIQUE_KEYS[n]))
def _(fx):
    return Q.unique_keys_audit({n: fx.sql(text) for n, text in STORED.items()}, UNIQUE_KEYS)


def tables(fx, **statements: str):
    return {n: fx.sql(text) for n, text in statements.items()}


WA = {
    "wa_account": "SELECT id, status FROM {fx_wa_account} a",
    "wa_campaign": "SELECT id, org_id, wa_account_id, status FROM {fx_wa_campaign} a",
    "wa_step": "SELECT campaign_id * 10 + order_index AS id, campaign_id FROM {fx_wa_step} a",
    "wa_campaign_contact": "SELECT id, campaign_id FROM {fx_wa_contact} a",
    "wa_conversation": "SELECT id, org_id, wa_account_id, status FROM {fx_wa_conversation} a",
    "wa_message": "SELECT provider_message_id AS id, conversation_id FROM {fx_wa_message} a",
}
GONE_ACCOUNTS = f"SELECT id FROM ({WA['wa_account']}) WHERE status = 'DISCONNECTED'"
GONE_CAMPAIGNS = f"SELECT id FROM ({WA['wa_campaign']}) WHERE status = 'CANCELLED'"
CLOSED = f"SELECT id FROM ({WA['wa_conversation']}) WHERE status = 'CLOSED'"


@query("DQ-02 cascade_delete", f"SELECT * FROM ({WA['wa_message']}) WHERE conversation_id NOT IN ({CLOSED})")
def _(fx):
    return Q.cascade_delete(tables(fx, **WA), fx.sql(CLOSED), "wa_conversation", DELETE_RULES)["wa_message"]


@query("DQ-02 set_null", " UNION ALL ".join(
    f"SELECT '{n}' AS table_name, id, org_id, CASE WHEN wa_account_id IN ({GONE_ACCOUNTS}) THEN NULL ELSE wa_account_id END AS wa_account_id FROM ({WA[n]})"
    for n in ("wa_campaign", "wa_conversation")))
def _(fx):
    left = Q.cascade_delete(tables(fx, **WA), fx.sql(GONE_ACCOUNTS), "wa_account", DELETE_RULES)
    campaigns, conversations = [left[n].select(F.lit(n).alias("table_name"), "id", "org_id", "wa_account_id")
                                for n in ("wa_campaign", "wa_conversation")]
    return campaigns.unionAll(conversations)


@query("DQ-02 wa_campaign", " UNION ALL ".join(
    f"SELECT '{n}' AS table_name, id, campaign_id FROM ({WA[n]}) WHERE campaign_id NOT IN ({GONE_CAMPAIGNS})"
    for n in ("wa_step", "wa_campaign_contact")))
def _(fx):
    left = Q.cascade_delete(tables(fx, **WA), fx.sql(GONE_CAMPAIGNS), "wa_campaign", DELETE_RULES)
    steps, contacts = [left[n].select(F.lit(n).alias("table_name"), "id", "campaign_id") for n in ("wa_step", "wa_campaign_contact")]
    return steps.unionAll(contacts)


# A fifth of the activities belong to another tenant than their lead, and some to no lead.
TENANT = {
    "organization": "SELECT id, plan FROM {fx_organization} a",
    "commercial_settings": "SELECT org_id AS id, org_id FROM {fx_profile} a",
    "user": "SELECT email AS id, org_id FROM {fx_user} a",
    "prospect": "SELECT cast(id AS varchar(20)) AS id, org_id FROM {fx_prospect} a",
    "activity": """SELECT cast(o_orderkey AS varchar(20)) AS id, concat('org_', cast((o_custkey + CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END) % 20 AS varchar(20))) AS org_id,
  CASE WHEN o_orderkey % 7 > 0 THEN cast(o_custkey AS varchar(20)) END AS prospect_id FROM {orders}""",
    "workflow": "SELECT concat('w', org_id) AS id, org_id FROM {fx_profile} a",
}
GONE_TENANTS = f"SELECT id FROM ({TENANT['organization']}) WHERE plan = 'trial'"
GONE_LEADS = f"SELECT id FROM ({TENANT['prospect']}) WHERE org_id IN ({GONE_TENANTS})"


@query("DQ-02 organization", " UNION ALL ".join(
    f"SELECT '{n}' AS table_name, id FROM ({TENANT[n]}) WHERE org_id NOT IN ({GONE_TENANTS})"
    + (f" AND (prospect_id IS NULL OR prospect_id NOT IN ({GONE_LEADS}))" if n == "activity" else "") for n in list(TENANT)[1:]))
def _(fx):
    left = Q.cascade_delete(tables(fx, **TENANT), fx.sql(GONE_TENANTS), "organization", DELETE_RULES)
    parts = [left[n].select(F.lit(n).alias("table_name"), "id") for n in list(TENANT)[1:]]
    return reduce(DataFrame.unionAll, parts)


OUTREACH = {
    "outreach_campaign": "SELECT id FROM {fx_outreach_campaign} a",
    "outreach_contact": "SELECT id, campaign_id FROM {fx_outreach_contact} a",
    "outreach_message": "SELECT id, contact_id FROM {fx_outreach_message} a",
    "outreach_event": "SELECT id, contact_id, message_id FROM {fx_outreach_event} a",
}
GONE_OUTREACH = f"SELECT id FROM ({OUTREACH['outreach_campaign']}) WHERE id IN (1, 4)"
GONE_CONTACTS = f"SELECT id FROM ({OUTREACH['outreach_contact']}) WHERE campaign_id IN ({GONE_OUTREACH})"
GONE_MESSAGES = f"SELECT id FROM ({OUTREACH['outreach_message']}) WHERE contact_id IN ({GONE_CONTACTS})"


@query("DQ-02 outreach_campaign", f"""
SELECT * FROM ({OUTREACH['outreach_event']}) WHERE contact_id NOT IN ({GONE_CONTACTS}) AND message_id NOT IN ({GONE_MESSAGES})""")
def _(fx):
    return Q.cascade_delete(tables(fx, **OUTREACH), fx.sql(GONE_OUTREACH), "outreach_campaign", DELETE_RULES)["outreach_event"]


ALLOWED = VOCABULARY[("prospect", "status")]
ODD = "SELECT id, CASE WHEN employees > 500 THEN 'lost' WHEN employees > 400 THEN NULL ELSE status END AS status FROM {fx_prospect} p"


@query("DQ-03 enum_audit", f"SELECT status, count(*) AS rows FROM ({ODD}) WHERE status IS NULL OR status NOT IN ({values(ALLOWED)}) GROUP BY 1")
def _(fx):
    return Q.enum_audit(fx.sql(ODD), "status", ALLOWED)

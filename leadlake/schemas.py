"""Column types of the stored tables. Enumerations stay text; times are UTC."""

from __future__ import annotations

from pyspark.sql.types import StructType

PARTNER = "struct<name:string,qualification:string,country:string,age_range:string,joined_at:string>"
SUMMARY = (
    "struct<domain:string,website_active:boolean,corporate_email:boolean,launch_velocity:double,"
    "operational_readiness:double,commercial_potential:double,tech_count:int>"
)

DDL = {
    "organization": "id string, name string, cnpj string, plan string, created_at timestamp, updated_at timestamp",
    "commercial_settings": (
        "id string, org_id string, onboarding_completed boolean, onboarding_step int, company_name string, "
        "sales_team_size string, target_segments array<string>, target_cnaes array<string>, "
        "target_locations array<string>, company_statuses array<string>, target_sizes array<string>, "
        "age_ranges array<string>, average_ticket int, sales_cycle string, value_proposition string, "
        "created_at timestamp, updated_at timestamp"
    ),
    "user": "id string, org_id string, email string, name string, role string, created_at timestamp",
    "prospect": (
        "id string, cnpj string, company_name string, trade_name string, status string, opportunity_score int, "
        "revenue_estimate bigint, employees int, industry string, city string, state string, cnpj_email string, "
        f"cnpj_phones array<string>, cnpj_partners array<{PARTNER}>, cnpj_raw_data string, "
        "cnpj_opened_at timestamp, cnpj_legal_nature string, enrichment_status string, enrichment_source string, "
        f"enrichment_error string, enrichment_version int, enrichment_summary {SUMMARY}, enriched_at timestamp, "
        "credit_risk_score int, credit_risk_level string, created_at timestamp, updated_at timestamp, org_id string"
    ),
    "activity": "id string, org_id string, prospect_id string, type string, description string, created_at timestamp",
    "workflow": "id string, org_id string, name string, trigger string, actions string, active boolean",
    "cnpj_enrichment": (
        "id string, company_id string, cnpj string, enrichment_version int, request_event_id string, status string, "
        "error_code string, error_message string, score int, raw_payload string, created_at timestamp"
    ),
    "email_account": (
        "id string, tenant_id string, email string, provider string, status string, last_history_id string, "
        "created_at timestamp"
    ),
    "outreach_campaign": "id string, tenant_id string, name string, status string, created_at timestamp",
    "outreach_contact": (
        "id string, campaign_id string, prospect_id string, email_account_id string, status string, "
        "outreach_sequence int, scheduled_at timestamp, sent_at timestamp, last_reply_at timestamp, "
        "reply_count int, cancel_reason string, created_at timestamp"
    ),
    "outreach_template": "id string, tenant_id string, name string, subject string, body string",
    "outreach_message": (
        "id string, contact_id string, subject string, body string, html_body string, status string, "
        "generated_at timestamp, scheduled_for timestamp, sent_at timestamp, tracking_token string, "
        "thread_id string, provider_message_id string, error string, reasoning_facts array<string>"
    ),
    "outreach_event": (
        "id string, contact_id string, message_id string, type string, status string, details string, "
        "created_at timestamp"
    ),
    "suppression_list": "id string, tenant_id string, email string, reason string, created_at timestamp",
    "wa_account": (
        "id string, org_id string, session_name string, phone_number string, status string, metadata string, "
        "created_at timestamp"
    ),
    "wa_campaign": (
        "id string, org_id string, wa_account_id string, name string, status string, started_at timestamp, "
        "paused_at timestamp, completed_at timestamp, created_at timestamp"
    ),
    "wa_step": (
        "id string, campaign_id string, order_index int, delay_minutes int, message_template string, "
        "conditions string"
    ),
    "wa_campaign_contact": (
        "id string, campaign_id string, prospect_id string, phone_number string, status string, "
        "current_step_index int, last_sent_at timestamp, cancel_reason string"
    ),
    "wa_conversation": (
        "id string, org_id string, wa_account_id string, prospect_id string, phone_number string, status string, "
        "assigned_to string, last_message_at timestamp, last_inbound_message_at timestamp"
    ),
    "wa_message": (
        "id string, conversation_id string, org_id string, campaign_contact_id string, step_index int, "
        "direction string, type string, content string, provider_message_id string, status string, error string, "
        "sent_at timestamp, delivered_at timestamp, read_at timestamp, failed_at timestamp, created_at timestamp"
    ),
    "lead_channel_state": (
        "id string, org_id string, prospect_id string, channel string, status string, phone_number string, "
        "reason string"
    ),
    "registry": (
        "cnpj string, legal_name string, trade_name string, main_cnae string, main_cnae_description string, "
        "city_name string, state string, registration_status string, is_active boolean, is_headquarters boolean, "
        "opening_date date, legal_nature_description string, company_size_code string, "
        "share_capital decimal(18,2), email string"
    ),
}


def schema(name: str) -> StructType:
    """Declared type of a stored table; needs a running session to parse."""
    return StructType.fromDDL(DDL[name])


# Natural unique keys; the audit in operators.quality reports violations.
UNIQUE_KEYS = {
    "organization": [["cnpj"]],
    "prospect": [["cnpj"], ["org_id", "cnpj"]],
    "cnpj_enrichment": [["company_id", "enrichment_version"]],
    "outreach_contact": [["prospect_id", "campaign_id"]],
    "suppression_list": [["tenant_id", "email"]],
    "wa_step": [["campaign_id", "order_index"]],
    "wa_campaign_contact": [["campaign_id", "prospect_id"]],
    "wa_conversation": [["org_id", "phone_number"]],
    "wa_message": [["conversation_id", "provider_message_id"], ["campaign_contact_id", "step_index"]],
    "lead_channel_state": [["prospect_id", "channel"]],
    "user": [["email"]],
    "commercial_settings": [["org_id"]],
    "wa_account": [["session_name"]],
}

# What deleting a parent does to its children: child, column, parent, action. Parents come before their children.
DELETE_RULES = [
    ("commercial_settings", "org_id", "organization", "cascade"),
    ("user", "org_id", "organization", "cascade"),
    ("prospect", "org_id", "organization", "cascade"),
    ("activity", "org_id", "organization", "cascade"),
    ("activity", "prospect_id", "prospect", "cascade"),
    ("workflow", "org_id", "organization", "cascade"),
    ("outreach_contact", "campaign_id", "outreach_campaign", "cascade"),
    ("outreach_message", "contact_id", "outreach_contact", "cascade"),
    ("outreach_event", "contact_id", "outreach_contact", "cascade"),
    ("outreach_event", "message_id", "outreach_message", "cascade"),
    ("wa_campaign", "wa_account_id", "wa_account", "set_null"),
    ("wa_step", "campaign_id", "wa_campaign", "cascade"),
    ("wa_campaign_contact", "campaign_id", "wa_campaign", "cascade"),
    ("wa_conversation", "wa_account_id", "wa_account", "set_null"),
    ("wa_message", "conversation_id", "wa_conversation", "cascade"),
]

VOCABULARY = {
    ("prospect", "status"): ["lead", "prospect", "qualified", "closed", "contacted", "proposal"],
    ("prospect", "enrichment_status"): ["pending", "enriched", "partial", "unavailable", "error"],
    ("outreach_contact", "status"): [
        "SELECTED", "QUEUED", "GENERATING", "SCHEDULED", "SENDING", "SENT", "DELIVERED_INFERRED",
        "OPENED_INFERRED", "REPLIED", "BOUNCED", "FAILED", "UNSUBSCRIBED", "CANCELLED",
    ],
    ("wa_campaign", "status"): ["DRAFT", "SCHEDULED", "RUNNING", "PAUSED", "COMPLETED", "CANCELLED"],
    ("wa_campaign_contact", "status"): [
        "QUEUED", "SENDING", "SENT", "REPLIED", "OPTED_OUT", "COMPLETED", "CANCELLED",
    ],
    ("wa_conversation", "status"): ["ACTIVE", "PAUSED", "HUMAN_HANDOFF", "CLOSED", "OPTED_OUT"],
    ("wa_message", "status"): ["PENDING", "SENT", "DELIVERED", "READ", "FAILED"],
}

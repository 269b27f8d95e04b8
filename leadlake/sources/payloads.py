"""JSON payloads from outside -> typed columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadlake.functions import fixed
from leadlake.functions.columns import cnpj_format, cnpj_valid, digits, first_present, half_up, lookup, present
from leadlake.schemas import PARTNER

QSA = (
    "array<struct<nome_socio:string,nome:string,nome_representante_legal:string,qualificacao_socio:string,"
    "qualificacao:string,qualificacao_representante_legal:string,pais:string,faixa_etaria:string,"
    "data_entrada_sociedade:string>>"
)
REGISTRY_PAYLOAD = (
    "razao_social string, nome_fantasia string, cnae_fiscal_descricao string, email string, municipio string, "
    "uf string, ddd_telefone_1 string, ddd_telefone_2 string, telefone string, natureza_juridica string, "
    f"data_inicio_atividade string, qsa {QSA}"
)
RESULT = (
    "company_id string, cnpj string, enrichment_version string, version string, status string, "
    "request_event_id string, event_id string, event_ts string, summary string, _corrupt_record string"
)
SUMMARY_FIELDS = (
    "domain string, website_active string, corporate_email string, launch_velocity string, "
    "operational_readiness string, commercial_potential string, tech_count string, cnpj string, "
    "company_id string, error_code string, error_message string"
)
WA_EVENT = (
    "event string, session string, payload struct<id:string,`from`:string,chatId:string,fromMe:boolean,body:string,"
    "type:string,ack:int,status:string,state:string,me:struct<id:string>,key:struct<id:string,remoteJid:string>>"
)


def hydrate(df: DataFrame, phones: str = "cnpj_phones", partners: str = "cnpj_partners") -> DataFrame:
    """JSON text columns -> arrays; null, malformed or non-array text -> empty array."""
    empty_p, empty_q = F.array().cast("array<string>"), F.array().cast(f"array<{PARTNER}>")
    is_array = lambda c: F.trim(F.col(c)).startswith("[")
    return df.withColumns({
        phones: F.coalesce(F.when(is_array(phones), F.from_json(phones, "array<string>")), empty_p),
        partners: F.coalesce(F.when(is_array(partners), F.from_json(partners, f"array<{PARTNER}>")), empty_q),
    })


def partners_standardise(qsa: Column) -> Column:
    """Partner structs from the alternative member names; blank members become null."""
    return F.transform(F.coalesce(qsa, F.array().cast(QSA)), lambda p: F.named_struct(
        F.lit("name"), first_present(p["nome_socio"], p["nome"], p["nome_representante_legal"]),
        F.lit("qualification"),
        first_present(p["qualificacao_socio"], p["qualificacao"], p["qualificacao_representante_legal"]),
        F.lit("country"), present(p["pais"]), F.lit("age_range"), present(p["faixa_etaria"]),
        F.lit("joined_at"), present(p["data_entrada_sociedade"])))


def payload_phones(d: Column) -> Column:
    """Distinct trimmed phones in listing order."""
    listed = F.array(*[F.trim(d[f]) for f in ("ddd_telefone_1", "ddd_telefone_2", "telefone")])
    return F.array_distinct(F.filter(listed, lambda p: p.isNotNull() & (p != "")))


def map_registry_payload(raw: DataFrame, body: str = "body") -> DataFrame:
    """Raw registry documents -> firmographic columns next to the raw text."""
    d = F.col("__d")
    return raw.withColumn("__d", F.from_json(body, REGISTRY_PAYLOAD)).withColumns({
        "company_name": first_present(d["razao_social"], d["nome_fantasia"]),
        "trade_name": present(d["nome_fantasia"]),
        "industry": present(d["cnae_fiscal_descricao"]),
        "city": present(d["municipio"]),
        "state": present(d["uf"]),
        "cnpj_email": present(d["email"]),
        "cnpj_opened_at": F.try_to_date(d["data_inicio_atividade"], "yyyy-MM-dd"),
        "cnpj_legal_nature": present(d["natureza_juridica"]),
        "cnpj_phones": payload_phones(d),
        "cnpj_partners": partners_standardise(d["qsa"]),
    }).drop("__d")


def map_registry_company(records: DataFrame) -> DataFrame:
    """Registry records -> company rows with an active flag and a formatted key."""
    status = F.upper(F.coalesce(F.col("registration_status"), F.lit("")))
    active = F.coalesce(F.col("is_active"), status.isin(fixed.ACTIVE_REGISTRATIONS))
    return records.select(
        cnpj_format(digits("cnpj")).alias("cnpj"),
        F.coalesce(first_present("legal_name", "trade_name"), F.lit("")).alias("legal_name"),
        present("trade_name").alias("trade_name"),
        present("main_cnae_description").alias("industry"),
        F.when(active, F.lit("active")).otherwise(F.lit("inactive")).alias("status"),
        present("city_name").alias("city"),
        present("state").alias("state"),
        F.col("opening_date"),
        present("legal_nature_description").alias("legal_nature"),
        present("company_size_code").alias("company_size"),
        F.col("share_capital").cast("decimal(18,2)").alias("share_capital"),
        present("email").alias("email"),
        active.alias("is_active"),
        F.coalesce(F.col("is_headquarters"), F.lit(True)).alias("is_headquarters"),
        F.lit("mcp.cnpj").alias("source"),
    )


def unwrap_tool_response(raw: DataFrame, body: str = "body") -> DataFrame:
    """Landed tool responses -> the result they carry, as JSON text in ``result``.

    The first parseable ``data:`` line wins, else the whole body. Inside it: the structured
    result, else the structured content, else the first non-empty text block.
    """
    text = F.trim(F.col(body))
    lines = F.filter(F.split(text, "\n"), lambda x: x.startswith("data:"))
    candidates = F.when(
        text.contains("\n") & (F.size(lines) > 0), F.transform(lines, lambda x: F.trim(F.substring(x, 6, 1 << 30)))
    ).otherwise(F.array(text))
    message = F.get(F.filter(F.transform(candidates, lambda t: F.try_parse_json(t)), lambda v: v.isNotNull()), F.lit(0))
    parsed = raw.withColumn("__m", message)
    inner = F.coalesce(F.try_variant_get("__m", "$.result", "variant"), F.col("__m"))
    structured = F.try_variant_get("__r", "$.structuredContent", "variant")
    result = F.try_variant_get("__r", "$.structuredContent.result", "variant")
    blocks = F.coalesce(
        F.try_variant_get("__r", "$.content", "array<struct<type:string,text:string>>"),
        F.array().cast("array<struct<type:string,text:string>>"),
    )
    first_text = F.get(F.filter(blocks, lambda b: (b["type"] == "text") & (b["text"] != "")), F.lit(0))["text"]
    return (parsed.withColumn("__r", inner)
            .withColumn("result", F.coalesce(F.to_json(result), F.to_json(structured), first_text))
            .drop("__m", "__r"))


def route_events(events: DataFrame, accounts: DataFrame) -> DataFrame:
    """Attach the owning account and a route; events of unknown sessions are dropped."""
    owners = accounts.select(F.col("session_name").alias("session"), F.col("id").alias("account_id"), "org_id")
    route = (F.when(F.col("event") == "message", "message")
             .when(F.col("event") == "message.ack", "ack")
             .when(F.col("event") == "session.status", "session")
             .otherwise("other"))
    return events.join(owners, "session").withColumn("route", route)


def parse_wa_events(raw: DataFrame, body: str = "body") -> DataFrame:
    """Webhook bodies -> one flat row per event."""
    e = F.from_json(body, WA_EVENT)
    p = F.col("__e.payload")
    return raw.withColumn("__e", e).select(
        *[c for c in raw.columns if c != body],
        F.col("__e.event").alias("event"),
        F.col("__e.session").alias("session"),
        F.coalesce(p["id"], p["key"]["id"]).alias("provider_message_id"),
        F.coalesce(p["from"], p["chatId"], p["key"]["remoteJid"]).alias("chat_id"),
        F.coalesce(p["fromMe"], F.lit(False)).alias("from_me"),
        p["body"].alias("content"),
        lookup(fixed.MEDIA_TYPE, F.upper(F.coalesce(p["type"], F.lit(""))), F.lit("TEXT")).alias("media_type"),
        p["ack"].alias("ack"),
        F.coalesce(p["status"], p["state"]).alias("raw_status"),
        p["me"]["id"].alias("me_id"),
    )


def dlq_split(raw: DataFrame, body: str = "body") -> tuple[DataFrame, DataFrame]:
    """Parsed results with a usable key, and the rest with a reason."""
    parsed = raw.withColumn("__d", F.from_json(body, RESULT, {"mode": "PERMISSIVE"}))
    d = F.col("__d")
    reason = (F.when(d.isNull() | d["_corrupt_record"].isNotNull(), F.lit("malformed_json"))
              .when(~cnpj_valid(d["cnpj"]), F.lit("invalid_cnpj")))
    marked = parsed.withColumn("reason", reason)
    bad = marked.filter(F.col("reason").isNotNull()).drop("__d")
    good = marked.filter(F.col("reason").isNull()).select(
        *[c for c in raw.columns if c != body],
        digits(d["cnpj"]).alias("cnpj"),
        present(d["company_id"]).alias("company_id"),
        F.coalesce(F.coalesce(d["enrichment_version"], d["version"]).try_cast("int"), F.lit(1)).alias("enrichment_version"),
        F.upper(F.coalesce(present(d["status"]), F.lit("COMPLETED"))).alias("status"),
        d["request_event_id"].alias("request_event_id"),
        d["event_id"].try_cast("long").alias("event_id"),
        F.try_to_timestamp(d["event_ts"]).cast("timestamp_ntz").alias("event_ts"),
        d["summary"].alias("summary"),
    )
    return good, bad


def _flag(c: Column) -> Column:
    return F.when(c.isNotNull(), ~F.lower(c).isin("false", "0", ""))


def _number(c: Column) -> Column:
    n = c.try_cast("double")
    return F.when(~F.isnan(n) & (F.abs(n) != F.lit(float("inf"))), n)


def summary_normalise(events: DataFrame, summary: str = "summary") -> DataFrame:
    """Seven summary fields: flags or null, numbers or null, a whole-number technology count."""
    s = F.col("__s")
    return events.withColumn("__s", F.from_json(summary, SUMMARY_FIELDS)).withColumns({
        "domain": s["domain"],
        "website_active": _flag(s["website_active"]),
        "corporate_email": _flag(s["corporate_email"]),
        "launch_velocity": _number(s["launch_velocity"]),
        "operational_readiness": _number(s["operational_readiness"]),
        "commercial_potential": _number(s["commercial_potential"]),
        "tech_count": half_up(_number(s["tech_count"])).cast("int"),
        "error_message": s["error_message"],
    }).drop("__s")


def explode_mailbox(changes: DataFrame) -> DataFrame:
    """Mailbox history rows -> the messages worth checking for replies.

    Added messages need an id; updated ones need at least one label change.
    """
    shape = (
        "added array<struct<message:struct<id:string>>>,"
        "updated array<struct<message:struct<id:string>,labelChanges:array<struct<labelsAdded:array<string>,labelsRemoved:array<string>>>>>"
    )
    parsed = changes.withColumn("__m", F.from_json("messages", shape))
    added = (parsed.select("account_id", "history_id", F.explode("__m.added").alias("x"))
             .select("account_id", "history_id", F.lit("added").alias("kind"), F.col("x.message.id").alias("message_id"))
             .filter(F.length("message_id") > 0))
    labelled = F.exists(
        F.col("x.labelChanges"), lambda c: c["labelsAdded"].isNotNull() | c["labelsRemoved"].isNotNull())
    updated = (parsed.select("account_id", "history_id", F.explode("__m.updated").alias("x"))
               .filter(labelled)
               .select("account_id", "history_id", F.lit("updated").alias("kind"), F.col("x.message.id").alias("message_id")))
    return added.unionByName(updated)


def advance_cursors(cursors: DataFrame, changes: DataFrame) -> DataFrame:
    """Per account: the newest history id seen, never moving back."""
    newest = changes.groupBy("account_id").agg(F.max("history_id").alias("__new"))
    return (cursors.join(newest, "account_id", "full")
            .select("account_id", F.greatest("last_history_id", "__new").alias("last_history_id")))


def mailbox_increment(changes: DataFrame, cursors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New mailbox messages past each account's cursor, and the advanced cursors."""
    fresh = (changes.join(cursors, "account_id", "left")
             .filter(F.col("last_history_id").isNull() | (F.col("history_id") > F.col("last_history_id")))
             .drop("last_history_id"))
    return explode_mailbox(fresh), advance_cursors(cursors, fresh)

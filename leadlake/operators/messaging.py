"""Messaging channel: inbound events, conversations, opt-outs, campaigns and step sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadlake.functions import fixed
from leadlake.functions.columns import is_opt_out, lookup, phone_normalise, phone_of_chat, present
from leadlake.operators.fold import Fold
from leadlake.operators.outreach import campaign_stagger
from leadlake.operators.state import MESSAGE, SEQUENCE, merge
from leadlake.plans.balance import first_row, join_hot
from leadlake.sources.upsert import upsert

CHANNEL = "whatsapp"


# --- recoding, matching and text ------------------------------------------------------------

def status_recode(df: DataFrame, kind: str, source: str, target: str) -> DataFrame:
    """Provider vocabulary -> ours: kind is session, media or registration."""
    raw = F.upper(F.coalesce(F.col(source), F.lit("")))
    if kind == "session":
        return df.withColumn(target, lookup(fixed.SESSION_STATUS, raw))
    if kind == "media":
        return df.withColumn(target, lookup(fixed.MEDIA_TYPE, raw, F.lit("TEXT")))
    if kind == "registration":
        return df.withColumn(target, lookup(fixed.REGISTRATION_STATUS, raw, F.when(raw != "", raw)))
    raise ValueError(f"unknown vocabulary {kind!r}")


def optout_detect(messages: DataFrame, keywords: list[str] | None = None, text: str = "content") -> DataFrame:
    return messages.withColumn("is_opt_out", is_opt_out(text, keywords))


def message_dedupe(messages: DataFrame) -> DataFrame:
    """First delivery of each (conversation, provider id); messages without one all stay."""
    keyed = messages.filter(F.col("provider_message_id").isNotNull())
    once = first_row(keyed, ["conversation_id", "provider_message_id"], [F.col("sent_epoch"), F.col("turn")])
    return once.unionByName(messages.filter(F.col("provider_message_id").isNull()))


def message_fold() -> Fold:
    """The kept delivery per (conversation, provider id); the key stays unique for good."""
    return Fold(("conversation_id", "provider_message_id"),
                {"first": F.struct("sent_epoch", "turn", "direction", "content", "org_id", "prospect_id")}, {})


LONGEST_VALUE = 500


def unfold_messages(folded: DataFrame) -> DataFrame:
    return folded.select("conversation_id", "provider_message_id", "first.*")


def _safe(c: Column, longest: int | None) -> Column:
    clean = F.regexp_replace(F.coalesce(c, F.lit("")), r"[\x00-\x1f\x7f]", "")
    return clean if longest is None else F.substring(clean, 1, longest)


def render(template: Column, values: dict[str, Column], longest: int | None = LONGEST_VALUE) -> Column:
    """Fill ``{{name}}`` marks with cleaned values of at most ``longest`` characters; unknown marks vanish."""
    out = F.coalesce(template, F.lit(""))
    for name, value in values.items():
        literal = F.replace(F.replace(_safe(value, longest), F.lit("\\"), F.lit("\\\\")), F.lit("$"), F.lit("\\$"))
        out = F.regexp_replace(out, F.lit(r"\{\{\s*" + name + r"\s*\}\}"), literal)
    return F.regexp_replace(F.regexp_replace(out, r"\{\{\s*[\w.]+\s*\}\}", ""), r"^\s+|\s+$", "")


def _lead_values() -> dict[str, Column]:
    """Template values from lead columns; the first partner's name comes first."""
    whom = F.coalesce(present("partner_name"), present("trade_name"), F.col("company_name"), F.lit(""))
    first_word = F.regexp_extract(whom, r"^\s*(\S+)", 1)
    return {"firstName": first_word, "companyName": F.col("company_name"), "jobTitle": F.col("partner_role"),
            "city": F.col("city"), "industry": F.col("industry")}


def template_render(leads: DataFrame, templates: DataFrame, on: list[str], template: str = "message_template",
                    longest: int | None = LONGEST_VALUE) -> DataFrame:
    """Leads x the templates of their campaign, rendered into ``content`` with values of at most ``longest`` characters (None: whole).

    ``leads`` has company_name, trade_name, city, industry and the first partner's
    partner_name and partner_role.
    """
    return leads.join(templates, on).withColumn("content", render(F.col(template), _lead_values(), longest))


def campaign_steps_normalise(campaigns: DataFrame, steps: str = "steps") -> DataFrame:
    """JSON step arrays -> ordered steps; blank templates dropped, day delays become minutes."""
    shape = "array<struct<orderIndex:string,messageTemplate:string,delayMinutes:string,delayDays:string,conditions:string>>"
    e = campaigns.select(F.col("id").alias("campaign_id"), F.posexplode(F.from_json(steps, shape)).alias("pos", "s"))
    minutes = F.coalesce(
        F.col("s.delayMinutes").try_cast("double"),
        F.floor(F.col("s.delayDays").try_cast("double") * 1440 + 0.5).cast("double"), F.lit(0.0))
    index = F.when(F.col("s.orderIndex").rlike(r"^-?[0-9]+$"), F.col("s.orderIndex").try_cast("int"))
    return (e.filter(present("s.messageTemplate").isNotNull())
            .select("campaign_id", F.coalesce(index, F.col("pos")).alias("order_index"), minutes.cast("int").alias("delay_minutes"),
                    F.col("s.messageTemplate").alias("message_template"), F.col("s.conditions").alias("conditions")))


# --- conversations --------------------------------------------------------------------------

def phone_resolve(phones: DataFrame, conversations: DataFrame, contacts: DataFrame, campaigns: DataFrame,
                  lead_phones: DataFrame) -> DataFrame:
    """(org, phone) -> lead: a conversation first, then a campaign contact, then a known phone.

    ``lead_phones``: org_id, prospect_id, phone (normalised). Ties go to the smallest lead id.
    """
    asked = phones.select("org_id", phone_normalise("phone").alias("phone")).filter(F.col("phone").isNotNull()).distinct()
    tiers = [
        conversations.filter(F.col("prospect_id").isNotNull()).select("org_id", F.col("phone_number").alias("phone"), "prospect_id"),
        contacts.join(campaigns.select(F.col("id").alias("campaign_id"), "org_id"), "campaign_id")
        .select("org_id", phone_normalise("phone_number").alias("phone"), "prospect_id"),
        lead_phones.select("org_id", "phone", "prospect_id"),
    ]
    known = None
    for i, t in enumerate(tiers):
        t = t.withColumn("tier", F.lit(i))
        known = t if known is None else known.unionByName(t)
    best = (known.join(asked, ["org_id", "phone"], "left_semi").groupBy("org_id", "phone")
            .agg(F.min(F.struct("tier", "prospect_id")).alias("m")))
    return asked.join(best, ["org_id", "phone"], "left").select(
        "org_id", "phone", F.col("m.prospect_id").alias("prospect_id"), F.col("m.tier").alias("tier"))


def conversation_upsert(conversations: DataFrame, inbound: DataFrame) -> DataFrame:
    """One conversation per (org, phone): created ACTIVE; a missing lead is filled when one arrives.

    ``inbound``: org_id, phone_number, wa_account_id, prospect_id, arrived.
    """
    known = F.col("prospect_id").isNotNull()
    per = inbound.groupBy("org_id", "phone_number").agg(
        F.min(F.struct("arrived", "wa_account_id")).alias("__first"),
        F.min(F.when(known, F.struct("arrived", "prospect_id", "wa_account_id"))).alias("__lead"))
    j = conversations.withColumn("__old", F.lit(True)).join(per, ["org_id", "phone_number"], "full")
    created = F.col("__old").isNull()
    fills = F.col("prospect_id").isNull() & F.col("__lead").isNotNull()
    out = {
        "prospect_id": F.coalesce("prospect_id", "__lead.prospect_id"),
        "wa_account_id": F.when(created, F.col("__first.wa_account_id"))
        .when(fills, F.coalesce("wa_account_id", "__lead.wa_account_id")).otherwise(F.col("wa_account_id")),
        "status": F.when(created, "ACTIVE").otherwise(F.col("status")),
    }
    return j.select("org_id", "phone_number", *[e.alias(n) for n, e in out.items()], F.coalesce("__old", F.lit(False)).alias("existed"))


def conversation_fold() -> Fold:
    """What the next state needs: first outbound, last opt-out, plain inbound and manual reply."""
    at = F.struct("sent_epoch", "turn")
    inbound = F.col("direction") == "INBOUND"
    stop = is_opt_out("content")
    manual = (F.col("direction") == "OUTBOUND") & F.col("sent_by").isNotNull()
    return Fold(
        ("conversation_id",),
        {"first_out": F.when(F.col("direction") == "OUTBOUND", at)},
        {"last_stop": F.when(inbound & stop, at), "last_plain": F.when(inbound & ~stop, at),
         "last_manual": F.when(manual, F.struct("sent_epoch", "turn", "sent_by")),
         "last_inbound": F.when(inbound, F.col("sent_epoch")), "last_message": F.col("sent_epoch")})


def conversation_state(conversations: DataFrame, messages: DataFrame, folded: bool = False) -> DataFrame:
    """State after all messages, in (time, turn) order.

    Opt-out wins for its message; an inbound after any outbound hands a known lead to a person;
    a manual reply reactivates; a closed conversation reopens on inbound. If an outbound came
    before the last plain inbound, that inbound is the last handoff, so extremes suffice.
    """
    f = messages if folded else conversation_fold().partial(messages)
    j = conversations.join(f.withColumnRenamed("conversation_id", "id"), "id", "left")

    def candidate(c, status, cond=None):
        s = F.struct(F.col(f"{c}.sent_epoch").alias("e"), F.col(f"{c}.turn").alias("t"), F.lit(status).alias("status"))
        return F.when(F.col(c).isNotNull() if cond is None else cond, s)

    handoff = F.coalesce(F.col("prospect_id").isNotNull() & (F.col("first_out") < F.col("last_plain")), F.lit(False))
    decided = F.greatest(candidate("last_stop", "OPTED_OUT"), candidate("last_plain", "HUMAN_HANDOFF", handoff),
                         candidate("last_manual", "ACTIVE"))
    reopened = F.when((F.col("status") == "CLOSED") & F.col("last_plain").isNotNull(), "ACTIVE").otherwise(F.col("status"))
    return j.select(
        F.col("id").alias("conversation_id"), "org_id", "prospect_id",
        F.coalesce(decided["status"], reopened).alias("status"),
        F.col("last_manual.sent_by").alias("assigned_to"),
        F.col("last_message").alias("last_message_epoch"), F.col("last_inbound").alias("last_inbound_epoch"))


def inbox(conversations: DataFrame, accounts: DataFrame, prospects: DataFrame, messages: DataFrame) -> DataFrame:
    """Conversations with account, lead and message count, latest activity first."""
    a = accounts.select(F.col("id").alias("wa_account_id"), "session_name", F.col("status").alias("account_status"))
    p = prospects.select(F.col("id").alias("prospect_id"), "company_name")
    n = messages.groupBy("conversation_id").agg(F.count(F.lit(1)).alias("messages"))
    return (conversations.withColumnRenamed("id", "conversation_id")
            .join(a, "wa_account_id", "left").join(p, "prospect_id", "left").join(n, "conversation_id", "left")
            .withColumn("messages", F.coalesce("messages", F.lit(0).cast("long")))
            .orderBy("org_id", F.col("last_message_epoch").desc_nulls_first(), "conversation_id"))


def conversation_history(conversations: DataFrame, messages: DataFrame) -> DataFrame:
    """Messages of conversations owned by the same tenant, oldest first."""
    owned = conversations.select(F.col("id").alias("conversation_id"), "org_id")
    return messages.join(owned, ["conversation_id", "org_id"], "left_semi").orderBy("conversation_id", "sent_epoch", "turn")


def echo_match(messages: DataFrame, echoes: DataFrame, accounts: DataFrame) -> DataFrame:
    """Echoes of own sends mark the outbound message sent, keeping its first sent time; delivered and read ones stay so.

    ``echoes``: session, provider_message_id, happened_at.
    """
    org = accounts.select(F.col("session_name").alias("session"), "org_id")
    first = echoes.join(org, "session").groupBy("org_id", "provider_message_id").agg(F.min("happened_at").alias("sent_at"))
    said = first.withColumns({"direction": F.lit("OUTBOUND"), "status": F.lit("SENT")})
    return merge(messages, said, ["org_id", "provider_message_id", "direction"], MESSAGE, fill=("sent_at",))


def delivery_fold() -> Fold:
    def since(n):
        return F.when(F.col("ack") >= n, F.col("happened_at"))

    return Fold(("org_id", "provider_message_id"), {"sent_at": since(1), "delivered_at": since(2), "read_at": since(3)},
                {"ack": F.col("ack")})


def delivery_status(messages: DataFrame, acks: DataFrame, folded: bool = False) -> DataFrame:
    """Highest acknowledgement so far decides; the first time of each level stays.

    ``acks``: org_id, provider_message_id, ack, happened_at. ``messages`` may hold status and times of earlier batches.
    """
    f = acks if folded else delivery_fold().partial(acks)
    level = F.col("ack")
    status = F.when(level >= 3, "READ").when(level >= 2, "DELIVERED").when(level >= 1, "SENT")
    times = ("sent_at", "delivered_at", "read_at")
    return merge(messages, f.select("org_id", "provider_message_id", status.alias("status"), *times), ["org_id", "provider_message_id"],
                 MESSAGE, first=times)


def session_fold() -> Fold:
    mapped = lookup(fixed.SESSION_STATUS, F.upper(F.coalesce(F.col("raw_status"), F.lit(""))))
    phone = F.when(F.col("me_id").isNotNull(), present(phone_of_chat("me_id")))
    return Fold(("session",), {}, {
        "last": F.when(mapped.isNotNull(), F.struct("happened_at", "event_id", mapped.alias("status"), F.col("raw_status").alias("raw_status"))),
        "last_phone": F.when(mapped.isNotNull() & phone.isNotNull(), F.struct("happened_at", "event_id", phone.alias("phone")))})


def session_status(accounts: DataFrame, events: DataFrame, folded: bool = False) -> DataFrame:
    """Accounts with the latest known session status and phone, and whether that changed them.

    ``events``: session, event_id, happened_at, raw_status, me_id.
    """
    f = events if folded else session_fold().partial(events)
    j = accounts.join(f.withColumnRenamed("session", "session_name"), "session_name", "left")
    new = F.coalesce("last.status", "status")
    return j.select("id", "org_id", "session_name", new.alias("new_status"), F.col("last.raw_status").alias("raw_status"),
                    F.col("last_phone.phone").alias("phone_number"), (new != F.col("status")).alias("changed"))


# --- opt-outs and automation ----------------------------------------------------------------

def contactable(leads: DataFrame, channel_state: DataFrame, lead: str = "id") -> DataFrame:
    s = channel_state.filter(F.col("channel") == CHANNEL).select(F.col("prospect_id").alias(lead), F.col("status").alias("__s"))
    return leads.join(s, lead, "left").withColumn("contactable", F.coalesce("__s", F.lit("active")) == "active").drop("__s")


def _set_channel(state: DataFrame, leads: DataFrame, status: str) -> DataFrame:
    updates = leads.select("prospect_id", F.lit(CHANNEL).alias("channel"), F.lit(status).alias("status"))
    return upsert(state, updates, ["prospect_id", "channel"], ["status"])


def optout_propagate(optouts: DataFrame, state: DataFrame, conversations: DataFrame, contacts: DataFrame,
                     campaigns: DataFrame | None = None, lead_phones: DataFrame | None = None) -> dict[str, DataFrame]:
    """Opt-outs -> channel state, conversations and running campaign contacts.

    ``optouts``: org_id, phone (normalised or null), prospect_id (or null). A contact is matched
    by phone where the opt-out has one, else by lead. With ``campaigns`` and ``lead_phones`` an
    opt-out that names no lead reaches the one :func:`phone_resolve` finds.
    """
    leads = optouts.filter(F.col("prospect_id").isNotNull()).select("prospect_id").distinct()
    if campaigns is not None and lead_phones is not None:
        unnamed = optouts.filter(F.col("prospect_id").isNull()).select("org_id", "phone")
        found = phone_resolve(unnamed, conversations, contacts, campaigns, lead_phones).filter(F.col("prospect_id").isNotNull())
        leads = leads.unionByName(found.select("prospect_id")).distinct()
    by_phone = optouts.filter(F.col("phone").isNotNull()).select("org_id", F.col("phone").alias("phone_number")).distinct()
    by_lead = optouts.filter(F.col("phone").isNull() & F.col("prospect_id").isNotNull()).select("prospect_id").distinct()
    out = {"status": F.lit("OPTED_OUT"), "cancel_reason": F.lit("opted_out")}
    conv = join_hot(conversations, by_phone.withColumn("__p", F.lit(True)), ["org_id", "phone_number"])
    conv = conv.withColumn("status", F.when(F.col("__p"), "OPTED_OUT").otherwise(F.col("status"))).drop("__p")
    c = merge(contacts, by_phone.select("phone_number").distinct().withColumns(out), ["phone_number"], SEQUENCE, take=("cancel_reason",), crowded=True)
    c = merge(c, by_lead.withColumns(out), ["prospect_id"], SEQUENCE, take=("cancel_reason",), crowded=True)
    return {"state": _set_channel(state, leads, "opted_out"), "conversations": conv, "contacts": c}


def _stop_contacts(contacts: DataFrame, leads: DataFrame, status: str, reason: str, only_from: list[str] | None = None) -> DataFrame:
    said = leads.select("prospect_id").distinct().withColumns({"status": F.lit(status), "cancel_reason": F.lit(reason)})
    return merge(contacts, said, ["prospect_id"], SEQUENCE, only_from, take=("cancel_reason",))


def do_not_contact(blocks: DataFrame, state: DataFrame, contacts: DataFrame) -> dict[str, DataFrame]:
    """Manual blocks -> channel state, and unfinished contacts cancelled."""
    leads = blocks.select("prospect_id").distinct()
    return {"state": _set_channel(state, leads, "do_not_contact"), "contacts": _stop_contacts(contacts, leads, "CANCELLED", "do_not_contact")}


def automation_stop(handoffs: DataFrame, contacts: DataFrame, reason: str = "replied") -> DataFrame:
    """A handoff ends the lead's running sequences."""
    return _stop_contacts(contacts, handoffs, "REPLIED", reason, fixed.ACTIVE_SEQUENCE)


# --- campaigns and sequences ----------------------------------------------------------------

def step_lists(steps: DataFrame) -> DataFrame:
    """One row per campaign with its steps in order; a campaign has few, so its list travels beside its account."""
    return steps.groupBy("campaign_id").agg(F.array_sort(F.collect_list(F.struct("order_index", "message_template", "delay_minutes"))).alias("__list"))


def campaign_list(campaigns: DataFrame, steps: DataFrame, accounts: DataFrame, contacts: DataFrame) -> DataFrame:
    """Campaigns x their ordered steps, with account and contact count; one row per step."""
    a = accounts.select(F.col("id").alias("wa_account_id"), "session_name", F.col("status").alias("account_status"))
    n = contacts.groupBy("campaign_id").agg(F.count(F.lit(1)).alias("contacts"))
    return (campaigns.withColumnRenamed("id", "campaign_id").join(a, "wa_account_id", "left").join(n, "campaign_id", "left")
            .withColumn("contacts", F.coalesce("contacts", F.lit(0).cast("long")))
            .join(steps, "campaign_id", "left").orderBy("org_id", "campaign_id", "order_index"))


def campaign_detail(campaigns: DataFrame, contacts: DataFrame, prospects: DataFrame) -> DataFrame:
    """Contacts of each campaign with their lead."""
    p = prospects.select(F.col("id").alias("prospect_id"), "company_name", "city")
    return (contacts.withColumnRenamed("id", "contact_id").join(campaigns.select(F.col("id").alias("campaign_id"), "org_id"), "campaign_id")
            .join(p, "prospect_id", "left"))


def campaign_completion(campaigns: DataFrame, contacts: DataFrame) -> DataFrame:
    """Campaigns with their unfinished contacts and whether they are complete."""
    active = contacts.filter(F.col("status").isin(fixed.ACTIVE_SEQUENCE)).groupBy("campaign_id").agg(
        F.count(F.lit(1)).alias("active"))
    return (campaigns.withColumnRenamed("id", "campaign_id").join(active, "campaign_id", "left")
            .withColumn("active", F.coalesce("active", F.lit(0).cast("long")))
            .withColumn("complete", F.col("active") == 0))


def campaign_transition(campaigns: DataFrame, contacts: DataFrame, commands: DataFrame) -> dict[str, DataFrame]:
    """Latest command per campaign: pause, resume or cancel; a cancel also cancels running contacts.

    ``commands``: campaign_id, command_id, happened_at, command.
    """
    last = commands.groupBy("campaign_id").agg(
        F.max_by("command", F.struct("happened_at", "command_id")).alias("__cmd"),
        F.max(F.when(F.col("command") == "cancel", 1).otherwise(0)).alias("__cancelled"))
    target = F.create_map(*[F.lit(x) for x in ("pause", "PAUSED", "resume", "RUNNING", "cancel", "CANCELLED")])
    c = campaigns.join(last.select(F.col("campaign_id").alias("id"), "__cmd"), "id", "left").withColumn(
        "status", F.coalesce(target[F.col("__cmd")], "status")).drop("__cmd")
    stop = last.filter(F.col("__cancelled") == 1).select("campaign_id", F.lit("CANCELLED").alias("status"), F.lit("cancelled").alias("cancel_reason"))
    k = merge(contacts, stop, ["campaign_id"], SEQUENCE, fixed.ACTIVE_SEQUENCE, take=("cancel_reason",), crowded=True)
    return {"campaigns": c, "contacts": k}


def campaign_start(campaigns: DataFrame, steps: DataFrame, accounts: DataFrame, selection: DataFrame,
                   lead_phones: DataFrame, state: DataFrame, prospects: DataFrame) -> dict[str, DataFrame]:
    """Selected leads -> queued or cancelled contacts of startable campaigns.

    ``selection``: campaign_id, org_id, pos, prospect_id. ``lead_phones``: prospect_id, pos,
    raw_phone. A campaign needs a step and a connected account. Leads of other tenants are left
    out but keep their slot.
    """
    ok = (campaigns.select(F.col("id").alias("campaign_id"), "org_id", "wa_account_id")
          .join(accounts.filter(F.col("status") == "CONNECTED").select(F.col("id").alias("wa_account_id")), "wa_account_id", "left_semi")
          .join(steps.select("campaign_id"), "campaign_id", "left_semi").select("campaign_id", "org_id"))
    first_phone = lead_phones.groupBy("prospect_id").agg(F.min_by("raw_phone", "pos").alias("__raw"))
    leads = prospects.select("org_id", F.col("id").alias("prospect_id"))
    rows = (selection.join(ok, ["campaign_id", "org_id"], "left_semi").join(leads, ["org_id", "prospect_id"], "left_semi")
            .join(first_phone, "prospect_id", "left").withColumn("phone_number", phone_normalise("__raw")).drop("__raw"))
    rows = contactable(rows, state, "prospect_id")
    queued = F.col("contactable") & F.col("phone_number").isNotNull()
    contacts = campaign_stagger(rows, 1000).select(
        "campaign_id", "org_id", "prospect_id", "pos", "phone_number", F.when(queued, "QUEUED").otherwise("CANCELLED").alias("status"),
        F.when(~F.col("contactable"), "do_not_contact").when(~queued, "no_phone").alias("cancel_reason"),
        F.when(queued, F.col("delay_ms")).alias("delay_ms"))
    counts = contacts.groupBy("campaign_id").agg(F.count_if(F.col("status") == "QUEUED").alias("queued"))
    started = ok.select(F.col("campaign_id").alias("id")).join(
        selection.select(F.col("campaign_id").alias("id")), "id", "left_semi").withColumn("__on", F.lit(True))
    after = campaigns.join(started, "id", "left").withColumn(
        "status", F.when(F.col("__on"), "RUNNING").otherwise(F.col("status"))).drop("__on")
    return {"contacts": contacts, "counts": counts, "campaigns": after}


def sequence_decide(due: DataFrame, contacts: DataFrame, campaigns: DataFrame, prospects: DataFrame, accounts: DataFrame,
                    steps: DataFrame, state: DataFrame, messages: DataFrame, rate: DataFrame,
                    longest: int | None = LONGEST_VALUE) -> DataFrame:
    """First matching outcome of each due (contact, step), and what it does to the contact.

    ``due``: contact_id, step_index. ``prospects`` carries the first partner's partner_name and
    partner_role. ``messages``: campaign_contact_id, step_index. ``rate``: contact_id, allowed,
    retry_ms.
    """
    c = contacts.select(F.col("id").alias("contact_id"), "campaign_id", "prospect_id", "phone_number", F.col("status").alias("__ct"))
    k = campaigns.select(F.col("id").alias("campaign_id"), "org_id", "wa_account_id", F.col("status").alias("__ca"))
    a = accounts.select(F.col("id").alias("wa_account_id"), F.col("status").alias("__ac"))
    p = prospects.select(F.col("id").alias("prospect_id"), "company_name", "trade_name", "city", "industry", "partner_name",
                         "partner_role", F.lit(True).alias("__lead"))
    done = messages.select(F.col("campaign_contact_id").alias("contact_id"), "step_index", F.lit(True).alias("__done")).distinct()
    r = rate.select("contact_id", F.col("allowed").alias("__ok"), "retry_ms")
    tenant = k.join(a, "wa_account_id", "left").join(step_lists(steps), "campaign_id", "left")
    j = due.join(c, "contact_id", "left").join(done, ["contact_id", "step_index"], "left").join(r, "contact_id", "left")
    crowd = contacts.groupBy("campaign_id").agg(F.count(F.lit(1)).alias("__n"))
    j = join_hot(j, tenant, ["campaign_id"], counts=crowd).join(p, "prospect_id", "left").withColumns({
        "__steps": F.coalesce(F.size("__list"), F.lit(0)), "message_template": F.get("__list", F.col("step_index"))["message_template"]}).drop("__list")
    j = contactable(j, state, "prospect_id")
    j = j.withColumns({"content": render(F.col("message_template"), _lead_values(), longest), "phone": phone_normalise("phone_number")})

    def outcome(name, status=None, reason=None, wait=None):
        return F.struct(F.lit(name).alias("outcome") if isinstance(name, str) else name.alias("outcome"),
                        F.lit(status).cast("string").alias("contact_status"), F.lit(reason).cast("string").alias("reason"),
                        (F.lit(None) if wait is None else wait).cast("long").alias("retry_ms"))

    ca, ct = F.col("__ca"), F.col("__ct")
    decision = (
        F.when(ct.isNull(), outcome("contact_not_found"))
        .when(F.col("__lead").isNull(), outcome("prospect_not_found"))
        .when(ca == "CANCELLED", outcome("campaign_cancelled", "CANCELLED", "cancelled"))
        .when(ca == "PAUSED", outcome("paused", wait=F.lit(60_000)))
        .when(F.coalesce(ca, F.lit("")) != "RUNNING", outcome(F.concat(F.lit("campaign_"), F.coalesce(ca, F.lit("MISSING")))))
        .when(ct.isin(fixed.TERMINAL_SEQUENCE), outcome(F.concat(F.lit("contact_"), ct)))
        .when(~F.col("contactable"), outcome("do_not_contact", "CANCELLED", "do_not_contact"))
        .when(F.coalesce("__ac", F.lit("")) != "CONNECTED", outcome("account_not_connected"))
        .when(F.col("step_index") >= F.col("__steps"), outcome("completed", "COMPLETED"))
        .when(F.col("phone").isNull(), outcome("no_phone", "CANCELLED", "no_phone"))
        .when(F.col("__done"), outcome("already_exists"))
        .when(~F.coalesce("__ok", F.lit(True)), outcome("rate_limited", wait=F.col("retry_ms")))
        .when(F.col("content") == "", outcome("empty_template", "CANCELLED", "empty_template"))
        .otherwise(outcome("send", "SENDING")))
    return j.withColumn("d", decision).select(
        "contact_id", "step_index", "campaign_id", "org_id", "prospect_id", F.col("phone").alias("phone_number"), "d.*",
        F.when(F.col("d.outcome") == "send", F.col("content")).alias("content"))


def sequence_emit(decided: DataFrame, messages: DataFrame) -> dict[str, DataFrame]:
    """Decisions to send -> pending messages, one per (contact, step), and contacts to update."""
    on = ["campaign_contact_id", "step_index"]
    rows = first_row(decided.filter(F.col("outcome") == "send").withColumnRenamed("contact_id", "campaign_contact_id"), on, [F.col("content")])
    new = rows.join(messages.select(*on), on, "left_anti").select(
        *on, "org_id", "phone_number", F.lit("OUTBOUND").alias("direction"), F.lit("TEXT").alias("type"), "content",
        F.lit("PENDING").alias("status"))
    touched = new.groupBy(F.col("campaign_contact_id").alias("contact_id")).agg(F.max("step_index").alias("current_step_index"))
    return {"messages": new, "contacts": touched.withColumn("status", F.lit("SENDING"))}


def wa_send_gate(messages: DataFrame, contacts: DataFrame, accounts: DataFrame) -> DataFrame:
    """Pending messages -> already_sent, error, failed or send."""
    c = contacts.select(F.col("id").alias("campaign_contact_id"), F.col("status").alias("__ct"))
    a = accounts.select(F.col("id").alias("wa_account_id"), F.col("status").alias("__ac"))
    terminal = F.col("__ct").isin("REPLIED", "OPTED_OUT", "CANCELLED")
    offline = F.coalesce("__ac", F.lit("")) != "CONNECTED"
    return (messages.join(c, "campaign_contact_id", "left").join(a, "wa_account_id", "left")
            .withColumn("outcome", F.when(F.col("status").isin("SENT", "DELIVERED", "READ"), "already_sent")
                        .when(offline, "error").when(terminal, "failed").otherwise("send"))
            .withColumn("error", F.when(F.col("outcome") == "failed", "contact_terminal_state")
                        .when(F.col("outcome") == "error", "account_not_connected"))
            .drop("__ct", "__ac"))


def sequence_next_step(sent: DataFrame, steps: DataFrame) -> DataFrame:
    """After a sent step: the next one and when it is due, or the sequence is complete.

    ``sent``: contact_id, campaign_id, step_index, sent_at.
    """
    j = join_hot(sent, step_lists(steps), ["campaign_id"]).withColumn("__next", F.get("__list", F.col("step_index") + 1))
    j = j.withColumns({"__more": F.col("__next").isNotNull(), "delay_minutes": F.col("__next.delay_minutes")})
    wait = F.greatest(F.lit(1), F.coalesce("delay_minutes", F.lit(0)) * 60)
    more = F.coalesce("__more", F.lit(False))
    return j.select(
        "contact_id", "campaign_id", "step_index", F.when(more, F.col("step_index") + 1).alias("next_step_index"),
        F.when(more, F.col("sent_at") + F.make_interval(secs=wait)).alias("due_at"), (~more).alias("complete"))


def wa_send_apply(results: DataFrame, messages: DataFrame, contacts: DataFrame, conversations: DataFrame,
                  steps: DataFrame) -> dict[str, DataFrame]:
    """Provider answers -> messages, contacts, conversations and the next steps.

    ``results``: message_id, ok, provider_message_id, error, happened_at; a message may have several, of which a first
    success counts, else the last failure. A message that was sent before keeps its id and time and moves nothing on.
    Contacts that ended stay so; the last step completes the others.
    """
    at = F.col("happened_at")
    r = results.groupBy(F.col("message_id").alias("id")).agg(
        F.min(F.when(F.col("ok"), F.struct(at, "provider_message_id"))).alias("good"), F.max(F.when(~F.col("ok"), F.struct(at, "error"))).alias("bad"))
    done = F.col("good").isNotNull()
    said = r.select("id", F.when(done, "SENT").otherwise("FAILED").alias("status"), F.col("good.provider_message_id").alias("provider_message_id"),
                    F.col("good.happened_at").alias("sent_at"), F.when(~done, F.col("bad.error")).alias("error"),
                    F.when(~done | (F.col("bad.happened_at") < F.col("good.happened_at")), F.col("bad.happened_at")).alias("failed_at"))
    before = messages.filter(F.coalesce(MESSAGE.rung(F.col("status")) < MESSAGE.rung(F.lit("SENT")), F.lit(True)))
    said = said.join(before.select("id"), "id", "left_semi")
    sent = before.join(said.filter(F.col("status") == "SENT").select("id", F.col("sent_at").alias("__at")), "id")
    after = merge(messages, said, ["id"], MESSAGE, take=("error", "failed_at"), fill=("provider_message_id", "sent_at"))
    after = after.withColumn("error", F.when(~F.col("status").isin("SENT", "DELIVERED", "READ"), F.col("error")))
    steps_due = sequence_next_step(
        sent.filter(F.col("campaign_contact_id").isNotNull()).select(
            F.col("campaign_contact_id").alias("contact_id"), "campaign_id", "step_index", F.col("__at").alias("sent_at")), steps)
    per_contact = sent.groupBy(F.col("campaign_contact_id").alias("id")).agg(F.max("__at").alias("last_sent_at")).withColumn("status", F.lit("SENT"))
    c = merge(contacts, per_contact, ["id"], SEQUENCE, last=("last_sent_at",))
    ended = steps_due.filter("complete").select(F.col("contact_id").alias("id"), F.lit("COMPLETED").alias("status")).distinct()
    c = merge(c, ended, ["id"], SEQUENCE, fixed.ACTIVE_SEQUENCE)
    per_conv = sent.groupBy(F.col("conversation_id").alias("id")).agg(F.max("__at").alias("last_message_at"))
    v = merge(conversations, per_conv, ["id"], last=("last_message_at",))
    return {"messages": after, "contacts": c, "conversations": v, "next_steps": steps_due}

"""E-mail outreach: drafts, gates, results, replies, follow-ups and reporting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadlake.functions import fixed
from leadlake.functions.columns import present, short_key
from leadlake.operators.fold import Fold
from leadlake.operators.intake import owned_ids_check
from leadlake.operators.rates import EMAIL, RateConfig, send_jitter
from leadlake.operators.state import MAIL, OUTREACH, merge
from leadlake.plans.balance import join_hot, top_k

EMAIL_PATTERN = r"([a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,})"
LATEST_EVENTS = 50


def _is_terminal(c="status") -> Column:
    return F.col(c).isin(fixed.TERMINAL_OUTREACH)


def email_draft_render(leads: DataFrame, settings: DataFrame | None = None, sender: str = fixed.MAIL_SENDER,
                       pixel_base: str = "https://example.com/t/o/") -> DataFrame:
    """Deterministic e-mail per lead; ``leads`` carries contact_id and sequence for the token."""
    vp = F.lit(fixed.MAIL_PROPOSITION)
    if settings is not None:
        leads = leads.join(settings.select("org_id", F.col("value_proposition").alias("__vp")), "org_id", "left")
        vp = F.coalesce(present("__vp"), vp)
    name, segment = F.coalesce("company_name", F.lit("")), F.coalesce(present("industry"), F.lit(fixed.MAIL_NO_SEGMENT))
    token = short_key("contact_id", "sequence")

    def text(gap, known, about, close, end=""):
        """The paragraphs with ``gap`` between them; ``known`` and ``about`` hold the name and the segment."""
        return F.concat(F.lit(f"{fixed.MAIL_GREETING}{gap}{fixed.MAIL_HOPE}{gap}{fixed.MAIL_KNOWN}"), known, F.lit(fixed.MAIL_SEGMENT), about,
                        F.lit(fixed.MAIL_CLAIM + gap + fixed.MAIL_HELP), vp,
                        F.lit(f".{gap}{fixed.MAIL_ASK}{gap}{close}{sender}{end}"))

    body = text("\n\n", name, segment, f"{fixed.MAIL_CLOSE}\n")
    strong, em = F.concat(F.lit("<strong>"), name, F.lit("</strong>")), F.concat(F.lit("<em>"), segment, F.lit("</em>"))
    html = F.concat(F.lit("<p>"), text("</p><p>", strong, em, f"{fixed.MAIL_CLOSE_HTML}<br/>", "</p>"), F.lit(f'<img src="{pixel_base}'), token,
                    F.lit('.gif" width="1" height="1" alt="" />'))
    about, segments, general = fixed.MAIL_FACTS
    return leads.withColumns({
        "subject": F.concat(F.lit(fixed.MAIL_SUBJECT), name), "body": body, "html_body": html, "tracking_token": token,
        "reasoning_facts": F.array(F.concat(F.lit(about), name), F.concat(F.lit(segments), F.coalesce(present("industry"), F.lit(general)))),
    }).drop("__vp")


def recipient_pick(messages: DataFrame, prospects: DataFrame) -> DataFrame:
    """Recipient from the lead, else the first address in the body; none fails the message."""
    mail = prospects.select(F.col("id").alias("prospect_id"), F.col("cnpj_email").alias("__mail"))
    found = present(F.regexp_extract(F.coalesce("body", F.lit("")), EMAIL_PATTERN, 1))
    return (messages.join(mail, "prospect_id", "left")
            .withColumn("recipient", F.coalesce(present("__mail"), found))
            .withColumn("error", F.when(F.col("recipient").isNull(), "No recipient email found"))
            .drop("__mail"))


def reply_detect(mails: DataFrame, headers: str = "headers") -> DataFrame:
    """Flag replies by headers (names compared in lower case; the last value wins) or subject."""
    lowered = F.transform(headers, lambda h: F.named_struct(
        F.lit("name"), F.lower(F.coalesce(h["name"], F.lit(""))), F.lit("value"), F.coalesce(h["value"], F.lit(""))))

    def value(name):
        hits = F.filter("__h", lambda h: h["name"] == name)
        return F.coalesce(F.try_element_at(hits, F.lit(-1))["value"], F.lit(""))

    subject = value("subject")
    is_reply = (value("in-reply-to") != "") | (value("references") != "") | subject.startswith("Re:") | subject.startswith("res:")
    return (mails.withColumn("__h", lowered)
            .withColumns({"is_reply": F.coalesce(is_reply, F.lit(False)), "subject": subject, "from_email": value("from")})
            .drop("__h"))


def reply_attribution(replies: DataFrame, messages: DataFrame, contacts: DataFrame, accounts: DataFrame) -> DataFrame:
    """Replies with the contact whose message shares the thread.

    Contacts in a terminal state and mails sent by the receiving account itself are skipped.
    """
    own = accounts.select(F.col("id").alias("account_id"), F.col("email").alias("__own"))
    live = contacts.filter(~_is_terminal()).select(F.col("id").alias("contact_id"))
    threads = (messages.filter(F.col("thread_id").isNotNull()).select("thread_id", "contact_id")
               .join(live, "contact_id", "left_semi").groupBy("thread_id").agg(F.min("contact_id").alias("contact_id")))
    others = (join_hot(replies, own, ["account_id"])
              .filter(F.col("__own").isNull() | ~F.contains(F.col("from_email"), F.col("__own"))).drop("__own"))
    return join_hot(others, threads, ["thread_id"], "inner")


def reply_stats(replies: DataFrame) -> DataFrame:
    return replies.groupBy("contact_id").agg(
        F.count(F.lit(1)).alias("replies"), F.max("replied_at").alias("last_reply_at"))


def reply_apply(attributed: DataFrame, contacts: DataFrame, messages: DataFrame) -> dict[str, DataFrame]:
    """Contacts replied, the thread noted on their first sent message, one event each.

    The first reply ends a contact, so later ones of this or another batch change nothing.
    """
    live = contacts.filter(~OUTREACH.final(F.col("status"))).select(F.col("id").alias("contact_id"))
    first = (attributed.groupBy("contact_id").agg(F.min(F.struct("replied_at", "reply_id", "thread_id")).alias("__r"))
             .join(live, "contact_id", "left_semi"))
    said = first.select(F.col("contact_id").alias("id"), F.lit("REPLIED").alias("status"), F.lit(1).alias("reply_count"),
                        F.col("__r.replied_at").alias("last_reply_at"), F.lit("replied").alias("cancel_reason"))
    after = merge(contacts, said, ["id"], OUTREACH, take=("cancel_reason",), last=("last_reply_at",), add=("reply_count",))
    first_sent = (messages.filter(F.col("status") == "SENT").groupBy("contact_id")
                  .agg(F.min(F.struct("created_at", "id")).alias("m")).select("contact_id", F.col("m.id").alias("id")))
    noted = first_sent.join(first, "contact_id").select("id", F.col("__r.thread_id").alias("__thread"))
    msgs = messages.join(noted, "id", "left").withColumn("thread_id", F.coalesce("__thread", "thread_id")).drop("__thread")
    events = (first.join(first_sent.withColumnRenamed("id", "message_id"), "contact_id", "left")
              .select("contact_id", "message_id", F.lit("email_replied").alias("type"), F.lit("replied").alias("status"),
                      F.col("__r.replied_at").alias("created_at"), F.col("__r.reply_id").alias("reply_id")))
    return {"contacts": after, "messages": msgs, "events": events}


def followup_plan(contacts: DataFrame, sent: DataFrame) -> DataFrame:
    """Next mail of live contacts, 3, 5 and 7 days after the last sent one, four mails at most.

    ``sent``: contact_id, sent_at.
    """
    last = sent.groupBy("contact_id").agg(F.max("sent_at").alias("last_sent_at"))
    days = F.element_at(F.array(*[F.lit(d) for d in fixed.FOLLOWUP_DAYS]), F.greatest(F.col("outreach_sequence"), F.lit(1)))
    live = contacts.filter(~_is_terminal() & (F.col("outreach_sequence") < fixed.MAX_EMAILS))
    return (live.select(F.col("id").alias("contact_id"), "prospect_id", "campaign_id", "outreach_sequence")
            .join(last, "contact_id")
            .withColumns({"next_sequence": F.col("outreach_sequence") + 1, "delay_days": days})
            .withColumn("due_at", F.col("last_sent_at") + F.make_interval(days=F.col("delay_days")))
            .drop("outreach_sequence"))


def followup_cancel(schedule: DataFrame, replies: DataFrame, contacts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Scheduled follow-ups that stay, and contacts with the cancel reason stamped."""
    replied = replies.select("contact_id").distinct()
    said = replied.select(F.col("contact_id").alias("id"), F.lit("replied").alias("cancel_reason"))
    return schedule.join(replied, "contact_id", "left_anti"), merge(contacts, said, ["id"], take=("cancel_reason",))


def open_fold() -> Fold:
    return Fold(("contact_id",), {"first": F.struct("opened_at", "message_id")}, {})


def first_open(opens: DataFrame, messages: DataFrame, contacts: DataFrame, folded: bool = False) -> DataFrame:
    """The first open of each contact and the contact status it leads to.

    ``opens``: tracking_token, opened_at; or, with ``folded``, the merged first opens.
    """
    if not folded:
        opens = open_fold().partial(opens.join(
            messages.select("tracking_token", "contact_id", F.col("id").alias("message_id")), "tracking_token"))
    c = contacts.select(F.col("id").alias("contact_id"), F.col("status").alias("__status"))
    return (opens.select("contact_id", "first.opened_at", "first.message_id").join(c, "contact_id", "left")
            .withColumn("contact_status", F.when(F.col("__status").isin(fixed.OPENABLE), "OPENED_INFERRED")
                        .otherwise(F.col("__status"))).drop("__status"))


def outreach_timeline(events: DataFrame, contacts: DataFrame, messages: DataFrame) -> DataFrame:
    """Events with their lead and a summary of the message, newest first."""
    c = contacts.select(F.col("id").alias("contact_id"), "prospect_id", "campaign_id")
    m = messages.select(F.col("id").alias("message_id"), "subject", F.col("status").alias("message_status"))
    return (events.select(F.col("id").alias("event_id"), "contact_id", "message_id", "type", "created_at")
            .join(c, "contact_id").join(m, "message_id", "left")
            .orderBy("prospect_id", F.col("created_at").desc(), F.col("event_id").desc()))


def outreach_status(contacts: DataFrame, campaigns: DataFrame, messages: DataFrame, events: DataFrame,
                    latest_events: int = LATEST_EVENTS) -> DataFrame:
    """Contacts with campaign, message count, event total and their latest events, one row each.

    Messages themselves stay in their own table; they are counted before the join.
    """
    camp = campaigns.select(F.col("id").alias("campaign_id"), F.col("name").alias("campaign_name"))
    n_msgs = messages.groupBy("contact_id").agg(F.count(F.lit(1)).alias("messages"))
    n_events = events.groupBy("contact_id").agg(F.count(F.lit(1)).alias("events"))
    latest = top_k(events.select("contact_id", F.col("id").alias("event_id"), "type", "created_at"), ["contact_id"],
                   [F.col("created_at").desc(), F.col("event_id").desc()], latest_events, "event_rank", spread=True)
    zero = F.lit(0).cast("long")
    return (contacts.select(F.col("id").alias("contact_id"), "prospect_id", "campaign_id", "status")
            .join(camp, "campaign_id", "left").join(n_msgs, "contact_id", "left").join(n_events, "contact_id", "left")
            .withColumns({"messages": F.coalesce("messages", zero), "events": F.coalesce("events", zero)})
            .join(latest, "contact_id", "left")
            .orderBy("prospect_id", "contact_id", "event_rank"))


def outreach_messages(contacts: DataFrame, campaigns: DataFrame, messages: DataFrame) -> DataFrame:
    """Every message of every lead with its contact and campaign, newest first per lead; the rows beside outreach_status."""
    camp = campaigns.select(F.col("id").alias("campaign_id"), F.col("name").alias("campaign_name"))
    c = contacts.select(F.col("id").alias("contact_id"), "prospect_id", "campaign_id").join(camp, "campaign_id", "left")
    m = messages.select(F.col("id").alias("message_id"), "contact_id", "subject", F.col("status").alias("message_status"), "created_at")
    return m.join(c, "contact_id").orderBy("prospect_id", F.col("created_at").desc(), F.col("message_id").desc())


def _progress() -> Column:
    return (F.when(F.col("type") == "email_scheduled", "SCHEDULED").when(F.col("type") == "email_sent", "SENT")
            .when(F.col("type") == "email_opened_inferred", "OPENED_INFERRED"))


def contact_fold() -> Fold:
    replied = F.col("type") == "email_replied"
    return Fold(
        ("contact_id",),
        {"first_reply": F.when(replied, F.struct("created_at", "id"))},
        {"last_step": F.when(_progress().isNotNull(), F.struct("created_at", "id", _progress().alias("status"))),
         "last_sent": F.when(F.col("type") == "email_sent", F.col("created_at"))})


def outreach_contact_state(contacts: DataFrame, events: DataFrame, folded: bool = False) -> DataFrame:
    """Contacts after all events: latest step wins, a reply ends it, terminal states are final."""
    f = events if folded else contact_fold().partial(events)
    j = contacts.join(f.withColumnRenamed("contact_id", "id"), "id", "left")
    done, replied = _is_terminal(), F.col("first_reply").isNotNull()
    return j.select(
        F.col("id").alias("contact_id"), "prospect_id", "campaign_id", "outreach_sequence",
        F.when(done, F.col("status")).when(replied, "REPLIED").otherwise(F.coalesce("last_step.status", "status")).alias("status"),
        F.col("last_sent").alias("sent_at"),
        F.when(~done & replied, 1).otherwise(0).alias("reply_count"),
        F.when(~done, F.col("first_reply.created_at")).alias("last_reply_at"),
        F.when(~done & replied, "replied").alias("cancel_reason"))


def campaign_stagger(selection: DataFrame, ms: int, pos: str = "pos") -> DataFrame:
    """Start delay from the lead's place in the request, so skipped leads still take a slot."""
    return selection.withColumn("delay_ms", F.col(pos).cast("long") * F.lit(ms))


def outreach_campaign_start(requests: DataFrame, campaigns: DataFrame, prospects: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Prepare rows of valid requests, and campaigns with the started ones active.

    ``requests``: request_id, org_id, campaign_id, pos, prospect_id.
    """
    own = campaigns.select(F.col("id").alias("campaign_id"), F.col("tenant_id").alias("org_id"))
    in_tenant = requests.join(own, ["campaign_id", "org_id"], "left_semi")
    valid = owned_ids_check(in_tenant, prospects).filter("valid").select("request_id")
    rows = campaign_stagger(in_tenant.join(valid, "request_id", "left_semi"), 500)
    started = rows.select(F.col("campaign_id").alias("id")).distinct().withColumn("__on", F.lit(True))
    after = campaigns.join(started, "id", "left").withColumn(
        "status", F.when(F.col("__on"), "active").otherwise(F.col("status"))).drop("__on")
    return rows, after


def outreach_prepare(due: DataFrame, contacts: DataFrame, prospects: DataFrame, settings: DataFrame | None = None,
                     cfg: RateConfig = EMAIL) -> dict[str, DataFrame]:
    """Due leads -> contact, message and event rows.

    ``due``: prospect_id, campaign_id, email_account_id, sequence, due_at. Contacts that ended,
    or already had this sequence sent, are left alone.
    """
    prior = contacts.select("prospect_id", "campaign_id", F.col("id").alias("__id"), F.col("status").alias("__status"),
                            F.col("outreach_sequence").alias("__seq"))
    wanted = F.coalesce("sequence", F.lit(1))
    j = (due.join(prior, ["prospect_id", "campaign_id"], "left")
         .withColumn("__next", F.greatest(F.coalesce("__seq", F.lit(0)), wanted))
         .filter(~F.coalesce(F.col("__status").isin(fixed.TERMINAL_OUTREACH), F.lit(False))
                 & ~F.coalesce((F.col("__status") == "SENT") & (F.col("__seq") >= wanted), F.lit(False))))
    new_id = short_key("prospect_id", "campaign_id")
    ready = (j.withColumn("contact_id", F.coalesce(F.col("__id").cast("string"), new_id))
             .withColumn("sequence", F.col("__next")).drop("__id", "__status", "__seq", "__next"))
    leads = prospects.select(F.col("id").alias("prospect_id"), "org_id", "company_name", "industry")
    drafted = email_draft_render(ready.join(leads, "prospect_id"), settings)
    drafted = send_jitter(drafted.withColumn("message_id", short_key("contact_id", "sequence", "campaign_id")), cfg)
    minute = F.col("due_at") + F.expr("INTERVAL 1 MINUTE")
    slot = F.col("due_at") + F.make_interval(secs=F.col("delay_seconds"))
    return {
        "contacts": drafted.select("contact_id", "prospect_id", "campaign_id", "email_account_id", F.lit("SCHEDULED").alias("status"),
                                   F.col("sequence").alias("outreach_sequence"), minute.alias("scheduled_at")),
        "messages": drafted.select("message_id", "contact_id", "subject", "body", "html_body", F.lit("SCHEDULED").alias("status"),
                                   "tracking_token", "reasoning_facts", slot.alias("scheduled_for")),
        "events": drafted.select("contact_id", "message_id", F.lit("email_scheduled").alias("type"),
                                 F.lit("scheduled").alias("status"), "sequence", F.col("due_at").alias("created_at")),
    }


def email_send_gate(messages: DataFrame, contacts: DataFrame, rate: DataFrame, prospects: DataFrame,
                    suppression: DataFrame | None = None) -> DataFrame:
    """What to do with each due message, first matching reason wins.

    ``rate``: account_id, allowed, retry_ms (one row per account).
    """
    c = contacts.select(F.col("id").alias("contact_id"), "prospect_id", "tenant_id", F.col("status").alias("__status"),
                        F.col("email_account_id").alias("account_id"))
    r = rate.select("account_id", F.col("allowed").alias("__ok"), "retry_ms")
    j = recipient_pick(messages.join(c, "contact_id", "left").join(r, "account_id", "left"), prospects)
    if suppression is not None:
        s = suppression.select("tenant_id", F.lower("email").alias("__to"), F.lit(True).alias("__stop")).distinct()
        j = j.withColumn("__to", F.lower("recipient")).join(s, ["tenant_id", "__to"], "left").drop("__to")
    else:
        j = j.withColumn("__stop", F.lit(None).cast("boolean"))
    limited = ~F.coalesce("__ok", F.lit(True))
    outcome = (F.when(F.col("__status").isin(fixed.TERMINAL_OUTREACH), "cancelled")
               .when(F.col("account_id").isNull(), "error").when(limited, "retry")
               .when(F.col("recipient").isNull(), "failed").when(F.col("__stop"), "cancelled").otherwise("send"))
    reason = (F.when(F.col("__status").isin(fixed.TERMINAL_OUTREACH), F.col("__status"))
              .when(F.col("account_id").isNull(), "no_account").when(limited, "rate_limited")
              .when(F.col("recipient").isNull(), F.col("error")).when(F.col("__stop"), "suppressed"))
    return j.withColumns({"outcome": outcome, "reason": reason,
                          "retry_ms": F.when(outcome == "retry", F.col("retry_ms"))}).drop("__status", "__ok", "__stop", "error")


def email_send_apply(results: DataFrame, messages: DataFrame, contacts: DataFrame) -> dict[str, DataFrame]:
    """Sent mails -> messages, contacts, the two events each and the next follow-up.

    ``results``: message_id, provider_message_id, thread_id, sent_at; the first of a message counts. Mails sent before keep
    their ids and time and bring no second events; contacts that ended stay so.
    """
    once = results.groupBy("message_id").agg(F.min(F.struct("sent_at", "provider_message_id", "thread_id")).alias("r"))
    news = once.select("message_id", "r.*").join(
        messages.filter(F.coalesce(F.col("status") != "SENT", F.lit(True))).select(F.col("id").alias("message_id"), "contact_id"), "message_id")
    said = news.drop("contact_id").withColumnRenamed("message_id", "id").withColumn("status", F.lit("SENT"))
    m = merge(messages, said, ["id"], MAIL, take=("provider_message_id", "thread_id"), fill=("sent_at",))
    last = news.groupBy(F.col("contact_id").alias("id")).agg(F.max("sent_at").alias("sent_at")).withColumn("status", F.lit("SENT"))
    c = merge(contacts, last, ["id"], OUTREACH, last=("sent_at",))
    kinds = F.array(F.struct(F.lit("email_sent").alias("type"), F.lit("sent").alias("status")),
                    F.struct(F.lit("email_delivered_inferred").alias("type"), F.lit("delivered").alias("status")))
    events = news.select("contact_id", "message_id", F.col("sent_at").alias("created_at"), F.inline(kinds))
    return {"messages": m, "contacts": c, "events": events, "followups": followup_plan(c, news.select("contact_id", "sent_at"))}


def suppression_exclude(recipients: DataFrame, suppression: DataFrame) -> DataFrame:
    """Recipients whose address the tenant has not suppressed."""
    s = suppression.select("tenant_id", F.lower("email").alias("__e"))
    return recipients.withColumn("__e", F.lower("email")).join(s, ["tenant_id", "__e"], "left_anti").drop("__e")

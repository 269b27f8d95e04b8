"""The same answers from streams: tables are replayed as files, batch by batch.

Each query stages its view as a folder of files, runs the stream until the folder is used up and
reads the tables the stream wrote. The DuckDB statements are those of the batch operators.
"""

from pyspark.sql import functions as F

from leadlake.catalog import enrich_q, messaging_q, outreach_q, sources_q
from leadlake.catalog.core import query
from leadlake.operators import enrich as E
from leadlake.operators import messaging as M
from leadlake.operators import outreach as O
from leadlake.operators.rates import EMAIL, MESSAGING, RateConfig
from leadlake.plans.scratch import cut, new_dir
from leadlake.sources import payloads as P
from leadlake.streaming import appliers as A
from leadlake.streaming import delivery as D
from leadlake.streaming import limits as L
from leadlake.streaming import readers as R

LEAST_FILES = 6
ROWS_PER_FILE = 1_000_000


def ddl(df) -> str:
    return ", ".join(f"`{n}` {t}" for n, t in df.dtypes)


def stage(df, name: str, order: str | None = None) -> str:
    """Rows as several files; with ``order`` each file covers one range, as a log would."""
    path = new_dir(df.sparkSession, f"stage-{name}")
    files = max(LEAST_FILES, df.count() // ROWS_PER_FILE)
    (df.repartitionByRange(files, order) if order else df.repartition(files)).write.parquet(path)
    return path


def replay(fx, df, name: str, order: str | None = None):
    return R.read_stream(fx.spark, stage(df, name, order), ddl(df), files=2)


def folded(fx, df, fold, name: str):
    log, ck = new_dir(fx.spark, f"fold-{name}"), new_dir(fx.spark, f"ck-{name}")
    A.fold_stream(replay(fx, df, name), fold, ck, log, every=3).awaitTermination()
    return A.read_fold(fx.spark, log, fold)


def doubled(df, cond: str):
    """Redelivered rows on top of the originals."""
    return df.unionByName(df.filter(cond))


def results(fx, part: int, cols: list[str]):
    """Usable results (part 0) or dead letters (part 1) as the stream leaves them."""
    path, out = stage(fx.sql(sources_q.RESULT_RAW), "results"), new_dir(fx.spark, "results")
    rows = R.read_results(fx.spark, path, files=2)[part].select(*cols)
    A.append_batches(rows, new_dir(fx.spark, "ck-results"), out).awaitTermination()
    return A.read_batches(fx.spark, out)


@query("src_enrichment_stream", sources_q.GOOD.replace(", body FROM", " FROM"))
def _(fx):
    return results(fx, 0, ["raw_id", "cnpj", "enrichment_version", "status"])


@query("src_enrichment_stream dead letters", sources_q.DEAD)
def _(fx):
    return results(fx, 1, ["raw_id", "body", "reason"])


@query("src_message_stream", f"""
SELECT w.event_id, a.org_id, CASE body->>'$.event' WHEN 'message' THEN 'message' WHEN 'message.ack' THEN 'ack' ELSE 'session' END AS route, 'm' || w.event_id AS provider_message_id
FROM ({sources_q.WA_RAW}) w JOIN {{fx_wa_account}} a ON a.session_name = body->>'$.session' WHERE body->>'$.event' <> 'presence'""")
def _(fx):
    path = stage(fx.sql(sources_q.WA_RAW), "events")
    routed = P.route_events(R.read_wa_events(fx.spark, path, files=2), fx("wa_account"))
    out = new_dir(fx.spark, "routes")
    cols = ["event_id", "org_id", "route", "provider_message_id"]
    A.write_routes(routed.select(*cols), new_dir(fx.spark, "ck-routes"), out, ["message", "ack", "session"]).awaitTermination()
    return A.read_batches(fx.spark, out).select(*cols)


# Rows that fail so many times before they are dealt with; above the budget, for good.
FAILS = "CASE {0} % 7 WHEN 3 THEN 1 WHEN 4 THEN 4 WHEN 5 THEN 5 WHEN 6 THEN 99 ELSE 0 END"


def failing(key: str):
    """A handler that fails each row as often as its key says."""
    def handle(rows):
        fails = F.expr(FAILS.format(key))
        return rows.withColumn("error", F.when(F.col("attempt") <= fails, F.concat(F.lit("attempt "), F.col("attempt").cast("string"))))

    return handle


def redelivered(fx, rows, key: str, name: str):
    """(done, dead) after the stream and the rounds that follow it."""
    path, schema, handle = new_dir(fx.spark, f"ledger-{name}"), rows.schema, failing(key)
    D.deliver(rows, [key], handle, new_dir(fx.spark, f"ck-{name}"), path).awaitTermination()
    D.redeliver(fx.spark, schema, handle, path)
    done, dead = D.delivered(fx.spark, schema, path)
    return done.withColumn("outcome", F.lit("done")).unionByName(dead.withColumn("outcome", F.lit("dead")), allowMissingColumns=True)


def delivery_sql(body: str, key: str, cols: str) -> str:
    fails = FAILS.format(key)
    return f"""SELECT {cols}, cast(least({fails} + 1, 5) AS int) AS attempt, CASE WHEN {fails} < 5 THEN 'done' ELSE 'dead' END AS outcome,
  CASE WHEN {fails} >= 5 THEN 'attempt 5' END AS error FROM ({body}) b"""


@query("src_enrichment_stream redelivery", delivery_sql(sources_q.GOOD, "raw_id", "raw_id, cnpj, enrichment_version, status"))
def _(fx):
    rows = R.read_results(fx.spark, stage(fx.sql(sources_q.RESULT_RAW), "results"), files=2)[0]
    return redelivered(fx, rows.select("raw_id", "cnpj", "enrichment_version", "status"), "raw_id", "results")


@query("src_message_stream redelivery", delivery_sql(
    f"SELECT event_id, body->>'$.event' AS event, body->>'$.session' AS session FROM ({sources_q.WA_RAW}) w", "event_id", "event_id, event, session"))
def _(fx):
    rows = R.read_wa_events(fx.spark, stage(fx.sql(sources_q.WA_RAW), "events"), files=2)
    return redelivered(fx, rows.select("event_id", "event", "session"), "event_id", "events")


KEYED = "SELECT id, concat(' 9', substr(cnpj, 2, 7), '/', substr(cnpj, 9)) AS cnpj, company_name, CASE WHEN id % 3 = 0 THEN ' ' ELSE trade_name END AS trade_name FROM {fx_prospect} p"
REQUESTS = f"""
SELECT e.change_id AS event_id, e.prospect_id, regexp_replace(p.cnpj, '[^0-9]', '', 'g') AS cnpj, p.company_name, nullif(trim(p.trade_name), '') AS trade_name, e.changed_at AS requested_at
FROM ({enrich_q.ENTRY}) e JOIN ({KEYED}) p ON p.id = e.prospect_id"""


@query("enrichment_requests", REQUESTS)
def _(fx):
    return E.enrichment_requests(E.stage_entry(fx("stage_change")), fx.sql(KEYED)).drop("company_id")


@query("enrichment_request_stream", f"""
SELECT * FROM ({REQUESTS}) UNION ALL SELECT event_id, prospect_id, cnpj, company_name, trade_name, requested_at + INTERVAL 3 MINUTE FROM ({REQUESTS}) WHERE event_id % 4 = 0""")
def _(fx):
    """Each request comes again a minute later, some of them three minutes later, files in no order of time.

    The watermark waits for the whole span of the log, so no row is late; a last row beyond it lets all others out.
    """
    requests = cut(E.enrichment_requests(E.stage_entry(fx("stage_change")), fx.sql(KEYED)), "requests")
    later = lambda m: requests.withColumn("requested_at", F.col("requested_at") + F.make_interval(mins=F.lit(m)))
    rows = requests.unionByName(requests).unionByName(later(1)).unionByName(later(3).filter("event_id % 4 = 0"))
    end = requests.limit(1).withColumns({"event_id": F.lit(-1).cast("long"), "requested_at": F.lit("2060-01-01 00:00:00").cast("timestamp_ntz")})
    path = stage(rows, "requests")
    end.write.mode("append").parquet(path)
    once = A.dedupe_by_time(R.read_stream(fx.spark, path, ddl(rows), files=3), ["event_id"], "requested_at", "2 MINUTES", "20000 days")
    out = new_dir(fx.spark, "requests")
    A.write_rows(once, new_dir(fx.spark, "ck-requests"), out).awaitTermination()
    return fx.spark.read.schema(once.schema).parquet(out).drop("company_id")


@query("enrichment_apply_stream", enrich_q.APPLY)
def _(fx):
    r = fx("enrichment_result").select("cnpj", "enrichment_version", "status", "commercial_potential", "event_ts", "event_id")
    kept = E.unfold_results(folded(fx, r, E.result_fold(), "results"))
    return E.enrichment_apply(fx("prospect"), kept).select("id", "org_id", "enrichment_status", "opportunity_score", "enrichment_version")


@query("message_dedupe_stream", "SELECT DISTINCT conversation_id, provider_message_id, turn, direction FROM {fx_wa_delivery} d")
def _(fx):
    return M.unfold_messages(folded(fx, fx("wa_delivery"), M.message_fold(), "messages")).select(
        "conversation_id", "provider_message_id", "turn", "direction")


@query("conversation_state_stream", messaging_q.STATE)
def _(fx):
    f = folded(fx, fx("wa_delivery"), M.conversation_fold(), "conversations")
    return M.conversation_state(fx("wa_conversation"), f, folded=True)


@query("delivery_status_stream", messaging_q.DELIVERY)
def _(fx):
    f = folded(fx, doubled(fx.sql(messaging_q.ACKS), "ack = 2"), M.delivery_fold(), "acks")
    return M.delivery_status(messaging_q.pending(fx), f, folded=True).drop("org_id")


@query("session_status_stream", messaging_q.SESSIONS)
def _(fx):
    f = folded(fx, fx.sql(messaging_q.SESSION_EVENTS), M.session_fold(), "sessions")
    return M.session_status(fx("wa_account"), f, folded=True)


@query("outreach_contact_state_stream", outreach_q.STATE)
def _(fx):
    f = folded(fx, doubled(fx("outreach_event"), "type = 'email_replied'"), O.contact_fold(), "contacts")
    return O.outreach_contact_state(fx("outreach_contact"), f, folded=True)


@query("first_open_stream", outreach_q.FIRST_OPEN)
def _(fx):
    m = fx("outreach_message").select("tracking_token", "contact_id", F.col("id").alias("message_id"))
    opens = replay(fx, fx.sql(outreach_q.OPENS), "opens").join(m, "tracking_token")
    log, fold = new_dir(fx.spark, "fold-opens"), O.open_fold()
    A.fold_stream(opens, fold, new_dir(fx.spark, "ck-opens"), log).awaitTermination()
    return O.first_open(A.read_fold(fx.spark, log, fold), fx("outreach_message"), fx("outreach_contact"), folded=True)


def rate_stream(fx, account, cfg: RateConfig):
    """Sends in no order of time; the watermark waits for the whole log, a last send beyond it lets all others out."""
    sends = fx.sql(outreach_q.SENDS).withColumn("account_id", account)
    end = sends.limit(1).withColumns({"send_id": F.lit(-1).cast("long"), "sent_at": F.lit("2100-01-01 00:00:00").cast("timestamp_ntz")})
    path = stage(sends, "sends")
    end.write.mode("append").parquet(path)
    counts = []
    for key in ["account_id"] + ["recipient_id"] * (cfg.recipient_daily is not None):
        out, stream = new_dir(fx.spark, f"counts-{key}"), R.read_stream(fx.spark, path, ddl(sends), files=4)
        rows = L.running_counts(stream, key, cfg.zone, "20000 days")
        A.write_rows(rows, new_dir(fx.spark, "ck-counts"), out).awaitTermination()
        counts.append(fx.spark.read.schema(rows.schema).parquet(out))
    return L.audited(sends, counts[0], counts[1] if len(counts) > 1 else None, cfg).drop("recipient_id", "sent_at")


@query("email_rate_audit_stream", outreach_q.audit_sql(EMAIL, "recipient_id"))
def _(fx):
    return rate_stream(fx, F.col("recipient_id"), EMAIL)


@query("wa_rate_audit_stream", outreach_q.audit_sql(MESSAGING, "recipient_id % 40"))
def _(fx):
    return rate_stream(fx, F.col("recipient_id") % 40, MESSAGING)


def mailbox(fx):
    """Changes in no order, some of them in two files, past stored cursors."""
    changes, cursors = doubled(fx.sql(sources_q.MAILBOX), "history_id % 3 = 0"), fx.sql(sources_q.CURSORS)
    path = new_dir(fx.spark, "mailbox")
    A.mailbox_stream(replay(fx, changes, "mailbox"), cursors, new_dir(fx.spark, "ck-mailbox"), path).awaitTermination()
    return A.read_mailbox(fx.spark, cursors, path)


@query("mailbox_increment_stream", sources_q.MAILBOX_MESSAGES)
def _(fx):
    return mailbox(fx)[0]


@query("mailbox_cursors_stream", sources_q.MAILBOX_CURSORS)
def _(fx):
    return mailbox(fx)[1]

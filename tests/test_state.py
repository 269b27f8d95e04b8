"""Stored rows under batches: statuses rise, what a batch does not say stays, batches may be split."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from leadlake.operators import messaging as M
from leadlake.operators import outreach as O
from leadlake.operators import state as S

NOW, OLD = dt.datetime(2024, 1, 2), dt.datetime(2023, 1, 1)
MESSAGE = "id long, campaign_contact_id long, campaign_id long, conversation_id long, step_index int, status string, provider_message_id string, sent_at timestamp_ntz, error string, failed_at timestamp_ntz"
RESULT = "message_id long, ok boolean, provider_message_id string, error string, happened_at timestamp_ntz"
CONTACT = "id long, campaign_id long, prospect_id long, status string, cancel_reason string, last_sent_at timestamp_ntz"


def rows(df, *cols):
    return {r[0]: tuple(r[1:]) for r in df.select(*cols).collect()}


@pytest.mark.parametrize("ladder", [S.MESSAGE, S.SEQUENCE, S.MAIL, S.OUTREACH])
def test_ladders(spark, ladder):
    names = [n for rung in ladder.rungs for n in rung] + [None, "ODD"]
    pairs = spark.createDataFrame([(a, b) for a in names for b in names], "a string, b string")
    rung = {n: i for i, r in enumerate(ladder.rungs) for n in r}
    for r in pairs.withColumn("ok", ladder.allows(F.col("a"), F.col("b"))).collect():
        want = r.b is not None and r.a not in ladder.rungs[-1] and rung.get(r.b, -1) >= rung.get(r.a, -1)
        assert r.ok == want, r


def test_sends_keep_what_is_stored(spark):
    messages = spark.createDataFrame([(1, 1, 1, 1, 0, "SENT", "p1", OLD, None, None), (2, 2, 1, 1, 0, "PENDING", None, None, None, None),
                                      (3, 3, 1, 2, 1, "FAILED", None, None, "old", OLD), (4, 4, 1, 3, 0, "READ", "p4", OLD, None, None)], MESSAGE)
    contacts = spark.createDataFrame([(1, 1, 1, "SENT", None, OLD), (2, 1, 2, "REPLIED", "replied", OLD), (3, 1, 3, "QUEUED", None, None), (4, 1, 4, "SENT", None, OLD)], CONTACT)
    talks = spark.createDataFrame([(1, OLD), (2, OLD), (3, OLD)], "id long, last_message_at timestamp_ntz")
    steps = spark.createDataFrame([(1, 0, 5, "a"), (1, 1, 5, "b")], "campaign_id long, order_index int, delay_minutes int, message_template string")
    results = spark.createDataFrame([(2, True, "p2", None, NOW), (2, True, "again", None, NOW + dt.timedelta(1)), (3, True, "p3", None, NOW),
                                     (4, False, None, "late", NOW), (4, True, "other", None, NOW), (9, True, "x", None, NOW)], RESULT)
    out = M.wa_send_apply(results, messages, contacts, talks, steps)
    assert rows(out["messages"], "id", "status", "provider_message_id", "sent_at", "error", "failed_at") == {
        1: ("SENT", "p1", OLD, None, None), 2: ("SENT", "p2", NOW, None, None), 3: ("SENT", "p3", NOW, None, OLD), 4: ("READ", "p4", OLD, None, None)}
    assert rows(out["contacts"], "id", "status", "cancel_reason", "last_sent_at") == {
        1: ("SENT", None, OLD), 2: ("REPLIED", "replied", NOW), 3: ("COMPLETED", None, NOW), 4: ("SENT", None, OLD)}
    assert rows(out["conversations"], "id", "last_message_at") == {1: (NOW,), 2: (NOW,), 3: (OLD,)}
    assert rows(out["next_steps"], "contact_id", "complete") == {2: (False,), 3: (True,)}


def test_acknowledgements_only_raise(spark):
    shape = "org_id string, provider_message_id string, direction string, status string, sent_at long, delivered_at long, read_at long"
    stored = spark.createDataFrame([("a", "1", "OUTBOUND", "READ", 1, 2, 3), ("a", "2", "OUTBOUND", "DELIVERED", 5, 6, None), ("a", None, "OUTBOUND", "PENDING", None, None, None),
                                    ("a", "3", "OUTBOUND", "PENDING", None, None, None), ("a", "4", "INBOUND", "READ", None, None, None)], shape)
    acks = spark.createDataFrame([("a", "1", 1, 9), ("a", "2", 3, 9), ("a", "3", 0, 9), ("a", None, 3, 9)], "org_id string, provider_message_id string, ack int, happened_at long")
    got = rows(M.delivery_status(stored, acks), "provider_message_id", "status", "sent_at", "delivered_at", "read_at")
    assert got == {"1": ("READ", 1, 2, 3), "2": ("READ", 5, 6, 9), None: ("PENDING", None, None, None), "3": ("PENDING", None, None, None), "4": ("READ", None, None, None)}
    echoes = spark.createDataFrame([("s", str(i), 7) for i in range(5)], "session string, provider_message_id string, happened_at long")
    accounts = spark.createDataFrame([("s", "a")], "session_name string, org_id string")
    got = rows(M.echo_match(stored, echoes, accounts), "provider_message_id", "status", "sent_at")
    assert got == {"1": ("READ", 1), "2": ("DELIVERED", 5), "3": ("SENT", 7), None: ("PENDING", None), "4": ("READ", None)}


def test_stops_keep_other_reasons(spark):
    contacts = spark.createDataFrame([(1, 1, 1, "SENT", None, OLD), (2, 1, 2, "CANCELLED", "no_phone", None), (3, 2, 3, "OPTED_OUT", "opted_out", OLD),
                                      (4, 2, None, "QUEUED", None, None), (5, 2, 5, "REPLIED", "replied", OLD)], CONTACT)
    hand = spark.createDataFrame([(1,), (3,), (None,)], "prospect_id long")
    assert rows(M.automation_stop(hand, contacts), "id", "status", "cancel_reason") == {
        1: ("REPLIED", "replied"), 2: ("CANCELLED", "no_phone"), 3: ("OPTED_OUT", "opted_out"), 4: ("QUEUED", None), 5: ("REPLIED", "replied")}
    state = spark.createDataFrame([], "prospect_id long, channel string, status string")
    after = M.do_not_contact(hand, state, contacts)["contacts"]
    assert rows(after, "id", "status", "cancel_reason") == {
        1: ("CANCELLED", "do_not_contact"), 2: ("CANCELLED", "no_phone"), 3: ("CANCELLED", "do_not_contact"), 4: ("QUEUED", None), 5: ("REPLIED", "replied")}


def test_mail_results_and_replies(spark):
    contact = "id long, prospect_id long, campaign_id long, outreach_sequence int, status string, reply_count int, last_reply_at timestamp_ntz, cancel_reason string, sent_at timestamp_ntz"
    contacts = spark.createDataFrame([(1, 1, 1, 1, "REPLIED", 2, OLD, "replied", OLD), (2, 2, 1, 1, "SCHEDULED", None, None, None, None), (3, 3, 1, 1, "OPENED_INFERRED", 0, None, "x", OLD)], contact)
    mail = "id long, contact_id long, created_at timestamp_ntz, status string, provider_message_id string, thread_id string, sent_at timestamp_ntz"
    mails = spark.createDataFrame([(1, 1, OLD, "SENT", "g1", "t1", OLD), (2, 2, OLD, "SCHEDULED", None, None, None), (3, 1, OLD, "SCHEDULED", None, None, None)], mail)
    results = spark.createDataFrame([(1, "again", "t9", NOW), (2, "g2", "t2", NOW), (2, "g2b", "t2b", NOW + dt.timedelta(1)), (3, "g3", None, NOW)],
                                    "message_id long, provider_message_id string, thread_id string, sent_at timestamp_ntz")
    out = O.email_send_apply(results, mails, contacts)
    assert rows(out["messages"], "id", "status", "provider_message_id", "thread_id", "sent_at") == {
        1: ("SENT", "g1", "t1", OLD), 2: ("SENT", "g2", "t2", NOW), 3: ("SENT", "g3", None, NOW)}
    assert rows(out["contacts"], "id", "status", "sent_at") == {1: ("REPLIED", NOW), 2: ("SENT", NOW), 3: ("OPENED_INFERRED", OLD)}
    assert out["events"].count() == 4 and [r.contact_id for r in out["followups"].collect()] == [2]
    again = O.email_send_apply(results, out["messages"], out["contacts"])
    assert again["events"].count() == 0 and rows(again["contacts"], "id", "status", "sent_at") == rows(out["contacts"], "id", "status", "sent_at")
    replies = spark.createDataFrame([(1, 7, "t", NOW), (3, 8, "t", NOW), (3, 9, "u", NOW)], "contact_id long, reply_id long, thread_id string, replied_at timestamp_ntz")
    got = O.reply_apply(replies, contacts, mails)
    assert rows(got["contacts"], "id", "status", "reply_count", "last_reply_at", "cancel_reason") == {
        1: ("REPLIED", 2, OLD, "replied"), 2: ("SCHEDULED", 0, None, None), 3: ("REPLIED", 1, NOW, "replied")}
    assert [r.contact_id for r in got["events"].collect()] == [3]

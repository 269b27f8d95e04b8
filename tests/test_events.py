"""Message events: first contact, handoff, opt-out, redelivery, tenants."""

from pyspark.sql import functions as F

from leadlake.operators import messaging as M
from leadlake.sources import payloads as P

MSG = "conversation_id int, sent_epoch long, turn int, direction string, sent_by string, content string"
CONV = "id int, org_id string, prospect_id int, status string"


def state(spark, conversations, messages):
    c, m = spark.createDataFrame(conversations, CONV), spark.createDataFrame(messages, MSG)
    return {r["conversation_id"]: r for r in M.conversation_state(c, m).collect()}


def test_states(spark):
    convs = [(1, "a", 7, "ACTIVE"), (2, "a", 7, "ACTIVE"), (3, "a", 7, "ACTIVE"), (4, "a", None, "ACTIVE"), (5, "b", 7, "CLOSED"),
             (6, "b", 7, "CLOSED"), (7, "b", 7, "ACTIVE"), (8, "b", 7, "ACTIVE")]
    msgs = [
        (1, 10, 0, "INBOUND", None, "oi"),
        (2, 10, 0, "OUTBOUND", None, "x"), (2, 20, 1, "INBOUND", None, "oi"),
        (3, 10, 0, "OUTBOUND", None, "x"), (3, 20, 1, "INBOUND", None, "SAIR"),
        (4, 10, 0, "OUTBOUND", None, "x"), (4, 20, 1, "INBOUND", None, "oi"),
        (5, 10, 0, "INBOUND", None, "oi"),
        (7, 10, 0, "OUTBOUND", None, "x"), (7, 20, 1, "INBOUND", None, "oi"), (7, 30, 2, "OUTBOUND", "ana", "y"),
        (8, 10, 0, "OUTBOUND", None, "x"), (8, 20, 1, "INBOUND", None, "sair"), (8, 30, 2, "INBOUND", None, "mudei de ideia"),
    ]
    got = state(spark, convs, msgs + msgs[2:5])
    assert {k: r["status"] for k, r in got.items()} == {
        1: "ACTIVE", 2: "HUMAN_HANDOFF", 3: "OPTED_OUT", 4: "ACTIVE", 5: "ACTIVE", 6: "CLOSED", 7: "ACTIVE", 8: "HUMAN_HANDOFF"}
    assert got[7]["assigned_to"] == "ana" and got[7]["last_inbound_epoch"] == 20 and got[7]["last_message_epoch"] == 30


def test_fold_merges_like_one_pass(spark):
    rows = [(i % 5, (i * 37) % 101, i, "INBOUND" if i % 3 else "OUTBOUND", "bob" if i % 7 == 0 else None, "sair" if i % 11 == 0 else "oi") for i in range(200)]
    m = spark.createDataFrame(rows, MSG)
    f = M.conversation_fold()
    parts = None
    for cond in ("turn % 3 = 0", "turn % 3 = 1", "turn % 3 >= 1"):
        p = f.partial(m.filter(cond))
        parts = p if parts is None else parts.unionByName(p)
    assert sorted(map(str, f.merge(parts).collect())) == sorted(map(str, f.partial(m).collect()))


def test_unknown_session_and_tenants(spark):
    raw = spark.createDataFrame([(1, '{"event":"message","session":"s1","payload":{"id":"m","from":"5511987654321@c.us","body":"x"}}'),
                                 (2, '{"event":"message","session":"nobody","payload":{"id":"n"}}')], "event_id int, body string")
    accounts = spark.createDataFrame([(1, "a", "s1"), (2, "b", "s2")], "id int, org_id string, session_name string")
    routed = P.route_events(P.parse_wa_events(raw), accounts).collect()
    assert [(r["event_id"], r["org_id"], r["route"]) for r in routed] == [(1, "a", "message")]


def test_opt_out_cascade(spark):
    optouts = spark.createDataFrame([("a", "5511987654321", 7)], "org_id string, phone string, prospect_id int")
    st = spark.createDataFrame([], "prospect_id int, channel string, status string")
    conv = spark.createDataFrame([(1, "a", "5511987654321", "ACTIVE")], "id int, org_id string, phone_number string, status string")
    contacts = spark.createDataFrame([(1, 7, "5511987654321", "SENT"), (2, 7, "5511987654321", "COMPLETED"), (3, 8, None, "SENT")],
                                     "id int, prospect_id int, phone_number string, status string")
    out = M.optout_propagate(optouts, st, conv, contacts)
    assert [tuple(r) for r in out["state"].collect()] == [(7, "whatsapp", "opted_out")]
    assert out["conversations"].first()["status"] == "OPTED_OUT"
    assert {r["id"]: r["status"] for r in out["contacts"].collect()} == {1: "OPTED_OUT", 2: "COMPLETED", 3: "SENT"}


def test_redelivery(spark):
    m = spark.createDataFrame([(1, "p", 5, 0), (1, "p", 5, 0), (1, None, 6, 1), (1, None, 6, 1)],
                              "conversation_id int, provider_message_id string, sent_epoch long, turn int")
    assert M.message_dedupe(m).count() == 3


def test_delivery_never_goes_back(spark):
    m = spark.createDataFrame([("a", "p", "PENDING")], "org_id string, provider_message_id string, status string")
    acks = spark.createDataFrame([("a", "p", 3, 30), ("a", "p", 1, 40), ("a", "p", 2, 20)], "org_id string, provider_message_id string, ack int, happened_at int")
    r = M.delivery_status(m, acks).first()
    assert (r["status"], r["sent_at"], r["delivered_at"], r["read_at"]) == ("READ", 20, 20, 30)


def test_every_due_step_has_one_outcome(spark):
    from leadlake.catalog.fixtures import Fixtures
    from leadlake.catalog.messaging_q import DUE, decided

    fx = Fixtures(spark, "/root/testdata/sf0.001")
    d = decided(fx)
    assert d.count() == fx.sql(DUE).count() and d.filter(F.col("outcome").isNull()).count() == 0

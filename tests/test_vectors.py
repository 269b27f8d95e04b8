"""Documented inputs and outcomes."""

from pyspark.sql import functions as F

from leadlake.functions.columns import chat_id, cnpj_format, is_opt_out, name_uuid, phone_normalise, phone_of_chat, short_key
from leadlake.operators import analytics, intake, messaging, scoring
from leadlake.sources import payloads


def one(spark, column, value, ddl="v string"):
    return spark.createDataFrame([(value,)], ddl).select(column("v")).first()[0]


def test_phones(spark):
    for raw in ("(11) 98765-4321", "11 98765 4321", "+55 11 98765-4321", "5511987654321"):
        assert one(spark, phone_normalise, raw) == "5511987654321"
    assert one(spark, phone_normalise, "") is None and one(spark, phone_normalise, None) is None
    assert one(spark, chat_id, "(11) 98765-4321") == "5511987654321@c.us"
    assert one(spark, phone_of_chat, "5511987654321@c.us") == "5511987654321"


def test_opt_out(spark):
    yes = ["STOP", "sair", "NAO QUERO", "não quero mais", "PARAR", "cancelar", "Por favor, STOP", " sair! "]
    no = ["Olá, podemos conversar?", "quero falar sobre a proposta", "", None, "STOP, agora"]
    for text in yes:
        assert one(spark, is_opt_out, text) is True, text
    for text in no:
        assert one(spark, is_opt_out, text) is False, text


def test_template_is_clean(spark):
    lead = spark.createDataFrame(
        [(1, "Acme\nLtda", None, "São\tPaulo", "Tech $1", "Ana Maria\n Souza", None)],
        "campaign_id int, company_name string, trade_name string, city string, industry string, partner_name string, partner_role string")
    tpl = spark.createDataFrame(
        [(1, "Oi {{firstName}}, da {{ companyName }} em {{city}} {{industry}} {{jobTitle}}{{other.x}}")], "campaign_id int, message_template string")
    out = messaging.template_render(lead, tpl, ["campaign_id"]).first()["content"]
    assert out == "Oi Ana, da AcmeLtda em SãoPaulo Tech $1"


def test_keys(spark):
    row = spark.createDataFrame([("c", "p", 1)], "a string, b string, c int")
    same, other = row.select(short_key("a", "b", "c"), short_key("a", "b", F.lit(2))).first()
    assert len(same) == 32 and same != other
    import uuid

    from leadlake.functions.fixed import COMPANY_ID_NAMESPACE
    for name in ("12345678000199", "00000000000001", "x"):
        assert one(spark, name_uuid, name) == str(uuid.uuid5(uuid.UUID(COMPANY_ID_NAMESPACE), name))
    assert one(spark, cnpj_format, "12345678000199") == "12.345.678/0001-99"


def test_forecast_and_rates(spark):
    rows = [("o", i, "qualified" if i < 3 else "lead", 80) for i in range(4)]
    p = spark.createDataFrame(rows, "org_id string, id int, status string, opportunity_score int")
    f = analytics.revenue_forecast_compounded(p).first()
    assert (f["this_month"], f["next_month"], f["quarter"]) == (45000, 51750, 129375)
    s = analytics.pipeline_summary(p).first()
    assert s["qualification_rate"] == 0.75 and s["qualification_pct"] == 75 and s["closure_pct"] == 64


def test_contactable(spark):
    leads = spark.createDataFrame([(1,), (2,), (3,)], "id int")
    state = spark.createDataFrame([(1, "whatsapp", "do_not_contact"), (3, "email", "opted_out")], "prospect_id int, channel string, status string")
    got = {r["id"]: r["contactable"] for r in messaging.contactable(leads, state).collect()}
    assert got == {1: False, 2: True, 3: True}


def test_credit_risk_future_opening(spark):
    p = spark.sql("""SELECT 1 AS id, 100 AS opportunity_score, 600 AS employees, 6000000L AS revenue_estimate, DATE '2030-01-01' AS cnpj_opened_at,
      'enriched' AS enrichment_status, 'a@b.co' AS cnpj_email, true AS has_phone""")
    r = scoring.credit_risk_score(p, "2025-01-01").first()
    assert r["risk_score"] == 100 and r["risk_level"] == "low" and r["age_tenths"] is None and "company_recent" in r["factors"]


def test_location_parse(spark):
    rows = [("São Paulo (sp)",), ("São Paulo, SP",), ("SP",), ("Recife",), (None,)]
    got = [tuple(r)[1:] for r in intake.location_parse(spark.createDataFrame(rows, "location string").coalesce(1)).collect()]
    assert got == [("São Paulo", "SP"), ("São Paulo", "SP"), (None, "SP"), ("Recife", None), (None, None)]


def test_tool_response(spark):
    bodies = [
        ('event: x\ndata: nope\ndata: {"result":{"structuredContent":{"result":[1]}}}', "[1]"),
        ('{"structuredContent":{"total":3}}', '{"total":3}'),
        ('{"content":[{"type":"text","text":"hi"}]}', "hi"),
        ("garbage", None),
    ]
    raw = spark.createDataFrame([(i, b) for i, (b, _) in enumerate(bodies)], "i int, body string")
    got = {r["i"]: r["result"] for r in payloads.unwrap_tool_response(raw).collect()}
    assert got == {i: w for i, (_, w) in enumerate(bodies)}

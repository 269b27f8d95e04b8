"""Rules that the fixtures' tables do not reach."""

import datetime as dt

from pyspark.sql import functions as F

from leadlake.operators import discovery, enrich, rates


def sends(spark, rows):
    return spark.createDataFrame(rows, "send_id long, account_id string, recipient_id string, sent_at timestamp")


def test_sends_without_recipient_stay(spark):
    at = dt.datetime(2018, 3, 5, 12)
    rows = [(i, "a", None if i % 2 else f"r{i % 4}", at + dt.timedelta(minutes=i)) for i in range(41)]
    got = {r.send_id: r for r in rates.wa_rate_audit(sends(spark, rows)).collect()}
    assert len(got) == 41 and all(got[i].recipient_today == 0 for i in range(1, 41, 2)) and got[40].recipient_today == 10


def test_counts_at_a_clock_change(spark):
    """The local day of the clock change has 25 hours."""
    at = dt.datetime(2018, 2, 17, 0)
    rows = [(i, "a", f"r{i % 3}", at + dt.timedelta(minutes=6 * i)) for i in range(500)]
    days = {r.send_id: r.day for r in sends(spark, rows).select("send_id", F.to_date(F.from_utc_timestamp("sent_at", rates.MESSAGING.zone)).alias("day")).collect()}
    for r in rates.rate_audit(sends(spark, rows), rates.MESSAGING).collect():
        assert r.sent_today == sum(days[j] == days[r.send_id] for j in range(r.send_id)) and r.sent_last_hour == min(r.send_id, 10)


def test_results_already_seen_do_not_count(spark):
    leads = spark.createDataFrame([("p", "00000000000001", "enriched", 50, 3), ("q", "00000000000001", "pending", 10, 0)],
                                  "id string, cnpj string, enrichment_status string, opportunity_score int, enrichment_version int")
    at = dt.datetime(2020, 1, 1)
    results = spark.createDataFrame([("00000000000001", 2, "COMPLETED", 80, at, "e1"), ("00000000000001", 4, "PARTIAL", None, at, "e2")],
                                    "cnpj string, enrichment_version int, status string, commercial_potential int, event_ts timestamp, event_id string")
    got = {r.id: r for r in enrich.enrichment_apply(leads, results).collect()}
    assert (got["p"].opportunity_score, got["p"].enrichment_version, got["p"].enrichment_status) == (50, 4, "partial")
    assert (got["q"].opportunity_score, got["q"].enrichment_version) == (80, 4)


def registry(spark, rows):
    return spark.createDataFrame(rows, "cnpj string, legal_name string, trade_name string, cnae string, cnae_description string, city string, state string, "
                                       "email string, is_active boolean, registration_status string")


def test_registry_rows_without_a_key_match_nothing(spark):
    firms = registry(spark, [(k, n, None, "1", "d", "c", "s", None, True, None) for k, n in
                             [("", "blank"), ("12", "short"), ("00000000000001", "B"), ("00.000.000/0000-01", "A")]])
    leads = spark.createDataFrame([("p", ""), ("q", "00000000000001")], "id string, cnpj string").selectExpr(
        "*", "'x' AS company_name", "'x' AS trade_name", "'x' AS industry", "'x' AS city", "'x' AS state", "'x' AS cnpj_email",
        "'pending' AS enrichment_status", "cast(null AS timestamp_ntz) AS enriched_at")
    got = {r.id: r.company_name for r in enrich.enrich_registry_overwrite(leads, firms, "2020-01-01").collect()}
    assert got == {"p": "x", "q": "A"} and enrich.hydrate_firmographics(leads, firms).count() == 2


def test_discovery_has_no_limit_of_its_own(spark):
    firms = registry(spark, [(f"{i:014d}", "n", None, "77", "d", "c", "s", None, True, None) for i in range(150)])
    profiles = spark.createDataFrame([("o", ["x", "y", "z", "u", "v", "w", "77"], [], [], ["active"])],
                                     "org_id string, target_cnaes array<string>, target_segments array<string>, target_locations array<string>, company_statuses array<string>")
    known = spark.createDataFrame([("o", f"{i:014d}") for i in range(20)], "org_id string, cnpj string")
    find = discovery.discovery_candidates
    assert find(profiles, firms, known).count() == 130
    assert {r.cnpj for r in find(profiles, firms, known, per_tenant=5).collect()} == {f"{i:014d}" for i in range(20, 25)}
    wanted = spark.createDataFrame([("o", "0000000000014"), ("o", "00000000000145"), ("other", "1")], "org_id string, cnpj string")
    got = find(profiles, firms, known, wanted)
    assert got.count() == got.select("org_id", "cnpj").distinct().count() == 10

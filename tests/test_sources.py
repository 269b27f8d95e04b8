"""Sinks, upserts and redaction invariants."""

import pytest
from pyspark.sql import functions as F

from leadlake.functions import fixed
from leadlake.operators import listing, quality
from leadlake.sources import csv_sink, tables
from leadlake.sources.upsert import bulk_delete, bulk_move, upsert

T = "k int, a string, b int"


def test_upsert_modes(spark):
    t = spark.createDataFrame([(1, "x", 1), (2, "", None), (3, "z", 3)], T)
    u = spark.createDataFrame([(1, "", 9), (2, "n", 8), (4, "q", 4)], T)
    want = {
        "overwrite": {1: ("", 9), 2: ("n", 8), 3: ("z", 3), 4: ("q", 4)},
        "non_null_overwrite": {1: ("x", 9), 2: ("n", 8), 3: ("z", 3), 4: ("q", 4)},
        "fill_missing": {1: ("x", 1), 2: ("n", 8), 3: ("z", 3), 4: ("q", 4)},
        "keep_first": {1: ("x", 1), 2: ("", None), 3: ("z", 3), 4: ("q", 4)},
    }
    for mode, rows in want.items():
        out = upsert(t, u, ["k"], None, mode)
        assert {r["k"]: (r["a"], r["b"]) for r in out.collect()} == rows, mode
        assert quality.unique_key_audit(out, ["k"]).count() == 0
    with pytest.raises(ValueError):
        upsert(t, u, ["k"], None, "nope")


def test_bulk(spark):
    p = spark.createDataFrame([("a", 1, "lead"), ("b", 2, "lead")], "org_id string, id int, status string")
    ids = spark.createDataFrame([("a", 1), ("a", 2)], "org_id string, id int")
    moved, counts = bulk_move(p, ids, "closed")
    assert {r["id"]: r["status"] for r in moved.collect()} == {1: "closed", 2: "lead"} and counts.first()["affected"] == 1
    left, gone = bulk_delete(p, ids)
    assert left.count() == 1 and gone.count() == 1
    with pytest.raises(ValueError):
        bulk_move(p, ids, "lost")


def test_csv_quotes_and_nulls(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a,b "q"', None)], "i int, t string, n string")
    csv_sink.write_csv(df.coalesce(1), str(tmp_path / "c"))
    text = "".join(p.read_text() for p in (tmp_path / "c").glob("part-*"))
    assert text.splitlines() == ["i,t,n", '1,"a,b ""q""",']


def test_redaction_leaks_nothing(spark):
    cols = fixed.RESTRICTED_FIELDS
    df = spark.createDataFrame([("free",) + ("s",) * len(cols), ("none",) + ("s",) * len(cols), ("paid",) + ("s",) * len(cols)],
                               "org_id string, " + ", ".join(f"{c} string" for c in cols))
    orgs = spark.createDataFrame([("free", "trial"), ("paid", "premium")], "id string, plan string")
    for r in listing.plan_redact(df, orgs).collect():
        assert r["data_restricted"] == (r["org_id"] != "paid")
        assert all((r[c] == "s") == (r["org_id"] == "paid") for c in cols)


def test_tables_round_trip(spark, tmp_path):
    p = spark.createDataFrame([("1", "9", "Acme")], "id string, cnpj string, company_name string")
    tables.save(p, str(tmp_path), "prospect")
    back = tables.load(spark, str(tmp_path), ["prospect"])["prospect"]
    assert back.first()["company_name"] == "Acme" and dict(back.dtypes)["cnpj_phones"] == "array<string>"


def test_enum_audit_counts_nulls(spark):
    df = spark.createDataFrame([("lead",), ("odd",), (None,)], "status string")
    assert {r["status"]: r["rows"] for r in quality.enum_audit(df, "status", ["lead"]).collect()} == {"odd": 1, None: 1}
    assert df.filter(F.col("status") == "lead").count() == 1

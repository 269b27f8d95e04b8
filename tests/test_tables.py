"""Stored tables by tenant bucket: folded updates, and files that stay."""

import os

import pytest

from leadlake.sources import upsert as U

SHAPE = "org_id string, id long, status string, name string"


def files(path):
    return {os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def rows(df):
    return sorted(map(tuple, df.select("org_id", "id", "status", "name").collect()))


@pytest.mark.parametrize("mode", U.MODES)
def test_repeated_keys(spark, mode):
    """Updates one after the other and folded have the same effect."""
    stored = spark.createDataFrame([("a", 1, "lead", None), ("a", 2, None, "x"), ("b", 1, "", "y")], SHAPE)
    news = [("a", 1, "p", "n1", 1), ("a", 1, None, "n2", 2), ("a", 1, "q", " ", 3), ("a", 2, None, None, 4), ("a", 2, "s", "z", 5), ("b", 1, "t", None, 6), ("c", 9, None, "new", 7), ("c", 9, "u", None, 8)]
    keys = ["org_id", "id"]
    one_by_one = stored
    for n in news:
        one_by_one = U.upsert(one_by_one, spark.createDataFrame([n[:4]], SHAPE), keys, mode=mode)
    updates = spark.createDataFrame(news, SHAPE + ", n int")
    folded = U.upsert(stored, U.fold_updates(updates, keys, ["n"], mode).drop("n"), keys, mode=mode)
    blank = lambda v: None if v is None or not str(v).strip() else v
    clean = lambda df: [tuple(map(blank, r)) for r in rows_any(df)]
    assert clean(folded) == clean(one_by_one)


def rows_any(df):
    return sorted(map(tuple, df.select("org_id", "id", "status", "name").collect()), key=str)


def test_untouched_files_stay(spark, tmp_path):
    path = str(tmp_path / "prospects")
    start = [(f"org_{i % 12}", i, "lead", f"n{i}") for i in range(600)]
    U.create_table(spark.createDataFrame(start, SHAPE), path, "org_id", 16)
    before = files(path)
    assert rows(U.read_table(spark, path)) == sorted(start)
    updates = spark.createDataFrame([("org_3", 3, "won", "m", 1), ("org_3", 3, "lost", "m", 2), ("org_3", 9000, "new", "k", 1)], SHAPE + ", n int")
    U.upsert_into(spark, path, updates, ["org_id", "id"], "org_id", ["n"], buckets=16)
    want = sorted([r for r in start if r[:2] != ("org_3", 3)] + [("org_3", 3, "lost", "m"), ("org_3", 9000, "new", "k")])
    assert rows(U.read_table(spark, path)) == want
    kept = before & files(path)
    changed = {f.split(U.BUCKET + "=")[1].split("/")[0] for f in before - kept}
    assert len(changed) == 1 and kept == {f for f in before if f"{U.BUCKET}={next(iter(changed))}/" not in f}
    U.move_in(spark, path, spark.createDataFrame([("org_5", 5), ("org_5", 17), ("org_4", 5)], "org_id string, id long"), "qualified", 16)
    want = sorted((o, i, "qualified" if (o, i) in (("org_5", 5), ("org_5", 17)) else s, n) for o, i, s, n in want)
    assert rows(U.read_table(spark, path)) == want
    gone = spark.createDataFrame([(o, i) for o, i, _, _ in want if o == "org_7"], "org_id string, id long")
    U.delete_from(spark, path, gone, "org_id", 16)
    assert rows(U.read_table(spark, path)) == [r for r in want if r[0] != "org_7"]


def test_tenant_joins_need_no_exchange(spark):
    from leadlake.catalog import QUERIES

    df = QUERIES["src_tables bucketed"](spark, "/root/testdata/sf0.001")
    text = df._jdf.queryExecution().executedPlan().toString()
    assert text.count("SortMergeJoin") == 2 and "Exchange" not in text and "Bucketed: true" in text


def test_one_bucket_is_read(spark, tmp_path):
    from leadlake.sources import tables as T

    auto = "spark.sql.sources.bucketing.autoBucketedScan.enabled"  # the plan names the buckets only without it
    spark.conf.set(auto, "false")
    try:
        rows = spark.createDataFrame([(f"org_{i % 5}", i, "x") for i in range(500)], "org_id string, id long, name string")
        held = T.save_bucketed(rows, str(tmp_path / "t"), "held_rows", ["id"], 16)
        again = T.open_bucketed(spark, rows, str(tmp_path / "t"), "held_again", ["id"], 16)
        for table in (held, again):
            one = table.filter("org_id = 'org_3' AND id = 33")
            assert "SelectedBucketsCount: 1 out of 16" in one._jdf.queryExecution().toString()
            assert [tuple(r) for r in one.collect()] == [("org_3", 33, "x")] and table.count() == 500
    finally:
        spark.conf.unset(auto)
        for name in ("held_rows", "held_again"):
            spark.sql(f"DROP TABLE IF EXISTS {name}")

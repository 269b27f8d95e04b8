"""Balanced building blocks against brute force, with crowded keys forced."""

import random

from pyspark.sql import functions as F

from leadlake.operators import rates
from leadlake.plans import balance as B
from leadlake.plans.textmatch import near_pairs, substring_pairs


def crowded(spark, n=3000):
    rng = random.Random(5)
    rows = [(0 if rng.random() < 0.34 else (None if rng.random() < 0.1 else rng.randrange(1, 40)), i, rng.randrange(0, 500)) for i in range(n)]
    return rows, spark.createDataFrame(rows, "k int, id int, v int")


def test_spread_join_and_totals(spark):
    rows, df = crowded(spark)
    right = spark.range(0, 45).select(F.col("id").cast("int").alias("k"), F.concat(F.lit("n"), "id").alias("name"))
    counts = df.groupBy("k").agg(F.count(F.lit(1)).alias("__n"))
    for how in ("left", "inner"):
        got = B._spread_join(df, right, ["k"], how, counts, 100).select("k", "id", "v", "name").collect()
        want = [(k, i, v, None if k is None else f"n{k}") for k, i, v in rows if how == "left" or k is not None]
        assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    n = sum(k == 0 for k, _, _ in rows)
    salts = lambda counts, unit: B.hot_keys(counts, ["k"], unit).filter("k = 0").first()["__salts"]
    assert salts(counts, 100) == -(-n // 100)
    assert salts(counts.withColumn("__n", F.col("__n") * 2), 100) == -(-2 * n // 100)


def test_top_k_spread(spark):
    rows, df = crowded(spark)
    got = B.top_k(df, ["k"], [F.col("v").desc(), F.col("id")], 7, spread=True).collect()
    want = set()
    for key in {r[0] for r in rows}:
        best = sorted((r for r in rows if r[0] == key), key=lambda r: (-r[2], r[1]))[:7]
        want |= {(key, r[1], r[2], i + 1) for i, r in enumerate(best)}
    assert {tuple(r) for r in got} == want


def test_running_number_and_previous(spark):
    rows, df = crowded(spark)
    df, rows = df.dropna(), [r for r in rows if r[0] is not None]
    num = {(r["k"], r["id"]): r["n"] for r in B.running_number(df, ["k"], ["v", "id"], "n", F.floor(F.col("v") / 50)).collect()}
    prev = {(r["k"], r["id"]): r["p"] for r in B.previous_value(df, ["k"], ["v", "id"], "id", "p", F.floor(F.col("v") / 50)).collect()}
    for key in {r[0] for r in rows}:
        ordered = sorted((r for r in rows if r[0] == key), key=lambda r: (r[2], r[1]))
        for i, r in enumerate(ordered):
            assert num[(key, r[1])] == i + 1
            assert prev[(key, r[1])] == (ordered[i - 1][1] if i else None)


def test_running_before(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(3), rng.randrange(0, 4 * B.DAY) // 1000 * 1000, rng.choice([1, 2])) for _ in range(800)]
    rows += rows[:50]
    df = spark.createDataFrame(rows, "k int, t long, n int").withColumn("d", F.floor(F.col("t") / F.lit(B.DAY)).cast("long"))
    for r in B.running_before(df, ["k"], "t", "d", ["n"]).collect():
        earlier = [x for x in rows if x[0] == r["k"] and x[1] < r["t"]]
        assert r["n_before"] == sum(x[2] for x in earlier)
        assert r["n_in_scope"] == sum(x[2] for x in earlier if x[1] // B.DAY == r["d"])
        assert r["previous_at"] == max((x[1] for x in earlier), default=None)


def test_attach_rows(spark):
    parents = spark.createDataFrame([(1, "a"), (2, "b")], "k int, p string")
    children = spark.createDataFrame([(1, 10), (1, 11), (3, 12)], "k int, c int")
    got = sorted(map(str, (tuple(r) for r in B.attach_rows(parents, children, ["k"]).select("k", "p", "c").collect())))
    assert got == sorted(map(str, [(1, "a", 10), (1, "a", 11), (2, "b", None)]))


def test_substring_pairs(spark):
    rng = random.Random(1)
    word = lambda n: "".join(rng.choice("abc") for _ in range(n))
    texts = [(rng.randrange(2), i, word(rng.randrange(1, 9))) for i in range(200)]
    needles = [(rng.randrange(2), word(rng.randrange(1, 6))) for _ in range(60)] + [(0, "zzz")]
    got = substring_pairs(spark.createDataFrame(needles, "s int, q string"), "q", spark.createDataFrame(texts, "s int, id int, t string"), "t", ["s"], ["id"])
    want = {(s, q, i) for s, q in needles for s2, i, t in texts if s == s2 and q in t}
    rows = [tuple(r) for r in got.collect()]
    assert set(rows) == want and len(rows) == len(want)


def test_near_pairs(spark):
    def distance(a, b):
        prev = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            cur = [i]
            for j, y in enumerate(b, 1):
                cur.append(min(prev[j] + 1, cur[-1] + 1, prev[j - 1] + (x != y)))
            prev = cur
        return prev[-1]

    rng = random.Random(2)
    word = lambda n: "".join(rng.choice("abcd") for _ in range(n))
    names = [(i, word(rng.randrange(1, 11))) for i in range(150)]
    asked = sorted({word(rng.randrange(1, 11)) for _ in range(60)})
    limit = lambda q: 1 if len(q) <= 4 else 2 if len(q) <= 8 else 3
    got = near_pairs(spark.createDataFrame([(q, limit(q)) for q in asked], "q string, m int"), "q", "m",
                     spark.createDataFrame(names, "id int, name string"), "name", ["id"], 3)
    want = {(q, i, distance(q, n)) for q in asked for i, n in names if distance(q, n) <= limit(q)}
    assert {tuple(r) for r in got.collect()} == want


def test_rate_audit_against_plain_counts(spark):
    rng = random.Random(4)
    rows = [(i, 0 if rng.random() < 0.4 else None if rng.random() < 0.3 else rng.randrange(1, 6), rng.choice([None, *range(9)]), 1704067200 + rng.randrange(0, 3 * 86400))
            for i in range(900)]
    rows += [(900 + i, 0, 1, 1704067200 + 60 * i) for i in range(40)] + [(950 + i, None, 2, 1704067200) for i in range(5)]
    s = spark.createDataFrame(rows, "send_id int, account_id int, recipient_id int, e long").select(
        "send_id", "account_id", "recipient_id", F.timestamp_seconds("e").cast("timestamp_ntz").alias("sent_at"))
    got = {r.send_id: r for r in rates.rate_audit(s, rates.MESSAGING).collect()}
    assert len(got) == len(rows)
    day = lambda e: (e - 3 * 3600) // 86400
    for i, a, r, e in rows:
        before = [x for x in rows if x[1] == a and x[3] < e]
        assert got[i].sent_today == sum(day(x[3]) == day(e) for x in before)
        assert got[i].sent_last_hour == sum(x[3] >= e - 3600 for x in before)
        assert got[i].gap_ms == (1000 * (e - max(x[3] for x in before)) if before else None)
        assert got[i].recipient_today == (0 if r is None else sum(x[2] == r and x[3] < e and day(x[3]) == day(e) for x in rows))

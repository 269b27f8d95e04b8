"""Delivery budget, mailbox cursors and event-time repeats: replayed batches and slow replays change nothing."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from leadlake.streaming import appliers as A
from leadlake.streaming import delivery as D
from leadlake.streaming import readers as R

ROWS = "id long, body string"


def failing(rows):
    """Row i fails i times."""
    return rows.withColumn("error", F.when(F.col("attempt") <= F.col("id"), "no"))


@pytest.fixture
def by_hand(monkeypatch):
    """Appliers hand out their batch function instead of starting a query."""
    for module in (A, D):
        monkeypatch.setattr(module, "start", lambda stream, checkpoint, each: each)


def batch(spark, ids):
    return spark.createDataFrame([(i, f"b{i}") for i in ids], ROWS)


def state(spark, path):
    done, dead = D.delivered(spark, batch(spark, [1]).schema, path)
    return {(r.id, r.attempt) for r in done.collect()}, {(r.id, r.attempt, r.error) for r in dead.collect()}


def test_budget_and_replay(spark, tmp_path, by_hand):
    path, first = str(tmp_path / "ledger"), batch(spark, range(8))
    each = D.deliver(first, ["id"], failing, "", path)
    each(first, 0)
    assert state(spark, path) == ({(0, 1)}, set())
    for _ in range(2):  # the second time is a replay
        each(batch(spark, [20, 0]), 1)
        assert state(spark, path) == ({(0, 1), (1, 2)}, set())
    each(batch(spark, []), 2)
    each(batch(spark, [3, 3]), 3)  # comes again while it waits: its fourth delivery
    assert (3, 4) in state(spark, path)[0]
    for _ in range(2):
        D.redeliver(spark, first.schema, failing, path)
        done, dead = state(spark, path)
        assert done == {(0, 1), (1, 2), (2, 3), (3, 4), (4, 5)}
        assert dead == {(i, 5, "no") for i in (5, 6, 7, 20)}
    each(batch(spark, [1]), 4)
    each(batch(spark, []), 5)
    assert (1, 2) in state(spark, path)[0] and len(state(spark, path)[1]) == 4


def test_budget_as_a_stream(spark, tmp_path):
    source, path = str(tmp_path / "in"), str(tmp_path / "ledger")
    for i in range(8):
        batch(spark, [i]).coalesce(1).write.mode("append").parquet(source)
    stream = R.read_stream(spark, source, ROWS, files=3)
    for _ in range(2):  # a restart finds nothing to do
        D.deliver(stream, ["id"], failing, str(tmp_path / "ck"), path).awaitTermination()
        D.redeliver(spark, stream.schema, failing, path)
        assert state(spark, path) == ({(i, i + 1) for i in range(5)}, {(i, 5, "no") for i in (5, 6, 7)})


def change(account, history):
    return account, history, f'{{"added":[{{"message":{{"id":"m{history}"}}}}]}}'


def test_mailbox_replay_and_disorder(spark, tmp_path, by_hand):
    shape, path = "account_id long, history_id long, messages string", str(tmp_path / "mail")
    cursors = spark.createDataFrame([(1, 10), (2, None)], "account_id long, last_history_id long")
    frames = [spark.createDataFrame([change(*c) for c in rows], shape) for rows in
              ([(1, 9), (1, 10), (1, 15), (2, 1)], [(1, 12), (1, 15), (2, 1), (2, 2), (None, 4)], [(1, 12), (1, 13), (1, 13)])]
    each = A.mailbox_stream(frames[0], cursors, "", path)
    for n, df in enumerate(frames):
        for _ in range(2):
            each(df, n)
    each(frames[1], 1)
    messages, after = A.read_mailbox(spark, cursors, path)
    assert sorted((r.account_id, r.history_id) for r in messages.filter("account_id IS NOT NULL").collect()) == [(1, 12), (1, 13), (1, 15), (2, 1), (2, 2)]
    assert {r.account_id: r.last_history_id for r in after.collect() if r.account_id} == {1: 15, 2: 2}


REQUEST = "key long, at timestamp_ntz, note string"


def requests(spark, minutes):
    at = dt.datetime(2024, 1, 1)
    return spark.createDataFrame([(k, None if m is None else at + dt.timedelta(minutes=m), f"{k}-{m}") for k, m in minutes], REQUEST)


def once(spark, root, files, delay, parts):
    source = str(root / f"in-{files}-{delay}".replace(" ", ""))
    for p in parts:
        requests(spark, p).coalesce(1).write.mode("append").parquet(source)
    out = source.replace("in-", "out-")
    kept = A.dedupe_by_time(R.read_stream(spark, source, REQUEST, files=files), ["key"], "at", "2 MINUTES", delay)
    for _ in range(2):
        A.write_rows(kept, out.replace("out-", "ck-"), out).awaitTermination()
    return sorted((r.key, r.note) for r in spark.read.schema(kept.schema).parquet(out).collect() if r.key < 99)


def test_repeats_by_their_own_time(spark, tmp_path):
    parts = [[(1, 5), (2, 0)], [(1, 3), (2, 1.9), (3, 4)], [(1, 4), (2, 2), (2, 3.9), (1, 5), (4, None)], [(99, 10_000)]]
    want = [(1, "1-3"), (1, "1-5"), (2, "2-0"), (2, "2-2"), (3, "3-4")]
    assert once(spark, tmp_path, 1, "1 hour", parts) == want
    assert once(spark, tmp_path, 10, "1 hour", parts) == want


def test_late_repeats_are_dropped(spark, tmp_path):
    parts = [[(1, 5)], [(2, 500)], [(2, 501)], [(1, 4), (3, 499)], [(99, 10_000)]]
    assert once(spark, tmp_path, 1, "10 minutes", parts) == [(1, "1-5"), (2, "2-500"), (3, "3-499")]

"""Send counters of a stream: Python is called for groups of keys, and each send has the counts that one pass gives it."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest

from leadlake.operators.rates import HOUR
from leadlake.streaming import appliers as A
from leadlake.streaming import limits as L
from leadlake.streaming import readers as R
from leadlake.streaming import waiting as W

BASE = dt.datetime(2024, 1, 1)


@pytest.fixture
def groups(monkeypatch):
    """The expressions by which stateful functions are called; three groups at most."""
    from pyspark.sql.pandas.group_ops import PandasGroupedOpsMixin as Grouped

    seen, real = [], Grouped.applyInPandasWithState
    monkeypatch.setattr(W, "BUCKETS", 3)
    monkeypatch.setattr(Grouped, "applyInPandasWithState", lambda self, *a, **k: (seen.append(str(self._jgd)), real(self, *a, **k))[1])
    yield seen
    assert seen and all("bucket" in g for g in seen)


def one_pass(sends):
    """(id, today, last hour, previous) as the earlier sends of the key give them, days in the zone three hours behind."""
    day = lambda t: (t - dt.timedelta(hours=3)).date()
    out = []
    for i, k, t in sends:
        own = [u for _, m, u in sends if m == k and u < t]
        out.append((i, sum(day(u) == day(t) for u in own), sum(u >= t - dt.timedelta(hours=1) for u in own), max(own, default=None)))
    return sorted(out, key=str)


@pytest.mark.parametrize("delay", ["0 seconds", "20000 days"])
def test_counts_of_many_keys(spark, tmp_path, groups, delay):
    pick = np.random.default_rng(6)
    times = np.sort(pick.integers(0, 3 * 24 * 60, 300)) if delay == "0 seconds" else pick.integers(0, 3 * 24 * 60, 300)
    sends = [(i // 2 * 2 if i % 50 == 1 else i, [None, 1, 2, 3, 4, 5, 6][int(pick.integers(0, 7))], BASE + dt.timedelta(minutes=int(m))) for i, m in enumerate(times)]
    schema, path = "send_id long, account_id int, sent_at timestamp_ntz", str(tmp_path / "in")
    for k in range(0, 300, 60):  # files in order of time where the watermark does not wait; equal times stay in one file
        part = [s for s in sends if sends[k][2] <= s[2] and (k + 60 >= 300 or s[2] < sends[k + 60][2])] if delay == "0 seconds" else sends[k:k + 60]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
    spark.createDataFrame([(-1, 99, dt.datetime(2100, 1, 1))], schema).write.mode("append").parquet(path)
    rows = L.running_counts(R.read_stream(spark, path, schema, files=1), "account_id", "America/Sao_Paulo", delay)
    A.write_rows(rows, str(tmp_path / "ck"), str(tmp_path / "out")).awaitTermination()
    got = spark.read.schema(rows.schema).parquet(str(tmp_path / "out")).filter("send_id >= 0").collect()
    at = lambda x: None if x is None else dt.datetime(1970, 1, 1) + dt.timedelta(microseconds=x)
    assert sorted(((r.send_id, r.today, r.last_hour, at(r.previous)) for r in got), key=str) == one_pass(sends)


def test_counts_go_on_from_what_is_known():
    rows = pd.DataFrame([("=a", 5 * HOUR, 0, "2"), ("=a", 5 * HOUR, 0, "2"), ("=a", 30 * HOUR, 1, "3"), ("=b", 9 * HOUR, 0, "4")], columns=["key", "t", "day", "id"])
    out, after = L._counted(rows, {"=a": (0, 7, 5 * HOUR - 1, [4 * HOUR, 5 * HOUR - 1], [3, 1])})
    assert out.fillna(-1).values.tolist() == [["2", 7, 4, 5 * HOUR - 1], ["2", 7, 4, 5 * HOUR - 1], ["3", 0, 0, 5 * HOUR], ["4", 0, 0, -1]]
    assert after == {"=a": (1, 1, 30 * HOUR, [30 * HOUR], [1]), "=b": (0, 1, 9 * HOUR, [9 * HOUR], [1])}

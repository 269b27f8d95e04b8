"""Stateful streams call Python for groups of keys, not for each key, and answer as one pass in order of time does."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest

from leadlake.streaming import appliers as A
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


def staged(spark, root, rows, end, schema, files):
    path = str(root / "in")
    for part in [rows[k::files] for k in range(files)] + [[end]]:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
    return path


def test_repeats_of_many_keys(spark, tmp_path, groups):
    pick = np.random.default_rng(5)
    rows = [(int(k), BASE + dt.timedelta(seconds=int(s)), f"{i:03}") for i, (k, s) in enumerate(zip(pick.integers(0, 40, 400), pick.integers(0, 900, 400)))]
    path = staged(spark, tmp_path, rows, (99, BASE + dt.timedelta(days=9), "end"), "key int, at timestamp_ntz, note string", 4)
    kept = A.dedupe_by_time(R.read_stream(spark, path, "key int, at timestamp_ntz, note string", files=1), ["key"], "at", "2 MINUTES", "1 hour")
    for _ in range(2):
        A.write_rows(kept, str(tmp_path / "ck"), str(tmp_path / "out")).awaitTermination()
    want, opened = [], {}
    for k, t, note in sorted(rows):
        if k not in opened or t >= opened[k] + dt.timedelta(minutes=2):
            opened[k] = t
            want.append((k, note))
    got = spark.read.schema(kept.schema).parquet(str(tmp_path / "out")).filter("key < 99").collect()
    assert sorted((r.key, r.note) for r in got) == sorted(want)


def test_rows_wait_until_they_are_due():
    rows = lambda *t: [pd.DataFrame({"key": [str(x) for x in t], "t": t, "other": 0})]
    due, waiting, soonest = W.take_due(rows(5, 9), ["key", "t"], [], None, 5)
    assert due is None and len(waiting) == 1 and soonest == 5
    due, waiting, soonest = W.take_due(rows(7, 3), ["key", "t"], waiting, soonest, 3)
    assert due is None and len(waiting) == 2 and soonest == 3
    due, waiting, soonest = W.take_due([], ["key", "t"], waiting, soonest, 7)
    assert sorted(due["t"]) == [3, 5] and list(due.columns) == ["key", "t"] and soonest == 7
    due, waiting, soonest = W.take_due(rows(8), ["key", "t"], waiting, soonest, 10)
    assert sorted(due["t"]) == [7, 8, 9] and waiting == [] and soonest is None

"""Replay with duplicates and disorder; a restart changes nothing."""

import os

from pyspark.sql import functions as F

from leadlake.operators import messaging as M
from leadlake.streaming import appliers as A
from leadlake.streaming import readers as R

MSG = "conversation_id int, sent_epoch long, turn int, direction string, sent_by string, content string"


def staged(spark, root):
    rows = [(i % 4, 1000 + i, i, "OUTBOUND" if i % 3 == 0 else "INBOUND", None, "sair" if i == 17 else "oi") for i in range(40)]
    m = spark.createDataFrame(rows, MSG)
    path = os.path.join(root, "in")
    m.filter("turn >= 20").coalesce(1).write.mode("append").parquet(path)
    m.filter("turn >= 20 AND turn % 10 = 0").coalesce(1).write.mode("append").parquet(path)
    m.filter("turn < 20").coalesce(1).write.mode("append").parquet(path)
    return m, path


def test_fold_stream_equals_batch_and_restarts(spark, tmp_path):
    m, path = staged(spark, str(tmp_path))
    fold, log, ck = M.conversation_fold(), str(tmp_path / "log"), str(tmp_path / "ck")
    conv = m.select(F.col("conversation_id").alias("id")).distinct().select(
        "id", F.lit("a").alias("org_id"), F.col("id").alias("prospect_id"), F.lit("CLOSED").alias("status"))
    want = sorted(map(str, M.conversation_state(conv, m).collect()))
    for _ in range(2):
        A.fold_stream(R.read_stream(spark, path, MSG, files=1), fold, ck, log, every=2).awaitTermination()
        got = M.conversation_state(conv, A.read_fold(spark, log, fold), folded=True)
        assert sorted(map(str, got.collect())) == want
    assert len([d for d in os.listdir(log) if d.startswith(A.GENERATION)]) >= 2
    assert sorted(map(str, A.read_fold(spark, log, fold).collect())) == sorted(map(str, fold.partial(m).collect()))


def test_arrival_dedupe(spark, tmp_path):
    m, path = staged(spark, str(tmp_path))
    once = A.dedupe_stream(R.read_stream(spark, path, MSG, files=1), ["turn"], "2 minutes")
    out, ck = str(tmp_path / "out"), str(tmp_path / "ck")
    for _ in range(2):
        A.write_rows(once, ck, out).awaitTermination()
        assert spark.read.parquet(out).count() == m.count()

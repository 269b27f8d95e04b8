"""Toxic documents are dropped row by row."""

import random

from leadlake.llm import toxicity

PICK = random.Random(3)
CLEAN = [" ".join(PICK.choices([f"{a}{b}{c}" for a in "blmnst" for b in ("ane", "ori", "ul") for c in ("dic", "fen", "gam", "per")], k=16)) for _ in range(80)]
BAD = [" ".join(w for pair in zip(t.split(), ["zorgblat"] * 16) for w in pair) for t in CLEAN]


def test_rows_share_ids(spark):
    rows = [(i, t) for i, t in enumerate(CLEAN + BAD)] + [(None, CLEAN[0]), (None, BAD[0]), (900, CLEAN[1]), (900, BAD[1]), (None, None)]
    docs = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(i, 1, int(i >= len(CLEAN))) for i in range(len(CLEAN + BAD))], "doc_id long, quality int, toxic int")
    left = toxicity.drop_toxic(docs, labels)
    assert left.columns == docs.columns
    got = {(r.doc_id, r.text) for r in left.collect()}
    assert {(None, CLEAN[0]), (900, CLEAN[1]), (None, None)} <= got and not {t for _, t in got} & set(BAD)

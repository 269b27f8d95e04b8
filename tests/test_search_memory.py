"""A task of the vector search holds the products of a bounded number of queries, however many meet a block."""

import numpy as np

from leadlake.operators import vectors


def test_few_queries_meet_a_block_at_once(spark, monkeypatch):
    monkeypatch.setattr(vectors, "MEET", 4, raising=False)
    keep = vectors._keep

    def bounded(sims, keys, k):
        assert sims.shape[0] <= 4
        return keep(sims, keys, k)

    monkeypatch.setattr(vectors, "_keep", bounded)
    pick = np.random.default_rng(4)
    m = pick.normal(size=(60, 6))
    v = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(m)], "vec_id long, embedding array<double>")
    got = {(r.query_id, r["rank"]): r.vec_id for r in vectors.registry_search(v.withColumnRenamed("vec_id", "query_id"), v, 3).collect()}
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    best = np.argsort(-(m @ m.T), axis=1, kind="stable")[:, :3]
    assert got == {(q, n + 1): int(i) for q, row in enumerate(best) for n, i in enumerate(row)}

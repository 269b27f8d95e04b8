"""Searches of every twentieth vector against brute force, in several blocks."""

import os

import numpy as np
import pytest

from leadlake.catalog import QUERIES
from leadlake.operators import vectors

DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", ["registry_search every 20th", "registry_search filtered every 20th"])
def test_against_all_pairs(spark, monkeypatch, name):
    monkeypatch.setattr(vectors, "BLOCK", 16)
    held = [r for r in spark.read.parquet(f"{DIR}/embeddings.parquet").select("vec_id", "embedding").collect() if r.embedding is not None]
    ids = np.array([r.vec_id for r in held])
    m = np.array([r.embedding for r in held], dtype="float64")
    m /= np.where((n := np.linalg.norm(m, axis=1, keepdims=True)) == 0, 1, n)
    city = lambda i: i % 3 if i % 7 else None
    got = {}
    for r in QUERIES[name](spark, DIR).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = r.vec_id
    assert set(got) == {i for i in ids if i % 20 == 0} and len(got) > 16
    at = {i: k for k, i in enumerate(ids)}
    for q, ranks in got.items():
        fits = [i for i in ids if "filtered" not in name or ((q % 40 or i % 5 == q % 5) and (city(q) is None or city(i) == city(q)))]
        assert set(ranks.values()) <= set(fits) and sorted(ranks) == list(range(1, min(20, len(fits)) + 1)) and len(set(ranks.values())) == len(ranks)
        want = sorted((float(m[at[q]] @ m[at[i]]) for i in fits), reverse=True)[:20]
        assert np.allclose([m[at[q]] @ m[at[ranks[k]]] for k in sorted(ranks)], want, atol=1e-12)


def brute(queries, rows, k):
    """(query_id, rank, similarity) over all pairs of one length that pass the filters."""
    out = {}
    sound = lambda v: v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v)
    unit = lambda v: np.array(v) / (np.linalg.norm(v) or 1)
    for q, v, *want in queries:
        if sound(v):
            best = sorted(((-float(unit(v) @ unit(w)), i) for i, w, *have in rows if sound(w) and len(w) == len(v)
                           and all(a is None or a == b for a, b in zip(want, have))))[:k]
            out[q] = [-s for s, _ in best]
    return {q: s for q, s in out.items() if s}


@pytest.mark.parametrize("spread", [0.05, 3.0])
def test_cells_and_odd_vectors(spark, monkeypatch, spread):
    monkeypatch.setattr(vectors, "BLOCK", 20)
    monkeypatch.setattr(vectors, "PIVOTS", 12)
    pick = np.random.default_rng(7)
    middle = pick.normal(size=(6, 5))
    rows = [(i, [float(x) for x in middle[i % 6] + spread * pick.normal(size=5)], ["SP", "RJ", None][i % 3], f"c{i % 4}") for i in range(400)]
    rows += [(1000 + i, rows[0][1], "SP", "c0") for i in range(70)]  # one vector many times
    rows += [(2000, None, "SP", "c1"), (2001, [], "SP", "c1"), (2002, [1.0, None, 0.0, 0.0, 0.0], "SP", "c1"), (2003, [float("nan")] * 5, None, None),
             (2004, [float("inf")] * 5, None, None), (2005, [1.0, 2.0], "SP", "c2"), (2006, [2.0, -1.0], "RJ", "c2"), (2007, [0.0] * 5, "SP", "c1"), (2008, [3.0], None, None)]
    asked = [(i, v, ["SP", None, "XX"][i % 3] if i % 2 else None, "c1" if i % 5 == 0 else None) for i, v, *_ in rows if i % 7 == 0 or i >= 2000]
    shape = "embedding array<double>, state string, city string"
    got = {}
    for r in vectors.registry_search(spark.createDataFrame(asked, f"query_id long, {shape}"), spark.createDataFrame(rows, f"vec_id long, {shape}").repartition(3), 8).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = r.similarity
    want = brute(asked, rows, 8)
    assert set(got) == set(want)
    for q, sims in want.items():
        assert sorted(got[q]) == list(range(1, len(sims) + 1)) and np.allclose([got[q][k] for k in sorted(got[q])], sims, atol=1e-12)
    none = spark.createDataFrame([], f"vec_id long, {shape}")
    assert vectors.registry_search(spark.createDataFrame(asked, f"query_id long, {shape}"), none).count() == 0


def test_far_blocks_are_left_out(spark, monkeypatch):
    """Where vectors lie in tight clusters, queries meet few of the blocks."""
    monkeypatch.setattr(vectors, "BLOCK", 16)
    seen = []
    scored = vectors._scored
    monkeypatch.setattr(vectors, "_scored", lambda pairs, blocks, *a: (seen.append((pairs.count(), blocks.count())), scored(pairs, blocks, *a))[1])
    pick = np.random.default_rng(3)
    middle = pick.normal(size=(16, 12))
    rows = [(i, [float(x) for x in middle[i % 16] + 0.01 * pick.normal(size=12)]) for i in range(1600)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    q = v.filter("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")
    assert vectors.registry_search(q, v, 5).count() == 80 * 5
    assert seen[-1][0] < 80 * seen[-1][1] / 4

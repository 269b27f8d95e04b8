"""Mixing, sharding, nearest neighbours, and the statements in DuckDB."""

import random
import zlib

import duckdb
import numpy as np
import pytest
from edge_rows import SF
from oracle import compare, connect

from leadlake.llm import mixing, sharding, voronoi
from leadlake.llm.common import components
from leadlake.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_duckdb(spark, name):
    assert compare(spark, connect(SF), QUERIES[name], ORACLES[name], SF) is None


def test_statements_on_edges(spark, edge, tmp_path):
    path = str(tmp_path / "documents.parquet")
    edge.filter("doc_id <> 7").dropDuplicates(["doc_id"]).write.parquet(path)  # the long text takes DuckDB minutes; test_text has it
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{path}/*.parquet')")
    for name in ("op4_substring_dedup", "op10_mixing"):
        assert compare(spark, con, QUERIES[name], ORACLES[name], str(tmp_path)) is None


def test_mixing(edge, none):
    rows = mixing.mix(edge).collect()
    assert len(rows) == edge.count() and mixing.mix(none).count() == 0
    total = sum(r.size for r in rows)
    by = {}
    for r in rows:
        assert 0 <= r.taken <= 2 * r.size
        by.setdefault((r.source_size, r.target), []).append(r.taken)
    for (_, target), taken in by.items():
        assert abs(sum(taken) - target) <= 0.5
    assert abs(sum(t for _, t in by) - 1.5 * total) < 1e-6 * total
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, mixing.mix(edge.repartition(7)).collect()), key=str)


def test_targets_match_resharing(spark):
    sizes = {"a": 10, "b": 1000, "c": 0, "d": 70, "e": 5}
    df = spark.createDataFrame([(k, v) for k, v in sizes.items()], "sk string, source_size long")
    weight = dict(zip(sorted(sizes), [5, 2, 1, 5, 2]))
    goal, total = {}, 1.5 * sum(sizes.values())
    free = set(sizes)
    while True:
        left = total - sum(goal.values())
        share = {k: left * weight[k] / sum(weight[x] for x in free) for k in free}
        over = {k for k in free if share[k] > 2 * sizes[k]}
        if not over:
            break
        goal |= {k: 2.0 * sizes[k] for k in over}
        free -= over
    goal |= share
    got = {r.sk: r.target for r in mixing.targets(df).collect()}
    assert got == pytest.approx(goal)


def test_take(edge, none):
    plan = {}
    for r in mixing.mix(edge).collect():
        plan[(r.doc_id, r.size)] = plan.get((r.doc_id, r.size), 0) + r.taken
    got = mixing.take(edge)
    assert got.columns == edge.columns and mixing.take(none).count() == 0
    words = {}
    for r in got.collect():
        assert r.n_chars == len(r.text)
        words[r.doc_id] = words.get(r.doc_id, 0) + len(r.text.split())
    want = {}
    for (i, _), n in plan.items():
        want[i] = want.get(i, 0) + n
    assert words == {i: n for i, n in want.items() if n}


def check_shards(rows, shards=24):
    slots = {}
    for r in rows:
        slots.setdefault(r.shard, []).append(r.slot)
        assert 0 <= r.shard < shards and r.law == "bytes" and r.grown_shard is None
    for s in slots.values():
        assert sorted(s) == list(range(len(s)))


def test_sharding_on_edges(edge, none):
    rows = sharding.shard(edge).collect()
    assert len(rows) == edge.count() and sharding.shard(none).count() == 0
    check_shards(rows)
    size = {r.doc_id: r.size for r in rows}
    assert size[3] == 8 and size[4] == 8
    crc = {r.doc_id: r.text_crc32 for r in rows}
    assert crc[3] is None and crc[4] == 0 and crc[6] == zlib.crc32(b"one two")
    assert len({r.shard for r in rows if r.doc_id in (1, 2)}) == 1


def test_sharding_balances(spark):
    pick = random.Random(3)
    rows = [(i, f"t{pick.randrange(700)} " * pick.randrange(1, 60)) for i in range(3000)] + [(3000 + i, "same text in all of these") for i in range(50)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    check_shards(got)
    text = dict(rows)
    home, load = {}, [0] * 24
    for r in got:
        assert home.setdefault(text[r.doc_id], r.shard) == r.shard
        load[r.shard] += r.size
    assert max(load) < 1.01 * min(load)


def test_lpt_matches_a_plain_heap():
    sizes = [97, 60, 60, 41, 33, 20, 20, 7]
    loads = [0] * 3
    for s in sizes:
        loads[loads.index(min(loads))] += s
    classes = [(s, sizes.count(s), s * sizes.count(s)) for s in set(sizes)]
    plan = sharding.lpt(classes, 3)
    assert sorted(loads) == sorted(sum(c * plan[c][j] for c in plan) for j in range(3))


def brute(rows, k, every):
    out = []
    whole = [(i, [int(np.floor(1024 * float(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    for n, (q, v) in enumerate(whole):
        if q % every == 0:
            some = sorted(((-sum(a * b for a, b in zip(v, w)), i) for i, w in whole if i != q and len(w) == len(v)))[:k]
            out += [(q, r, i, -s) for r, (s, i) in enumerate(some, 1)]
    return sorted(out)


@pytest.mark.parametrize("spread", [1.0, 40.0])
def test_voronoi(spark, monkeypatch, spread):
    monkeypatch.setattr(voronoi, "QUERY_BLOCK", 4)
    monkeypatch.setattr(voronoi, "DATA_BLOCK", 50)
    pick = np.random.default_rng(4)
    middle = pick.normal(size=(6, 8)) * spread
    rows = [(i, [float(x) for x in middle[i % 6] + pick.normal(size=8)]) for i in range(600)]
    rows += [(600 + i, rows[0][1]) for i in range(120)]  # a hot vector
    rows += [(None, rows[1][1]), (900, None), (901, [1.0, None] + [0.0] * 6), (902, [float("nan")] * 8), (903, [float("inf")] * 8), (1000, [2.0, 1.0]), (1001, [1.0, -1.0]), (1100, []), (1101, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(map(tuple, voronoi.top_products(df, k=5, every=20, pivots=6).collect()))
    assert got == brute(rows, 5, 20)


def test_voronoi_without_queries(spark):
    df = spark.createDataFrame([(1, [1.0])], "vec_id long, embedding array<float>")
    assert voronoi.top_products(df).count() == 0 and voronoi.top_products(df.filter("vec_id > 1")).count() == 0


def test_components(spark):
    pick = random.Random(9)
    edges = [(pick.randrange(300), pick.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)] + [(None, 1), (7, 7)]
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = top(a), top(b)
            up[max(x, y)] = min(x, y)
    got = components(spark.createDataFrame(edges, "a long, b long"))
    assert {(r.node, r.component) for r in got.collect()} == {(x, top(x)) for x in list(up)}

"""The near-copy join and its components take few stages, which count where shuffles have many partitions."""

import random

import numpy as np
import pyarrow as pa

from leadlake.llm import common, jaccard


def stages(spark, name, run):
    """The result, and how many stages its jobs have."""
    context = spark.sparkContext
    context.setJobGroup(name, name)
    try:
        out = run()
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    tracker = context.statusTracker()
    return out, sum(len(tracker.getJobInfo(j).stageIds) for j in tracker.getJobIdsForGroup(name))


def tops(edges):
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = top(a), top(b)
        up[max(x, y)] = min(x, y)
    return {x: top(x) for x in list(up)}


def test_components_in_few_stages(spark):
    """Classes around a node that is not their smallest, one of them a long chain."""
    pick = random.Random(4)
    edges = [(100 * g + 50, 100 * g + i) for g in range(12) for i in range(100) if i != 50] + [(5000 + i, 5001 + i) for i in range(80)]
    pick.shuffle(edges)
    df = spark.createDataFrame(edges, "a long, b long").repartition(4)
    got, n = stages(spark, "components", lambda: common.components(df).collect())
    assert {r.node: r.component for r in got} == tops(edges)
    assert n <= 130


def test_stars():
    pick = np.random.default_rng(3)
    for n in (1, 3, 40, 400):
        u, v = pick.integers(0, 300, n), pick.integers(0, 300, n)
        leaf, low = common.stars(u, v)
        want = tops(list(zip(u.tolist(), v.tolist())))
        assert dict(zip(leaf.tolist(), low.tolist())) == {x: y for x, y in want.items() if x != y}


def test_units_without_more_pairs_end():
    """Three sets within the bound of each other: the forest is two pairs, and if these fail the third is the last."""
    members = pa.table({"sid": [2, 4, 6], "n": [100, 100, 100], "comp": [2, 4, 6], "fold": [bytes(16), bytes(16), bytes(16)]})
    some, more = jaccard._forest(members, {}, 90, 0)
    offered = {(a, b) for a, b in some if a != b}
    assert len(offered) == 2 and more
    some, more = jaccard._forest(members, dict.fromkeys(offered, False), 90, 1)
    assert set(some) | offered == {(2, 4), (2, 6), (4, 6)} and not more
    assert jaccard._forest(members.set_column(2, "comp", pa.array([2, 2, 2])), {}, 90, 0) == ([], False)

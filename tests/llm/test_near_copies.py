"""The near-copy stage against brute force on five words and 0.8."""

import random

import corpus_pipeline
import numpy as np
import pytest
from edge_rows import SF
from test_text import near_rows, sets_of

from leadlake.llm import jaccard
from leadlake.llm.common import table


def firsts(rows):
    """The ids that are the smallest of their class."""
    sets = sets_of(rows, 5)
    up = {i: i for i, _ in rows}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            if s and t and min(len(s), len(t)) * 5 >= 4 * max(len(s), len(t)) and 5 * len(s & t) >= 4 * len(s | t):
                x, y = top(i), top(j)
                up[max(x, y)] = min(x, y)
    return {i for i in up if top(i) == i}


def kept(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    return {r.doc_id for r in corpus_pipeline.keep_one_of_near_copies(spark, docs, SF).collect()}


def test_scattered_changes(spark):
    base = [f"w{i}" for i in range(500)]
    some = [f"v{i}" if i % 50 == 25 else w for i, w in enumerate(base)]  # 446 / 546 of five words, 468 / 528 of three
    many = [f"u{i}" if i % 20 == 10 else w for i, w in enumerate(base)]
    assert kept(spark, [(1, " ".join(base)), (2, " ".join(some)), (3, " ".join(many))]) == {1, 3}


def test_by_chance(spark):
    rows = near_rows(3, 30, 6, [8, 20, 35, 90, 200, 400])
    pick = random.Random(4)
    for i, t in rows[::6]:
        w = t.split(" ")
        for at in pick.sample(range(len(w)), len(w) // 45):
            w[at] = "x" + w[at]
        rows.append((len(rows), " ".join(w)))
    assert kept(spark, rows) == firsts(rows)


def test_whole_table(spark):
    rows = [(r.doc_id, r.text) for r in table(spark, SF, "documents").select("doc_id", "text").collect()]
    assert kept(spark, rows) == firsts(rows)


class Grams:
    """Two sets of shingle hashes in the layout of a slice."""

    def __init__(self, *sets):
        sets = [np.unique(np.array(sorted(s), np.uint64)) for s in sets]
        self.sizes = np.array([len(s) for s in sets])
        self.grams, self.rows = np.concatenate(sets), np.repeat(np.arange(len(sets)), self.sizes)


@pytest.mark.parametrize("similar", [80, 90])
def test_linked_sets_share_a_key(similar):
    pick = np.random.default_rng(similar)
    linked = 0
    for trial in range(3000):
        n = int(pick.integers(5, 60 if trial % 3 else 500))
        apart = int(jaccard.most_apart(2 * n, similar))
        drop, add = (int(pick.integers(0, apart + 1)) for _ in range(2))
        whole = {int(x) for x in pick.integers(0, 1 << 63, n, dtype=np.uint64)}
        other = set(sorted(whole)[drop:]) | {int(x) for x in pick.integers(0, 1 << 63, add, dtype=np.uint64)}
        s = Grams(whole, other)
        keys = [jaccard._signatures(s, similar, np.array([2, 4]), np.array([True, True]), k) for k in (0, 1)]
        keys = {i: {(int(k), 0) for found, sets in keys for k, x in zip(found, sets) if x & ~1 == i} for i in (2, 4)}
        if whole != other and 100 * len(whole & other) >= similar * len(whole | other):
            linked += 1
            assert keys[2] & keys[4], (n, len(whole & other), len(whole | other))
    assert linked > 300


def test_empty_segments_are_sent_where_many(monkeypatch):
    """Without spare segments every set with an empty one sends it, and links are still met."""
    monkeypatch.setattr(jaccard, "spare", lambda apart: 0 * apart)
    test_linked_sets_share_a_key(80)

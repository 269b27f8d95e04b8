"""Crowded keys of the near-copy join: what hangs together is contracted before blocks are dealt."""

import random

import numpy as np
import pytest
from test_near_copies import Grams, firsts, kept

from leadlake.llm import jaccard


def test_a_large_class_costs_rows_in_proportion():
    """One class of many blocks and a few other sets: the copies of the class are not paired with each other."""
    def rows(blocks):
        comp = np.concatenate((np.full(blocks * jaccard.BLOCK, 1), np.arange(2, 12)))
        return sum(len(at) for _, at in jaccard.block_pairs(comp))

    assert rows(40) < 3 * 40 * jaccard.BLOCK
    assert rows(40) < 2.2 * rows(20)


def test_members_of_two_components_meet(monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 4)
    pick = np.random.default_rng(5)
    for n in (2, 4, 5, 9, 17, 30):
        comp = np.sort(pick.integers(0, 5, n))
        met = {(i, j) for _, at in jaccard.block_pairs(comp) for i in at for j in at if i < j}
        assert {(i, j) for j in range(n) for i in range(j) if comp[i] != comp[j]} <= met


@pytest.mark.parametrize("similar", [80, 90])
def test_linked_sets_share_the_needed_keys(similar):
    pick = np.random.default_rng(similar)
    linked = 0
    for trial in range(1500):
        n = int(pick.integers(5, 60 if trial % 3 else 500))
        drop, add = (int(pick.integers(0, jaccard.most_apart(2 * n, similar) + 1)) for _ in range(2))
        whole = {int(x) for x in pick.integers(0, 1 << 63, n, dtype=np.uint64)}
        other = set(sorted(whole)[drop:]) | {int(x) for x in pick.integers(0, 1 << 63, add, dtype=np.uint64)}
        if whole == other or 100 * len(whole & other) < similar * len(whole | other):
            continue
        linked += 1
        s = Grams(whole, other)
        band = jaccard.bands(s.sizes, similar)
        nexts = [int(band.max() - b) for b in band]
        keys = []
        for i, k in enumerate(nexts):
            found, sets = jaccard._signatures(s, similar, np.array([2, 4]), np.array([True, True]), k)
            keys.append(set(found[sets & ~1 == 2 * i + 2].tolist()))
        for i, k in enumerate(nexts):
            assert len(keys[0] & keys[1]) >= jaccard.needed(s, similar, k)[i]
    assert linked > 150


def test_crowded_groups_against_brute_force(spark, monkeypatch):
    """Groups of near copies around several texts that share a long passage, so that keys are crowded and hold many classes."""
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    pick = random.Random(9)
    passage = [f"p{i}" for i in range(60)]
    rows = []
    for g in range(5):
        base = passage + [f"g{g}w{i}" for i in range(40 + 4 * g)]
        for _ in range(14):
            w = list(base)
            for at in pick.sample(range(60, len(w)), pick.choice((0, 1, 2, 3))):
                w[at] = f"x{len(rows)}"
            rows.append((len(rows), " ".join(w)))
    pick.shuffle(rows)
    assert kept(spark, rows) == firsts(rows)

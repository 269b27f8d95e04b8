"""Windows, sets, templates: edge cases and brute force."""

import hashlib
import random
import re

import pytest
from edge_rows import SF

from leadlake.llm import contamination, jaccard, substring
from leadlake.llm.common import table

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def kept(rows, window):
    """Brute force: rows of (id, text) -> (id, words, removed, kept text)."""
    first = {}
    words = [WORD.findall(t or "") for _, t in rows]
    for (i, _), w in zip(rows, words):
        for k in range(len(w) - window + 1):
            key = tuple(w[k:k + window])
            if i is not None:
                first[key] = min(first.get(key, i), i)
    out = []
    for (i, _), w in zip(rows, words):
        gone = set()
        for k in range(len(w) - window + 1):
            if i is not None and first[tuple(w[k:k + window])] < i:
                gone.update(range(k, k + window))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=str)


@pytest.mark.parametrize("window", [13, 6])
def test_substring_on_edges(edge, window):
    rows = [(r.doc_id, r.text) for r in edge.select("doc_id", "text").collect()]
    got = substring.remove_repeats(edge, window).collect()
    assert sorted(map(tuple, got), key=str) == kept(rows, window)


def test_substring_by_chance(spark):
    pick = random.Random(5)
    base = [pick.choice("abcd") for _ in range(400)]
    rows = []
    for i in range(80):
        k = pick.randrange(380)
        rows.append((i, " ".join([pick.choice("xyz")] * pick.randrange(3) + base[k:k + pick.randrange(40)] + [pick.choice("abcd") for _ in range(pick.randrange(30))])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, substring.remove_repeats(docs).collect()), key=str) == kept(rows, 13)


def test_digest(edge):
    got = {(r.doc_id, r.n_words, r.kept_sha256) for r in substring.digest(substring.remove_repeats(edge)).collect()}
    assert (4, 0, hashlib.sha256(b"").hexdigest()) in got and (3, 0, hashlib.sha256(b"").hexdigest()) in got


def test_difference_covers():
    for period in range(2, 40):
        cover = substring.difference_cover(period)
        assert {(a - b) % period for a in cover for b in cover} == set(range(period))


def sets_of(rows, n=3):
    out = []
    for i, t in rows:
        w = WORD.findall((t or "").translate({k: k + 32 for k in range(65, 91)}))
        out.append((i, {tuple(w[k:k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()))
    return out


def classes(rows, similar=90):
    sets = [(i, s) for i, s in sets_of(rows)]
    up = {i: i for i, _ in sets if i is not None}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            if i is not None and j is not None and s and t and 100 * len(s & t) >= similar * len(s | t):
                x, y = top(i), top(j)
                up[max(x, y)] = min(x, y)
    return sorted(((i, len(s), None if i is None else top(i) if s else i) for i, s in sets), key=str)


def test_jaccard_on_edges(edge):
    rows = [(r.doc_id, r.text) for r in edge.select("doc_id", "text").collect()]
    assert sorted(map(tuple, jaccard.near_classes(edge).collect()), key=str) == classes(rows)


def near_rows(seed, families, copies, words):
    pick = random.Random(seed)
    rows = []
    for _ in range(families):
        base = [f"w{pick.randrange(5000)}" for _ in range(pick.choice(words))]
        for _ in range(copies):
            w = list(base)
            for _ in range(pick.randrange(max(2, len(w) // 25))):
                w[pick.randrange(len(w))] = f"v{pick.randrange(10 ** 6)}"
            rows.append((len(rows), " ".join(w)))
    return rows


def test_jaccard_by_chance(spark):
    rows = near_rows(1, 40, 6, [8, 20, 35, 90, 200, 400])
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted(map(tuple, jaccard.near_classes(docs).collect()), key=str) == classes(rows)


def test_jaccard_in_crowded_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 16)
    rows = near_rows(2, 2, 90, [80, 150])
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted(map(tuple, jaccard.near_classes(docs).collect()), key=str) == classes(rows)


def test_keep_one(edge):
    kept_rows = jaccard.keep_one(edge)
    assert kept_rows.columns == edge.columns
    got = sorted(((r.doc_id, r.text) for r in kept_rows.collect()), key=str)
    assert 1 in {i for i, _ in got} and not {2, 11} & {i for i, _ in got}
    assert {3, 4, 8, 6, 7, 9, 10} <= {i for i, _ in got if i is not None}
    assert sum(i is None for i, _ in got) == 2


ITEM = "If Tom drives 60 km in 2 hours and then Anna drives 90 km in 3 hours what is the mean speed of Tom"


def test_leaks(spark):
    other = ITEM.replace("Tom", "Paul").replace("Anna", "Rita").replace("60", "75").replace("90", "15").replace("2 hours", "4 hours").replace("3 hours", "5 hours")
    mixed = ITEM.replace("of Tom", "of Paul")  # one name stands for two: not the same question
    filler = "nothing to see here but plain words that say little about anything at all " * 4
    rows = [(1, filler + ITEM + " " + filler), (2, filler + other), (3, mixed), (4, filler), (None, ITEM), (5, None), (6, ""), (1, ITEM), (7, ITEM), (7, ITEM)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(0, ITEM), (1, None), (2, "too short"), (None, ITEM + " and Anna"), (3, "")], "item_id long, text string")
    rows = contamination.leaks(docs, items).collect()
    got = {(r.doc_id, r.item_id): r for r in rows}
    assert {d for d, _ in got} == {1, 2, 7, None}
    assert got[(1, 0)].n_changed == 0 and got[(2, 0)].n_changed == 6 and got[(2, 0)].n_agree == got[(2, 0)].n_tokens
    assert sum((r.doc_id, r.item_id) == (1, 0) for r in rows) == 2
    left = contamination.drop_leaks(docs, items)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == {3, 4, 5, 6}


def test_leaks_of_exact_passages(spark):
    docs, items = table(spark, SF, "documents"), table(spark, SF, "benchmark")
    texts = items.collect()
    want = {(r.doc_id, i.item_id) for r in docs.select("doc_id", "text").collect() for i in texts if i.text in r.text}
    assert {(r.doc_id, r.item_id) for r in contamination.leaks(docs, items).collect()} == want and want


def test_leaks_uses_column_functions_only(spark):
    plan = contamination.leaks(table(spark, SF, "documents"), table(spark, SF, "benchmark"))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_empty_tables(none, spark):
    items = spark.createDataFrame([(0, ITEM)], "item_id long, text string")
    assert substring.remove_repeats(none).count() == 0
    assert jaccard.keep_one(none).count() == 0
    assert contamination.leaks(none, items).count() == 0
    assert contamination.leaks(none, items.filter("item_id > 0")).count() == 0
    assert contamination.drop_leaks(none, items).count() == 0


def test_leaks_on_edges(edge, spark):
    items = spark.createDataFrame([(0, "the old mill stands by the river and turns its slow wheel all day long")], "item_id long, text string")
    assert {r.doc_id for r in contamination.leaks(edge, items).collect()} == {1, 2, None, 11}

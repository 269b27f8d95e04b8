"""Items at every offset, cut by inserted words, and re-parameterised with names of other lengths."""

from test_text import ITEM

from leadlake.llm import contamination

FILLER = "nothing to see here but plain words that say little about anything at all".split() * 4
SHORT = "Tom has 5 apples and Anna has 7"


def found(spark, texts, items):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {(r.doc_id, r.item_id): r for r in contamination.leaks(docs, spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()}


def test_every_offset(spark):
    texts = [" ".join([*FILLER[:k], item, *FILLER]) for item in (ITEM, SHORT) for k in range(16)]
    got = found(spark, texts, [ITEM, SHORT])
    assert set(got) == {(k + 16 * i, i) for i in (0, 1) for k in range(16)}
    assert all(r.n_agree == r.n_tokens and r.n_changed == 0 for r in got.values())


def test_mostly_placeholders(spark):
    item = "Tom 5 Anna 7 Paul 9 Rita 11"
    assert set(found(spark, [" ".join([*FILLER[:k], item, *FILLER]) for k in range(4)], [item])) == {(k, 0) for k in range(4)}


def test_shifts_add_up(spark):
    w = ITEM.split()
    thirds = " ".join([*w[:8], "quietly", *w[8:17], "slowly", *w[17:]])
    names = ITEM.replace("Tom", "Mary Ann").replace("Anna", "Rita Lee Gray").replace("60 km", "75km")
    apart = " ".join([*w[:5], *FILLER * 3, *w[5:9]])
    got = found(spark, [" ".join([*FILLER[:k], t, *FILLER]) for t in (thirds, names) for k in range(8)] + [apart], [ITEM])
    assert set(got) == {(k, 0) for k in range(16)}
    assert [got[(k, 0)].n_agree >= 14 for k in range(8)] == [True] * 8
    assert [(got[(k, 0)].n_agree, got[(k, 0)].n_changed) for k in range(8, 16)] == [(19, 4)] * 8  # If Tom, Tom, Anna, 60


def test_loose_slots_are_left_out(spark):
    item = "The boat leaves the quay at noon. The crew counts the crates on deck. The captain writes the total of them down for Paul"
    changed = item.replace("The crew", "Our crew")
    cut_off = " ".join(item.split()[:18]) + " yesterday Rome Paul"
    got = found(spark, [changed, cut_off], [item])
    assert set(got) == {(0, 0), (1, 0)} and got[(0, 0)].n_agree == got[(0, 0)].n_tokens - 1

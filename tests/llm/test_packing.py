"""Packing: tokens against the tokenizer itself, bins against plain item-by-item packing."""

import random
import zlib

import numpy as np
import pytest
from edge_rows import LONG, SF, by_id

from leadlake.llm import encoders, packing
from leadlake.llm.common import table
from leadlake.llm.queries import QUERIES

PATH = f"{encoders.TOKENIZERS}/{packing.VOCABULARY}"


def ids_of(texts):
    model = encoders.tokenizer(PATH)
    return [[*e.ids, 0] for e in model.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def check(rows, capacity):
    """Sequences without gaps or overlaps, none too long; their number."""
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for items in bins.values():
        at = 0
        for offset, n in sorted(items):
            assert offset == at and n > 0
            at += n
        assert at <= capacity
    return len(bins)


def whole(rows, texts, capacity):
    """Every document's pieces are its tokens, each document as often as it occurs."""
    want = {}
    for i, ids in zip((i for i, _ in texts), ids_of([t for _, t in texts])):
        for p, at in enumerate(range(0, len(ids), capacity)):
            one = np.array(ids[at:at + capacity], "<u4").tobytes()
            want[i, p, at, len(one) // 4, zlib.crc32(one)] = want.get((i, p, at, len(one) // 4, zlib.crc32(one)), 0) + 1
    got = {}
    for r in rows:
        k = r.doc_id, r.piece, r.start, r.length, r.ids_crc32
        got[k] = got.get(k, 0) + 1
    assert got == want


def plain(sizes, capacity):
    """Number of bins of best-fit decreasing, item by item."""
    gaps = []
    for s in sorted(sizes, reverse=True):
        fit = min((g for g in gaps if g >= s), default=None)
        if fit is not None:
            gaps.remove(fit)
        gaps.append((capacity if fit is None else fit) - s)
    return len(gaps)


def test_query(spark):
    rows = QUERIES["op12_packing"](spark, SF).collect()
    whole(rows, [(r.doc_id, r.text) for r in table(spark, SF, "documents").collect()], 2048)
    n = check(rows, 2048)
    sizes = [r.length for r in rows]
    assert n <= plain(sizes, 2048) and n >= -(-sum(sizes) // 2048)


@pytest.mark.parametrize("capacity", [2048, 16])
def test_edges(spark, edge, none, capacity):
    rows = packing.pack_documents(edge, PATH, capacity).collect()
    whole(rows, [(r.doc_id, r.text) for r in edge.collect()], capacity)
    check(rows, capacity)
    assert {r.length for r in by_id(rows)[3]} == {1}
    assert packing.pack_documents(none, PATH, capacity).count() == 0


def test_sequences(spark, edge):
    small = edge.filter("doc_id <> 7")
    packed = packing.pack_documents(small, PATH, 32, keep_ids=True)
    rows = packed.collect()
    whole_ids = {r.sequence_id: r.ids for r in packing.sequences(spark.createDataFrame(rows, packed.schema)).collect()}
    for r in rows:
        assert whole_ids[r.sequence_id][r.offset:r.offset + r.length] == r.ids


def fill(counts, capacity):
    out = packing.plan(counts, capacity)
    items, load = {}, {}
    for size, low, high, first, each, offset in out.steps:
        for k in range(low, high):
            assert (size, k) not in items
            items[size, k] = first + (k - low) // each, offset + (k - low) % each * size
    assert set(items) == {(s, k) for s, n in counts.items() for k in range(n)}
    for (s, _), (b, at) in items.items():
        load.setdefault(b, []).append((at, s))
    for parts in load.values():
        at = 0
        for offset, s in sorted(parts):
            assert offset == at
            at += s
        assert at <= capacity
    assert len(load) == out.bins
    return out


@pytest.mark.parametrize("seed", range(12))
def test_plan(seed):
    pick = random.Random(seed)
    capacity = pick.choice([10, 64, 300])
    counts = {}
    for _ in range(pick.randrange(1, 400)):
        s = min(capacity, 1 + int(pick.expovariate(4 / capacity)))
        counts[s] = counts.get(s, 0) + pick.choice([1, 1, 3])
    out = fill(counts, capacity)
    sizes = [s for s, n in counts.items() for _ in range(n)]
    assert out.bins <= plain(sizes, capacity) + 1


def best_pairs(large, capacity):
    """Largest number of disjoint pairs that fit, by trying all."""
    if len(large) < 2:
        return 0
    head, rest = large[0], large[1:]
    return max([best_pairs(rest, capacity), *(1 + best_pairs(rest[:i] + rest[i + 1:], capacity) for i, x in enumerate(rest) if head + x <= capacity)])


def test_pairs_are_a_largest_matching():
    pick = random.Random(2)
    for _ in range(60):
        large = [pick.randrange(11, 31) for _ in range(pick.randrange(1, 9))]
        counts = {s: large.count(s) for s in large}
        assert fill(counts, 30).bins == len(large) - best_pairs(large, 30)


def test_steps_do_not_grow_with_the_items():
    steps = [len(packing.plan({s: n * (s % 7 + 1) for s in range(1, 2049)}, 2048).steps) for n in (1, 1000, 1_000_000)]
    assert max(steps) < 50_000 and steps[2] < 2 * steps[1]


def test_words_encode_as_in_whole_texts():
    texts = ["It's 2024's best　 café ́x", "a\x1cb\x85c  d", "<|endoftext|> x<|startoftext|>y", "ΣΑΣ İI ﬁ", "\U0001d4d0 \U0001f600!? ...", " ", "", LONG[:5000], "x" * 5000,
             "T\u0308 H\u0331 I\u0307 Y\u030a J\u030c", "<|ENDOFTEXT|> A<|endoftext|>B, c.", "Word, it's. DON'T! a,b.. (x). e.g., Ω. 5! é. 'll. ''s, \u212a K."]
    words = encoders.WordCache(PATH)
    ids, first = words.encode([t.encode() for t in texts])
    got = [ids[i:j].tolist() for i, j in zip(first, first[1:])]
    assert got == [ids[:-1] for ids in ids_of(texts)]

"""Classifiers and token counts: edge cases, held-out accuracy, brute force."""

import itertools
import math
import random

import numpy as np
import pytest
from edge_rows import SF, by_id

from leadlake.llm import language, quality, tokens, toxicity
from leadlake.llm.queries import QUERIES

SF01 = SF.replace("sf0.001", "sf0.01")


def held_out(spark, name, label):
    got = QUERIES[name](spark, SF01)
    rows = got.filter("held_out").join(spark.read.parquet(f"{SF01}/labels.parquet"), "doc_id").collect()
    return [(r.predicted, r[label]) for r in rows], got


def test_quality_held_out(spark):
    pairs, got = held_out(spark, "op1_quality", "quality")
    assert np.mean([a == b for a, b in pairs]) > 0.97
    assert got.count() == spark.read.parquet(f"{SF01}/documents.parquet").count()


def test_toxicity_held_out(spark):
    pairs, _ = held_out(spark, "op8_toxicity", "toxic")
    assert np.mean([a == b for a, b in pairs]) > 0.95 and not any(a and not b for a, b in pairs)


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet").select("doc_id", "lang")
    rows = QUERIES["op3_language"](spark, SF01).filter("held_out").join(docs, "doc_id").collect()
    assert np.mean([r.lang_pred == r.lang for r in rows]) > 0.97


@pytest.mark.parametrize("score", [quality.score, toxicity.score])
def test_scores_on_edges(edge, none, labels, score):
    rows = score(edge, labels).collect()
    assert len(rows) == edge.count() and all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in rows)
    assert all(r.held_out for r in rows if r.doc_id is None)
    assert len({r.score for r in by_id(rows)[2]}) == 1
    assert score(none, labels).count() == 0
    assert {r.score for r in score(edge, labels.filter("doc_id > 100")).collect()} == {0.0}


def test_drop_toxic_keeps_columns(edge, labels):
    assert toxicity.drop_toxic(edge, labels).columns == edge.columns


def test_language_on_edges(edge, none):
    rows = language.identify(edge, 5).collect()
    assert len(rows) == edge.count() and language.identify(none).count() == 0
    by = by_id(rows)
    for i in (3, 4, 8, 10):
        assert by[i][0].lang_pred == "und" and by[i][0].score == 0
    assert all(r.lang_pred in ("en", "fr", "und") and 0 <= r.score <= 1 for r in rows)


def test_codes():
    for n in (2, 3, 4, 6, 9, 40):
        code = language.codes(n)
        assert set(np.unique(code)) == {-1.0, 1.0}
        assert min((a != b).sum() for a, b in itertools.combinations(code, 2)) >= (1 if n == 2 else 2)


def test_chain_against_all_paths():
    pick = np.random.default_rng(2)
    sizes, moves = np.array([4, 1, 3]), pick.normal(size=(2, 2))
    emit = pick.normal(size=8)
    good, pair, total = quality.chain(emit, sizes, moves)
    at = 0
    for c, n in enumerate(sizes):
        weight = {p: math.exp(sum(emit[at + i] * s for i, s in enumerate(p)) + sum(moves[a, b] for a, b in zip(p, p[1:]))) for p in itertools.product((0, 1), repeat=int(n))}
        z = sum(weight.values())
        assert total[c] == pytest.approx(math.log(z))
        for i in range(n):
            assert good[at + i] == pytest.approx(sum(w for p, w in weight.items() if p[i]) / z)
        at += n
    assert pair.sum() == pytest.approx((sizes - 1).sum())


def brute_tokens(token, scores):
    best = [(0, 0)]
    for d in range(1, len(token) + 1):
        best.append(max((best[s][0] + scores[token[s:d]], best[s][1] - 1) for s in range(d) if token[s:d] in scores))
    return -best[-1][1]


def test_trie_against_plain_scores(spark, monkeypatch):
    monkeypatch.setattr(tokens, "NODES", 500)
    scores = tokens.vocabulary(spark, tokens.VOCABULARY)
    trie, pick = tokens.Trie(scores), random.Random(1)
    words = [bytes(pick.choice(b" thetionanderingso") for _ in range(pick.randrange(1, 14))) for _ in range(400)] + ["日本語".encode(), b"x" * 700, bytes(range(256))]
    for w in words:
        assert trie.insert(w) == brute_tokens(w, scores)


def test_token_counts_on_edges(edge, none):
    by = by_id(tokens.count_tokens(edge).collect())
    assert tuple(by[3][0])[1:] == (0, 0, 0) and tuple(by[4][0])[1:] == (0, 0, 0)
    assert by[6][0].n_bytes == 7 and by[6][0].n_pretokens == 2 and by[6][0].n_tokens >= 2
    assert by[1][0][1:] == by[2][0][1:] and len(by[2]) == 2 and tokens.count_tokens(none).count() == 0

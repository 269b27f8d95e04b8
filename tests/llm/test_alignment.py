"""Aligned tokenizers against a plain walk over the tokens of whole texts."""

import hashlib

import numpy as np
import pytest
from edge_rows import SF

from leadlake.llm import alignment as al
from leadlake.llm import encoders
from leadlake.llm.common import table
from leadlake.llm.queries import QUERIES

A, B = f"{encoders.TOKENIZERS}/{al.A_FILE}", f"{encoders.TOKENIZERS}/{al.B_FILE}"


@pytest.fixture(scope="module")
def models():
    from sentencepiece import SentencePieceProcessor

    a = encoders.tokenizer(A)
    a.encode_special_tokens = True
    return a, SentencePieceProcessor(model_file=B)


def spelt_groups(models, text):
    """Lists of A ids and B ids between common ends, or None."""
    a, b = models
    if not text:
        return None
    letters = al.byte_letters()
    a_ids, b_ids = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    a_bytes = [bytes(letters[c] for c in a.id_to_token(i)) for i in a_ids]
    b_bytes = []
    for i in b_ids:
        p = b.id_to_piece(i)
        b_bytes.append(bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode())
    whole = (" " + text).encode()
    if b"".join(a_bytes) != whole or b"".join(b_bytes) != whole:
        return None
    out, left, right, i, j, ea, eb = [], [], [], 0, 0, 0, 0
    while i < len(a_ids) or j < len(b_ids):
        if ea <= eb and i < len(a_ids):
            left.append(a_ids[i])
            ea += len(a_bytes[i])
            i += 1
        else:
            right.append(b_ids[j])
            eb += len(b_bytes[j])
            j += 1
        if ea == eb and left and right:
            out.append((left, right))
            left, right = [], []
    return out


def expected(models, rows):
    found = [(i, spelt_groups(models, t)) for i, t in rows]
    count = {}
    for _, groups in found:
        for p in {(x, y) for left, right in groups or () for x in left for y in right}:
            count[p] = count.get(p, 0) + 1
    top = {}
    for (x, _), n in count.items():
        top[x] = max(top.get(x, 0), n)
    out = []
    for i, groups in found:
        if groups is None:
            out.append((i, 0, 0, 0, 0, 0, 0, ""))
            continue
        links = [(x, y) for left, right in groups for x in left for y in right]
        spelt = ";".join(",".join(map(str, left)) + "|" + ",".join(map(str, right)) for left, right in groups)
        out.append((i, sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), len(links), sum(count[p] == top[p[0]] for p in links),
                    sum(count[p] for p in links), hashlib.sha256(spelt.encode()).hexdigest()))
    return sorted(out, key=str)


def test_query(spark, models):
    rows = [(r.doc_id, r.text) for r in table(spark, SF, "documents").collect()]
    assert sorted(map(tuple, QUERIES["op11_tokenizer_alignment"](spark, SF).collect()), key=str) == expected(models, rows)


ODD = [" ", "  two  blanks ", "tab\tand\nline\n\n end \n", "a  b　 c　", "▁ lower block", "été ééé 中文字 \U0001d4d0\U0001f600", "<|endoftext|> <s> </s> <unk>",
       "x" * 3000, "ab" * 2000, "日本語" * 300, "\x00\x01\x1c\x85 \x0b", "don't 'tis 1234567890 ...!!! ''", " ", "a ", "  ", "a\n b\n", "Word, it's. DON'T! a,b.. (x). e.g., Ω. 5! é. 'll. ''s,", "\ufeffbom", "½ ﬁ ①"]


@pytest.mark.parametrize("unit,join", [(1, 7), (4000, 1 << 21), (1 << 24, 1 << 21)])
def test_edges(spark, monkeypatch, models, edge, none, unit, join):
    monkeypatch.setattr(al, "JOIN_PAIRS", join)
    rows = [(r.doc_id, r.text) for r in edge.collect()] + [(100 + i, t) for i, t in enumerate(ODD)] + [(200, "same words here")] * 5
    df = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], "doc_id long, text string, unit int, row int, groups string").repartition(4)
    got = al.agreement(df, A, B, unit_bytes=unit)
    assert sorted(map(tuple, got.collect()), key=str) == expected(models, rows)
    assert al.agreement(none, A, B).count() == 0


def test_groups_are_kept_on_request(spark, models):
    df = spark.createDataFrame([(1, "Tokenizers disagree about unhyphenated words.")], "doc_id long, text string")
    row = al.agreement(df, A, B, keep_groups=True).first()
    assert hashlib.sha256(row.groups.encode()).hexdigest() == row.groups_sha256 and row.groups.count(";") + 1 == row.n_groups


def test_chunks_encode_as_whole_texts(models):
    texts = [t for t in ODD] + ["a\n  b", "a \n b", "a \t", "x\u3000 y  \u3000 z", "end  ", "end ", "\n\n  lead", "tab\t two"]
    sides = encoders.PairCache(A, B).encode([b" " + t.encode() for t in texts] + [b""])
    a, b = ([ids[i:j].tolist() for i, j in zip(first, first[1:])] for ids, first in sides)
    assert a == [e.ids for e in models[0].encode_batch([" " + t for t in texts], add_special_tokens=False)] + [[]]
    assert b == models[1].encode(texts) + [[]]

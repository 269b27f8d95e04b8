"""Rows and helpers the tests of this folder share."""

import os

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
# Names that the operators use inside, as columns of the input.
CLASH = "size int, key int, unit int, row int, b int, sid int, n int, shard int, target int, rank int, at int, item int, h int, c int, label int, score int, held_out int, kind int, sk int"
LONG = " ".join(f"Word{i % 977} runs {i}" for i in range(40_000)) + "\n" + "x" * 30_000


def documents():
    plain = [("the old mill stands by the river and turns its slow wheel all day long for the town below " * 3).strip(), "A short one", "one two"]
    rows = [(1, plain[0], "en", "a"), (2, plain[0], "en", "a"), (2, plain[0], "en", "a"), (3, None, None, None), (4, "", "en", "b"), (None, plain[0], None, "b"),
            (None, None, None, None), (5, plain[1], "en", "b"), (6, plain[2], "fr", None), (7, LONG, "en", "c"), (8, " \t\n ", "en", "c"), (9, "été 中文 \U0001d4d0 12 km", "fr", "c"),
            (10, "12 34 !!", "en", "a"), (11, plain[0].upper(), "en", "a"), (5, "another text of id five", "en", "a")]
    return [(i, t, la, s, len(t or ""), *range(19)) for i, t, la, s in rows]


def by_id(rows):
    out = {}
    for r in rows:
        out.setdefault(r["doc_id"], []).append(r)
    return out

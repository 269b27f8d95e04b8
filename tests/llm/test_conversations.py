"""Conversation repair against brute force: every sequence of edits, and a plain table over whole tables."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from edge_rows import SF

from leadlake.llm import conversations as cv
from leadlake.llm.common import table
from leadlake.llm.queries import QUERIES

SHAPE = re.compile(r"(s?(ua)+)?")
SAID = re.compile(r"[^\x20\x09-\x0D]")


def harmed(rows):
    out = []
    for c, t, role, text in rows:
        one = lambda v: " " if v is None else str(v)
        k = zlib.crc32(f"{one(c)}:{one(t)}".encode()) % 20
        role, text = one(role), one(text)
        if k == 1:
            text = ""
        if k == 2:
            text = re.sub("[.!?]", "", text)
        if k == 4:
            role = "user"
        out += [] if k == 0 else [(c, t, role, text)] * (2 if k == 3 else 1)
    return out


def cheapest(rows, faults):
    """(cost, audit, repaired) by the best prefixes per message and state, kept whole."""
    best = {0: (0, "", [])}

    def grow(best):
        for _ in range(3):
            for s, (c, a, m) in list(best.items()):
                to = 3 if s == 2 else 2
                new = (c + 5, a + "I", [*m, "assistant:" if s == 2 else "user:"])
                best[to] = min(best.get(to, new), new)
        return best

    for (_, _, role, text), f in zip(rows, faults):
        after = {}
        for s, (c, a, m) in grow(best).items():
            options = [(s, (c + 2, a + "D", m))]
            if f not in ("blank", "duplicate"):
                extra, to = 5 * (f == "truncated"), 3 if s == 2 else 2
                options.append((to, (c + 1 + extra, a + "R", [*m, ("assistant:" if s == 2 else "user:") + text])))
                keep = {"s": 1 if s == 0 else None, "u": 2 if s != 2 else None, "a": 3 if s == 2 else None}.get(role[:1])
                if keep:
                    options.append((keep, (c + extra, a + "K", [*m, f"{role}:{text}"])))
            for to, v in options:
                after[to] = min(after.get(to, v), v)
        best = after
    return min(v for s, v in grow(best).items() if s in (0, 3))


def fault_list(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        said = SAID.findall(text)
        out.append("blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def expected(rows):
    out = {}
    for c in {r[0] for r in rows}:
        mine = sorted((r for r in harmed(rows) if r[0] == c), key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.md5(f"{len(r[2])}:{r[2]}{r[3]}".encode()).digest()))
        faults, turns = fault_list(mine), [r[1] for r in mine if r[1] is not None]
        cost, audit, left = cheapest(mine, faults)
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        bad = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:]))
        out[c] = (gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), bad, cost, audit, hashlib.sha256("\n".join(left).encode()).hexdigest())
    return out


def got(rows):
    return {r.conv_id: tuple(r)[1:9] for r in rows}


def test_query_against_brute_force(spark):
    rows = [tuple(r) for r in table(spark, SF, "conversations").select("conv_id", "turn", "role", "text").collect()]
    answer = QUERIES["op13_conversation_repair"](spark, SF).collect()
    assert len(answer) == len({r[0] for r in rows}) and got(answer) == expected(rows)


def people(seed, many, most):
    pick = random.Random(seed)
    out = []
    for c in range(many):
        for t in range(pick.randrange(1, most)):
            turn = None if pick.random() < 0.05 else t + pick.randrange(2)
            role = pick.choice(["user", "assistant"] * 4 + ["system", "tool", "", None, "umpire"])
            out.append((None if c == 3 else c, turn, role, pick.choice(["Yes.", "No!", "cut off", " \t", "", None, f"Said {pick.randrange(9)}?", f"{t}."])))
    return out


@pytest.mark.parametrize("block", [3, 256])
def test_edges(spark, monkeypatch, block):
    monkeypatch.setattr(cv, "BLOCK_ROWS", block)
    rows = people(1, 60, 12) + [(500, t, "user", "Again.") for t in range(40)] + [(501, 7, "user", "Same.")] * 30 + [(502, t, "ua"[t % 2], f"x{t}.") for t in range(300)]
    rows += [(503, 1, "user", "long " * 400_000 + "."), (504, -(1 << 40), "system", "S."), (504, 1 << 40, "user", "U.")] + [(505, None, None, None)] * 3
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, block int, h string").repartition(5)
    answer = cv.digest(cv.repair(cv.damage(df)), df).collect()
    assert got(answer) == expected(rows)
    none = df.filter("turn = 12345")
    assert cv.digest(cv.repair(cv.damage(none)), none).count() == 0
    assert got(cv.digest(cv.repair(cv.damage(none)), df.filter("conv_id = 500")).collect()) == {500: (0,) * 6 + ("", hashlib.sha256(b"").hexdigest())}


def test_repaired_messages(spark):
    rows = [(1, 0, "assistant", "Hello."), (1, 1, "user", "Why?"), (1, 2, "user", "When?"), (1, 3, "assistant", "Now."), (2, 0, "user", " ")]
    df = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")
    left = sorted((r.conv_id, r.block, r.place, r.edit, r.role, r.text) for r in cv.repaired(cv.repair(df)).collect())
    assert [(r[0], *r[3:]) for r in left] == [(1, "R", "user", "Hello."), (1, "R", "assistant", "Why?"), (1, "K", "user", "When?"), (1, "K", "assistant", "Now.")]


def test_search_against_all_edits():
    """Every sequence of up to two insertions before each message and one edit of it."""
    pick = random.Random(5)
    for _ in range(60):
        n = pick.randrange(1, 4)
        initials, faults = "".join(pick.choice("suax") for _ in range(n)), "".join(pick.choice("---tbd") for _ in range(n))
        for entry in range(4):
            best = {}
            for inserts in itertools.product(range(3), repeat=n):
                for letters in itertools.product("DKR", repeat=n):
                    state, cost, ok = entry, 0, True
                    for k, letter in enumerate(letters):
                        for _ in range(inserts[k]):
                            state, cost = (3 if state == 2 else 2), cost + 5
                        step = {m[0]: m for m in cv.moves(state, initials[k], faults[k])}
                        if letter not in step:
                            ok = False
                            break
                        state, cost = step[letter][2], cost + step[letter][1]
                    if ok:
                        new = cost, "".join("I" * i + x for i, x in zip(inserts, letters))
                        best[state] = min(best.get(state, new), new)
            found = cv.search(initials, faults, entry)
            least = min(v[0] for v in best.values())
            assert found == {s: v for s, v in best.items() if v[0] <= least + cv.SLACK}


def test_audits_have_the_shape():
    pick = random.Random(8)
    for _ in range(300):
        n = pick.randrange(1, 30)
        initials, faults = "".join(pick.choice("uuaas") for _ in range(n)), "".join(pick.choice("-----tbd") for _ in range(n))
        chain = cv.Chain()
        table = cv.search(initials, faults, 0)
        ranks = sorted(a for _, a in table.values())
        chain.add(0, [table.get(x, (-1, ""))[0] for x in range(16)], [ranks.index(table[x][1]) if x in table else -1 for x in range(16)])
        (_, k, tail), = chain.path()
        roles = [{"u": "user", "a": "assistant", "s": "system"}[c] for c in initials]
        left = cv.apply(0, table[k % 4][1] + tail, roles, [""] * n)
        assert SHAPE.fullmatch("".join(r[0] for _, r, _ in left))

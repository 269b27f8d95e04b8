"""Conversation structure repair: the cheapest edits that make a conversation alternate, by depth-first branch-and-bound."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadlake.plans.scratch import cut

#: Costs of the edits; a truncated message that stays costs TRUNCATED more.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: A block holds so many messages, or so many characters of text, at most; a longer message is a block of its own.
BLOCK_ROWS, BLOCK_CHARS = 256, 1 << 20
SPACE, ENDS = "\x20\x09\x0a\x0b\x0c\x0d", ".!?"
#: What stands behind: nothing (0), a system message (1), a user's (2), an assistant's (3). A conversation may end in 0 or 3.
STATES = range(4)
TAIL = ["", "II", "I", ""]
#: A path that costs over SLACK more than another one out of the same block is beaten whatever follows: two inserted
#: messages and the deletion of a system message lead from any state to what another state allows.
SLACK = 2 * INSERT + DELETE
SOLVED = 1 << 14


def damage(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copy): messages harmed by the remainder of crc32("conv_id:turn") modulo 20.

    0 drops the row, 1 empties its text, 2 takes ``.!?`` out of it, 3 repeats it, 4 makes it a user's. Null roles and texts,
    and null ids and turns inside the key, read as one space.
    """
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.pmod(F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")), F.lit(20))
    text = F.when(kind == 1, F.lit("")).when(kind == 2, F.regexp_replace(part("text"), "[.!?]", "")).otherwise(part("text"))
    rows = conversations.select("conv_id", "turn", F.when(kind == 4, F.lit("user")).otherwise(part("role")).alias("role"), text.alias("text"),
                                kind.alias("kind"))
    copies = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.filter("kind <> 0").select("conv_id", "turn", "role", "text", F.explode(copies).alias("copy"))


# ---- blocks of messages in order ----------------------------------------------------------------

def _initial(role: str) -> str:
    return role[0] if role[:1] in ("s", "u", "a") else "x"


def _fault(text: str) -> str:
    """b for blank, t for truncated, - for neither."""
    said = text.rstrip(SPACE)
    return "b" if not said else "-" if said[-1] in ENDS else "t"


def blocks(messages: DataFrame) -> DataFrame:
    """Runs of one conversation's messages in order of turn (nulls first), role, digest of the text.

    A range sort over all of these and a row number deals the messages out, so that a conversation of any length spreads over
    tasks. ``block`` numbers the runs in order; ``opens`` says that a run is certainly the first of its conversation.
    """
    kind = messages.schema["conv_id"].dataType.simpleString()
    rows = messages.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    digest = F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary")))
    rows = rows.withColumns({"h": digest, "n": F.monotonically_increasing_id()})
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("h"), F.col("n")]
    names = ["conv_id", "block", "opens", "low", "high", "turns", "initials", "faults", "roles", "texts", "digests"]
    types = [None, pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.string()), pa.list_(pa.string()), pa.list_(pa.binary())]

    def run(batches):
        at, seen, opens, sid, held, chars = TaskContext.get().partitionId() << 32, False, False, None, [], 0
        id_type = None

        def close():
            nonlocal at, held, chars
            turns = [t for t, *_ in held if t is not None]
            row = [sid, at, opens, turns[0] if turns else None, turns[-1] if turns else None, len(set(turns)), "".join(_initial(r) for _, r, _, _ in held),
                   "".join(_fault(t) for _, _, t, _ in held), [r for _, r, _, _ in held], [t for _, _, t, _ in held], [h for _, _, _, h in held]]
            at, held, chars = at + 1, [], 0
            return pa.RecordBatch.from_arrays([pa.array([v], t or id_type) for v, t in zip(row, types)], names=names)

        for batch in batches:
            id_type = batch.schema.field(0).type
            for i, turn, role, text, h in zip(*(batch.column(c).to_pylist() for c in range(5))):
                if held and i != sid:
                    yield close()
                    opens, seen = True, True
                elif held and (len(held) >= BLOCK_ROWS or chars + len(text) > BLOCK_CHARS):
                    yield close()
                    opens = False
                sid = i
                held.append((turn, role, text, h))
                chars += len(text)
        if held:
            yield close()

    schema = f"conv_id {kind}, block long, opens boolean, low long, high long, turns long, initials string, faults string, roles array<string>, texts array<string>, digests array<binary>"
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "turn", "role", "text", "h").mapInArrow(run, schema)


def first_sayings(runs: DataFrame) -> DataFrame:
    """(block, firsts): places of a block at which a role and text come up for the first time in the conversation."""
    said = runs.select("conv_id", "block", F.posexplode("digests").alias("i", "h"))
    first = said.groupBy("conv_id", "h").agg(F.min(F.struct("block", "i")).alias("f")).select("f.block", "f.i")
    return first.groupBy("block").agg(F.collect_list("i").alias("firsts"))  # at most BLOCK_ROWS


# ---- the search ---------------------------------------------------------------------------------

def moves(state: int, initial: str, fault: str) -> list[tuple[str, int, int]]:
    """(letter, cost, next state) of the edits that may be done to a message; letters in ASCII order."""
    out = [("D", DELETE, state)]
    if fault in "bd":
        return out
    extra = TRUNCATED if fault == "t" else 0
    to = 3 if state == 2 else 2
    if initial == "s" and state == 0:
        out.append(("K", extra, 1))
    elif initial == "ua"[to - 2]:
        out.append(("K", extra, to))
    return [*out, ("R", REROLE + extra, to)]


def suffix_bounds(initials: str, faults: str) -> list[list[int]]:
    """Lower bounds of what the messages from each place on cost, with an assistant not due (0) or due (1).

    The bound is the cost of a laxer task: system messages may stand wherever no assistant is due, and any end is allowed.
    """
    out = [[0, 0]]
    for c, f in zip(reversed(initials), reversed(faults)):
        after, row = out[-1], []
        for due in (0, 1):
            cheap = DELETE + after[due]
            if f not in "bd":
                extra = TRUNCATED if f == "t" else 0
                cheap = min(cheap, REROLE + extra + after[1 - due])
                if c == "ua"[due]:
                    cheap = min(cheap, extra + after[1 - due])
                if c == "s" and not due:
                    cheap = min(cheap, extra + after[0])
            row.append(cheap)
        out.append([min(row[0], INSERT + row[1]), min(row[1], INSERT + row[0])])
    return out[::-1]


def search(initials: str, faults: str, entry: int) -> dict[int, tuple[int, str]]:
    """Least (cost, audit) from the entry state through all messages, by exit state.

    Depth first on an explicit stack. A node is (messages done, state); its table entry holds the best (cost, audit) of all
    prefixes that reached it, and prefixes no better are cut. So are those whose cost and suffix bound exceed the incumbent
    by more than SLACK: such an exit can win nowhere. Messages are inserted before one of the block, so an audit ends with a
    letter of the last message and none is the beginning of another.
    """
    n, bounds = len(initials), suffix_bounds(initials, faults)
    table: list[tuple[int, str] | None] = [None] * (4 * n + 4)
    found: dict[int, tuple[int, str]] = {}
    incumbent = None
    stack = [(0, entry, 0, "")]
    while stack:
        i, state, cost, audit = stack.pop()
        if incumbent is not None and cost + bounds[i][state == 2] > incumbent + SLACK:
            continue
        known = table[4 * i + state]
        if known is not None and known <= (cost, audit):
            continue
        table[4 * i + state] = cost, audit
        if i == n:
            found[state] = cost, audit
            incumbent = cost if incumbent is None else min(incumbent, cost)
            continue
        step = [(cost + c + bounds[i + 1][to == 2], letter, i + 1, to, cost + c) for letter, c, to in moves(state, initials[i], faults[i])]
        to = 3 if state == 2 else 2
        step.append((cost + INSERT + bounds[i][to == 2], "I", i, to, cost + INSERT))
        for _, letter, j, to, c in sorted(step, reverse=True):
            stack.append((j, to, c, audit + letter))
    return {x: v for x, v in found.items() if v[0] <= incumbent + SLACK}


def solve(runs: DataFrame) -> DataFrame:
    """(conv_id, block, faults, costs, ranks, audits) of blocks joined with their ``firsts``.

    The arrays have 16 entries, 4 * entry + exit; cost -1 marks one that cannot win. Ranks order the audits of a block.
    """
    kind = runs.schema["conv_id"].dataType.simpleString()

    def run(batches):
        solved: dict = {}
        for batch in batches:
            marks, costs, ranks, audits = [], [], [], []
            cols = [batch.column(c).to_pylist() for c in ("opens", "initials", "faults", "firsts")]
            for opens, initials, faults, firsts in zip(*cols):
                firsts = set(firsts or ())
                faults = "".join(f if f == "b" or i in firsts else "d" for i, f in enumerate(faults))
                key = opens, initials, faults
                if key not in solved:
                    if len(solved) > SOLVED:
                        solved.clear()
                    table = {4 * e + x: v for e in (STATES[:1] if opens else STATES) for x, v in search(initials, faults, e).items()}
                    place = {a: r for r, a in enumerate(sorted({a for _, a in table.values()}))}
                    got = [table.get(k, (-1, "")) for k in range(16)]
                    solved[key] = [c for c, _ in got], [place.get(a, -1) for _, a in got], [a for _, a in got]
                marks.append(faults)
                for out, v in zip((costs, ranks, audits), solved[key]):
                    out.append(v)
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("block"), pa.array(marks, pa.string()), pa.array(costs, pa.list_(pa.int32())),
                                              pa.array(ranks, pa.list_(pa.int32())), pa.array(audits, pa.list_(pa.string()))],
                                             names=["conv_id", "block", "faults", "costs", "ranks", "audits"])

    return runs.mapInArrow(run, f"conv_id {kind}, block long, faults string, costs array<int>, ranks array<int>, audits array<string>")


class Chain:
    """Best paths through a conversation's blocks so far: per state (cost, rank among the states), and the choices made."""

    def __init__(self):
        self.live = {0: (0, 0)}
        self.blocks: list[int] = []
        self.from_ = bytearray()

    def add(self, block: int, costs: list[int], ranks: list[int]) -> None:
        best = {}
        for m, (cost, rank) in self.live.items():
            for x in STATES:
                k = 4 * m + x
                if costs[k] >= 0:
                    best[x] = min(best.get(x, (1 << 62, 0, 0, 0)), (cost + costs[k], rank, ranks[k], m))
        least = min(v[0] for v in best.values())
        best = {x: v for x, v in best.items() if v[0] <= least + SLACK}
        order = sorted(best, key=lambda x: best[x][1:3])
        self.live = {x: (best[x][0], r) for r, x in enumerate(order)}
        self.blocks.append(block)
        self.from_ += bytes(best[x][3] if x in best else 4 for x in STATES)

    def path(self) -> list[tuple[int, int, str]]:
        """(block, 4 * entry + exit, letters behind its messages), last block first."""
        x = min(self.live, key=lambda s: (self.live[s][0] + INSERT * len(TAIL[s]), self.live[s][1]))
        out, tail = [], TAIL[x]
        for k in range(len(self.blocks) - 1, -1, -1):
            m = self.from_[4 * k + x]
            out.append((self.blocks[k], 4 * m + x, tail))
            x, tail = m, ""
        return out


def choose(solved: DataFrame) -> DataFrame:
    """(block, pick, tail): the entry and exit of each block on the cheapest path of its conversation.

    Blocks of a conversation pass one task in order as 16 costs and ranks each; four bytes a block are kept.
    """
    def run(batches):
        chain, sid = None, None
        for batch in batches:
            out = []
            for i, block, costs, ranks in zip(*(batch.column(c).to_pylist() for c in range(4))):
                if chain is None or i != sid:
                    out += chain.path() if chain else []
                    chain, sid = Chain(), i
                chain.add(block, costs, ranks)
            yield from rows(out)
        if chain:
            yield from rows(chain.path())

    def rows(out):
        for at in range(0, len(out), 10_000):
            b, p, t = zip(*out[at:at + 10_000])
            yield pa.RecordBatch.from_arrays([pa.array(b, pa.int64()), pa.array(p, pa.int32()), pa.array(t, pa.string())], names=["block", "pick", "tail"])

    links = solved.select("conv_id", "block", "costs", "ranks").repartition("conv_id").sortWithinPartitions("conv_id", "block")
    return links.mapInArrow(run, "block long, pick int, tail string")


# ---- results ------------------------------------------------------------------------------------

def repair(messages: DataFrame) -> DataFrame:
    """Blocks of messages with their edits: conv_id, block, low, high, turns, initials, roles, texts, faults, entry, audit, cost.

    ``messages`` has conv_id, turn, role, text; other columns are not looked at. The messages of a conversation stand in order
    of turn (nulls first), then role, then a digest of the text; a null conv_id is a conversation like others, null roles and
    texts read as one space. A message is blank without a character besides white space, else a duplicate if its role and text
    came earlier in the conversation, else truncated if its last such character is none of ``.!?``; ``faults`` marks these b, d,
    t. ``audit`` has a letter for each edit, the cheapest ones that leave initials of the form (s?(ua)+)?, and the least in ASCII
    order among those; ``cost`` is their cost. An empty table gives no rows. ``repaired`` lists the messages that result.
    """
    runs = cut(blocks(messages), "turns")
    known = runs.select("conv_id", "block", "opens", "initials", "faults").join(first_sayings(runs), "block", "left")
    solved = cut(solve(known), "edits")
    picked = solved.join(choose(solved), "block").select(
        "block", "faults", F.floor(F.col("pick") / 4).cast("int").alias("entry"), F.concat(F.element_at("audits", F.col("pick") + 1), "tail").alias("audit"),
        (F.element_at("costs", F.col("pick") + 1) + INSERT * F.length("tail")).alias("cost"))
    return runs.drop("digests", "opens", "faults").join(picked, "block")


def apply(entry: int, audit: str, roles: list[str], texts: list[str]) -> list[tuple[str, str, str]]:
    """(edit, role, text) of the messages that the edits of a block leave."""
    out, at, due = [], 0, "assistant" if entry == 2 else "user"
    for letter in audit:
        if letter == "I":
            out.append((letter, due, ""))
        else:
            if letter != "D":
                out.append((letter, due if letter == "R" else roles[at], texts[at]))
            at += 1
        if letter != "D":
            due = "assistant" if _initial(out[-1][1]) == "u" else "user"
    return out


def repaired(repairs: DataFrame) -> DataFrame:
    """(conv_id, block, place, edit, role, text): the messages of the repaired conversations; edit is K, R or I."""
    kind = repairs.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "block", "place", "edit", "role", "text"]

    def run(batches):
        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("entry", "audit", "roles", "texts")]
            for k, row in enumerate(zip(*cols)):
                left = apply(*row)
                if left:
                    edit, role, text = (pa.array(v, pa.string()) for v in zip(*left))
                    one = pa.array([k] * len(left))
                    yield pa.RecordBatch.from_arrays([batch.column("conv_id").take(one), batch.column("block").take(one),
                                                      pa.array(range(len(left)), pa.int32()), edit, role, text], names=names)

    return repairs.mapInArrow(run, f"conv_id {kind}, block long, place int, edit string, role string, text string")


class Digest:
    """Figures of one conversation, summed up block by block."""

    def __init__(self):
        self.low = self.high = self.before = None
        self.turns = self.illegal = self.cost = 0
        self.faults = dict.fromkeys("bdt", 0)
        self.audit, self.hash, self.any = [], hashlib.sha256(), False

    def add(self, low, high, turns, initials, faults, audit, cost, entry, roles, texts) -> None:
        if turns:
            self.turns += turns - (self.high == low)
            self.low, self.high = low if self.low is None else self.low, high
        pairs = (self.before or "") + initials
        self.illegal += sum(pairs[i:i + 2] not in ("su", "ua", "au") for i in range(len(pairs) - 1))
        self.before = initials[-1]
        for f in self.faults:
            self.faults[f] += faults.count(f)
        self.cost += cost
        self.audit.append(audit)
        for _, role, text in apply(entry, audit, roles, texts):
            self.hash.update(("\n" * self.any + role + ":" + text).encode("utf-8", "surrogatepass"))
            self.any = True

    def row(self) -> list:
        gaps = self.high - self.low + 1 - self.turns if self.turns else 0
        return [gaps, *self.faults.values(), self.illegal, self.cost, "".join(self.audit), self.hash.hexdigest()]


def digest(repairs: DataFrame, ids: DataFrame) -> DataFrame:
    """One row per conv_id of ``ids``: gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    A digest of a whole text is taken from its beginning to its end, so the blocks of a conversation pass one task in order;
    it holds one batch of them and the audit, which is a value of the result. Ids without messages get zeros.
    """
    kind = ids.schema["conv_id"].dataType.simpleString()
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    fields = ["low", "high", "turns", "initials", "faults", "audit", "cost", "entry", "roles", "texts"]

    def run(batches):
        state, sid, id_type = None, None, None
        for batch in batches:
            done, id_type = [], batch.schema.field(0).type
            for i, block, *values in zip(*(batch.column(c).to_pylist() for c in ["conv_id", "block", *fields])):
                if state is None or i != sid:
                    done += [(sid, *state.row())] if state else []
                    state, sid = Digest(), i
                if block >= 0:
                    state.add(*values)
            yield from rows(done, id_type)
        if state:
            yield from rows([(sid, *state.row())], id_type)

    def rows(done, id_type):
        if done:
            cols = list(zip(*done))
            types = [id_type, *[pa.int64()] * 6, pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["conv_id", *numbers, "audit", "repaired_sha256"])

    marks = ids.select("conv_id").distinct().withColumn("block", F.lit(-1).cast("long"))
    both = repairs.select("conv_id", "block", *fields).unionByName(marks, allowMissingColumns=True)
    both = both.repartition("conv_id").sortWithinPartitions("conv_id", "block")
    return both.mapInArrow(run, f"conv_id {kind}, {', '.join(f'{n} long' for n in numbers)}, audit string, repaired_sha256 string")

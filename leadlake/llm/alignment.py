"""Tokens of two tokenizers aligned at the byte offsets where both end, as Arrow columns inside tasks."""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadlake.llm.encoders import PairCache, byte_letters, text_runs
from leadlake.plans.scratch import cut

A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Pairs that one Acero join makes at most, unless one token of a group has more partners.
JOIN_PAIRS = 1 << 21
#: Links of a group that are laid out without counting its ids first.
FEW = 64


def byte_level_entries(path: str) -> list[bytes]:
    """Bytes of each id of a byte-level tokenizer file."""
    letters = byte_letters()
    with open(path, encoding="utf-8") as f:
        whole = json.load(f)
    out = [b""] * (1 + max([*whole["model"]["vocab"].values(), *(t["id"] for t in whole["added_tokens"])]))
    for entry, i in whole["model"]["vocab"].items():
        out[i] = bytes(letters[c] for c in entry) if all(c in letters for c in entry) else entry.encode()
    return out


def piece_entries(model) -> list[bytes]:
    """Bytes of each piece of a sentencepiece model."""
    return [bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace("▁", " ").encode()
            for i in range(model.get_piece_size())]


class Pair:
    """Both tokenizers with the bytes, sizes and names of their ids."""

    known: dict[tuple[str, str], Pair] = {}

    def __init__(self, a_path: str, b_path: str):
        self.cache = PairCache(a_path, b_path)
        self.entries = [pa.array(e, pa.binary()) for e in (byte_level_entries(a_path), piece_entries(self.cache.pieces))]
        self.names = [pa.array([str(i) for i in range(len(e))]) for e in self.entries]

    @classmethod
    def of(cls, a_path: str, b_path: str) -> Pair:
        """One per worker, kept over its tasks."""
        if (a_path, b_path) not in cls.known:
            cls.known[a_path, b_path] = cls(a_path, b_path)
        return cls.known[a_path, b_path]

    def encode(self, texts: list[bytes]) -> list[pa.ListArray]:
        """Ids of both tokenizers as Arrow lists, one list a text."""
        sides = self.cache.encode([b" " + t if t else b"" for t in texts])
        return [pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(ids.astype(np.int32))) for ids, first in sides]


class Side:
    """One tokenizer's tokens of a run of texts: flat ids, parent text, end offset in the text, group."""

    def __init__(self, lists: pa.ListArray, entries: pa.Array):
        self.ids, self.doc = pc.list_flatten(lists), pc.list_parent_indices(lists)
        spelled = pc.take(entries, self.ids)
        self.counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
        total = pc.cumulative_sum(pc.binary_length(spelled).cast(pa.int64())).to_numpy()
        first = np.cumsum(self.counts) - self.counts
        self.starts = np.concatenate(([0], total))[first]  # bytes before each text
        self.ends = pc.subtract(pa.array(total), pc.take(pa.array(self.starts), self.doc))
        self.buffer = spelled.buffers()[2]

    def bytes_of(self, k: int) -> bytes:
        to = self.starts[k + 1] if k + 1 < len(self.starts) else (self.buffer.size if self.buffer else 0)
        return self.buffer.slice(self.starts[k], to - self.starts[k]).to_pybytes() if self.buffer and to > self.starts[k] else b""

    def keep(self, good: np.ndarray) -> None:
        """Drop the tokens of texts that do not take part."""
        if not good.all():
            mask = pc.take(pa.array(good), self.doc)
            self.ids, self.doc, self.ends = (pc.filter(c, mask) for c in (self.ids, self.doc, self.ends))
            self.counts = np.where(good, self.counts, 0)

    def ends_table(self, name: str) -> pa.Table:
        """(key, place): each token's text and end as one number, and its place."""
        return pa.table({"key": pc.bit_wise_or(pc.shift_left(self.doc.cast(pa.int64()), 40), self.ends), name: pa.array(np.arange(len(self.ids)))})

    def cut(self, places: np.ndarray) -> None:
        """Groups end with the tokens at these places."""
        last = np.zeros(len(self.ids), np.int64)
        last[places] = 1
        self.group = np.cumsum(last) - last
        self.first = np.concatenate(([0], np.flatnonzero(last) + 1)).astype(np.int64)  # of each group, and one more

    def tally(self, name: str, groups: np.ndarray) -> pa.Table:
        """(group, id, number) of the distinct ids of some groups."""
        mine = groups[self.group]
        some = pa.table({"group": self.group[mine], name: self.ids.filter(pa.array(mine))})
        return some.group_by(["group", name], use_threads=False).aggregate([([], "count_all")]).rename_columns(["group", name, f"n_{name}"])

    def spelt(self, names: pa.Array) -> pa.Array:
        """Ids of each group, joined by commas."""
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(self.first.astype(np.int32)), pc.take(names, self.ids)), ",")


def linked(a: Side, b: Side, width: int, height: int) -> pa.Table:
    """(key, links): distinct id pairs of each text as doc * height * width + a * width + b, with their linked occurrences.

    The links of a group are laid out one by one where it has few; ids of a group with many are counted first, and the
    distinct ones joined, a bounded number of pairs at a time.
    """
    sizes = np.diff(a.first), np.diff(b.first)
    many = sizes[0] * sizes[1]
    owner = a.doc.to_numpy()[a.first[:-1]].astype(np.int64)
    key = lambda g, x, y: (owner[g] * height + x) * width + y
    few = np.flatnonzero(many <= FEW)
    group = np.repeat(few, many[few])
    link = np.arange(len(group)) - np.repeat(np.cumsum(many[few]) - many[few], many[few])
    left, right = np.divmod(link, sizes[1][group])
    keys = key(group, a.ids.to_numpy()[a.first[group] + left], b.ids.to_numpy()[b.first[group] + right])
    out = [pa.table({"key": keys}).group_by("key", use_threads=False).aggregate([([], "count_all")]).rename_columns(["key", "links"])]
    if (many > FEW).any():
        left, right = (s.tally(n, many > FEW).sort_by("group") for s, n in ((a, "a"), (b, "b")))
        groups, of = left["group"].to_numpy(), right["group"].to_numpy()
        low, high = np.searchsorted(of, groups), np.searchsorted(of, groups, side="right")
        upto, at = np.cumsum(high - low), 0
        while at < len(groups):
            to = max(int(np.searchsorted(upto, (upto[at - 1] if at else 0) + JOIN_PAIRS, side="right")), at + 1)
            both = left.slice(at, to - at).join(right.slice(low[at], high[to - 1] - low[at]), "group", join_type="inner", use_threads=False)
            keys = key(both["group"].to_numpy(), both["a"].to_numpy(), both["b"].to_numpy())
            both = pa.table({"key": keys, "links": pc.multiply(both["n_a"], both["n_b"])})
            out.append(both.group_by("key", use_threads=False).aggregate([("links", "sum")]).rename_columns(["key", "links"]))
            at = to
        return pa.concat_tables(out).group_by("key", use_threads=False).aggregate([("links", "sum")]).rename_columns(["key", "links"])
    return out[0]


def align(pair: Pair, texts: list[bytes], keep_groups: bool = False) -> tuple[pa.Table, pa.Table]:
    """For a run of texts: (n_a, n_b, n_groups, n_links, groups_sha256) by text, and (doc, pair, links) of their distinct pairs.

    The digest is of the ids spelt ``a1,a2|b1;a3|b2,b3``; with ``keep_groups`` there is a column of these, too. A pair is a * (size of B) + b. A text takes part if both tokenizers'
    bytes are a blank and the text.
    """
    a, b = (Side(ids, entries) for ids, entries in zip(pair.encode(texts), pair.entries))
    good = np.array([bool(t) and a.bytes_of(k) == b" " + t == b.bytes_of(k) for k, t in enumerate(texts)], bool)
    a.keep(good)
    b.keep(good)
    common = a.ends_table("a").join(b.ends_table("b"), "key", join_type="inner", use_threads=False)
    a.cut(common["a"].to_numpy())
    b.cut(common["b"].to_numpy())
    height, width = map(len, pair.entries)
    pairs = linked(a, b, width, height)
    doc, id_pair = np.divmod(pairs["key"].to_numpy(), height * width)
    links = pairs["links"].to_numpy()
    n_groups = np.bincount((common["key"].to_numpy() >> 40).astype(np.int64), minlength=len(texts))
    one = pc.binary_join_element_wise(a.spelt(pair.names[0]), b.spelt(pair.names[1]), "|")
    at = np.concatenate(([0], np.cumsum(n_groups))).astype(np.int32)
    spelt = pc.binary_join(pa.ListArray.from_arrays(pa.array(at), one), ";")
    sums = [hashlib.sha256(g.as_buffer()).hexdigest() if n else "" for g, n in zip(spelt, n_groups)]
    n_links = np.zeros(len(texts), np.int64)
    np.add.at(n_links, doc, links)
    rows = pa.table({"n_a": a.counts.astype(np.int64), "n_b": b.counts.astype(np.int64), "n_groups": n_groups.astype(np.int64), "n_links": n_links, "groups_sha256": sums})
    if keep_groups:
        rows = rows.append_column("groups", spelt)
    return rows, pa.table({"doc": doc.astype(np.int32), "pair": id_pair, "links": links})


# ---- over Spark -----------------------------------------------------------------------------------

#: Text bytes whose distinct pairs are counted together before they are sent.
UNIT_BYTES = 16 << 20
FIGURES = ["n_a", "n_b", "n_groups", "n_links"]


def align_documents(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", unit_bytes: int = UNIT_BYTES,
                    keep_groups: bool = False) -> DataFrame:
    """One row per text and, with a null ``row``, one per unit of texts.

    Texts: unit, row, doc_id, n_a, n_b, n_groups, n_links, groups_sha256 (and with ``keep_groups`` the groups spelt out),
    places and links: the text's distinct id pairs, as places in the list of its unit, and how often each is linked. Units:
    pairs, a * (size of B) + b in order, and docs, in how many of the unit's texts each is linked.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["unit", "row", "doc_id", *FIGURES, "groups_sha256", *["groups"] * keep_groups, "places", "links", "pairs", "docs"]
    kinds = ["long", "long", kind, *["long"] * 4, "string", *["string"] * keep_groups, "array<int>", "array<long>", "array<long>", "array<long>"]

    def run(batches):
        pa.set_cpu_count(1)
        pair, unit, row, held, size = Pair.of(a_path, b_path), TaskContext.get().partitionId() << 32, 0, [], 0
        for batch in batches:
            for at, texts in text_runs(batch.column(1)):
                rows, found = align(pair, texts, keep_groups)
                held.append((batch.column(0).slice(at, len(texts)), rows, found))
                size += sum(map(len, texts))
                if size >= unit_bytes:
                    yield from close(unit, row, held)
                    unit, row, held, size = unit + 1, row + sum(len(h[0]) for h in held), [], 0
        if held:
            yield from close(unit, row, held)

    def lists(doc, values, n, of):
        at = np.searchsorted(doc, np.arange(n + 1)).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(at), pa.array(values, of))

    def close(unit, row, held):
        # Distinct pairs of the texts so far, counted by texts; a text's own pairs refer to this list.
        whole = pa.concat_tables(found.select(["pair"]) for _, _, found in held)
        total = whole.group_by("pair", use_threads=False).aggregate([([], "count_all")]).sort_by("pair")
        pairs = total["pair"].to_numpy()
        for ids, rows, found in held:
            n = len(ids)
            doc, links = found["doc"].to_numpy(), found["links"].to_numpy()
            place = np.searchsorted(pairs, found["pair"].to_numpy())
            order = np.lexsort((place, doc))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, unit)), pa.array(np.arange(row, row + n)), ids, *(rows[c].combine_chunks() for c in rows.column_names),
                 lists(doc[order], place[order], n, pa.int32()), lists(doc[order], links[order], n, pa.int64()),
                 pa.nulls(n, pa.list_(pa.int64())), pa.nulls(n, pa.list_(pa.int64()))], names=names)
            row += n
        one = [pa.array([unit]), pa.nulls(1, pa.int64()), pa.nulls(1, held[0][0].type), *[pa.nulls(1, pa.int64())] * 4, *[pa.nulls(1, pa.string())] * (1 + keep_groups),
               pa.nulls(1, pa.list_(pa.int32())), pa.nulls(1, pa.list_(pa.int64())), pa.array([pairs], pa.list_(pa.int64())),
               pa.array([total["count_all"].to_numpy()], pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(one, names=names)

    texts = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    return texts.mapInArrow(run, ", ".join(f"{n} {k}" for n, k in zip(names, kinds)))


def pair_counts(aligned: DataFrame, width: int) -> DataFrame:
    """(pair, a, b, docs): in how many texts of the corpus each id pair is linked."""
    parts = aligned.filter("row IS NULL").select(F.inline(F.arrays_zip("pairs", "docs")))
    return parts.groupBy(F.col("pairs").alias("pair")).agg(F.sum("docs").alias("docs")).select(
        "pair", F.expr(f"cast(pair div {width} as int)").alias("a"), F.expr(f"cast(pair % {width} as int)").alias("b"), "docs")


def agreement(docs: DataFrame, a_path: str, b_path: str, **options) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256[, groups]), one row per input row.

    Each text is encoded by the byte-level tokenizer at ``a_path``, with a blank before it, and by the pieces at ``b_path``,
    which add that blank; offsets where tokens of both end cut them into groups, and all pairs of an A and a B token of a
    group are linked. A pair of ids counts the texts of the corpus in which it is linked. ``n_best`` is the number of links
    whose count is the highest of their A id, ties included; ``count_sum`` sums the counts over the links. Null and empty
    texts, and those that the tokens of either do not spell byte by byte, have no tokens: zeros and an empty string. Repeated
    rows count each; other columns are not looked at. An empty table gives no rows.

    Tasks count the pairs of a unit of texts; Spark adds the counts up, finds the highest of each A id (at most one row
    per id of the vocabulary, broadcast) and sends each unit the answers to its own pairs.
    """
    width = piece_count(b_path)
    aligned = cut(align_documents(docs, a_path, b_path, **options), "aligned")
    counts = cut(pair_counts(aligned, width), "pair-counts")
    best = F.broadcast(counts.groupBy("a").agg(F.max("docs").alias("top")))  # at most one row per id of A
    judged = counts.join(best, "a").select(F.col("pair").alias("pairs"), "docs", (F.col("docs") == F.col("top")).alias("best"))
    asked = aligned.filter("row IS NULL").select("unit", F.explode("pairs").alias("pairs"))
    answers = asked.join(judged, "pairs").select(F.col("unit").alias("of"), "pairs", "docs", "best")
    keep = ["doc_id", *FIGURES, "groups_sha256", *["groups"] * ("groups" in aligned.columns)]
    texts = aligned.filter("row IS NOT NULL").select("unit", *keep, "places", "links")
    types = dict(aligned.dtypes)

    def look_up(texts: pa.Table, answers: pa.Table) -> pa.Table:
        answers = answers.sort_by("pairs")
        docs, best = answers["docs"].to_numpy(), answers["best"].to_numpy()
        place, links = (pc.list_flatten(texts[c]).to_numpy() for c in ("places", "links"))
        doc = pc.list_parent_indices(texts["places"].combine_chunks()).to_numpy()
        n = texts.num_rows
        n_best, total = np.zeros(n, np.int64), np.zeros(n, np.int64)
        np.add.at(n_best, doc, links * best[place])
        np.add.at(total, doc, links * docs[place])
        return texts.select(keep).append_column("n_best", pa.array(n_best)).append_column("count_sum", pa.array(total))

    schema = ", ".join(f"{c} {types[c]}" for c in keep) + ", n_best long, count_sum long"
    out = texts.groupBy("unit").cogroup(answers.groupBy("of")).applyInArrow(look_up, schema)
    return out.select("doc_id", *FIGURES, "n_best", "count_sum", *keep[5:])


def piece_count(path: str) -> int:
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=path).get_piece_size()

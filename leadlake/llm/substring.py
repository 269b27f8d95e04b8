"""Exact removal of repeated word windows, found through difference-cover anchors."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadlake.llm.common import U64, gram_hashes, spans, text_bytes, text_slices, units_for, within, word_hashes

WINDOW = 13


@lru_cache
def difference_cover(period: int) -> tuple[int, ...]:
    """Residues such that every difference modulo the period is one of two of them; smallest first, grown greedily."""
    cover, missing = [0], set(range(1, period))
    while missing:
        gain = {x: {(x - c) % period for c in cover} | {(c - x) % period for c in cover} for x in range(period) if x not in cover}
        best = max(gain, key=lambda x: (len(gain[x] & missing), -x))
        cover.append(best)
        missing -= gain[best]
    return tuple(sorted(cover))


#: Of a key, messages carry the lower 48 bits; the bucket tells of the upper ones. Of the other hash of a window they carry 32.
SENT = U64((1 << 48) - 1)


def _deal(keys: np.ndarray, parts: int):
    """(part, rows) for each part that gets any of the keys."""
    part = (keys >> U64(40)) % U64(parts)
    order = np.argsort(part, kind="stable")
    cuts = np.flatnonzero(np.diff(part[order])) + 1
    for rows in np.split(order, cuts) if len(order) else []:
        yield int(part[rows[0]]), rows


def _bytes_table(schema: list[tuple[str, pa.DataType]], rows: list[tuple]) -> pa.Table:
    cols = list(zip(*rows)) if rows else [[] for _ in schema]
    return pa.table([pa.array(c, t) for c, (_, t) in zip(cols, schema)], names=[n for n, _ in schema])


def _array(column, dtype) -> np.ndarray:
    return np.frombuffer(b"".join(x.as_py() for x in column), dtype=dtype)


def _pack(keys: np.ndarray) -> bytes:
    return np.ascontiguousarray(keys).view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _keys(column) -> np.ndarray:
    six = _array(column, np.uint8).reshape(-1, 6)
    out = np.zeros((len(six), 8), np.uint8)
    out[:, :6] = six
    return out.view(U64).ravel()


class _Words:
    """The word hashes of one unit's texts, slice by slice."""

    def __init__(self, table: pa.Table, window: int):
        self.table, self.window = table, window
        self.period = (window + 1) // 2
        self.anchor = window - self.period + 1
        self.ids = table.column("doc_id").to_numpy()

    def slices(self):
        for first, data, offsets in text_slices(self.table.column("text")):
            starts, ends, at = spans(data, offsets)
            yield first, data, starts, ends, at, word_hashes(data, starts, ends)

    def anchors(self, words: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first word, hash) of the windows at cover positions of their own document."""
        counts = np.diff(at)
        place = np.arange(at[-1]) - np.repeat(at[:-1], counts)
        on = np.zeros(self.period, dtype=bool)
        on[list(difference_cover(self.period))] = True
        keep = np.flatnonzero(on[place % self.period] & within(at, self.anchor))
        return keep, gram_hashes(words, self.anchor)[keep]

    def windows(self, data, starts, ends, at, words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first word, two hashes) of every whole window."""
        keep = np.flatnonzero(within(at, self.window))
        other = word_hashes(data, starts, ends, seed=12)
        return keep, gram_hashes(words, self.window)[keep], (gram_hashes(other, self.window, seed=12)[keep] >> U64(32)).astype(np.uint32)


def _unique(keys: np.ndarray, ids: np.ndarray, *more: np.ndarray):
    """Each key once with its smallest and largest id, and its values of ``more``."""
    order = np.lexsort((ids, keys))
    keys, ids = keys[order], ids[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.empty(0, np.int64)
    last = np.concatenate((first[1:], [len(keys)])) - 1 if len(keys) else first
    return keys[first], ids[first], ids[last], *(m[order][first] for m in more)


def remove_repeats(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept): each text without words that a window shares with a smaller id.

    A window is ``window`` consecutive words of one document; if its words also start in a document
    of smaller id, all its words go. With period p = (window + 1) / 2 and a difference cover modulo p,
    any two equal windows have, at one offset below p, cover positions in both, and the p or so words
    there are equal. So only the shorter windows at cover positions are hashed and shuffled at first:

    1. Texts are dealt into units by a hash of the id. Each unit sends every distinct anchor hash with
       its smallest id to a bucket of the hash; the bucket answers, to the units concerned, which
       anchors occur in more than one document.
    2. Anchors that answered are extended: the unit hashes (96 bits) the whole windows around them and
       sends each distinct one with its smallest id; the bucket answers with the smallest id of all.
    3. The unit removes the words of windows that start in a smaller id.

    A passage in a third of all documents costs one message per unit, not per document. The three
    steps read the same exchange of texts. Null and empty texts have no words and keep an empty string;
    rows with a null id are neither compared nor cut, rows of equal id do not cut each other; ids must
    be integers. Other columns are not looked at. An empty table gives no rows.
    """
    spark = docs.sparkSession
    units = units_for(spark, text_bytes(docs, text_col))
    buckets = units
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    texts = texts.withColumn("unit", F.pmod(F.xxhash64("doc_id"), F.lit(units)).cast("int"))
    message = [("bucket", pa.int32()), ("unit", pa.int32()), ("keys", pa.binary()), ("other", pa.binary()), ("ids", pa.binary()), ("many", pa.binary())]
    ddl = "bucket int, unit int, keys binary, other binary, ids binary, many binary"

    def send(unit, keys, other, low, high):
        rows = []
        for bucket, r in _deal(keys, buckets):
            r = r[np.argsort(low[r], kind="stable")]
            rows.append((bucket, unit, _pack(keys[r]), other[r].tobytes() if len(other) else b"", low[r].tobytes(), np.packbits(low[r] != high[r]).tobytes()))
        return _bytes_table(message, rows)

    def gather(parts):
        keys, ids = (np.concatenate(x) if x else np.empty(0, t) for x, t in zip(zip(*parts), (U64, np.int64))) if parts else (np.empty(0, U64), np.empty(0, np.int64))
        return keys, ids

    def anchors(table: pa.Table) -> pa.Table:
        known = table.filter(pa.compute.is_valid(table.column("doc_id")))
        w, parts = _Words(known, window), []
        for first, _, _, _, at, words in w.slices():
            keep, keys = w.anchors(words, at)
            ids = np.repeat(w.ids[first:first + len(at) - 1], np.diff(at))[keep]
            u = _unique(keys, ids)
            parts.append((np.concatenate((u[0], u[0][u[1] != u[2]])), np.concatenate((u[1], u[2][u[1] != u[2]]))))
        keys, ids = gather(parts)
        keys, low, high = _unique(keys, ids)
        return send(int(table.column("unit")[0].as_py()), keys, np.empty(0, np.uint32), low, high)

    def answer(table: pa.Table) -> pa.Table:
        """Which keys occur in several documents, and the smallest, to each unit that sent them.

        Of a whole window, a unit whose only document with it is the smallest needs no answer.
        """
        sizes = np.array([len(k.as_py()) // 6 for k in table.column("keys")])
        keys, ids = _keys(table.column("keys")), _array(table.column("ids"), np.int64)
        other = _array(table.column("other"), np.uint32)
        many = np.concatenate([np.unpackbits(np.frombuffer(m.as_py(), np.uint8), count=n) for m, n in zip(table.column("many"), sizes)])
        unit = np.repeat(table.column("unit").to_numpy(), sizes)
        order = np.lexsort((other, keys)) if len(other) else np.argsort(keys, kind="stable")
        k = keys[order]
        new = np.concatenate(([True], k[1:] != k[:-1])) if len(k) else np.empty(0, bool)
        if len(other):
            o = other[order]
            new[1:] |= o[1:] != o[:-1]
        first = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        low = np.minimum.reduceat(ids[order], first) if len(k) else ids
        high = np.maximum.reduceat(ids[order], first) if len(k) else ids
        shared = (low != high) | (np.maximum.reduceat(many[order], first) > 0) if len(k) else np.empty(0, bool)
        wanted = shared[group] if len(k) else np.empty(0, bool)
        if len(other):
            wanted &= (low[group] < ids[order]) | (many[order] > 0)
        pick = np.flatnonzero(wanted)
        pick = pick[np.lexsort((low[group[pick]], unit[order[pick]]))]
        rows, to = [], unit[order[pick]]
        for r in np.split(pick, np.flatnonzero(np.diff(to)) + 1) if len(pick) else []:
            rows.append((0, int(unit[order[r[0]]]), _pack(k[r]), other[order[r]].tobytes() if len(other) else b"", low[group[r]].tobytes(), b""))
        return _bytes_table(message, rows)

    def extend(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows or not answers.num_rows:
            return _bytes_table(message, [])
        known = table.filter(pa.compute.is_valid(table.column("doc_id")))
        shared = np.sort(_keys(answers.column("keys")))
        w, parts = _Words(known, window), []
        for first, data, starts, ends, at, words in w.slices():
            keep, keys = w.anchors(words, at)
            hit = keep[_member(keys & SENT, shared)]
            if not len(hit):
                continue
            near = np.zeros(len(words) + 1, dtype=np.int64)  # window starts from which a window covers a shared anchor
            np.add.at(near, np.maximum(hit - (window - w.anchor), 0), 1)
            np.add.at(near, hit + 1, -1)
            near = np.cumsum(near)[:-1] > 0
            start, a, b = w.windows(data, starts, ends, at, words)
            on = near[start]
            ids = np.repeat(w.ids[first:first + len(at) - 1], np.diff(at))[start]
            parts.append((a[on], b[on], ids[on]))
        if not parts:
            return _bytes_table(message, [])
        a, b, ids = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((ids, b, a))
        a, b, ids = a[order], b[order], ids[order]
        first = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))) if len(a) else np.empty(0, np.int64)
        last = np.concatenate((first[1:], [len(a)])) - 1 if len(a) else first
        return send(int(table.column("unit")[0].as_py()), a[first], b[first], ids[first], ids[last])

    def drop(table: pa.Table, answers: pa.Table) -> pa.Table:
        n = table.num_rows
        w = _Words(table, window)
        valid = np.asarray(pa.compute.is_valid(table.column("doc_id")))
        if not n:
            return pa.table({"doc_id": pa.array([], pa.int64()), "n_words": pa.array([], pa.int64()), "n_removed": pa.array([], pa.int64()), "kept": pa.array([], pa.string())})
        a0, b0, low = _keys(answers.column("keys")), _array(answers.column("other"), np.uint32), _array(answers.column("ids"), np.int64)
        order = np.argsort(a0, kind="stable")
        a0, b0, low = a0[order], b0[order], low[order]
        n_words, n_removed, kept = np.zeros(n, np.int64), np.zeros(n, np.int64), [""] * n
        for first, data, starts, ends, at, words in w.slices():
            rows = len(at) - 1
            gone = np.zeros(len(words) + 1, dtype=np.int64)
            if len(a0) and len(words):
                start, a, b = w.windows(data, starts, ends, at, words)
                doc = np.repeat(np.arange(rows), np.diff(at))[start]
                which = _find(a & SENT, b, a0, b0)
                bad = (which >= 0) & valid[first + doc]
                bad[bad] = low[which[bad]] < w.ids[first + doc[bad]]
                np.add.at(gone, start[bad], 1)
                np.add.at(gone, start[bad] + window, -1)
            gone = np.cumsum(gone)[:-1] > 0
            n_words[first:first + rows] = np.diff(at)
            left = np.concatenate(([0], np.cumsum(gone)))
            n_removed[first:first + rows] = left[at[1:]] - left[at[:-1]]
            raw = data.tobytes()
            for i in range(rows):
                s, e, g = starts[at[i]:at[i + 1]], ends[at[i]:at[i + 1]], gone[at[i]:at[i + 1]]
                kept[first + i] = b" ".join([raw[x:y] for x, y in zip(s[~g].tolist(), e[~g].tolist())]).decode()
        return pa.table({"doc_id": table.column("doc_id"), "n_words": n_words, "n_removed": n_removed, "kept": pa.array(kept, pa.string())})

    asked = texts.groupBy("unit").applyInArrow(anchors, ddl)
    told = asked.groupBy("bucket").applyInArrow(answer, ddl)
    asked = texts.groupBy("unit").cogroup(told.groupBy("unit")).applyInArrow(extend, ddl)
    told = asked.groupBy("bucket").applyInArrow(answer, ddl)
    return texts.groupBy("unit").cogroup(told.groupBy("unit")).applyInArrow(drop, "doc_id long, n_words long, n_removed long, kept string")


def _member(keys: np.ndarray, among: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(among, keys), len(among) - 1)
    return among[at] == keys


def _find(a: np.ndarray, b: np.ndarray, a0: np.ndarray, b0: np.ndarray) -> np.ndarray:
    """Where the pair (a, b) stands among the pairs (a0, b0), which are sorted by a0; -1 if nowhere."""
    low, high = np.searchsorted(a0, a, side="left"), np.searchsorted(a0, a, side="right")
    out = np.full(len(a), -1, dtype=np.int64)
    for k in range(int((high - low).max()) if len(a) else 0):  # more than one turn only where keys collide
        at = np.minimum(low + k, len(a0) - 1)
        hit = (low + k < high) & (b0[at] == b) & (out < 0)
        out[hit] = at[hit]
    return out


def digest(kept: DataFrame) -> DataFrame:
    """The result of remove_repeats with a SHA-256 of the kept text instead of the text."""
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))

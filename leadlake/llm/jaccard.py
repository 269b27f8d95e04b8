"""Exact n-gram Jaccard join and its classes by parity sketches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadlake.llm.common import U64, components, gram_hashes, mix, shuffle_parts, spans, stream, text_bytes, text_slices, units_for, within, word_hashes
from leadlake.plans.scratch import cut, drop

SHINGLE = 3
#: Two sets link at a similarity of SIMILAR / 100 or more.
SIMILAR = 90
#: Keys shared by up to so many sets name all their pairs; larger ones go through sketches in blocks.
SMALL = 8
BLOCK = 1024
#: Signatures a task gathers before it sends them, and sets of which it remembers that it has sent them (copies it forgot are
#: dropped where keys meet).
HELD = 1 << 21
SEEN = 1 << 16
#: Bits of the folded sketch per segment.
FOLD = 8


def band_edges(similar: int, upto: int) -> np.ndarray:
    """Largest size of each size band: sizes that can link lie in the same or in neighbouring bands."""
    edges, low = [], 1
    while not edges or edges[-1] < upto:
        edges.append(max(low, low * 100 // similar))
        low = edges[-1] + 1
    return np.array(edges, dtype=np.int64)


_EDGES: dict[int, np.ndarray] = {}


def bands(sizes: np.ndarray, similar: int) -> np.ndarray:
    most = int(sizes.max(initial=1))
    if similar not in _EDGES or _EDGES[similar][-1] < most * 2:
        _EDGES[similar] = band_edges(similar, most * 4)
    return np.searchsorted(_EDGES[similar], sizes)


def segments(band: np.ndarray | int, similar: int):
    """More than the largest symmetric difference two linked sets of a band can have: one more, and spare ones."""
    apart = most_apart(2 * _EDGES[similar][band], similar)
    return apart + 1 + spare(apart)


def spare(apart):
    """How many segments a set may leave empty without sending keys for them.

    Linked sets agree in more segments than that, so in one that is not empty.
    """
    return 2 + apart // 20


def most_apart(both, similar: int):
    """|A| + |B| -> the largest |A xor B| at which 100 |A and B| >= similar |A or B|."""
    return both * (100 - similar) // (100 + similar)


class _Sets:
    """The distinct shingles of each text in a slice: values sorted by row, with row bounds."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, n: int):
        starts, ends, at = spans(data, offsets)
        words = word_hashes(data, starts, ends, lower=True)
        keep = np.flatnonzero(within(at, n))
        row = np.repeat(np.arange(len(at) - 1), np.diff(at))
        grams, rows = [gram_hashes(words, n)[keep]], [row[keep]]
        for k in range(1, n):  # texts of fewer words: the whole sequence
            short = np.flatnonzero(np.diff(at) == k)
            if len(short):
                grams.append(gram_hashes(words, k, seed=40 + k)[at[short]])
                rows.append(short)
        grams, rows = np.concatenate(grams), np.concatenate(rows)
        order = np.lexsort((grams, rows))
        grams, rows = grams[order], rows[order]
        new = np.ones(len(grams), dtype=bool)
        new[1:] = (grams[1:] != grams[:-1]) | (rows[1:] != rows[:-1])
        self.grams, self.rows = grams[new], rows[new]
        self.first = np.searchsorted(self.rows, np.arange(len(at)))
        self.sizes = np.diff(self.first)

    def ids(self) -> tuple[np.ndarray, np.ndarray]:
        """Two 63-bit digests of each set."""
        out = []
        for seed in (51, 52):
            sums = np.zeros(len(self.sizes), U64)
            if len(self.grams):
                full = np.flatnonzero(self.sizes)
                sums[full] = np.add.reduceat(mix(self.grams ^ stream(1, seed)[0]), self.first[full])
            out.append((mix(sums + self.sizes.astype(U64)) >> U64(2) << U64(1)).astype(np.int64))
        return out[0], out[1]


def sketch(grams: np.ndarray, parts: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
    """(segment, bit) of each shingle: it flips that bit of that 64-bit segment."""
    high = grams >> U64(32)
    return ((high * np.asarray(parts).astype(U64)) >> U64(32)).astype(np.int64), U64(1) << (grams & U64(63))


def _signatures(s: _Sets, similar: int, sids: np.ndarray, new: np.ndarray, next_band: int) -> tuple[np.ndarray, np.ndarray]:
    """(key, set) for each segment of the sketches for the sets' own band or the next one.

    The key holds the segment's parity bits and the XOR of the whole hashes of its shingles, so segments of unlike sets
    hardly ever meet. Empty segments, which would, are sent only by sets that have more than the spare ones.
    """
    some = np.flatnonzero((s.sizes > 0) & new)
    band = bands(s.sizes[some], similar) + next_band
    parts = segments(band, similar)
    apart = most_apart(2 * _EDGES[similar][band], similar)
    some, band, parts, apart = some[apart > 0], band[apart > 0], parts[apart > 0], apart[apart > 0]  # others link with equal sets only
    if not len(some):
        return np.empty(0, U64), np.empty(0, np.int64)
    count = np.zeros(len(s.sizes), np.int64)
    count[some] = parts
    base = np.concatenate(([0], np.cumsum(count)))
    use = count[s.rows] > 0
    seg, bit = sketch(s.grams[use], count[s.rows[use]])
    at = base[s.rows[use]] + seg
    words, whole, held = np.zeros(base[-1], U64), np.zeros(base[-1], U64), np.zeros(base[-1], bool)
    np.bitwise_xor.at(words, at, bit)
    np.bitwise_xor.at(whole, at, mix(s.grams[use] + stream(1, 53)[0]))
    held[at] = True
    place = np.arange(base[-1]) - np.repeat(base[some], parts)
    salt = mix(np.repeat(band, parts).astype(U64) * U64(1 << 32) + place.astype(U64))
    empty = np.add.reduceat((~held).astype(np.int64), base[some])
    send = held | np.repeat(empty > spare(apart), parts)
    return mix(mix(words ^ salt) + whole)[send], np.repeat(sids[some] | next_band, parts)[send]


def needed(s: _Sets, similar: int, next_band: int) -> np.ndarray:
    """How many keys of its own or the next band a set shares at least with any set that it links with there.

    Linked sets agree in more segments than the spare ones, and of these only the empty ones can be without a key.
    """
    band = bands(s.sizes, similar) + next_band
    parts = segments(band, similar)
    base = np.concatenate(([0], np.cumsum(parts)))
    held = np.zeros(base[-1], np.int64)
    seg, _ = sketch(s.grams, parts[s.rows])
    held[base[s.rows] + seg] = 1
    empty = parts - np.add.reduceat(held, base[:-1]) if len(parts) else parts
    unsent = spare(most_apart(2 * _EDGES[similar][band], similar))
    return 1 + unsent - np.minimum(empty, unsent)


def fold(grams: np.ndarray, band: int, similar: int) -> bytes:
    """A set's parity sketch in a band, its bits folded by XOR to FOLD per segment; still a lower bound of differences."""
    parts = int(segments(band, similar))
    seg, bit = sketch(grams, parts)
    words = np.zeros(-(-parts // 8) * 8, U64)
    np.bitwise_xor.at(words, seg, bit)
    words ^= words >> U64(32)
    words ^= words >> U64(16)
    words ^= words >> U64(8)
    return (words & U64(0xFF)).astype(np.uint8).tobytes()


def _col(column, dtype) -> np.ndarray:
    return np.frombuffer(b"".join(x.as_py() for x in column), dtype=dtype)


def _splits(values: np.ndarray):
    """Runs of equal values as index arrays."""
    return np.split(np.arange(len(values)), np.flatnonzero(np.diff(values)) + 1) if len(values) else []


def _sets_of(texts: DataFrame, shingle: int, similar: int) -> DataFrame:
    """Size, digests, needed keys and folded sketches (own band, next band) of each row's set."""
    def scan(batches):
        for batch in batches:
            parts, folds = [], [[], []]
            for _, data, offsets in text_slices(batch.column("text")):
                s = _Sets(data, offsets, shingle)
                parts.append((s.sizes.astype(np.int64), *s.ids(), needed(s, similar, 0), needed(s, similar, 1)))
                own = bands(s.sizes, similar)
                for i, band in enumerate(own):
                    g = s.grams[s.first[i]:s.first[i + 1]]
                    for k in (0, 1):
                        folds[k].append(fold(g, band + k, similar) if len(g) else None)
            numbers = [np.concatenate(x) for x in zip(*parts)] if parts else [[]] * 5
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in numbers), *(pa.array(c, pa.binary()) for c in folds)],
                                             names=["doc_id", "n", "sid", "sid2", "need0", "need1", "fold0", "fold1"])
    return texts.mapInArrow(scan, "doc_id long, n long, sid long, sid2 long, need0 long, need1 long, fold0 binary, fold1 binary")


def _candidates(texts: DataFrame, shingle: int, similar: int, buckets: int) -> DataFrame:
    """Rows of kind ``pairs`` (a, b in binary columns), of kind ``key`` (a key of many sets with its members) and of kind ``star``.

    One member of a crowded key, the same for as many keys as it can be, stands for it: the key is written as that set with
    the band it is in, and a star holds the pairs of the other members with it.
    """
    def rows(found):
        keys, sets = (np.concatenate(x) for x in zip(*found))
        part = (keys >> U64(40)) % U64(buckets)
        order = np.argsort(part, kind="stable")
        rows = [(int(part[order[r[0]]]), keys[order[r]].tobytes(), sets[order[r]].tobytes()) for r in _splits(part[order])]
        cols = list(zip(*rows)) if rows else [[]] * 3
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.binary(), pa.binary()))], names=["bucket", "keys", "sets"])

    def emit(batches):
        found, held, seen = [], 0, np.empty(0, np.int64)
        for batch in batches:
            for _, data, offsets in text_slices(batch.column("text")):
                s = _Sets(data, offsets, shingle)
                sids, _ = s.ids()
                new = np.zeros(len(sids), dtype=bool)
                new[np.unique(sids, return_index=True)[1]] = True
                new &= ~np.isin(sids, seen)
                seen = np.concatenate((seen, sids[new]))[-SEEN:]
                found += [_signatures(s, similar, sids, new, k) for k in (0, 1)]
                held += len(found[-1][0]) * 2
                if held > HELD:
                    yield rows(found)
                    found, held = [], 0
        if found:
            yield rows(found)

    def meet(table: pa.Table) -> pa.Table:
        keys, sets = _col(table.column("keys"), U64), _col(table.column("sets"), np.int64)
        order = np.lexsort((sets, keys))
        keys, sets = keys[order], sets[order]
        new = np.ones(len(keys), dtype=bool)
        new[1:] = (keys[1:] != keys[:-1]) | (sets[1:] != sets[:-1])
        keys, sets = keys[new], sets[new]
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        size = np.diff(np.concatenate((first, [len(keys)])))
        def dealt(kind, low, high):
            order = np.lexsort((high, low))
            low, high = low[order], high[order]
            new = low != high
            new[1:] &= (low[1:] != low[:-1]) | (high[1:] != high[:-1])
            low, high = low[new], high[new]
            part = (mix(low.astype(U64) ^ mix(high.astype(U64))) % U64(buckets)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            return [(kind, int(part[order[r[0]]]), 0, low[order[r]].tobytes(), high[order[r]].tobytes()) for r in _splits(part[order])]

        lows, highs = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for m in range(2, SMALL + 1):
            group = first[size == m]
            if len(group):
                members = sets[group[:, None] + np.arange(m)] & ~1
                i, j = np.triu_indices(m, 1)
                x, y = members[:, i].ravel(), members[:, j].ravel()
                lows.append(np.minimum(x, y))
                highs.append(np.maximum(x, y))
        rows = dealt("pairs", np.concatenate(lows), np.concatenate(highs))
        lows, highs = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for f, m in zip(first[size > SMALL], size[size > SMALL]):
            members = sets[f:f + m] & ~1
            hub = mix(members.astype(U64)).argmin()
            lows.append(np.minimum(members, members[hub]))
            highs.append(np.maximum(members, members[hub]))
            rows.append(("key", 0, int(sets[f + hub]), sets[f:f + m].tobytes(), b""))
        rows += dealt("star", np.concatenate(lows), np.concatenate(highs))
        cols = list(zip(*rows)) if rows else [[]] * 5
        return pa.table([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int32(), pa.int64(), pa.binary(), pa.binary()))],
                        names=["kind", "bucket", "key", "a", "b"])

    sent = texts.mapInArrow(emit, "bucket long, keys binary, sets binary")
    return sent.groupBy("bucket").applyInArrow(meet, "kind string, bucket int, key long, a binary, b binary")


def _distinct_pairs(pairs: DataFrame) -> DataFrame:
    """(a, b, must): the pairs of small keys, which must be verified, and those of stars."""
    def merge(table: pa.Table) -> pa.Table:
        a, b = _col(table.column("a"), np.int64), _col(table.column("b"), np.int64)
        must = np.repeat([x.as_py() == "pairs" for x in table.column("kind")], [len(x.as_py()) // 8 for x in table.column("a")])
        order = np.lexsort((b, a, must))
        a, b, must = a[order], b[order], must[order]
        new = np.ones(len(a), dtype=bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (must[1:] != must[:-1])
        return pa.table({"a": a[new], "b": b[new], "must": must[new]})
    return pairs.groupBy("bucket").applyInArrow(merge, "a long, b long, must boolean")


def _listed(keys: DataFrame) -> DataFrame:
    """(key, sid, next): the members of crowded keys, a row for each key, though several are written alike."""
    def spread(batches):
        for batch in batches:
            sets = [np.frombuffer(blob, np.int64) for blob in batch.column("a").to_pylist()]
            key = np.repeat(batch.column("key").to_numpy(), [len(x) for x in sets])
            sets = np.concatenate([np.empty(0, np.int64), *sets])
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(sets & ~1), pa.array((sets & 1).astype(np.int32))], names=["key", "sid", "next"])
    return keys.select("key", "a").mapInArrow(spread, "key long, sid long, next int")


def block_pairs(comp: np.ndarray):
    """(unit, places) of members sorted by component: two blocks, so all pairs of members that are not joined yet meet in a unit."""
    starts = np.arange(0, len(comp), BLOCK)
    ends = np.minimum(starts + BLOCK, len(comp))
    if len(starts) == 1:
        yield 0, np.arange(len(comp))
    for i in range(len(starts)):
        for j in range(i + 1, len(starts)):
            if comp[starts[i]] != comp[ends[j] - 1]:
                yield i * len(starts) + j, np.concatenate((np.arange(starts[i], ends[i]), np.arange(starts[j], ends[j])))


def _open_keys(listed: DataFrame, folds: DataFrame, joined: DataFrame) -> DataFrame:
    """(key, sets): for each set that stands for crowded keys, the members of all of them, in the order of their components.

    ``joined`` holds the (node, component) known so far. Where all hang together, the keys are done. So is a member of fewer
    keys than it needs: it links with no set with which it shares crowded keys alone.
    """
    need = F.when(F.col("next") == 1, F.col("need1")).otherwise(F.col("need0"))
    sets = listed.groupBy("sid", "next").agg(F.collect_list("key").alias("keys"))
    sets = sets.join(folds.select("sid", "need0", "need1").hint("merge"), "sid").filter(F.size("keys") >= need)
    sets = sets.join(joined.hint("merge"), F.col("sid") == F.col("node"), "left")
    rows = sets.select(F.coalesce("component", "sid").alias("comp"), "sid", "next", F.explode(F.array_distinct("keys")).alias("key"))
    keys = rows.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.sort_array(F.collect_list(F.struct("comp", "sid", "next"))).alias("sets"))
    return cut(keys.filter("low <> high").select("key", "sets"), "open")


def _members(keys: DataFrame) -> DataFrame:
    """(unit, key, sid, next, comp): the members of open keys, dealt into pairs of blocks of bounded size.

    Two blocks that are both of one and the same component are not paired, so a large class costs rows in proportion to its size.
    """
    names = ["key", "unit", "sid", "next", "comp"]

    def spread(batches):
        for batch in batches:
            out, held = [], 0
            for key, sets in zip(batch.column("key").to_pylist(), batch.column("sets")):
                comp, sid, later = (sets.values.field(c).to_numpy() for c in ("comp", "sid", "next"))
                for unit, at in block_pairs(comp):
                    out.append((np.full(len(at), key), np.full(len(at), unit), sid[at], later[at], comp[at]))
                    held += len(at)
                    if held > SEEN:
                        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], names=names)
                        out, held = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], names=names)
    return keys.mapInArrow(spread, "key long, unit long, sid long, next int, comp long")


def _forest(members: pa.Table, tested: dict[tuple[int, int], bool], similar: int, turn: int) -> tuple[list[tuple[int, int]], bool]:
    """Pairs within the Hamming bound that join parts of a unit not known to hang together (the nearest of each part), and whether there are more.

    Sets of one component (``comp``) hang together. ``tested`` holds pairs verified before; those that failed are left out, the others already join.
    Later turns offer sixteen times as many pairs for each part, so the number of turns stays small.
    The first turn also names, paired with itself, each set that any turn can offer.
    """
    sid, n, comp = (members.column(c).to_numpy() for c in ("sid", "n", "comp"))
    order = np.unique(sid, return_index=True)[1]
    sid, n, comp = sid[order], n[order], comp[order]
    if comp.min() == comp.max():
        return [], False
    bits = np.frombuffer(b"".join(members.column("fold")[int(i)].as_py() for i in order), U64).reshape(len(order), -1)
    m = len(sid)
    apart = np.full((m, m), np.iinfo(np.int32).max, dtype=np.int32)
    for i in range(0, m, 64):
        d = np.bitwise_count(bits[i:i + 64, None, :] ^ bits[None, :, :]).sum(axis=2, dtype=np.int32)
        both = n[i:i + 64, None] + n[None, :]
        small, large = np.minimum(n[i:i + 64, None], n[None, :]), np.maximum(n[i:i + 64, None], n[None, :])
        fits = (d <= most_apart(both, similar)) & (100 * small >= similar * large)
        apart[i:i + 64][fits] = d[fits]
    none = np.iinfo(np.int32).max
    np.fill_diagonal(apart, none)
    _, label, part = np.unique(comp, return_index=True, return_inverse=True)
    label = label[part]

    def join(i, j):
        a, b = label[i], label[j]
        if a != b:
            label[label == max(a, b)] = min(a, b)

    at = {int(s): i for i, s in enumerate(sid)}
    for (a, b), linked in tested.items():
        if a in at and b in at:
            i, j = at[a], at[b]
            apart[i, j] = apart[j, i] = none
            if linked:
                join(i, j)
    out, first, open_pairs = set(), True, 0
    while True:
        cross = np.where(label[:, None] != label[None, :], apart, none)
        best = cross.argmin(axis=1)
        near = cross[np.arange(m), best]
        if (near == none).all():
            break
        if first:
            open_pairs = int((cross < none).sum()) // 2
        if first and not turn:
            out.update((x, x) for x in sid[near < none])
        picked = []
        for part in np.unique(label[near < none]):
            rows = np.flatnonzero((label == part) & (near < none))
            i = rows[near[rows].argmin()]
            picked.append((i, best[i]))
            if turn and first:
                spots = np.argsort(cross[rows], axis=None, kind="stable")[:16 ** turn]
                spots = spots[cross[rows].ravel()[spots] < none]
                out.update((min(sid[rows[p // m]], sid[p % m]), max(sid[rows[p // m]], sid[p % m])) for p in spots)
        first = False
        for i, j in picked:
            if label[i] != label[j]:
                out.add((min(sid[i], sid[j]), max(sid[i], sid[j])))
                join(i, j)
    return [(int(a), int(b)) for a, b in out], sum(a != b for a, b in out) < open_pairs


def _edges_in(members: DataFrame, tested: DataFrame | None, similar: int, turn: int) -> DataFrame:
    """(key, unit, a, b, more): the pairs that units offer in a turn; after the first those that had one fail and have more."""
    schema = "key long, unit long, a long, b long, more boolean"

    def solve(table: pa.Table, known: pa.Table | None = None) -> pa.Table:
        pairs: dict = {}
        again = set()
        if known is not None:
            for key, unit, a, b, linked, more, at in zip(*(known.column(c).to_pylist() for c in ("key", "unit", "a", "b", "linked", "more", "turn"))):
                pairs.setdefault((key, unit), {})[(a, b)] = linked
                if more and not linked and at == turn - 1:
                    again.add((key, unit))
        key, unit = (table.column(c).to_numpy() for c in ("key", "unit")) if table.num_rows else (np.empty(0), np.empty(0))
        order = np.lexsort((unit, key))
        change = np.flatnonzero((np.diff(key[order]) != 0) | (np.diff(unit[order]) != 0)) + 1
        rows = []
        width = np.array([len(x.as_py()) for x in table.column("fold")])
        for r in np.split(order, change) if len(order) else []:
            k, u = int(key[r[0]]), int(unit[r[0]])
            if turn and (k, u) not in again:
                continue
            for w in np.unique(width[r]):  # more than one only where keys of two bands collide
                some, more = _forest(table.take(pa.array(r[width[r] == w])), pairs.get((k, u), {}), similar, turn)
                rows += [(k, u, a, b, more) for a, b in some]
        cols = list(zip(*rows)) if rows else [[]] * 5
        return pa.table([*(pa.array(c, pa.int64()) for c in cols[:4]), pa.array(cols[4], pa.bool_())], names=["key", "unit", "a", "b", "more"])

    if tested is None:
        return members.groupBy("pack").applyInArrow(lambda t: solve(t), schema)
    return members.groupBy("pack").cogroup(tested.groupBy("pack")).applyInArrow(solve, schema)


def _close(pairs: DataFrame, sketches: DataFrame, similar: int) -> DataFrame:
    """The pairs whose folded sketches are not too far apart, compared in the band of the larger set, with the thousandths of the bound they are apart."""
    def test(batches):
        for batch in batches:
            n, m = batch.column("n").to_numpy(), batch.column("m").to_numpy()
            size = [batch.column(c).to_pylist() for c in ("x0", "x1", "y0", "y1")]
            x_band, y_band = bands(n, similar), bands(m, similar)
            keep, far = np.zeros(len(n), dtype=bool), np.zeros(len(n), np.int64)
            for i, (x0, x1, y0, y1) in enumerate(zip(*size)):
                x, y = (x0, y0) if x_band[i] == y_band[i] else (x1, y0) if x_band[i] < y_band[i] else (x0, y1)
                if len(x) == len(y):
                    d = int(np.bitwise_count(np.frombuffer(x, U64) ^ np.frombuffer(y, U64)).sum())
                    most = most_apart(n[i] + m[i], similar)
                    keep[i], far[i] = d <= most, d * 1000 // (most + 1)
            yield pa.RecordBatch.from_arrays([*(batch.column(c).filter(pa.array(keep)) for c in ("a", "b", "must")), pa.array(far[keep])], names=["a", "b", "must", "far"])

    x = sketches.select(F.col("sid").alias("a"), "n", F.col("fold0").alias("x0"), F.col("fold1").alias("x1"))
    y = sketches.select(F.col("sid").alias("b"), F.col("n").alias("m"), F.col("fold0").alias("y0"), F.col("fold1").alias("y1"))
    return pairs.join(x.hint("merge"), "a").join(y.hint("merge"), "b").select("a", "b", "must", "n", "m", "x0", "x1", "y0", "y1").mapInArrow(test, "a long, b long, must boolean, far long")


def _nearest(near: DataFrame) -> DataFrame:
    """For each set, its pair with the smallest distance."""
    ends = near.select(F.col("a").alias("x"), F.col("b").alias("y"), "far").union(near.select(F.col("b").alias("x"), F.col("a").alias("y"), "far"))
    best = ends.groupBy("x").agg(F.min(F.struct("far", "y")).alias("p"))
    return best.select(F.least("x", "p.y").alias("a"), F.greatest("x", "p.y").alias("b"))


def _verify(pairs: DataFrame, sets: DataFrame, similar: int) -> DataFrame:
    """(a, b, linked) by the exact sets."""
    def test(batches):
        for batch in batches:
            linked = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist()):
                x, y = np.frombuffer(x, U64), np.frombuffer(y, U64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                linked.append(100 * both >= similar * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(linked, pa.bool_())], names=["a", "b", "linked"])

    x = sets.select(F.col("sid").alias("a"), F.col("grams").alias("x"))
    y = sets.select(F.col("sid").alias("b"), F.col("grams").alias("y"))
    return pairs.join(x.hint("merge"), "a").join(y.hint("merge"), "b").select("a", "b", "x", "y").mapInArrow(test, "a long, b long, linked boolean")


def similar_sets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similar: int = SIMILAR):
    """(classes, links): ``classes`` has a row (doc_id, n, sid) per document, ``links`` pairs (a, b) of ``sid`` that verified pairs connect.

    A document's set holds its distinct shingles; ``sid`` digests the set, so copies share one. Sets are
    compared once each. ``links`` names enough pairs to connect all that any links connect.
    """
    spark = docs.sparkSession
    total = text_bytes(docs, text_col)
    buckets = units_for(spark, total)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    named = texts.filter("doc_id IS NOT NULL")
    classes = cut(_sets_of(texts, shingle, similar), "sets")
    found = cut(_candidates(named.select("text"), shingle, similar, buckets), "candidates")
    pairs = cut(_distinct_pairs(found.filter("kind <> 'key'").select("kind", "bucket", "a", "b")), "pairs")
    packs = shuffle_parts(spark)
    listed = cut(_listed(found.filter("kind = 'key'")), "listed")
    drop(found)

    def sets_in(pairs):
        return pairs.select(F.col("a").alias("sid")).union(pairs.select(F.col("b").alias("sid"))).distinct()

    # Texts, sketches and sets are exchanged at every size (the hints), so that the plan does not change with the input.
    folds = classes.filter("n > 0 AND doc_id IS NOT NULL").join(sets_in(pairs).hint("merge"), "sid", "left_semi")
    folds = cut(folds.groupBy("sid").agg(F.min(F.struct("doc_id", "n", "need0", "need1", "fold0", "fold1")).alias("x")).select("sid", "x.*"), "folds")
    near = cut(_close(pairs, folds, similar), "near")
    drop(pairs)

    def load(batches):
        for batch in batches:
            rows = []
            sid = batch.column("sid").to_numpy()
            for first, data, offsets in text_slices(batch.column("text")):
                s = _Sets(data, offsets, shingle)
                for i in np.flatnonzero(s.ids()[0] == sid[first:first + len(s.sizes)]):  # other texts of the same id are not meant
                    rows.append((int(sid[first + i]), s.grams[s.first[i]:s.first[i + 1]].tobytes()))
            cols = list(zip(*rows)) if rows else [[]] * 2
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.binary())], names=["sid", "grams"])

    def loaded(chosen):
        kept = named.join(chosen, "doc_id").select("sid", "text")
        return cut(kept.mapInArrow(load, "sid long, grams binary"), "grams")

    # Of the pairs in stars one for each set is enough to find what hangs together; what they leave apart meets in blocks.
    pairs = cut(near.filter("must").select("a", "b").union(_nearest(near.filter("NOT must"))).distinct(), "pairs")
    which = folds.select("sid", "doc_id")
    sets = loaded(which.join(sets_in(pairs), "sid", "left_semi").hint("merge"))
    joined = components(_verify(pairs, sets, similar).filter("linked"))
    drop(near, pairs)
    links = joined.select(F.col("node").alias("a"), F.col("component").alias("b"))

    opened = _open_keys(listed, folds, joined)
    drop(listed)
    members = cut(_members(opened), "members")
    drop(opened)
    pack = F.pmod(F.xxhash64("key", "unit"), F.lit(packs * 4)).cast("int").alias("pack")
    folded = F.when(F.col("next") == 1, F.col("fold1")).otherwise(F.col("fold0")).alias("fold")
    crowded = cut(members.join(folds.hint("merge"), "sid").select(pack, "key", "unit", "sid", "comp", "n", folded), "crowded")
    drop(members)
    offered = cut(_edges_in(crowded, None, similar, 0), "forest")
    # The sets that this turn or a later one offers: what hangs together is known by now, so they are few, and sent to the texts if they are.
    chosen = cut(which.join(sets_in(offered), "sid", "left_semi"), "chosen")
    before, sets = sets, loaded(chosen)
    drop(before)
    known, turn = None, 0
    while True:
        offered = offered.filter("a <> b")
        tested = _verify(offered.select("a", "b").distinct(), sets, similar)
        tested = cut(offered.join(tested, ["a", "b"]).select(pack, "key", "unit", "a", "b", "linked", "more", F.lit(turn).alias("turn")), "tested")
        links = links.union(tested.filter("linked").select("a", "b"))
        failed = tested.filter("more AND NOT linked").select("key", "unit")
        if not failed.limit(1).count():
            break
        if not turn:  # only these units can offer more, and links found elsewhere may have closed them
            joined = components(links)
            links = joined.select(F.col("node").alias("a"), F.col("component").alias("b"))
            rest = crowded.join(failed.distinct(), ["key", "unit"], "left_semi").join(joined.hint("merge"), F.col("sid") == F.col("node"), "left")
            before, crowded = crowded, cut(rest.select("pack", "key", "unit", "sid", F.coalesce("component", "sid").alias("comp"), "n", "fold"), "crowded")
            drop(before)
        known = tested if known is None else known.unionByName(tested)
        turn += 1
        offered = cut(_edges_in(crowded, known, similar, turn), "forest")
    return classes.select("doc_id", "n", "sid", "sid2"), links


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similar: int = SIMILAR) -> DataFrame:
    """(doc_id, n_shingles, component_id), one row per input row.

    Texts are lower-cased (A-Z only) and cut into words; a set is the distinct runs of ``shingle``
    words, or the whole sequence of a shorter text. Sets link when 100 |A and B| >= similar |A or B|,
    which allows at most d = (|A| + |B|) (100 - similar) / (100 + similar) differing shingles.

    Each shingle flips one bit of a parity sketch, so sketches differ in at most as many bits as sets
    differ in shingles. Sizes fall into bands such that linked sets lie in one band or in neighbours;
    a set takes part in its own band and the next. There its sketch has d + 1 segments of 64 bits and a
    few spare ones, d taken at the largest sizes, so two linked sets agree in whole segments (pigeonhole), of
    which one at least is not empty, or both sets have more empty ones than spare: the hash of band, place,
    segment and the XOR of its shingles' hashes is the join key. Up to 8 sets of one key name all their pairs, and pairs
    whose folded sketches are too far apart fall out. The sets of a more crowded key meet in blocks of
    at most 1,024, where of the pairs within the bound a spanning forest is offered. Every offered pair
    is verified on the exact sets; where one fails, its block offers further pairs until none is left
    that could join two parts. So no link that joins classes is lost, and equal sets are compared once.

    Null and empty texts have 0 shingles and are linked with nothing; ids must be integers; a row with
    a null id keeps a null component and links nothing; rows of equal id and text are copies; rows of
    equal id and different text act as one node. An empty table gives no rows. Other columns are not
    looked at. Sets are told apart by 62-bit digests, two of them in ``classes``.
    """
    classes, links = similar_sets(docs, id_col, text_col, shingle, similar)
    full = classes.filter("n > 0 AND doc_id IS NOT NULL")
    nodes = cut(full.groupBy("sid").agg(F.min("doc_id").alias("node")), "nodes")
    edges = links.join(nodes.select(F.col("sid").alias("a"), F.col("node").alias("na")), "a")
    edges = edges.join(nodes.select(F.col("sid").alias("b"), F.col("node").alias("nb")), "b")
    joined = components(edges.select(F.col("na").alias("a"), F.col("nb").alias("b")))
    nodes = nodes.join(joined, "node", "left").select("sid", F.coalesce("component", "node").alias("component_id"))
    linked = full.join(nodes, "sid").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    alone = classes.filter("n = 0 OR doc_id IS NULL")
    return linked.unionByName(alone.select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows whose id is the smallest of their class (rows without words and rows without id are all kept)."""
    classes = near_classes(docs, id_col, text_col, **how).filter("component_id = doc_id").select("doc_id").distinct()
    return docs.join(classes, docs[id_col] == classes["doc_id"], "left_semi").unionByName(docs.filter(F.col(id_col).isNull()))

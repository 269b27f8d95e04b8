"""Helpers the training-data operators share: sizes, row keys, connected components, word hashes."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leadlake.plans.scratch import cut

#: A word is a run of characters other than space, tab, line feed, vertical tab, form feed and return.
WORD = r"[^\x20\x09-\x0D]+"
SLICE_BYTES = 2 << 20
U64 = np.uint64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc(col: Column) -> Column:
    """Unsigned CRC-32 of a value as text."""
    return F.crc32(col.cast("string").cast("binary"))


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def units_for(spark: SparkSession, total_bytes: int) -> int:
    """How many units to deal text into: 8 MB each, growing to 256 MB so that unit-to-unit messages stay above 1 KB."""
    unit = min(max(8 << 20, int(math.sqrt(max(total_bytes, 1) * 1700))), 256 << 20)
    return max(shuffle_parts(spark), -(-total_bytes // unit))


def text_bytes(docs: DataFrame, col: str = "text") -> int:
    return docs.agg(F.sum(F.octet_length(col)).alias("n")).first().n or 0


# ---- words of Arrow text columns -------------------------------------------------------------

def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


mix = _mix


def stream(n: int, seed: int) -> np.ndarray:
    """n pseudo-random odd 64-bit numbers that depend on the seed and the position alone."""
    return _mix(np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed)) | U64(1)


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = {seed: stream(256, seed) for seed in (11, 12)}
_POS: dict[int, np.ndarray] = {seed: stream(4096, seed + 100) for seed in (11, 12)}


def text_slices(column, limit: int = SLICE_BYTES):
    """(first row, bytes, row offsets) over slices of a text column of about ``limit`` bytes; null reads as empty."""
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    first = 0
    for chunk in chunks:
        chunk = pc.fill_null(chunk, "") if chunk.null_count else chunk
        wide = pa.types.is_large_string(chunk.type) or pa.types.is_large_binary(chunk.type)
        if len(chunk):
            _, offsets, data = chunk.buffers()
            offsets = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[chunk.offset:chunk.offset + len(chunk) + 1]
            data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)
            at = 0
            while at < len(chunk):
                to = int(np.searchsorted(offsets, int(offsets[at]) + limit, side="right")) - 1
                to = min(max(to, at + 1), len(chunk))
                yield first + at, data[offsets[at]:offsets[to]], (offsets[at:to + 1] - offsets[at]).astype(np.int64)
                at = to
        first += len(chunk)


def spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end) of each word in the bytes, and the index of each row's first word, one more at the end."""
    if not len(data):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(offsets), np.int64)
    word = ~_SPACE[data]
    cut_at = np.zeros(len(data) + 1, dtype=bool)
    cut_at[offsets] = True
    starts = word.copy()
    starts[1:] &= ~word[:-1] | cut_at[1:-1]
    ends = word.copy()
    ends[:-1] &= ~word[1:] | cut_at[1:-1]
    starts = np.flatnonzero(starts)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False, seed: int = 11) -> np.ndarray:
    """A 64-bit hash of each word's bytes (A-Z lowered on request)."""
    if not len(starts):
        return np.empty(0, U64)
    sizes = ends - starts
    longest = int(sizes.max())
    if longest > len(_POS[seed]):
        _POS[seed] = stream(longest * 2, seed + 100)
    first = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    place = np.arange(int(sizes.sum()), dtype=np.int64)
    place -= np.repeat(first, sizes)
    letters = data[place + np.repeat(starts, sizes)]
    if lower:
        letters = _LOWER[letters]
    return _mix(np.add.reduceat(_BYTE[seed][letters] * _POS[seed][place], first) + sizes.astype(U64))


def gram_hashes(words: np.ndarray, n: int, seed: int = 11) -> np.ndarray:
    """A hash of the n words from each word on; the last n - 1 entries mean nothing."""
    out = np.zeros(len(words), U64)
    for k, c in enumerate(stream(n, seed + 200)):
        out[:max(len(words) - k, 0)] += words[k:] * c
    return _mix(out)


def within(first_word: np.ndarray, n: int) -> np.ndarray:
    """Which words start n words of their own row."""
    counts = np.diff(first_word)
    place = np.arange(first_word[-1]) - np.repeat(first_word[:-1], counts)
    return place + n <= np.repeat(counts, counts)


# ---- connected components --------------------------------------------------------------------

#: Edges that a task contracts at once.
EDGES = 1 << 20


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges as (node, smallest node that they reach from it), for each node but the smallest ones."""
    nodes, at = np.unique(np.concatenate((u, v)), return_inverse=True)
    i, j = at[:len(u)], at[len(u):]
    low = np.arange(len(nodes))
    while True:
        was = low.copy()
        np.minimum.at(low, was[i], was[j])
        np.minimum.at(low, was[j], was[i])
        while (low[low] != low).any():
            low = low[low]
        if (low == was).all():
            break
    leaf = np.flatnonzero(low != np.arange(len(nodes)))
    return nodes[leaf], nodes[low[leaf]]


def _contract(batches):
    """The edges of each chunk of a task, as stars."""
    def out(held):
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in stars(*(np.concatenate(x) for x in zip(*held)))], names=["u", "v"])

    held, n = [], 0
    for batch in batches:
        held.append((batch.column("u").to_numpy(), batch.column("v").to_numpy()))
        n += batch.num_rows
        if n > EDGES:
            yield out(held)
            held, n = [], 0
    if held:
        yield out(held)


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable, for every node of an edge ``a``-``b``.

    Tasks first contract the edges they read. Then large-star and small-star steps alternate, each one group-by minimum and
    one join, until the edges are stars: no node has a smaller neighbour and another one. Nulls and loops are ignored;
    repeated edges count once.
    """
    e = cut(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")), "cc")
    e = cut(e.mapInArrow(_contract, "u long, v long"), "cc")
    for _ in range(rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("low"), F.max("v").alias("high"))
        low = cut(low.select("u", F.least("u", "low").alias("m"), F.expr("low < u AND low < high").alias("open")), "cc")
        if not low.filter("open").limit(1).count():
            return low.select(F.col("u").alias("node"), F.col("m").alias("component"))
        large = cut(both.join(low, "u").filter("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")), "cc")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"),
                                            F.col("m").alias("v"))
        e = cut(small.filter("u <> v").distinct(), "cc")
    raise RuntimeError("components did not settle")


# ---- bounded samples of labelled rows ---------------------------------------------------------

#: Longest text, in bytes, that a training sample takes; longer ones are scored but not learned from.
SAMPLE_TEXT = 128 << 10


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, folds: int, held_out: int) -> list[tuple[str, object]]:
    """At most ``per_class`` (text, label) rows of each class, chosen by hash, from rows outside the held-out fold.

    Rows whose id or label is null take no part; of several labels of one id the largest counts, and of
    several texts of one id the first in code-point order.
    """
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & (F.pmod(crc(F.col("doc_id")), F.lit(folds)) != held_out))
    known = known.groupBy(F.col("doc_id").alias("_id")).agg(F.max(label).alias("_label"))
    order = [F.xxhash64("_id", F.lit(label)), F.col("_id")]
    classes = [r[0] for r in known.select("_label").distinct().limit(1000).collect()]
    ids = None
    for c in sorted(classes):
        some = known.filter(F.col("_label") == F.lit(c)).orderBy(*order).limit(per_class)
        ids = some if ids is None else ids.union(some)
    if ids is None:
        return []
    rows = docs.select(F.col("doc_id").alias("_id"), "text").filter(F.octet_length("text") <= SAMPLE_TEXT)
    rows = rows.join(F.broadcast(ids), "_id")  # at most per_class ids of each class
    rows = rows.groupBy("_id").agg(F.min("text").alias("text"), F.max("_label").alias("label"))
    return [(r.text, r.label) for r in sorted(rows.collect(), key=lambda r: r._id)]


def class_counts(labels: DataFrame, label: str, folds: int, held_out: int) -> dict:
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & (F.pmod(crc(F.col("doc_id")), F.lit(folds)) != held_out))
    return {r[0]: r[1] for r in known.groupBy(label).count().collect()}


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 50) -> np.ndarray:
    """Weights of a ridge logistic regression by Newton steps; the first column of x is the constant and is not penalised."""
    w = np.zeros(x.shape[1])
    pen = np.full(x.shape[1], ridge)
    pen[0] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + pen * w
        hess = (x * (p * (1 - p))[:, None]).T @ x + np.diag(pen) + 1e-9 * np.eye(x.shape[1])
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w

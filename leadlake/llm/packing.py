"""Best-fit packing of tokenized documents: large pieces are matched in pairs, small ones fill the remaining gaps."""

from __future__ import annotations

import bisect
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leadlake.llm.encoders import WordCache, text_runs
from leadlake.plans.scratch import cut

VOCABULARY = "word_bpe_49k.json"
CAPACITY = 2048
END = 0
#: Text bytes encoded at a time.
RUN_BYTES = 4 << 20


# ---- the plan, from counts per length alone -------------------------------------------------------

class Bins:
    """Runs of bins with equal gaps, and the steps that put items into them.

    A step (length, low, high, bin, per_bin, offset) says: the items low to high - 1 of that length go, per_bin to each, into
    bins from ``bin`` on, the first at ``offset``.
    """

    def __init__(self, capacity: int):
        self.capacity, self.bins, self.steps = capacity, 0, []
        self.gaps: dict[int, list[tuple[int, int]]] = {}
        self.known: list[int] = []

    def keep(self, gap: int, first: int, bins: int) -> None:
        if gap and bins:
            if gap not in self.gaps:
                self.gaps[gap] = []
                bisect.insort(self.known, gap)
            self.gaps[gap].append((first, bins))

    def tightest(self, size: int) -> tuple[int, int, int] | None:
        """(gap, first bin, bins) of a run with the smallest gap that takes the size; the run is taken out."""
        at = bisect.bisect_left(self.known, size)
        if at == len(self.known):
            return None
        gap = self.known[at]
        first, bins = self.gaps[gap].pop()
        if not self.gaps[gap]:
            del self.gaps[gap], self.known[at]
        return gap, first, bins

    def new(self, bins: int) -> tuple[int, int, int]:
        self.bins += bins
        return self.capacity, self.bins - bins, bins

    def put(self, size: int, low: int, many: int, run: tuple[int, int, int], most: int | None = None) -> int:
        """Items from ``low`` on into a run of bins, as many to each as fit (or ``most``); the number of items put."""
        gap, first, bins = run
        each = min(gap // size, most or gap)
        full = min(bins, many // each)
        rest = min(many - full * each, each) if full < bins else 0
        if full:
            self.steps.append((size, low, low + full * each, first, each, self.capacity - gap))
            self.keep(gap - each * size, first, full)
        if rest:
            self.steps.append((size, low + full * each, low + full * each + rest, first + full, rest, self.capacity - gap))
            self.keep(gap - rest * size, first + full, 1)
        used = full + (rest > 0)
        self.keep(gap, first + used, bins - used)
        return full * each + rest


def plan(counts: dict[int, int], capacity: int) -> Bins:
    """Steps for so many items of each length.

    Of items above a third of the capacity no three fit together. Those above half of it open a bin each, the longest
    first, and take the longest free partner that fits: the choices of a longer item are among those of a shorter one, so
    the greedy matching is a largest one. The others above a third pair among themselves. Shorter items, the longest first,
    go where the gap is tightest, and open bins where none is left. All items of a length are placed run by run, so the work
    and the number of steps depend on the capacity (each visit to a run at least halves its gap) and not on the items.
    """
    out, left = Bins(capacity), {s: [0, n] for s, n in sorted(counts.items(), reverse=True) if n}
    large = [s for s in left if 3 * s > capacity]
    medium = sorted(s for s in large if 2 * s <= capacity)

    def give(size: int, many: int, run: tuple[int, int, int], most: int | None = None) -> int:
        done = out.put(size, left[size][0], many, run, most)
        left[size][0] += done
        left[size][1] -= done
        return done

    def take(run: tuple[int, int, int]) -> None:
        """Partners for a run of bins that hold one item each."""
        gap, first, bins = run
        at = bisect.bisect_right(medium, gap)
        while bins and at:
            size = medium[at - 1]
            n = min(left[size][1], bins)
            if n:
                give(size, n, (gap, first, n), 1)
                first, bins = first + n, bins - n
            if not left[size][1]:
                medium.pop(at - 1)
            at -= 1
        out.keep(gap, first, bins)

    for size in large:
        many = left[size][1]
        if 2 * size > capacity:
            _, first, _ = out.new(many)
            out.steps.append((size, 0, many, first, 1, 0))
            left[size] = [many, 0]
            take((capacity - size, first, many))
    while medium:
        size = medium[-1]
        many = left[size][1]
        if many > 1:
            give(size, many // 2 * 2, out.new(many // 2), 2)
        if left[size][1]:
            medium.pop()
            _, first, _ = out.new(1)
            out.steps.append((size, left[size][0], left[size][0] + 1, first, 1, 0))
            left[size] = [left[size][0] + 1, 0]
            take((capacity - size, first, 1))
        elif medium and medium[-1] == size:
            medium.pop()
    for size in [s for s in left if 3 * s <= capacity]:
        while left[size][1]:
            many = left[size][1]
            give(size, many, out.tightest(size) or out.new(-(-many // (capacity // size))))
    return out


# ---- tables ---------------------------------------------------------------------------------------

def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, part, k[, ids]): the token ids of each text and an end id, cut every ``capacity``.

    ``part`` is the task that wrote the row and ``k`` its number among that task's pieces of equal length.
    """
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "k"] + ["ids"] * keep_ids
    types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]

    def run(batches):
        words, part, seen = WordCache.of(path), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for at, texts in text_runs(batch.column(1), RUN_BYTES):
                ids, first = words.encode(texts)
                rows, out, kept = [], [], []
                for i in range(len(texts)):
                    data = np.append(ids[first[i]:first[i + 1]], np.uint32(END))
                    for piece, start in enumerate(range(0, len(data), capacity)):
                        one = data[start:start + capacity]
                        n = len(one)
                        rows.append(at + i)
                        out.append((piece, start, n, zlib.crc32(one), part, int(seen[n])))
                        seen[n] += 1
                        if keep_ids:
                            kept.append(one.astype(np.int32))
                cols = [pa.array(c, t) for c, t in zip(zip(*out), types)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), *cols, *([pa.array(kept, pa.list_(pa.int32()))] * keep_ids)], names=names)

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")).mapInArrow(
        run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, part int, k long" + ", ids array<int>" * keep_ids)


def pack(rows: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``rows`` (of ``pieces``) with sequence_id and offset, without part and k.

    The driver sees one count per length, at most ``capacity`` of them, and sends steps, at most some tens of thousands
    whatever the data. Pieces of a length are numbered by the task that wrote them and their number there, with offsets
    summed over the counts of the tasks, so no task holds the pieces of a common length.
    """
    spark = rows.sparkSession
    rows = cut(rows, "pieces")
    counts = cut(rows.groupBy("length", "part").agg(F.count("*").alias("n")), "piece-counts")
    lengths = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most one row per length
    steps = np.array(sorted(plan(lengths, capacity).steps), np.int64).reshape(-1, 6)
    shared = spark.sparkContext.broadcast(steps)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__first"))
    numbered = rows.join(offsets, ["part", "length"]).withColumn("k", F.col("__first") + F.col("k")).drop("__first", "part")
    names = [n for n in rows.columns if n not in ("part", "k")]

    def run(batches):
        table = shared.value
        starts = {s: np.flatnonzero(table[:, 0] == s) for s in np.unique(table[:, 0])}
        for batch in batches:
            size, k = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "k"))
            step = np.zeros(len(k), np.int64)
            for s in np.unique(size):
                mine, own = size == s, starts[s]
                step[mine] = own[np.searchsorted(table[own, 1], k[mine], side="right") - 1]
            _, low, _, first, each, base = table[step].T
            at, place = np.divmod(k - low, each)
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(first + at), pa.array(base + place * size)],
                                             names=[*names, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in names)
    return numbered.select(*names, "k").mapInArrow(run, f"{schema}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids], sequence_id, offset): all documents in sequences of ``capacity`` tokens.

    A document is its token ids and an end id; only longer ones are cut. A null text is read as empty and gives the end id
    alone. Repeated rows are packed each, whatever their ids; other columns are not looked at. An empty table gives no rows.
    """
    return pack(pieces(docs, path, capacity, keep_ids=keep_ids), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids): whole sequences from packed pieces with their ids; a group has at most ``capacity`` of these."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))

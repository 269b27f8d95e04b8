"""Exact top-k inner products by a Voronoi join of queries and data."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadlake.plans.scratch import cut

TOP = 10
PIVOTS = 64
SCALE = 1024
EVERY = 100
QUERY_BLOCK = 512
DATA_BLOCK = 16384
SCHEMA = "dim int, cell int, away double, vec_id long, v binary"


def valid(col: Column) -> Column:
    """Not null, and neither null nor infinite nor not-a-number in any component."""
    bad = F.exists(col, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return col.isNotNull() & ~F.coalesce(bad, F.lit(True))


def _vectors(blobs, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(b.as_py() for b in blobs), np.int64).reshape(len(blobs), dim)


def scores(queries: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Exact integer inner products; those outside the range of a long are cut off at its ends."""
    if not queries.shape[1]:
        return np.zeros((len(queries), len(data)), np.int64)
    most = float(np.abs(queries.astype(float)).max()) * float(np.abs(data.astype(float)).max()) * queries.shape[1]
    if most < 2 ** 53:
        return (queries.astype(float) @ data.T.astype(float)).astype(np.int64)
    if most < 2 ** 62:
        return queries @ data.T
    big = queries.astype(object) @ data.T.astype(object)
    return np.clip(big, -2 ** 63, 2 ** 63 - 1).astype(np.int64)


def best(score: np.ndarray, ids: np.ndarray, own: int, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id, leaving out a query's own id."""
    at = np.flatnonzero(ids != own)
    if len(at) > k:
        some = score[at]
        at = at[some >= np.partition(some, len(some) - k)[len(some) - k]]
    return at[np.lexsort((ids[at], -score[at]))][:k]


def top_products(vectors: DataFrame, k: int = TOP, every: int = EVERY, scale: int = SCALE, pivots: int = PIVOTS) -> DataFrame:
    """(query_id, rank, vec_id, score): for each vector whose id is divisible by ``every``, the k highest inner products.

    Components become floor(scale * x). ``pivots`` vectors, drawn by hash, split the space; a vector lies
    in the cell of its nearest pivot of the same length (vectors of a length without a pivot form one
    cell around 0). Each cell is summarised by its radius and the distances of its k + 1 vectors nearest
    to the pivot. For a query q and a vector x of a cell around p, q.p - |q||x - p| <= q.x <= q.p + |q||x - p|:
    the left sides over the summaries give a score that at least k vectors reach; a cell whose right side
    at its radius stays below it is not needed. Queries of neighbouring cells travel in blocks to the
    blocks of the cells they need, where exact integer products are formed, and k per block go on.

    Only summaries reach the driver: pivots, and k + 2 numbers a cell. Vectors that are null or hold a null
    or non-finite component take no part, nor do rows with a null id; vectors of different length are not
    compared; empty vectors score 0. Rows with a query's own id are left out for it; other repeated ids
    are rows of their own. An empty table, or one without queries, gives no rows.
    """
    spark = vectors.sparkSession
    shape = "query_id long, rank int, vec_id long, score long"
    rows = cut(vectors.filter(valid(F.col("embedding")) & F.col("vec_id").isNotNull()).select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("v")), "vectors")
    chosen = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(pivots).select("v").collect()
    centres: dict[int, np.ndarray] = {}
    for v in sorted({tuple(r.v) for r in chosen}):
        centres.setdefault(len(v), []).append(v)
    centres = {d: np.array(v, dtype=float).reshape(-1, d) for d, v in centres.items()}

    def assign(batches):
        for batch in batches:
            v, ids = batch.column("v"), batch.column("vec_id").to_numpy()
            size = np.diff(v.offsets.to_numpy())
            flat, start = v.values.to_numpy(), v.offsets.to_numpy()[:-1]
            for dim in np.unique(size):
                at = np.flatnonzero(size == dim)
                x = flat[start[at][:, None] + np.arange(dim)].reshape(len(at), dim)
                y = x.astype(float)
                if dim in centres:
                    c = centres[dim]
                    cell = ((y ** 2).sum(1)[:, None] - 2 * y @ c.T + (c ** 2).sum(1)).argmin(axis=1)
                    away = np.sqrt(((y - c[cell]) ** 2).sum(1))
                else:
                    cell, away = np.full(len(at), -1), np.sqrt((y ** 2).sum(1))
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(at), dim), pa.int32()), pa.array(cell, pa.int32()), pa.array(away), pa.array(ids[at]),
                    pa.array([r.tobytes() for r in x], pa.binary())], names=["dim", "cell", "away", "vec_id", "v"])

    placed = cut(rows.mapInArrow(assign, SCHEMA), "cells")
    is_query = F.pmod("vec_id", F.lit(every)) == 0
    near = Window.partitionBy("dim", "cell").orderBy("away", "vec_id")
    nearest = placed.withColumn("r", F.row_number().over(near)).filter(F.col("r") <= k + 1).groupBy("dim", "cell").agg(F.sort_array(F.collect_list("away")).alias("near"))
    sizes = placed.groupBy("dim", "cell").agg(F.count("*").alias("n"), F.count_if(is_query).alias("q"), F.max("away").alias("radius"))
    cells = [(r.dim, r.cell, r.n, r.q, r.radius, r.near) for r in sizes.join(nearest, ["dim", "cell"]).orderBy("dim", "cell").collect()]
    if not any(c[3] for c in cells):
        return spark.createDataFrame([], shape)

    groups, last, held = [], None, 0  # cells of few queries share a block, cells of many are split
    number = 0
    for dim, cell, _, q, _, _ in cells:
        if q:
            if last != dim or held + q > QUERY_BLOCK:
                number, last, held = number + 1, dim, 0
            parts = -(-q // QUERY_BLOCK)
            groups.append((dim, cell, number, parts))
            held += q
            if parts > 1:
                number, held = number + parts - 1, QUERY_BLOCK
    blocks = [(dim, cell, -(-n // DATA_BLOCK)) for dim, cell, n, *_ in cells]
    by_hash = lambda n: F.pmod(F.xxhash64("vec_id"), F.col(n)).cast("int")

    def need(table: pa.Table) -> pa.Table:
        """One row for the block of queries and each cell that one of them needs."""
        dim = table.column("dim")[0].as_py()
        q = _vectors(table.column("v"), dim).astype(float)
        norm = np.sqrt((q ** 2).sum(1)) * (1 + 1e-9)
        here = [c for c in cells if c[0] == dim]
        low, high = [], []
        for _, cell, _, _, radius, close in here:
            middle = q @ centres[dim][cell] if cell >= 0 else np.zeros(len(q))
            slack = 1e-6 * (1 + np.abs(middle))
            low += [middle - norm * a - slack for a in close]
            high.append(middle + norm * radius * (1 + 1e-9) + slack)
        low = np.sort(np.array(low), axis=0)[::-1]
        reach = low[k] if len(low) > k else np.full(len(q), -np.inf)  # one of the k + 1 may be the query itself
        wanted = [c[1] for c, h in zip(here, high) if (h >= reach).any()]
        ids, v = table.column("vec_id").to_numpy().tobytes(), b"".join(b.as_py() for b in table.column("v"))
        return pa.table([pa.array([dim] * len(wanted), pa.int32()), pa.array(wanted, pa.int32()), pa.array([ids] * len(wanted), pa.binary()),
                         pa.array([v] * len(wanted), pa.binary())], names=["dim", "cell", "q_ids", "q"])

    def pack(table: pa.Table) -> pa.Table:
        return pa.table([table.column(c).slice(0, 1) for c in ("dim", "cell", "block")]
                        + [pa.array([table.column("vec_id").to_numpy().tobytes()]), pa.array([b"".join(b.as_py() for b in table.column("v"))])],
                        names=["dim", "cell", "block", "ids", "x"])

    def solve(batches):
        for batch in batches:
            out = []
            for dim, q_ids, q, ids, x in zip(*(batch.column(c).to_pylist() for c in ("dim", "q_ids", "q", "ids", "x"))):
                q_ids, ids = np.frombuffer(q_ids, np.int64), np.frombuffer(ids, np.int64)
                s = scores(np.frombuffer(q, np.int64).reshape(len(q_ids), dim), np.frombuffer(x, np.int64).reshape(len(ids), dim))
                for i, own in enumerate(q_ids):
                    at = best(s[i], ids, own, k)
                    out.append((np.full(len(at), own), ids[at], s[i][at]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names=["query_id", "vec_id", "score"])

    group_of = F.broadcast(spark.createDataFrame(groups, "dim int, cell int, first int, parts int"))  # one row per cell
    block_of = F.broadcast(spark.createDataFrame(blocks, "dim int, cell int, blocks int"))
    queries = placed.filter(is_query).join(group_of, ["dim", "cell"]).withColumn("grp", F.col("first") + by_hash("parts"))
    queries = queries.groupBy("dim", "grp").applyInArrow(need, "dim int, cell int, q_ids binary, q binary")
    queries = queries.join(block_of, ["dim", "cell"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    data = placed.join(block_of, ["dim", "cell"]).withColumn("block", by_hash("blocks"))
    data = data.groupBy("dim", "cell", "block").applyInArrow(pack, "dim int, cell int, block int, ids binary, x binary")
    found = queries.join(data, ["dim", "cell", "block"]).select("dim", "q_ids", "q", "ids", "x").mapInArrow(solve, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

"""Exact nearest companies by cosine similarity: cells of the sphere, blocks of a cell, filters before products."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadlake.plans.balance import top_k
from leadlake.plans.scratch import cut

#: Vectors of a block, and queries that meet a block together.
BLOCK = 1024
#: Vectors that stand for the cells; a sample, which bounds what the driver holds and decides speed only.
PIVOTS = 64
#: Blocks of its own cell that a query meets first, to learn how near its k-th neighbour is at most.
HOME = 2
#: Queries whose products with a block are held at once.
MEET = 128
FILTERS = ("state", "city", "code")
#: Angles are compared with this much room for rounding.
ROOM = 1e-6


def _keep(sims: np.ndarray, keys: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Best k columns of each row, ties to the smaller key."""
    by_key = np.argsort(keys, axis=1, kind="stable")
    sims, keys = np.take_along_axis(sims, by_key, 1), np.take_along_axis(keys, by_key, 1)
    by_sim = np.argsort(-sims, axis=1, kind="stable")[:, :k]
    return np.take_along_axis(sims, by_sim, 1), np.take_along_axis(keys, by_sim, 1)


def _whole(df: DataFrame, key: str, filters: list[str]) -> DataFrame:
    """Rows with a vector of finite numbers; its length, and the filter values as text."""
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    rows = df.select(key, F.col("embedding").cast("array<double>").alias("embedding"), *[F.col(c).cast("string").alias(c) for c in filters])
    return rows.filter((F.size("embedding") > 0) & F.coalesce(sound, F.lit(False))).withColumn("size", F.size("embedding"))


def _placed(rows: DataFrame, pivots: dict[int, tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """Unit vectors with their angles to the pivots of their length, and the nearest one as cell (-1: no pivot has the length)."""
    def place(batches):
        for pdf in batches:
            units, cells, angles = [], [], []
            for v in pdf["embedding"]:
                v = np.asarray(v, dtype="float64")
                n = np.linalg.norm(v)
                v = v / n if n else v
                cell, m = pivots.get(len(v), (np.array([-1]), np.zeros((1, len(v)))))
                a = np.arccos(np.clip(m @ v, -1, 1))
                units.append(v)
                angles.append(a)
                cells.append(int(cell[a.argmin()]))
            yield pdf.drop(columns="embedding").assign(unit=units, cell=np.array(cells, dtype="int32"), angles=angles)

    kinds = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes if n != "embedding")
    return rows.mapInPandas(place, f"{kinds}, unit array<double>, cell int, angles array<double>")


def _pivots(rows: DataFrame, key: str) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length: numbers and unit vectors of the pivots, rows sampled by a hash of their key."""
    held = rows.orderBy(F.xxhash64(key), key).limit(PIVOTS).collect()  # at most PIVOTS
    out: dict[int, list] = {}
    for n, r in enumerate(held):
        v = np.asarray(r["embedding"], dtype="float64")
        if (size := np.linalg.norm(v)) > 0:
            out.setdefault(len(v), []).append((n, v / size))
    return {d: (np.array([n for n, _ in some]), np.array([v for _, v in some])) for d, some in out.items()}


def _blocks(placed: DataFrame, key: str, filters: list[str]) -> DataFrame:
    """Runs of at most BLOCK rows of a cell and length in order of the filter values, with their range of angles.

    A range sort deals the rows out, so a crowded cell spreads over tasks.
    """
    own = F.element_at(F.array_sort("angles"), 1)  # the cell is the nearest pivot's
    rows = placed.select(F.col(key).alias("key"), "size", "cell", own.alias("angle"), "unit", *filters)
    order = ["cell", "size", *filters, "key"]

    def run(batches):
        at, held = TaskContext.get().partitionId() << 32, None

        def pack(pdf):
            nonlocal at
            at += 1
            row = {"block": at, "cell": pdf["cell"].iloc[0], "size": pdf["size"].iloc[0], "low": pdf["angle"].min(), "high": pdf["angle"].max(),
                   "keys": pdf["key"].to_numpy(), "flat": np.concatenate(pdf["unit"].to_list())}
            for c in filters:
                row[f"v{c}"] = pdf[c].tolist()
                row[f"d{c}"] = sorted({x for x in pdf[c] if x is not None})
            return row

        for pdf in batches:
            pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            out, ends = [], pdf.groupby(["cell", "size"], sort=False, dropna=False).indices
            held = None
            for n, index in enumerate(ends.values()):
                for start in range(0, len(index), BLOCK):
                    part = pdf.iloc[index[start:start + BLOCK]]
                    if n == len(ends) - 1 and start + BLOCK >= len(index):
                        held = part  # may go on in the next batch
                    else:
                        out.append(pack(part))
            if out:
                yield pd.DataFrame(out)
        if held is not None:
            yield pd.DataFrame([pack(held)])

    key_type = dict(placed.dtypes)[key]
    schema = f"block long, cell int, size int, low double, high double, keys array<{key_type}>, flat array<double>" + "".join(
        f", v{c} array<string>, d{c} array<string>" for c in filters)
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInPandas(run, schema)


def _may_hold(filters: list[str]) -> Column:
    """Whether the block has a row for each filter that the query names."""
    ok = F.lit(True)
    for c in filters:
        ok = ok & (F.col(c).isNull() | F.array_contains(F.col(f"d{c}"), F.col(c)))
    return ok


def _least() -> Column:
    """No vector of the block (or cell) has a smaller angle to the query: triangle inequality on the sphere."""
    return F.greatest(F.col("angle") - F.col("high"), F.col("low") - F.col("angle"), F.lit(0.0)) - ROOM


def _scored(pairs: DataFrame, blocks: DataFrame, k: int, filters: list[str], q_type: str, id_type: str) -> DataFrame:
    """Best k rows of each (query, block) pair; queries of a block come in groups of about BLOCK."""
    groups = pairs.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK)).alias("__groups"))
    packed = (pairs.join(groups, "block").groupBy("block", F.pmod(F.xxhash64("query_id"), F.col("__groups")).alias("group"))
              .agg(F.collect_list(F.struct("query_id", "unit", *filters)).alias("q")))
    packed = packed.select("block", F.col("q.query_id").alias("ids"), F.flatten("q.unit").alias("units"), *[F.col(f"q.{c}").alias(f"q{c}") for c in filters])

    def score(batches):
        for batch in batches:  # read row by row where Arrow has it, so a task holds the products of MEET queries and a block beside it
            at = {c: batch.column(c) for c in batch.schema.names}
            shape = pa.schema([("query_id", at["ids"].type.value_type), ("vec_id", at["keys"].type.value_type), ("similarity", pa.float64())])
            for i in range(batch.num_rows):
                ids, units, keys, flat = (at[c][i].values.to_numpy(zero_copy_only=False) for c in ("ids", "units", "keys", "flat"))
                q, v = units.reshape(len(ids), -1), flat.reshape(len(keys), -1)
                asked = list(zip(*(at[f"q{c}"][i].as_py() for c in filters))) if filters else [()] * len(ids)
                held = [np.asarray(at[f"v{c}"][i].as_py(), dtype=object) for c in filters]
                for want in set(asked):  # queries that name the same values meet the rows that have them
                    mine = np.flatnonzero([a == want for a in asked])
                    fits = np.ones(len(keys), dtype=bool)
                    for w, h in zip(want, held):
                        if w is not None:
                            fits &= h == w
                    fits = np.flatnonzero(fits)
                    if not len(fits):
                        continue
                    rows = v[fits].T
                    for some in np.split(mine, range(MEET, len(mine), MEET)):
                        sims = q[some] @ rows
                        sims, best = _keep(sims, np.broadcast_to(keys[fits], sims.shape), k)
                        found = pd.DataFrame({"query_id": np.repeat(ids[some], best.shape[1]), "vec_id": best.ravel(), "similarity": sims.ravel()})
                        yield pa.RecordBatch.from_pandas(found, shape, preserve_index=False)

    cols = ["block", "keys", "flat", *[f"v{c}" for c in filters]]
    return packed.join(blocks.select(*cols), "block").mapInArrow(score, f"query_id {q_type}, vec_id {id_type}, similarity double")


def registry_search(queries: DataFrame, vectors: DataFrame, k: int = 10) -> DataFrame:
    """Top k vectors per query (query_id, embedding), ties to the smaller vec_id; exact.

    Where both sides have a column state, city or code, a query that names a value gets only
    vectors with that value; null asks for any. Rows whose vector is null, empty or holds a null or a number that is not
    finite take no part; vectors of another length than the query's never match; a zero vector has similarity 0.

    Vectors fall into cells by their nearest pivot and there into blocks sorted by the filter values. A query first meets
    HOME blocks of its own cell; the angle of its k-th best there bounds its search, and it goes on only to blocks
    that may hold a row with its values and within that angle, told by the block's range of angles to its pivot. Products are
    taken for the rows that pass the filters.
    """
    if k < 1:
        raise ValueError("k must be positive")
    filters = [c for c in FILTERS if c in queries.columns and c in vectors.columns]
    id_type, q_type = dict(vectors.dtypes)["vec_id"], dict(queries.dtypes)["query_id"]
    rows = _whole(vectors, "vec_id", filters)
    pivots = _pivots(rows, "vec_id")
    blocks = cut(_blocks(_placed(rows, pivots), "vec_id", filters), "search-blocks")
    asked = cut(_placed(_whole(queries, "query_id", filters), pivots), "search-queries")
    about = blocks.select("block", "cell", "size", "low", "high", *[f"d{c}" for c in filters])

    home = asked.withColumn("angle", F.element_at(F.array_sort("angles"), 1)).join(about, ["cell", "size"]).filter(_may_hold(filters))
    home = top_k(home.withColumn("least", _least()), ["query_id"], [F.col("least"), F.col("block")], HOME)
    met = _scored(home.select("query_id", "unit", "block", *filters), blocks, k, filters, q_type, id_type)
    kth = met.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list("similarity"), asc=False).alias("s"))  # at most k * HOME
    within = kth.filter(F.col("n") >= k).select("query_id", F.acos(F.greatest(F.least(F.get("s", F.lit(k - 1)), F.lit(1.0)), F.lit(-1.0))).alias("within"))
    asked = asked.join(within, "query_id", "left").withColumn("within", F.coalesce("within", F.lit(4.0)))

    numbers = {d: n.tolist() for d, (n, _) in pivots.items()}
    cells = F.array(F.lit(-1))
    for d, some in numbers.items():
        cells = F.when(F.col("size") == d, F.array(*[F.lit(c) for c in some])).otherwise(cells)
    far = asked.select("query_id", "size", "unit", "within", *filters, F.explode(F.arrays_zip(cells.alias("cell"), F.col("angles").alias("angle"))).alias("c"))
    far = far.select("query_id", "size", "unit", "within", *filters, "c.cell", "c.angle")
    ranges = about.groupBy("cell", "size").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    near = far.join(F.broadcast(ranges), ["cell", "size"]).filter(_least() <= F.col("within")).drop("low", "high")  # PIVOTS rows, and one per odd length
    pairs = near.join(about, ["cell", "size"]).filter(_may_hold(filters) & (_least() <= F.col("within")))
    found = _scored(pairs.select("query_id", "unit", "block", *filters), blocks, k, filters, q_type, id_type)
    return top_k(found, ["query_id"], [F.col("similarity").desc(), F.col("vec_id")], k, spread=True)

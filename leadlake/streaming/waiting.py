"""Rows that wait in a stream until the watermark has passed their time, many keys in one state."""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Groups of keys whose rows wait and are judged together, so Python is called once for a group and batch, not for each key.
BUCKETS = 1 << 10
#: Chunks of a group before they are joined to one.
CHUNKS = 64
#: What a state holds of waiting rows; the time is that of the first one.
STATE = "waiting array<binary>, soonest long"


def bucket_of(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")


def _pack(rows: pd.DataFrame) -> bytes:
    table, sink = pa.Table.from_pandas(rows, preserve_index=False).replace_schema_metadata(None), pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpack(waiting: Iterable[bytes]) -> list[pd.DataFrame]:
    return [pa.ipc.open_stream(bytes(b)).read_pandas() for b in waiting]


def take_due(frames: Iterable[pd.DataFrame], cols: list[str], waiting: list[bytes], soonest: int | None, passed: int):
    """(rows with ``t`` before ``passed`` or None, chunks of those that wait on, the time of the first of these).

    New rows are added as a chunk of their own; older chunks are only opened when some of their rows are due.
    """
    new = [f[cols] for f in frames if len(f)]
    first = min([int(f["t"].min()) for f in new] + ([] if soonest is None else [soonest]), default=None)
    if first is None or first >= passed:
        waiting = list(waiting) + ([_pack(pd.concat(new, ignore_index=True))] if new else [])
        if len(waiting) > CHUNKS:
            waiting = [_pack(pd.concat(_unpack(waiting), ignore_index=True))]
        return None, waiting, first
    rows = pd.concat(_unpack(waiting) + new, ignore_index=True)
    due = rows["t"] < passed
    left = rows[~due]
    return rows[due], [_pack(left)] if len(left) else [], int(left["t"].min()) if len(left) else None

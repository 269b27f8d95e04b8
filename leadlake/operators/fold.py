"""Order-free folds of event logs.

A fold keeps, per key, minima and maxima of (time, id, value) structs. Such folds can be taken
over any split of the log, merged later and fed duplicates without changing the answer, so the
batch operators and the streaming appliers share them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Fold:
    keys: tuple[str, ...]
    lows: dict[str, Column]
    highs: dict[str, Column]

    def partial(self, rows: DataFrame) -> DataFrame:
        return rows.groupBy(*self.keys).agg(
            *[F.min(e).alias(n) for n, e in self.lows.items()], *[F.max(e).alias(n) for n, e in self.highs.items()])

    def merge(self, partials: DataFrame) -> DataFrame:
        return partials.groupBy(*self.keys).agg(
            *[F.min(n).alias(n) for n in self.lows], *[F.max(n).alias(n) for n in self.highs])

"""Stored rows and what a batch says about them: statuses rise, and what the batch does not say stays.

A ladder holds the rungs of a status, lowest first; statuses of one rung may follow each other, and
nothing leaves the last rung. The merge below is the only way in which the appliers change stored
messages, contacts and conversations.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadlake.plans.balance import join_hot


@dataclass(frozen=True)
class Ladder:
    rungs: tuple[tuple[str, ...], ...]

    def rung(self, status: Column) -> Column:
        """0-based rung; -1 for statuses that are not on the ladder, null among them."""
        at = F.lit(-1)
        for i, names in enumerate(self.rungs):
            at = F.when(status.isin(*names), i).otherwise(at)
        return at

    def final(self, status: Column) -> Column:
        return F.coalesce(status.isin(*self.rungs[-1]), F.lit(False))

    def allows(self, old: Column, new: Column) -> Column:
        """Whether the status may become the new one: not below, and never off the last rung."""
        return new.isNotNull() & ~self.final(old) & (self.rung(new) >= self.rung(old))


#: A message of the messaging channel; a failed send may be repeated, a sent one never fails.
MESSAGE = Ladder((("PENDING", "QUEUED"), ("FAILED",), ("SENT",), ("DELIVERED",), ("READ",)))
#: A contact of a message sequence. A reply ends it, an opt-out still counts after a reply, a block after both.
SEQUENCE = Ladder((("QUEUED",), ("SENDING",), ("SENT",), ("REPLIED",), ("OPTED_OUT",), ("COMPLETED", "CANCELLED")))
#: A mail: sent once, or failed until it is sent.
MAIL = Ladder((("SCHEDULED", "PENDING"), ("FAILED",), ("SENT",)))
#: A contact of mail outreach: steps of a live contact follow each other, a new mail after an opened one included.
OUTREACH = Ladder((("SCHEDULED", "FAILED", "SENT", "DELIVERED_INFERRED", "OPENED_INFERRED"), ("REPLIED", "UNSUBSCRIBED", "CANCELLED")))


def merge(stored: DataFrame, said: DataFrame, keys: list[str], ladder: Ladder | None = None, only_from: list[str] | None = None,
          take: tuple[str, ...] = (), fill: tuple[str, ...] = (), first: tuple[str, ...] = (), last: tuple[str, ...] = (),
          add: tuple[str, ...] = (), crowded: bool = False, status: str = "status") -> DataFrame:
    """``stored`` after what ``said`` (at most one row per key) says; keys that are not stored are ignored.

    The status changes where the ladder allows it and, with ``only_from``, the stored one is listed. Where
    ``said`` has a status, ``take`` columns (the new value unless null) and ``add`` columns (summed up)
    change only with it. Columns of ``fill`` take the new value where none is stored, ``first`` and
    ``last`` the smaller and the larger of both. So the answer does not depend on how rows are dealt to
    batches. Columns that ``stored`` lacks count as null. With ``crowded`` one key may hold much of
    ``stored``; its rows are then spread. A row with a null key is not changed.
    """
    named = [c for c in said.columns if c not in keys]
    news = said.select(*keys, *[F.col(c).alias(f"__new_{c}") for c in named], F.lit(True).alias("__said"))
    j = join_hot(stored, news, keys) if crowded else stored.join(news, keys, "left")
    hit = F.coalesce("__said", F.lit(False))
    types = dict(said.dtypes)

    def old(c):
        return F.col(c) if c in stored.columns else F.lit(None).cast(types[c])

    rises, out = hit, {}
    if status in named:
        rises = hit & ladder.allows(old(status), F.col(f"__new_{status}"))
        if only_from is not None:
            rises = rises & F.coalesce(old(status).isin(*only_from), F.lit(False))
        out[status] = F.when(rises, F.col(f"__new_{status}")).otherwise(old(status))
    for c in take:
        out[c] = F.when(rises, F.coalesce(f"__new_{c}", old(c))).otherwise(old(c))
    for c in fill:
        out[c] = F.coalesce(old(c), F.col(f"__new_{c}"))
    for c in first:
        out[c] = F.least(old(c), F.col(f"__new_{c}"))
    for c in last:
        out[c] = F.greatest(old(c), F.col(f"__new_{c}"))
    for c in add:
        out[c] = F.coalesce(old(c), F.lit(0)) + F.when(rises, F.col(f"__new_{c}")).otherwise(F.lit(0))
    return j.withColumns(out).drop("__said", *[f"__new_{c}" for c in named]).select(
        *stored.columns, *[c for c in out if c not in stored.columns])

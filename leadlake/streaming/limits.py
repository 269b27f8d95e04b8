"""Send counters over a stream: every send meets the counts that the batch audit gives it."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

from leadlake.operators.rates import HOUR, RateConfig, _key, judged, timed
from leadlake.streaming.waiting import STATE as WAITING
from leadlake.streaming.waiting import bucket_of, take_due

STATE = "keys array<string>, day array<long>, today array<long>, last array<long>, at array<array<long>>, sends array<array<long>>, " + WAITING


def _counted(rows: pd.DataFrame, known: dict[str, tuple]) -> tuple[pd.DataFrame, dict[str, tuple]]:
    """Counts of the sends (key, t, day, id) of some keys, and what is known of each key after them.

    Known of a key: its day, the count of that day, its last send, the instants of its last hour and the sends at each.
    """
    code, names = pd.factorize(rows["key"])
    order = np.lexsort((rows["t"].to_numpy(), code))
    rows, code = rows.iloc[order], code[order]
    before = [(c, t, m) for c, k in enumerate(names) if k in known for t, m in zip(known[k][3], known[k][4])]
    b_code, b_at, b_n = np.array(before, dtype=np.int64).reshape(-1, 3).T
    # Instants of all keys in order; those known from before have no day and no sends of their own to answer.
    t = rows["t"].to_numpy()
    first = np.flatnonzero(np.concatenate(([True], (code[1:] != code[:-1]) | (t[1:] != t[:-1]))))
    each = np.diff(np.append(first, len(t)))
    i_code, i_at, i_n = np.concatenate((b_code, code[first])), np.concatenate((b_at, t[first])), np.concatenate((b_n, each))
    i_day, new = np.concatenate((np.zeros_like(b_at), rows["day"].to_numpy()[first])), np.arange(len(i_at)) >= len(b_at)
    order = np.lexsort((i_at, i_code))
    i_code, i_at, i_n, i_day, new = (x[order] for x in (i_code, i_at, i_n, i_day, new))
    sent = np.concatenate(([0], np.cumsum(i_n)))
    # Instants earlier than an hour before each: those that come before it among the instants of its key.
    m = len(i_at)
    both = np.lexsort((np.repeat((0, 1), m), np.concatenate((i_at - HOUR, i_at)), np.concatenate((i_code, i_code))))
    passed = np.cumsum(both >= m)
    since = np.empty(m, np.int64)
    since[both[both < m]] = passed[both < m]
    hour = sent[:-1] - sent[since]

    code_n, at_n, day_n, n_n, hour = i_code[new], i_at[new], i_day[new], i_n[new], hour[new]
    opens = np.concatenate(([True], code_n[1:] != code_n[:-1]))
    run = np.flatnonzero(opens | np.concatenate(([True], day_n[1:] != day_n[:-1])))
    upto = np.concatenate(([0], np.cumsum(n_n)))[:-1]
    length = np.diff(np.append(run, len(n_n)))
    today = upto - np.repeat(upto[run], length)
    previous, has = np.concatenate(([0], at_n[:-1])), ~opens
    start = np.flatnonzero(opens)
    runs = dict(zip(run.tolist(), length.tolist()))
    for s in start.tolist():
        day, count, last, *_ = known.get(names[code_n[s]], (None, 0, None))
        if last is not None:
            previous[s], has[s] = last, True
        if day == day_n[s]:
            today[s:s + runs[s]] += count

    after, ends = {}, np.append(start[1:], len(n_n)) - 1
    i_end = np.flatnonzero(np.concatenate((i_code[1:] != i_code[:-1], [True])))
    for e, i in zip(ends.tolist(), i_end.tolist()):
        since_i = since[i]
        after[names[code_n[e]]] = (int(day_n[e]), int(today[e] + n_n[e]), int(at_n[e]), i_at[since_i:i + 1].tolist(), i_n[since_i:i + 1].tolist())
    own = np.repeat(np.arange(len(first)), each)
    out = pd.DataFrame({"id": rows["id"].to_numpy(), "today": today[own], "last_hour": hour[own],
                        "previous": pd.array(previous[own], dtype="Int64")})
    out.loc[~has[own], "previous"] = pd.NA
    return out, after


def running_counts(sends: DataFrame, key: str, zone: str, delay: str) -> DataFrame:
    """(send_id, today, last_hour, previous) of a stream of sends: counts of earlier sends of the same key.

    Sends wait until the watermark, ``delay`` behind the newest one, has passed them, and are counted in order of time, equal
    instants together; so the counts do not depend on the batches. Later ones are dropped. The state of a key is the count of its
    day, its last send and the sends of its last hour, and is dropped a day after that.

    The keys fall into groups that share a state (``waiting.BUCKETS``), so Python is called for groups and not for keys.
    """
    rows = timed(sends, zone).filter("sent_at IS NOT NULL").withColumn("__at", F.col("sent_at").cast("timestamp")).withWatermark("__at", delay)
    rows = rows.select(_key(key).alias("key"), "__at", F.col("__t").alias("t"), F.col("__day").alias("day"), F.col("send_id").cast("string").alias("id"))

    def count(_, frames, state: GroupState):
        *held, waiting, soonest = state.get if state.exists else ([], [], [], [], [], [], [], None)
        known, passed, out = {k: tuple(v) for k, *v in zip(*held)}, state.getCurrentWatermarkMs() * 1000, None
        due, waiting, soonest = take_due(frames, ["key", "t", "day", "id"], waiting, soonest, passed)
        if due is not None:
            out, after = _counted(due, known)
            known |= after
        known = {k: v for k, v in known.items() if v[2] + 24 * HOUR >= passed}
        if waiting or known:
            state.update((*([list(x) for x in zip(*((k, *v) for k, v in known.items()))] or [[]] * 6), waiting, soonest))
            next_due = min([v[2] + 24 * HOUR for v in known.values()] + ([] if soonest is None else [soonest]))
            state.setTimeoutTimestamp(max(next_due, passed) // 1000 + 1)
        else:
            state.remove()
        if out is not None:
            yield out

    out = rows.withColumn("bucket", bucket_of("key")).groupBy("bucket").applyInPandasWithState(
        count, "id string, today long, last_hour long, previous long", STATE, "append", "EventTimeTimeout")
    return out.select(F.col("id").cast(sends.schema["send_id"].dataType).alias("send_id"), "today", "last_hour", "previous")


def audited(sends: DataFrame, by_account: DataFrame, by_recipient: DataFrame | None, cfg: RateConfig) -> DataFrame:
    """The audit of the sends whose counters have been written, as :func:`leadlake.operators.rates.rate_audit` has it."""
    a = by_account.select("send_id", F.col("today").alias("sent_today"), F.col("last_hour").alias("sent_last_hour"), F.col("previous").alias("__prev"))
    out = timed(sends, cfg.zone).join(a, "send_id")
    if by_recipient is not None:
        r = by_recipient.select("send_id", F.col("today").alias("recipient_today"))
        out = out.join(r, "send_id", "left").withColumn(
            "recipient_today", F.when(F.col("recipient_id").isNull(), F.lit(0).cast("long")).otherwise(F.col("recipient_today")))
    return judged(out, cfg)

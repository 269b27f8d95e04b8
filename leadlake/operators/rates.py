"""Send-rate audits: what the limiter would have said before each send."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leadlake.functions.columns import half_up, micros
from leadlake.plans.balance import DAY, running_before

HOUR = 3_600_000_000


@dataclass(frozen=True)
class RateConfig:
    daily: int
    hourly: int
    min_gap: int
    max_gap: int
    opens: int
    closes: int
    recipient_daily: int | None = None
    zone: str = "America/Sao_Paulo"
    hard_daily_cap: int = 5000


EMAIL = RateConfig(daily=30, hourly=5, min_gap=60, max_gap=600, opens=9, closes=17)
MESSAGING = RateConfig(daily=50, hourly=10, min_gap=45, max_gap=180, opens=8, closes=20, recipient_daily=4)


def _local(t, zone: str):
    return F.unix_micros(F.from_utc_timestamp(F.timestamp_micros(t), zone))


def _local_day(t, zone: str):
    """The day in the zone of an instant in microseconds."""
    return F.floor(_local(t, zone) / F.lit(DAY)).cast("long")


def _key(c: str):
    """The key as text with a sign before it, so that rows without one are a group of their own in joins, too."""
    return F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-"))


def timed(sends: DataFrame, zone: str) -> DataFrame:
    """Adds the instant, its local time and local day."""
    s = sends.withColumn("__t", micros("sent_at"))
    return s.withColumns({"__local": _local(F.col("__t"), zone), "__day": _local_day(F.col("__t"), zone)})


def _account_counts(s: DataFrame, zone: str) -> DataFrame:
    """Adds sent_today, sent_last_hour and __prev, by prefixes over the minutes and days of each account.

    A send counts into the rolling hour at its instant and out one hour later, so no task sees more than the
    sends of a minute, the minutes of a day or the days of an account.
    """
    s = s.withColumn("__account", _key("account_id"))
    enter = s.select("__account", "__t", "__day", F.lit(1).alias("n"), F.lit(1).alias("hour"), F.lit(True).alias("__real"))
    later = F.col("__t") + F.lit(HOUR)
    leave = s.select("__account", later.alias("__t"), _local_day(later, zone).alias("__day"),
                     F.lit(0).alias("n"), F.lit(-1).alias("hour"), F.lit(False).alias("__real"))
    counts = running_before(enter.unionByName(leave), ["__account"], "__t", "__day", ["n", "hour"], "__real").select(
        "__account", "__t", "__day", F.col("n_in_scope").alias("sent_today"), F.col("hour_before").alias("sent_last_hour"),
        F.col("previous_at").alias("__prev"))
    return s.join(counts, ["__account", "__t", "__day"]).drop("__account")


def _recipient_counts(s: DataFrame) -> DataFrame:
    """Adds recipient_today; a send without recipient has sent nothing to it before and keeps a key of its own."""
    nobody = F.concat(F.lit("!"), F.xxhash64("account_id", "__t").cast("string"))
    s = s.withColumn("__to", F.when(F.col("recipient_id").isNull(), nobody).otherwise(_key("recipient_id")))
    rows = s.filter(F.col("recipient_id").isNotNull()).select("__to", "__t", "__day", F.lit(1).alias("n"))
    counts = running_before(rows, ["__to"], "__t", "__day", ["n"], across=False).withColumnRenamed("n_in_scope", "recipient_today")
    out = s.join(counts, ["__to", "__day", "__t"], "left")
    return out.withColumn("recipient_today", F.coalesce("recipient_today", F.lit(0).cast("long"))).drop("__to")


def rate_audit(sends: DataFrame, cfg: RateConfig) -> DataFrame:
    """Earlier sends that local day and hour, gap to the last one, first failing rule, retry delay.

    ``sends``: send_id, account_id, recipient_id, sent_at (UTC). Sends without account count as one account's.
    """
    out = _account_counts(timed(sends, cfg.zone), cfg.zone)
    return judged(_recipient_counts(out) if cfg.recipient_daily is not None else out, cfg)


def judged(out: DataFrame, cfg: RateConfig) -> DataFrame:
    """Sends with their counts -> first failing rule and retry delay."""
    gap_ms = F.floor((F.col("__t") - F.col("__prev")) / F.lit(1000)).cast("long")
    of_day = F.pmod(F.col("__local"), F.lit(DAY))
    opens, closes = cfg.opens * HOUR, cfg.closes * HOUR
    open_now = (of_day >= opens) & (of_day < closes)
    to_open = F.floor((F.when(of_day < opens, F.lit(opens) - of_day).otherwise(F.lit(DAY + opens) - of_day)) / F.lit(1000)).cast("long")
    day_ms, hour_ms = F.lit(86_400_000).cast("long"), F.lit(3_600_000).cast("long")
    rules = [
        ("daily", F.col("sent_today") >= min(cfg.daily, cfg.hard_daily_cap), day_ms),
        ("hourly", F.col("sent_last_hour") >= cfg.hourly, hour_ms),
        ("gap", F.coalesce(gap_ms < cfg.min_gap * 1000, F.lit(False)), F.lit(cfg.min_gap * 1000).cast("long") - gap_ms),
    ]
    if cfg.recipient_daily is not None:
        rules.append(("recipient", F.col("recipient_today") >= cfg.recipient_daily, day_ms))
    rules.append(("hours", ~open_now, to_open))
    rule = retry = None
    for name, broken, wait in rules:
        rule = F.when(broken, name) if rule is None else rule.when(broken, name)
        retry = F.when(broken, wait) if retry is None else retry.when(broken, wait)
    return (out.withColumns({"gap_ms": gap_ms, "in_hours": open_now, "rule": rule, "retry_ms": retry})
            .withColumn("allowed", F.col("rule").isNull())
            .drop("__t", "__local", "__day", "__prev"))


def email_rate_audit(sends: DataFrame, cfg: RateConfig = EMAIL) -> DataFrame:
    return rate_audit(sends, cfg)


def wa_rate_audit(sends: DataFrame, cfg: RateConfig = MESSAGING) -> DataFrame:
    return rate_audit(sends, cfg)


def send_jitter(messages: DataFrame, cfg: RateConfig = EMAIL, id_col: str = "message_id") -> DataFrame:
    """Delay in whole seconds between the configured bounds, fixed by the message id."""
    u = F.conv(F.substring(F.md5(F.col(id_col).cast("string").cast("binary")), 1, 8), 16, 10).cast("long") % 10_000 / F.lit(10_000.0)
    return messages.withColumn("delay_seconds", half_up(F.lit(cfg.min_gap) + u * (cfg.max_gap - cfg.min_gap)))

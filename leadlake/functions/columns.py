"""Reusable column expressions. Everything here stays inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leadlake.functions import fixed


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def digits(c) -> Column:
    """Keep only 0-9; null becomes the empty string."""
    return F.regexp_replace(F.coalesce(col(c), F.lit("")), "[^0-9]", "")


def present(c) -> Column:
    """Null out blank strings."""
    return F.when(F.trim(col(c)) != "", col(c))


def first_present(*cs) -> Column:
    return F.coalesce(*[present(c) for c in cs])


def trimmed(c) -> Column:
    return F.when(F.trim(col(c)) != "", F.trim(col(c)))


def half_up(c) -> Column:
    """Round half towards positive infinity, to a long."""
    return F.floor(col(c).cast("double") + F.lit(0.5))


def clamp(c, low, high) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), col(c)))


def fold(c) -> Column:
    """Accent-free text, case kept."""
    return F.translate(F.coalesce(col(c), F.lit("")), fixed.ACCENTED, fixed.UNACCENTED)


def place_key(c) -> Column:
    return F.trim(F.lower(fold(c)))


def lookup(mapping: dict[str, str], c, default: Column | None = None) -> Column:
    """Small fixed vocabulary as a CASE, so no join is needed."""
    by_target: dict[str, list[str]] = {}
    for k, v in mapping.items():
        by_target.setdefault(v, []).append(k)
    out = None
    for target, keys in by_target.items():
        cond = col(c).isin(keys)
        out = F.when(cond, F.lit(target)) if out is None else out.when(cond, F.lit(target))
    return out.otherwise(default) if default is not None else out


def cnpj_valid(c) -> Column:
    return F.length(digits(c)) == 14


def cnpj_format(c) -> Column:
    d = digits(c)
    dotted = F.concat(
        F.substring(d, 1, 2), F.lit("."), F.substring(d, 3, 3), F.lit("."), F.substring(d, 6, 3),
        F.lit("/"), F.substring(d, 9, 4), F.lit("-"), F.substring(d, 13, 2),
    )
    return F.when(F.length(d) == 14, dotted).otherwise(F.coalesce(col(c), F.lit("")))


def phone_normalise(c) -> Column:
    """Digits with the country prefix 55 for national numbers; blank -> null."""
    d = digits(c)
    national = F.when(d.startswith("55") & (F.length(d) >= 12), F.substr(d, F.lit(3))).otherwise(d)
    return F.when(
        d != "",
        F.when(F.length(national).between(10, 11), F.concat(F.lit("55"), national)).otherwise(national),
    )


def chat_id(c) -> Column:
    return F.concat(phone_normalise(c), F.lit("@c.us"))


def phone_of_chat(c) -> Column:
    return digits(F.substring_index(F.coalesce(col(c), F.lit("")), "@", 1))


def is_opt_out(c, keywords: list[str] | None = None) -> Column:
    """Whole text, prefix, token or phrase match against the opt-out keywords."""
    text = F.regexp_replace(F.upper(fold(c)), r"^\s+|\s+$", "")
    tokens = F.split(text, r"\s+")
    hit = F.lit(False)
    for k in keywords if keywords is not None else fixed.OPT_OUT_KEYWORDS:
        if " " in k:
            hit = hit | text.contains(k)
        else:
            hit = hit | text.startswith(k + "!") | text.startswith(k + ".")
    singles = [k for k in (keywords if keywords is not None else fixed.OPT_OUT_KEYWORDS) if " " not in k]
    return (text != "") & (hit | F.arrays_overlap(tokens, F.array(*[F.lit(s) for s in singles])))


def name_uuid(c, namespace: str = fixed.COMPANY_ID_NAMESPACE) -> Column:
    """Version-5 UUID of a name inside a namespace."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(F.coalesce(col(c), F.lit("")), "UTF-8")))
    nibble = F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4
    return F.concat(
        F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"),
        F.substr(F.lit("89ab"), nibble + 1, F.lit(1)), F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12),
    )


def short_key(*cs, size: int = 32) -> Column:
    """Leading hex of the SHA-256 of the parts joined by a bar; nulls are empty."""
    parts = [F.coalesce(col(c).cast("string"), F.lit("")) for c in cs]
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, size)


def micros(c) -> Column:
    """Microseconds since the epoch, reading zone-free timestamps as UTC."""
    return F.unix_micros(col(c).cast("timestamp"))


def utc_ntz(c) -> Column:
    """Zone-free timestamp from microseconds since the epoch."""
    return F.timestamp_micros(col(c)).cast("timestamp_ntz")

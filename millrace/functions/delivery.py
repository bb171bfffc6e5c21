"""Outcomes, retries and times as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Permanent codes that are tried again, beside all from 400 to 499.
RETRIED_CODES = [500, 501, 502, 503, 504, 521, 530, 550, 551, 552, 553, 554]
MAX_RETRIES = 5
FIRST_DELAY_S, LAST_DELAY_S, LAST_POWER = 60, 86_400, 24


def retryable(code: Column) -> Column:
    return F.coalesce(code.between(400, 499) | code.isin(RETRIED_CODES), F.lit(False))


def classify(transient: Column, permanent: Column, code: Column) -> Column:
    """defer for transient errors, retried codes and errors of neither kind; else bounce."""
    return F.when(transient, "defer").when(permanent & ~retryable(code), "bounce").otherwise("defer")


def backoff_s(attempts: Column) -> Column:
    """Seconds to the next attempt: doubled from a minute up to a day."""
    power = F.pow(F.lit(2.0), F.least(attempts, F.lit(LAST_POWER)))
    return F.least(F.lit(FIRST_DELAY_S) * power, F.lit(float(LAST_DELAY_S))).cast("long")


def unreadable_backoff_ms(attempts: Column) -> Column:
    return (F.lit(60_000) * F.pow(F.lit(2.0), F.least(attempts, F.lit(10)))).cast("long")


def exhausted(attempts: Column, most: int = MAX_RETRIES) -> Column:
    return attempts >= most


def delay_ms(queued_ms: Column, logged_ms: Column) -> Column:
    return F.when(queued_ms.isNotNull(), F.greatest(F.lit(0).cast("long"), logged_ms - queued_ms))


def age_text(ms: Column) -> Column:
    """Two units at most: 45s, 3m12s, 1h4m, 2d3h; negative ages are 0s."""
    s = F.floor(F.greatest(ms, F.lit(0)) / 1000).cast("long")
    d, h, m = (s / 86_400).cast("long"), (s % 86_400 / 3600).cast("long"), (s % 3600 / 60).cast("long")
    t = lambda n, unit: F.concat(n.cast("string"), F.lit(unit))
    return F.when(d > 0, F.concat(t(d, "d"), t(h, "h"))).when(h > 0, F.concat(t(h, "h"), t(m, "m"))).when(m > 0, F.concat(t(m, "m"), t(s % 60, "s"))).otherwise(t(s, "s"))


def ratio_text(dead: Column, total: Column) -> Column:
    return F.concat(F.format_string("%.1f", F.when(total > 0, dead / total * 100).otherwise(0.0)), F.lit("%"))


def rfc3339(ms: Column) -> Column:
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def shard_of(message_id: Column, shards: int) -> Column:
    """The last two bytes of a 16-byte id, little-endian, modulo the number of shards; only for new messages."""
    low, high = (F.conv(F.hex(F.substring(message_id, at, 1)), 16, 10).cast("int") for at in (15, 16))
    return (low + 256 * high) % shards


def record_bytes(sender: Column, recipients: Column, body_bytes: Column) -> Column:
    """The length of an encoded payload record."""
    return 60 + F.octet_length(sender) + F.aggregate(recipients, F.lit(0), lambda n, r: n + 2 + F.octet_length(r)) + body_bytes


def sts_field(text: Column, key: str, pair: str = "[;\r\n]+", between: str = "[=:]") -> Column:
    """The first value of key in a policy text or record; null where absent."""
    parts = F.transform(F.split(text, pair), lambda p: F.trim(p))
    return F.regexp_extract(F.get(F.filter(parts, lambda p: p.rlike(rf"^{key}\s*{between}")), F.lit(0)), rf"^{key}\s*{between}\s*(.*?)\s*$", 1)


def sts_policy_error(text: Column, longest_s: int = 31_557_600) -> Column:
    """Null for a valid policy, else what is wrong first: version, mode, max_age or mx."""
    mode, age = sts_field(text, "mode", r"\r?\n", ":"), sts_field(text, "max_age", r"\r?\n", ":").try_cast("long")
    mx = sts_field(text, "mx", r"\r?\n", ":")
    return (
        F.when(F.coalesce(sts_field(text, "version", r"\r?\n", ":"), F.lit("")) != "STSv1", "version")
        .when(~F.coalesce(mode, F.lit("")).isin("enforce", "testing", "none"), "mode")
        .when(age.isNull() | (age < 0) | (age > longest_s), "max_age")
        .when((mode != "none") & mx.isNull(), "mx")
    )


def enforcement(mode: Column, matches: Column) -> Column:
    return F.when((mode == "enforce") & ~matches, "skip").when((mode == "testing") & ~matches, "count").otherwise("use")

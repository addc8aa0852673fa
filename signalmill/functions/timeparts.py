"""Zone-free time arithmetic on TIMESTAMP_NTZ columns."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, SparkSession, functions as F

US = 1_000_000
MINUTE = 60 * US
HOUR = 3600 * US
DAY = 24 * HOUR


def as_us(moment: datetime | int) -> int:
    """Epoch microseconds of a driver-side moment (naive = UTC)."""
    if isinstance(moment, int):
        return moment
    if moment.tzinfo is None:
        moment = moment.replace(tzinfo=timezone.utc)
    delta = moment - datetime(1970, 1, 1, tzinfo=timezone.utc)
    return (delta.days * 86_400 + delta.seconds) * US + delta.microseconds


def ntz(moment: datetime | int) -> Column:
    """TIMESTAMP_NTZ literal."""
    if isinstance(moment, int):
        return from_us(F.lit(moment))
    return F.lit(moment.isoformat(sep=" ")).cast("timestamp_ntz")


def _session_is_utc() -> bool:
    session = SparkSession.getActiveSession()
    zone = session.conf.get("spark.sql.session.timeZone") if session else ""
    return zone in ("UTC", "Etc/UTC", "GMT", "Z", "+00:00")


def to_us(ts: Column | str) -> Column:
    """Epoch microseconds of a TIMESTAMP_NTZ column, whatever the session zone.

    In a UTC session the plain conversion gives the same number and costs less.
    """
    ts = F.col(ts) if isinstance(ts, str) else ts
    if _session_is_utc():
        return F.unix_micros(ts.cast("timestamp"))
    days = F.datediff(ts.cast("date"), F.lit("1970-01-01").cast("date")).cast("bigint")
    seconds = F.date_part(F.lit("SECOND"), ts)
    return (
        days * DAY
        + F.hour(ts).cast("bigint") * HOUR
        + F.minute(ts).cast("bigint") * MINUTE
        + (seconds * F.lit(US)).cast("bigint")
    )


def from_us(us: Column | str) -> Column:
    """TIMESTAMP_NTZ of an epoch-microsecond column."""
    us = F.col(us) if isinstance(us, str) else us
    if _session_is_utc():
        return F.timestamp_micros(us.cast("bigint")).cast("timestamp_ntz")
    secs = us.cast("decimal(24,0)") / F.lit(US).cast("decimal(8,0)")
    step = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), secs.cast("decimal(18,6)"))
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + step


def floor_div(num: Column, den: int | Column) -> Column:
    """Integer floor division (toward minus infinity)."""
    den = F.lit(den) if isinstance(den, int) else den
    return ((num - F.pmod(num, den)) / den).cast("bigint")


def shift(ts: Column | str, minutes: float) -> Column:
    """Move a timestamp by a fixed minute offset (query time zone, no DST)."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    return ts + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(int(minutes)), F.lit(0))


def time_attr(ts: Column | str, attr: str) -> Column:
    """Zero-based calendar part: minute, hour, dayOfWeek (Mon=0), dayOfMonth, month."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    parts = {
        "minute": lambda: F.minute(ts),
        "hour": lambda: F.hour(ts),
        "dayOfWeek": lambda: F.weekday(ts),
        "dayOfMonth": lambda: F.dayofmonth(ts) - 1,
        "month": lambda: F.month(ts) - 1,
    }
    if attr not in parts:
        raise ValueError(f"unknown time attribute {attr!r}")
    return parts[attr]().cast("int")

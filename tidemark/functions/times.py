"""Time columns: UTC text, epoch conversion, market-zone wall time, source date formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NEW_YORK = "America/New_York"
SECOND = 1_000_000
MINUTE = 60 * SECOND
HOUR = 60 * MINUTE
DAY = 24 * HOUR


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def micros(c: Column | str) -> Column:
    """Microseconds since the epoch of a TIMESTAMP (or of an NTZ value read as UTC)."""
    return F.unix_micros(_c(c).cast("timestamp"))


def from_micros(c: Column | str) -> Column:
    return F.timestamp_micros(_c(c))


def nanos_to_timestamp(c: Column | str) -> Column:
    """Integer nanoseconds since the epoch, floored to microseconds."""
    ns = _c(c).cast("long")
    return F.timestamp_micros(((ns - F.pmod(ns, F.lit(1000))) / F.lit(1000).cast("decimal(4,0)")).cast("long"))


def to_utc_iso(c: Column | str) -> Column:
    """``YYYY-MM-DDTHH:MM:SS[.ffffff]Z``; the fraction only when it is not zero."""
    text = F.date_format(_c(c), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return F.concat(F.regexp_replace(text, r"\.000000$", ""), F.lit("Z"))


def parse_utc_iso(c: Column | str) -> Column:
    """ISO text with ``Z`` or an offset; anything without a zone gives NULL."""
    text = F.trim(_c(c))
    zoned = text.rlike(r"(Z|[+-]\d{2}:?\d{2})$")
    return F.when(zoned, F.try_to_timestamp(text))


def wall_seconds(c: Column | str, zone: str = NEW_YORK) -> Column:
    """Seconds since local midnight, with the microsecond fraction."""
    local = F.from_utc_timestamp(_c(c), zone)
    return F.hour(local) * 3600 + F.minute(local) * 60 + F.second(local) + F.pmod(micros(_c(c)), F.lit(SECOND)) / F.lit(1e6)


def _clock(text: str) -> int:
    parts = [int(p) for p in text.split(":")]
    return parts[0] * 3600 + parts[1] * 60 + (parts[2] if len(parts) > 2 else 0)


def in_session(c: Column | str, zone: str = NEW_YORK, opens: str = "09:30", closes: str = "16:00") -> Column:
    """Regular-session test on local wall time, both ends inclusive; no weekday or holiday rule."""
    return wall_seconds(c, zone).between(F.lit(_clock(opens)), F.lit(_clock(closes)))


def session_close(c: Column | str, zone: str = NEW_YORK, closes: str = "16:00") -> Column:
    """UTC instant of the session close on the local date of ``c``."""
    local_day = F.date_trunc("day", F.from_utc_timestamp(_c(c), zone))
    return F.to_utc_timestamp(local_day + F.make_dt_interval(secs=F.lit(_clock(closes))), zone)


def local_date(c: Column | str, zone: str = NEW_YORK) -> Column:
    return F.to_date(F.from_utc_timestamp(_c(c), zone))


def end_of_local_day(day: Column | str, zone: str = NEW_YORK) -> Column:
    """Last microsecond of a local date as a UTC instant."""
    nxt = F.date_add(_c(day), 1).cast("timestamp")
    return F.timestamp_micros(micros(F.to_utc_timestamp(nxt, zone)) - 1)


def strict_date(c: Column | str) -> Column:
    """``YYYY-MM-DD`` exactly, else NULL."""
    text = _c(c)
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(text, "yyyy-MM-dd"))


def leading_date(c: Column | str) -> Column:
    """Date in the first ten characters, else NULL."""
    return strict_date(F.substring(_c(c), 1, 10))


def filing_timestamp(c: Column | str, zone: str = NEW_YORK) -> Column:
    """Fourteen digits are Eastern wall time; ISO text must carry a zone; else NULL."""
    text = F.trim(_c(c))
    digits = F.when(text.rlike(r"^\d{14}$"), F.to_utc_timestamp(F.try_to_timestamp(text, F.lit("yyyyMMddHHmmss")), zone))
    return F.coalesce(digits, F.when(~text.rlike(r"^\d{14}$"), parse_utc_iso(text)))


def source_date(c: Column | str) -> Column:
    """``MM/DD/YYYY`` or ISO source date, else NULL."""
    text = F.trim(_c(c))
    return F.coalesce(F.when(text.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), F.try_to_date(text, "M/d/yyyy")), leading_date(text))


def discovery_window(observed_at: Column | str, lookback_days: int, zone: str = NEW_YORK) -> Column:
    """Struct (start, end) of the local date range of N days ending on the observed day."""
    end = local_date(observed_at, zone)
    return F.struct(F.date_sub(end, lookback_days - 1).alias("start"), end.alias("end"))


def next_bar_due(t: Column | str, bar_seconds: int = 300, grace_seconds: int = 30) -> Column:
    """First ``bar boundary + grace`` strictly after ``t``."""
    width, grace = bar_seconds * SECOND, grace_seconds * SECOND
    boundary = micros(_c(t)) - F.pmod(micros(_c(t)), F.lit(width))
    due = boundary + grace
    return F.timestamp_micros(F.when(due > micros(_c(t)), due).otherwise(due + width))

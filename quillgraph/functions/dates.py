"""Dates, ages, durations, retention and intervals."""

from __future__ import annotations

import re
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Seconds of a unit; months and years are not those of the calendar.
UNITS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400, "week": 7 * 86400, "month": 30 * 86400, "year": 365 * 86400}
WEEKDAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")


def humanise_days(days: Column) -> Column:
    text = lambda n, unit: F.concat((days / n).cast("int").cast("string"), F.lit(unit))
    return F.when(days < 1, "today").when(days < 7, text(1, "d")).when(days < 30, text(7, "w")).when(days < 365, text(30, "mo")).otherwise(text(365, "y"))


def parse_time(text: str, now: datetime) -> tuple[str, object]:
    """("offset", n) of HEAD~n, ("at", time) of a time or a phrase for one, ("ref", text) of anything else.

    A date means its last second. Phrases: now, today, yesterday, last week, last <weekday>, <n> <units> ago.
    """
    s = text.strip()
    low = s.lower()
    if m := re.fullmatch(r"head(?:~(\d*))?", low):
        return "offset", int(m[1] or 1) if "~" in low else 0
    if re.fullmatch(r"\d{4}-\d{2}-\d{2}", s):
        return "at", datetime.fromisoformat(s).replace(hour=23, minute=59, second=59, tzinfo=timezone.utc)
    try:
        at = datetime.fromisoformat(s.replace("Z", "+00:00"))
        if at.tzinfo:
            return "at", at
    except ValueError:
        pass
    start = now.replace(hour=0, minute=0, second=0, microsecond=0)
    if low == "now":
        return "at", now
    if low in ("today", "yesterday"):
        return "at", start - timedelta(days=low == "yesterday")
    if low == "last week":
        return "at", start - timedelta(days=7)
    if (m := re.fullmatch(r"last (\w+)", low)) and m[1] in WEEKDAYS:
        back = (now.weekday() - WEEKDAYS.index(m[1])) % 7 or 7
        return "at", start - timedelta(days=back)
    if m := re.fullmatch(r"(\d+) (\w+?)s? ago", low):
        if m[2] in UNITS:
            return "at", now - timedelta(seconds=int(m[1]) * UNITS[m[2]])
    return "ref", s


def retention(text: str) -> tuple[str, int]:
    """("forever", 0), ("count", n) of `last-n`, or ("seconds", n) of `<n>d`, `w`, `mo` or `y`."""
    s = text.strip()
    if s.lower() == "forever":
        return "forever", 0
    if m := re.fullmatch(r"last-(\d+)", s):
        return "count", int(m[1])
    if m := re.fullmatch(r"(-?\d+)\s*(mo|d|w|y)", s):
        return "seconds", int(m[1]) * {"mo": UNITS["month"], "d": UNITS["day"], "w": UNITS["week"], "y": UNITS["year"]}[m[2]]
    raise ValueError(f"not a retention: {text}")


#: A date, or a time with a zone.
RFC3339 = r"^\d{4}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01])(?:[Tt](?:[01]\d|2[0-3]):[0-5]\d:[0-5]\d(?:\.\d+)?(?:[Zz]|[+-]\d{2}:\d{2}))?$"


def resolve_date(sources: list[tuple[str, Column]], ceiling: str | None = None) -> tuple[Column, Column, Column]:
    """(date, source, error) from the first source, in order, that isn't blank.

    A plain date means midnight UTC. `malformed`: no date or time with a zone, no real day, in the future, or before
    1970; `missing`: all are blank.
    """
    picked = F.coalesce(*(F.when(F.trim(F.coalesce(c, F.lit(""))) != "", F.struct(F.lit(n).alias("source"), F.trim(c).alias("raw"))) for n, c in sources))
    raw = picked["raw"]
    real = F.try_to_timestamp(F.substring(raw, 1, 10), F.lit("yyyy-MM-dd")).isNotNull()
    full = F.when(raw.rlike(RFC3339) & real, F.when(F.length(raw) == 10, F.concat(raw, F.lit("T00:00:00Z"))).otherwise(raw))
    late = (full > ceiling) if ceiling else F.lit(False)
    ok = full.isNotNull() & ~late & (full >= "1970-01-01T00:00:00Z")
    return F.when(ok, full), picked["source"], F.when(picked.isNull(), "missing").when(~F.coalesce(ok, F.lit(False)), "malformed")


def minus_seconds(rfc3339: Column, seconds: int) -> Column:
    """An earlier time in the same form, in UTC."""
    return F.date_format(F.to_timestamp(rfc3339) - F.expr(f"interval {seconds} seconds"), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def epoch_to_rfc3339(seconds: Column) -> Column:
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def rfc822(ts: Column) -> Column:
    return F.date_format(ts, "EEE, dd MMM yyyy HH:mm:ss '+0000'")


def temporal_relation(now: Column, start: Column, end: Column) -> Column:
    """How a moment stands to an interval."""
    return F.when(now < start, "before").when(now == start, "meets").when(now < end, "within").when(now == end, "finishes").otherwise("after")


def archive_range(seq: Column, size: int) -> tuple[Column, Column]:
    """The half-open bucket of an archive that a sequence number falls into."""
    start = F.floor(seq / size) * size
    return start, start + size


def vault_hash(description: Column) -> Column:
    """The 64 hex digits after `vault_root_hash=`, else null."""
    return F.nullif(F.regexp_extract(description, r"vault_root_hash=([0-9a-fA-F]{64})(?![0-9a-fA-F])", 1), F.lit(""))


def co_authors(description: Column) -> Column:
    """array<struct<name, email>> of the `Co-authored-by` trailers."""
    pattern = r"(?im)^\s*co-authored-by:\s*([^<\n]*?)\s*<([^>\n]*)>\s*$"
    names, mails = (F.regexp_extract_all(description, F.lit(pattern), F.lit(i)) for i in (1, 2))
    return F.transform(F.arrays_zip(names.alias("name"), mails.alias("email")), lambda x: F.struct(x["name"].alias("name"), x["email"].alias("email")))

"""Multi-format timestamp parsing and rendering.

Layouts are tried in a fixed order; the first that parses wins.  Layouts
without an offset are wall-clock time in the local zone.  A literal ``Z``
after whole seconds is matched by a layout that ignores it, so such text is
read as local time too (``z_suffix="local"``, the reproduced behaviour);
``z_suffix="utc"`` reads it as UTC instead.
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import config

# (pattern, has_offset, shape) in the order they are tried.  A layout parses no text
# that lacks its shape: the shapes spare the parser texts of other layouts.
_CLOCK = r"\d+:\d+:\d+"
_LAYOUTS = [
    ("yyyy-M-d'T'H:m:s", False, rf"(?i)t{_CLOCK}$"),
    ("yyyy-M-d'T'H:m:s'Z'", False, rf"(?i)t{_CLOCK}z$"),
    ("yyyy-M-d'T'H:m:sxx", True, rf"(?i)t{_CLOCK}[+-]\d+$"),
    ("yyyy-M-d'T'H:m:sxxx", True, rf"(?i)t{_CLOCK}[+-]\d+:\d+$"),
    ("yyyy/M/d H:m:s", False, rf"^[+-]?\d+/\d+/\d+ {_CLOCK}$"),
    ("yyyy-M-d H:m:s", False, rf"^[+-]?\d+-\d+-\d+ {_CLOCK}$"),
    ("d/M/yyyy H:m:s", False, rf"^\d+/\d+/[+-]?\d+ {_CLOCK}$"),
]
# ISO-8601 tail: basic or extended date, week date, basic or extended time down
# to hours alone, fraction after a point or comma, optional offset or Z.
_ISO = (r"^(\d{4}-\d{2}-\d{2}|\d{8}|\d{4}-W\d{2}(-[1-7])?|\d{4}W\d{2}[1-7]?)"
        r"([T ](\d{2}|\d{2}:\d{2}(:\d{2}([.,]\d+)?)?|\d{4}(\d{2}([.,]\d+)?)?))?(Z|[+-]\d{2}(:?\d{2})?)?$")
_ISO_ZONED = r"(Z|[+-]\d{2}(:?\d{2})?)$"
_ISO_TIME = r"[T ]\d{2}"
_ISO_WEEK = r"^(\d{4})-?W(\d{2})-?([1-7]?)(.*)$"
# rewrites to the one form that the cast reads, in this order
_ISO_REWRITES = [
    (r"^(\d{4})(\d{2})(\d{2})", "$1-$2-$3"),
    (r"[T ](\d{2})(\d{2})(\d{2})", "T$1:$2:$3"),
    (r"[T ](\d{2})(\d{2})(?!\d)", "T$1:$2"),
    (r"[T ](\d{2})(?![\d:])", "T$1:00"),
    (r"[T ](\d{2}:\d{2})(?!:)", "T$1:00"),
    (r"[.,](\d{1,6})\d*", ".$1"),
    (r"([+-]\d{2})(\d{2})$", "$1:$2"),
]


def _try(s: Column, fmt: str) -> Column:
    return F.try_to_timestamp(s, F.lit(fmt))


def _week_date(s: Column) -> Column:
    """ISO week date (Monday if no day is given) as a calendar date, with the
    rest of the text; NULL if the year has no such week."""
    year, week, day = (F.regexp_extract(s, _ISO_WEEK, i).try_cast("int") for i in (1, 2, 3))
    first = F.date_trunc("week", F.to_date(F.concat(F.regexp_extract(s, _ISO_WEEK, 1), F.lit("-01-04")))).cast("date")
    monday = F.date_add(first, (week - 1) * 7)
    date = F.date_add(monday, F.coalesce(day, F.lit(1)) - 1)
    there = (week >= 1) & (F.year(F.date_add(monday, 3)) == year)
    return F.when(there, F.concat(date.cast("string"), F.regexp_extract(s, _ISO_WEEK, 4)))


def parse_event_time(text: Column, local_tz: str = config.LOCAL_TZ, z_suffix: str = "local",
                     stripped: bool = False) -> Column:
    """F3 + F4: UTC instant as TimestampType, NULL when no layout parses.
    ``text`` should already be stripped of surrounding white space when it is
    a shared column (see ``ingest.validate``); it is stripped here otherwise."""
    s = text if stripped else F.regexp_replace(text, r"^\s+|\s+$", "")
    candidates = []
    for fmt, has_offset, shape in _LAYOUTS:
        if fmt.endswith("'Z'") and z_suffix == "utc":
            has_offset = True
            fmt = fmt.replace("'Z'", "X")
            shape = rf"(?i)t{_CLOCK}(z|[+-]\d+)$"
        ts = F.when(s.rlike(shape), _try(s, fmt))
        candidates.append(ts if has_offset else F.to_utc_timestamp(ts, local_tz))
    iso_ok = s.rlike(_ISO)
    plain = F.when(s.rlike(_ISO_WEEK), _week_date(s)).otherwise(s)
    for pattern, form in _ISO_REWRITES:
        plain = F.regexp_replace(plain, pattern, form)
    zoned = s.rlike(_ISO_TIME) & s.rlike(_ISO_ZONED)
    iso_ts = F.try_to_timestamp(F.when(iso_ok, plain))
    candidates.append(F.when(zoned, iso_ts).otherwise(F.to_utc_timestamp(iso_ts, local_tz)))
    return F.coalesce(*candidates)


def utc_text(ts: Column) -> Column:
    """``yyyy-MM-ddTHH:mm:ssZ`` (session time zone must be UTC)."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def local_text(ts: Column, local_tz: str = config.LOCAL_TZ) -> Column:
    """local wall clock plus offset without colon, e.g. ``+0330``."""
    local = F.from_utc_timestamp(ts, local_tz)
    off = (F.unix_timestamp(local) - F.unix_timestamp(ts)).cast("long")
    sign = F.when(off < 0, F.lit("-")).otherwise(F.lit("+"))
    a = F.abs(off)
    hh = F.lpad((a / 3600).cast("long").cast("string"), 2, "0")
    mm = F.lpad(((a % 3600) / 60).cast("long").cast("string"), 2, "0")
    return F.concat(F.date_format(local, "yyyy-MM-dd'T'HH:mm:ss"), sign, hh, mm)


def is_night(ts: Column) -> Column:
    """UTC hour >= 20 or < 2."""
    h = F.hour(ts)
    return (h >= 20) | (h < 2)

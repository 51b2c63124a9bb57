"""Durations, timestamps and partition keys. Time is a signed 64-bit count of nanoseconds since 1970, UTC."""

from __future__ import annotations

import re
import time
from datetime import datetime, timezone
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

NS = 1_000_000_000
DAY_NS = 86_400 * NS
UNITS = {"ns": 1, "us": 1_000, "ms": 1_000_000, "s": NS}
#: Nanoseconds of each duration unit.
DURATION_UNITS = {"ns": 1, "us": 1_000, "µs": 1_000, "μs": 1_000, "ms": 1_000_000, "s": NS, "m": 60 * NS, "h": 3_600 * NS, "d": DAY_NS, "w": 7 * DAY_NS}
MAX_RELATIVE_NS = 3_650 * DAY_NS
PARTITION_MODES = ("day", "month", "year", "forever")
_PART = re.compile(r"(\d+\.?\d*|\.\d+)(ns|us|µs|μs|ms|s|m|h|d|w)")
_TEXT = re.compile(r"(\d{4})-(\d{2})-(\d{2})(?:[ T](\d{2})(?::(\d{2})(?::(\d{2}))?)?)?(?:\.(\d*))?(Z|[+-]\d{2}:\d{2})?")


def parse_duration(text: str) -> int:
    """Nanoseconds of a duration such as 90s, 1.5h or 1w2d3h; a sign may stand in front, and 0 needs no unit."""
    v = text.strip()
    if not v:
        raise ValueError("missing duration")
    sign, body = (-1 if v[0] == "-" else 1), v.lstrip("+-") if v[0] in "+-" else v
    if body == "0":
        return 0
    total, at = 0, 0
    for m in _PART.finditer(body):
        if m.start() != at:
            break
        total += int(Decimal(m[1]) * DURATION_UNITS[m[2]])
        at = m.end()
    if at != len(body) or not body:
        raise ValueError(f"invalid duration {text!r}")
    if total >= 1 << 63:
        raise ValueError(f"duration {text!r} is out of range")
    return sign * total


def normalize_unit(unit: str | None) -> str:
    u = (unit or "").strip().lower() or "ns"
    if u not in UNITS:
        raise ValueError(f"invalid timestamp unit {unit!r} (one of ns, us, ms, s)")
    return u


def _now(now: int | None) -> int:
    return time.time_ns() if now is None else now


def _relative(text: str, scale: int, now: int | None) -> int | None:
    """now less the magnitude that follows the minus sign; None if it isn't one."""
    body = text[1:]
    if re.fullmatch(r"\d+(\.\d+)?", body):
        ns = int(Decimal(body) * scale)
    else:
        try:
            ns = parse_duration(body)
        except ValueError:
            return None
    if ns > MAX_RELATIVE_NS:
        raise ValueError("a relative time may go back 10 years at most")
    return _now(now) - ns


def _text(text: str) -> int:
    m = _TEXT.fullmatch(text)
    if not m:
        raise ValueError(f"invalid timestamp {text!r}")
    y, mo, d, h, mi, s = (int(g or 0) for g in m.groups()[:6])
    base = int(datetime(y, mo, d, h, mi, s, tzinfo=timezone.utc).timestamp())
    if m[8] and m[8] != "Z":
        sign = 1 if m[8][0] == "+" else -1
        base -= sign * (int(m[8][1:3]) * 3600 + int(m[8][4:6]) * 60)
    return base * NS + int((m[7] or "").ljust(9, "0")[:9])


def parse_timestamp(text: str, now: int | None = None) -> int:
    """Nanoseconds from a whole number of them, a date with or without time, or a relative time (bare numbers are seconds)."""
    v = text.strip()
    if not v:
        raise ValueError("a timestamp cannot be empty")
    if v[0] == "-" and len(v) > 1 and (r := _relative(v, NS, now)) is not None:
        return r
    return int(v) if v.isdigit() else _text(v)


def parse_timestamp_with_unit(text: str, unit: str | None = "ns", now: int | None = None) -> int:
    """As parse_timestamp, with bare numbers, whole or not, in the unit."""
    scale = UNITS[normalize_unit(unit)]
    v = text.strip()
    if not v:
        raise ValueError("a timestamp cannot be empty")
    if v[0] == "-" and len(v) > 1 and (r := _relative(v, scale, now)) is not None:
        return r
    if v.isdigit():
        return int(v) * scale
    if re.fullmatch(r"\d*\.\d+|\d+\.", v):
        return int(float(v) * scale)
    return _text(v)


def parse_cli_time(text: str, unit: str | None = "ns", now: int | None = None) -> int:
    """A positive duration is that long before now; anything else is a timestamp."""
    try:
        d = parse_duration(text)
    except ValueError:
        d = 0
    return _now(now) - d if d > 0 else parse_timestamp_with_unit(text, unit, now)


def format_timestamp(ns: int) -> str:
    s, f = divmod(ns, NS)
    return datetime.fromtimestamp(s, timezone.utc).strftime("%Y-%m-%d %H:%M:%S") + f".{f:09d}"


def partition_key_of(ns: int, mode: str) -> str:
    if mode not in PARTITION_MODES:
        raise ValueError(f"unknown partition mode {mode!r}")
    if mode == "forever":
        return "forever"
    return format_timestamp(ns)[: {"day": 10, "month": 7, "year": 4}[mode]]


def partition_start(key: str) -> int | None:
    """The first nanosecond of a partition; None for one that never ends."""
    if key == "forever":
        return None
    return _text((key + "-01-01")[:10])


# Columns


def whole_div(a: Column, n: int) -> Column:
    """Whole-number division that truncates towards zero."""
    return F.call_function("div", a, F.lit(n).cast("long"))


def floor_to(a: Column, n: int) -> Column:
    """The multiple of n at or below a."""
    return a - F.pmod(a, F.lit(n).cast("long"))


def as_timestamp(ts_ns: Column) -> Column:
    """Microsecond timestamp of a nanosecond count, for display and keys only."""
    return F.timestamp_micros(whole_div(floor_to(ts_ns, 1000), 1000))


def partition_key(ts_ns: Column, mode: str) -> Column:
    if mode not in PARTITION_MODES:
        raise ValueError(f"unknown partition mode {mode!r}")
    if mode == "forever":
        return F.lit("forever")
    return F.date_format(as_timestamp(ts_ns), {"day": "yyyy-MM-dd", "month": "yyyy-MM", "year": "yyyy"}[mode])


def timestamp_text(ts_ns: Column) -> Column:
    """YYYY-MM-DD HH:MM:SS.nnnnnnnnn in UTC (the session's time zone must be UTC)."""
    return F.concat(F.date_format(as_timestamp(ts_ns), "yyyy-MM-dd HH:mm:ss"), F.lit("."), F.lpad(F.pmod(ts_ns, F.lit(NS).cast("long")).cast("string"), 9, "0"))


def unix_seconds(ts_ns: Column) -> Column:
    return ts_ns / F.lit(1e9)


def from_timestamp(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp")) * F.lit(1000).cast("long")


def parse_timestamp_column(text: Column) -> Column:
    """Nanoseconds of line-protocol time text; null where it is neither a whole number nor a date with or without time."""
    t = F.trim(text)
    base = F.substring_index(t, ".", 1)
    full = F.concat(base, F.substring(F.lit("YYYY-MM-DD 00:00:00"), F.length(base) + 1, F.lit(19)))
    seconds = F.unix_seconds(F.try_to_timestamp(full, F.lit("yyyy-MM-dd HH:mm:ss")))
    fraction = F.rpad(F.substring(t, F.length(base) + 2, F.lit(9)), 9, "0").cast("long")
    dated = t.rlike(r"^\d{4}-\d{2}-\d{2}( \d{2}(:\d{2}(:\d{2})?)?)?(\.\d*)?$")
    return F.when(dated, seconds * F.lit(NS).cast("long") + fraction).when(t.rlike(r"^\d+$"), t.try_cast("long"))


def duration_column(text: Column) -> Column:
    """Nanoseconds of a column of durations (units s, m, h, d, w, ms, us, ns, each with a whole or decimal number, a sign in front); null where malformed."""
    t = F.trim(text)
    body = F.regexp_replace(t, r"^[+-]", "")
    parts = F.regexp_extract_all(body, F.lit(r"(\d+\.?\d*|\.\d+)(ns|us|µs|μs|ms|s|m|h|d|w)"), F.lit(0))
    scale = F.create_map(*[F.lit(x) for k, v in DURATION_UNITS.items() for x in (k, v)])
    one = lambda p: (F.regexp_extract(p, r"^[\d.]+", 0).cast("decimal(25,9)") * F.element_at(scale, F.regexp_extract(p, r"[^\d.]+$", 0))).cast("long")
    total = F.aggregate(parts, F.lit(0).cast("long"), lambda a, p: a + one(p))
    sound = (F.size(parts) > 0) & (F.array_join(parts, "") == body)
    return F.when(sound, F.when(t.startswith("-"), -total).otherwise(total)).when(body == "0", F.lit(0).cast("long"))

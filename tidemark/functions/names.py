"""Names: validation, globs, topic filters, sanitising, targets."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

METRIC_BYTES, EVENT_BYTES = 255, 255
DATABASE = r"^[A-Za-z0-9_][A-Za-z0-9_.-]{0,63}$"
INTERNAL = "internal"


def is_database(name: str) -> bool:
    return re.fullmatch(DATABASE[1:-1], name) is not None


def check_database(name: str) -> str:
    if not is_database(name):
        raise ValueError(f"invalid database name {name!r}")
    return name


def valid_database(c: Column) -> Column:
    return c.rlike(DATABASE)


def valid_metric(c: Column) -> Column:
    return (F.octet_length(c) > 0) & (F.octet_length(c) <= METRIC_BYTES) & ~c.contains("/")


def valid_event(c: Column) -> Column:
    return (F.octet_length(c) > 0) & (F.octet_length(c) <= EVENT_BYTES)


def glob_to_regex(pattern: str) -> str | None:
    """A whole-name regex of a glob: * and ? stop at /, [..] is a class, a backslash quotes. None if malformed."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        i += 1
        if c == "*":
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "\\":
            if i == len(pattern):
                return None
            out.append(re.escape(pattern[i]))
            i += 1
        elif c == "[":
            end = pattern.find("]", i + (2 if pattern[i : i + 1] == "^" else 1))
            if end < 0:
                return None
            body = pattern[i:end]
            negated = body.startswith("^")
            body = body[1:] if negated else body
            if not body or body.startswith("-") or body.endswith("-"):
                return None
            out.append(f"[{'^' if negated else ''}{re.sub(r'([\\\\\\[&])', r'\\\\\\1', body)}]")
            i = end + 1
        else:
            out.append(re.escape(c))
    return f"^(?:{''.join(out)})$"


def has_glob(pattern: str) -> bool:
    return any(c in pattern for c in "*?[")


def glob_match(c: Column, pattern: str) -> Column:
    """Whether a name matches a glob; a malformed one matches nothing."""
    regex = glob_to_regex(pattern)
    return F.lit(False) if regex is None else c.rlike(regex)


def glob_select(c: Column, include: str, exclude: list[str] | tuple[str, ...] = ()) -> Column:
    """Include by one glob; any of the excluding ones wins."""
    out = glob_match(c, include)
    for e in exclude:
        out = out & ~glob_match(c, e)
    return out


def topic_to_regex(topic_filter: str) -> str:
    """+ is one level, # is the rest of the topic, or nothing."""
    out = ""
    for i, part in enumerate(topic_filter.split("/")):
        sep = "/" if i else ""
        if part == "#":
            return f"^{out}(?:{sep}.*)?$" if i else "^.*$"
        out += sep + ("[^/]*" if part == "+" else re.escape(part))
    return f"^{out}$"


def topic_parts(topic: Column, topic_filter: str) -> Column:
    """What the wildcards of a filter stand for in a topic that matches it."""
    levels = F.split(topic, "/")
    parts = []
    for i, part in enumerate(topic_filter.split("/")):
        if part == "+":
            parts.append(F.slice(levels, i + 1, 1))
        elif part == "#":
            rest = F.slice(levels, i + 1, F.greatest(F.size(levels) - i, F.lit(0)))
            parts.append(F.when(F.size(levels) > i, F.array(F.array_join(rest, "/"))).otherwise(F.array().cast("array<string>")))
            break
    return F.concat(*parts) if parts else F.array().cast("array<string>")


def topic_names(topic: Column, topic_filter: str, db: str = "", name: str = "") -> tuple[Column, Column]:
    """Database and name of a topic: given ones win; else the first wildcard is the database if there are several."""
    db, name = db.strip(), name.strip()
    if db and name:
        return F.lit(db), F.lit(name)
    parts = topic_parts(topic, topic_filter)
    joined, several = F.array_join(parts, "/"), F.size(parts) > 1
    rest = F.array_join(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), "/")
    db_c = F.lit(db) if db else F.when(several, F.element_at(parts, 1)).otherwise("")
    name_c = F.when(F.lit(name) == joined, rest).otherwise(name) if name and not db else F.lit(name) if name else F.when(several, rest).otherwise(joined) if not db else joined
    return db_c, name_c


def sanitize(c: Column) -> Column:
    """Runs of anything but letters, digits and . - _ / become one _, and _ . - / are cut off at both ends."""
    cleaned = F.regexp_replace(F.trim(c), r"[^\p{L}\p{Nd}.\-_/]+", "_")
    return F.regexp_replace(cleaned, r"^[_.\-/]+|[_.\-/]+$", "")


def split_target(query: str, db: str | None = None) -> tuple[str, str]:
    """Database and metric of a target: an explicit database wins, else the first / divides."""
    if db:
        return check_database(db), query
    head, sep, tail = query.partition("/")
    if not sep or not tail:
        raise ValueError(f"target {query!r} has no database")
    return check_database(head), tail

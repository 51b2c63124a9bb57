"""Typed values: literals, suffixes, JSON spelling, and their text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INT, FLOAT, NONE = "int32", "float32", "none"
INT_MIN, INT_MAX = -(1 << 31), (1 << 31) - 1
FLOAT_MAX = 3.4028234663852886e38
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
LITERAL = r"^(?i:[+-]?(?:(?:\d+\.?\d*|\.\d+)(?:e[+-]?\d+)?|inf(?:inity)?)|nan)$"


def looks_like_float(c: Column) -> Column:
    return c.rlike(r"[.eE]")


def has_int_suffix(c: Column) -> Column:
    return c.endswith("i")


def lp_int(c: Column) -> Column:
    """An int32 literal with its suffix; null if it's none or out of range."""
    body = F.regexp_extract(c, r"^([+-]?\d+)i$", 1)
    return F.when(body != "", body.try_cast("int"))


def lp_double(c: Column) -> Column:
    """What a float literal says as a double, before it is fitted; null if it is none. NaN and Inf are spelled out."""
    return F.when(c.rlike(LITERAL), c.try_cast("double"))


def fitted(c: Column, d: Column) -> Column:
    """The float32 of a literal and its double; null beyond the type."""
    return F.when((F.abs(d) <= FLOAT_MAX) | c.rlike("(?i)[nN]"), d.cast("float"))


def lp_float(c: Column) -> Column:
    """A float32 literal; null if it's none or beyond the type."""
    return fitted(c, lp_double(c))


def lp_type(c: Column) -> Column:
    """int32 or float32 by a literal's spelling; null if it's malformed."""
    return F.when(has_int_suffix(c), F.when(lp_int(c).isNotNull(), INT)).when(lp_float(c).isNotNull(), FLOAT)


def json_type(literal: Column) -> Column:
    """Type of a raw JSON literal by its spelling: none if absent or null, null (an error) for anything but numbers."""
    t = F.trim(literal)
    return F.when(t.isNull() | (t == "null"), NONE).when(t.rlike(r"^-?\d+$"), F.when(t.try_cast("int").isNotNull(), INT)).when(t.rlike(NUMBER), F.when(F.abs(t.try_cast("double")) <= FLOAT_MAX, FLOAT))


def integral_type(c: Column) -> Column:
    """Type of a JSON number by its value: whole and in range is int32, whatever its spelling."""
    d = c.try_cast("double")
    return F.when((d == F.round(d)) & d.between(INT_MIN, INT_MAX), INT).when(d.isNotNull(), FLOAT)


def spelled_type(c: Column) -> Column:
    """Type of a number in a text message: a point or exponent is a float, else int32 where it fits."""
    return F.when(looks_like_float(c), F.when(lp_float(c).isNotNull(), FLOAT)).when(c.rlike(r"^[+-]?\d+$") & c.try_cast("int").isNotNull(), INT).when(lp_float(c).isNotNull(), FLOAT)


def common_value(int32_value: Column, float32_value: Column) -> Column:
    """What is aggregated: int32 widened to float32."""
    return F.coalesce(int32_value.cast("float"), float32_value)


def float_text(c: Column) -> Column:
    """The shortest decimal of a float32, without an exponent and without an empty fraction."""
    t = c.cast("string")
    mantissa, power = F.regexp_extract(t, r"^-?([\d.]+)E", 1), F.regexp_extract(t, r"E(-?\d+)$", 1).try_cast("int")
    digits, sign = F.regexp_replace(F.regexp_replace(mantissa, r"\.0$", ""), r"\.", ""), F.when(t.startswith("-"), "-").otherwise("")
    large = F.concat(sign, digits, F.repeat(F.lit("0"), F.greatest(power + 1 - F.length(digits), F.lit(0))))
    below = F.concat(sign, F.lit("0."), F.repeat(F.lit("0"), F.greatest(-power - 1, F.lit(0))), digits)
    exponent = F.when(power >= 0, large).otherwise(below)
    return F.when(t.contains("E"), exponent).otherwise(F.regexp_replace(t, r"\.0$", ""))


def value_text(int32_value: Column, float32_value: Column, suffix: bool = False) -> Column:
    whole = int32_value.cast("string")
    return F.coalesce(F.concat(whole, F.lit("i")) if suffix else whole, float_text(float32_value))


def compact_payload(payload: Column) -> Column:
    """JSON text of a payload: null if empty, compacted if it is JSON, else its base64 in an object."""
    text = payload.cast("string")
    parsed = F.try_parse_json(text)
    raw = F.concat(F.lit('{"raw_base64":"'), F.base64(payload.cast("binary")), F.lit('"}'))
    return F.when(payload.isNull() | (F.octet_length(payload) == 0), F.lit(None)).when(parsed.isNotNull(), F.to_json(parsed)).otherwise(raw)


def scale_to_int(value: Column, scale: float) -> Column:
    """value times scale rounded half away from zero; null beyond int32. A scale of 0 means 1."""
    r = F.round(value * F.lit(float(scale or 1)))
    return F.when(r.between(INT_MIN, INT_MAX), r.cast("int"))

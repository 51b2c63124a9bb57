"""The registry of aggregates: name to Column over the widened values of a window.

Sums and means are doubles throughout; several aggregates of a request always come from one grouping.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT_STEP = "avg"
ROLLUP_DEFAULT = ("min", "max", "sum", "avg", "count")


#: Percentiles are exact, with linear interpolation at (n - 1) p.
PERCENTILES = {"median": 0.5, "p50": 0.5, "p95": 0.95, "p99": 0.99}
SHARES = sorted(set(PERCENTILES.values()))


def percentile(p: float) -> Callable[[Column], Column]:
    """One entry of the percentiles of all shares: equal calls are one buffer of a window's values, whichever entries are asked for."""
    return lambda v: F.percentile(v.cast("double"), F.array(*[F.lit(x) for x in SHARES])).getItem(SHARES.index(p))


def trimmed(v: Column) -> Column:
    """Mean without a twentieth of the values at either end, one at least; without any cut if that would leave none; null of no values."""
    s = F.sort_array(F.collect_list(v.cast("double")))
    n = F.size(s)
    cut = F.when(n >= 20, F.floor(n / 20)).otherwise(1).cast("int")
    cut = F.when(2 * cut >= n, 0).otherwise(cut)
    rest = F.slice(s, cut + 1, n - 2 * cut)
    return F.aggregate(rest, F.lit(0.0), lambda a, x: a + x) / F.when(F.size(rest) > 0, F.size(rest))


AGGREGATES: dict[str, Callable[[Column], Column]] = {
    "min": lambda v: F.min(v).cast("double"),
    "max": lambda v: F.max(v).cast("double"),
    "sum": lambda v: F.sum(v.cast("double")),
    "avg": lambda v: F.avg(v.cast("double")),
    "count": lambda v: F.count(v).cast("double"),
    "median": percentile(PERCENTILES["median"]),
    "p50": percentile(PERCENTILES["p50"]),
    "p95": percentile(PERCENTILES["p95"]),
    "p99": percentile(PERCENTILES["p99"]),
    "trimmed_avg": trimmed,
    "trimmed_average": trimmed,
}
#: Names under which a rollup writes an alias.
CANONICAL = {"trimmed_average": "trimmed_avg"}
TRIMMED = ("trimmed_avg", "trimmed_average")


def supported() -> list[str]:
    return sorted(AGGREGATES)


def resolve(names: str | Sequence[str], fold_case: bool = False) -> list[str]:
    """Requested aggregates in order, blanks and repeats dropped; none or an unknown one is an error."""
    given = names.split(",") if isinstance(names, str) else list(names)
    out = dict.fromkeys(n for n in ((x.strip().lower() if fold_case else x.strip()) for x in given) if n)
    if unknown := [n for n in out if n not in AGGREGATES]:
        raise ValueError(f"unknown aggregate {unknown[0]!r}")
    if not out:
        raise ValueError("no aggregates requested")
    return list(out)


def columns(names: Sequence[str], value: Column) -> list[Column]:
    return [AGGREGATES[n](value).alias(n) for n in names]

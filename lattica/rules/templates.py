"""Check templates as columns: true where a row breaks the check, else false, never null.

A check whose answer is unknown holds, as SQL constraints have it. That is written as "the operands are
set and the check fails", not as NOT coalesce(check, true): the first form reaches the file scan as a
filter, the second does not.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.geo import wkb_kind
from ..model.catalog import DOMAINS
from ..model.defs import Check


def _as_column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def enum(c: Column | str, members: list[str]) -> Column:
    c = _as_column(c)
    return c.isNotNull() & ~c.isin(list(members))


def in_range(c: Column | str, low=None, high=None) -> Column:
    c = _as_column(c)
    outside = [c < low] if low is not None else []
    outside += [c > high] if high is not None else []
    return c.isNotNull() & reduce(lambda a, b: a | b, outside)


def ordered(start: Column | str, end: Column | str) -> Column:
    start, end = _as_column(start), _as_column(end)
    return start.isNotNull() & end.isNotNull() & (end < start)


def regex(c: Column | str, pattern: str) -> Column:
    r"""The pattern must end in \z where it means the end: $ lets a line break follow."""
    c = _as_column(c)
    return c.isNotNull() & ~c.rlike(pattern)


def not_same(a: Column | str, b: Column | str) -> Column:
    a, b = _as_column(a), _as_column(b)
    return a.isNotNull() & b.isNotNull() & (a == b)


def set_of(columns: list[Column | str]) -> Column:
    """How many of the columns are not null."""
    return reduce(lambda a, b: a + b, (_as_column(c).isNotNull().cast("int") for c in columns))


def at_least_one(*columns: Column | str) -> Column:
    return set_of(list(columns)) < 1


def at_most_one(*columns: Column | str) -> Column:
    return set_of(list(columns)) > 1


def iff(state: Column, value: Column | str) -> Column:
    """The state holds exactly where the value is set; an unknown state breaks nothing."""
    return state.isNotNull() & (state != _as_column(value).isNotNull())


def not_null(c: Column | str) -> Column:
    return _as_column(c).isNull()


def too_long(c: Column | str, most: int, exact: bool = False) -> Column:
    n = F.length(_as_column(c))
    return n.isNotNull() & (n != most if exact else n > most)


def geometry_kind(c: Column | str, kinds: list[int]) -> Column:
    kind = wkb_kind(_as_column(c))
    return kind.isNotNull() & ~kind.isin(list(kinds))


def compiled(check: Check) -> Column:
    """The column of a check of the catalogue."""
    a = check.arguments
    match check.kind:
        case "enum":
            return enum(a[0], DOMAINS[a[1]].split())
        case "range":
            low, high = (None if x == "-" else F.lit(x).cast("decimal(38,18)") for x in a[1:3])
            return in_range(F.col(a[0]).cast("decimal(38,18)"), low, high)
        case "ordered":
            return ordered(*a)
        case "regex":
            return regex(a[0], a[1])
        case "not_same":
            return not_same(*a)
        case "at_least_one":
            return at_least_one(*a)
        case "at_most_one":
            return at_most_one(*a)
        case "iff":
            return iff(F.col(a[0]) == a[1], a[2])
        case "geometry_kind":
            return geometry_kind(a[0], [int(x) for x in a[1:]])
    raise ValueError(f"unknown check {check.kind}")

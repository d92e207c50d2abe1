"""Property filters, compiled to columns.

Filters of one call hold together; calls for the same property are alternatives; different properties all hold.
A filtered property must be present, also for a negated filter. Only a negated Has asks for its absence.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Filter:
    """A test on one property; ~filter negates it."""

    negated: bool = False

    def __invert__(self) -> Filter:
        from dataclasses import replace

        return replace(self, negated=not self.negated)

    def test(self, c: Column) -> Column:
        raise NotImplementedError

    def column(self, c: Column) -> Column:
        t = self.test(c)
        return c.isNotNull() & (~t if self.negated else t)


@dataclass(frozen=True)
class Has(Filter):
    def column(self, c: Column) -> Column:
        return c.isNull() if self.negated else c.isNotNull()


@dataclass(frozen=True)
class _Valued(Filter):
    value: object = None

    def __init__(self, value: object, negated: bool = False):
        object.__setattr__(self, "value", value)
        object.__setattr__(self, "negated", negated)


class Eq(_Valued):
    def test(self, c: Column) -> Column:
        return c == F.lit(self.value)


class Contains(_Valued):
    def test(self, c: Column) -> Column:
        return c.contains(self.value)


class Regex(_Valued):
    """Found anywhere in the value."""

    def test(self, c: Column) -> Column:
        return c.rlike(self.value)


class StartsWith(_Valued):
    def test(self, c: Column) -> Column:
        return c.startswith(self.value)


class EndsWith(_Valued):
    def test(self, c: Column) -> Column:
        return c.endswith(self.value)


@dataclass(frozen=True)
class DistanceLt(Filter):
    """Edit distance to `value` below `below`; the threshold form stops early and gives -1 beyond it."""

    value: str = ""
    below: int = 1

    def __init__(self, value: str, below: int, negated: bool = False):
        for k, v in (("value", value), ("below", below), ("negated", negated)):
            object.__setattr__(self, k, v)

    def test(self, c: Column) -> Column:
        return F.lit(False) if self.below < 1 else F.levenshtein(c, F.lit(self.value), self.below - 1) >= 0


class Lt(_Valued):
    def test(self, c: Column) -> Column:
        return c < self.value


class Le(_Valued):
    def test(self, c: Column) -> Column:
        return c <= self.value


class Gt(_Valued):
    def test(self, c: Column) -> Column:
        return c > self.value


class Ge(_Valued):
    def test(self, c: Column) -> Column:
        return c >= self.value


def property_column(name: str, groups: tuple[tuple[Filter, ...], ...]) -> Column:
    """Any group whose filters all hold; no groups hold nowhere."""
    every = [reduce(Column.__and__, [f.column(F.col(name)) for f in g], F.lit(True)) for g in groups]
    return reduce(Column.__or__, every) if every else F.lit(False)


def node_column(properties: dict[str, tuple[tuple[Filter, ...], ...]], uids: tuple[int, ...] | None) -> Column:
    """All properties' filters, and one of the uids where any are asked for."""
    out = F.lit(True)
    for name, groups in properties.items():
        out = out & property_column(name, groups)
    return out if uids is None else out & F.col("uid").isin(*uids)

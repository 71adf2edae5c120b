"""Predicates on variables as columns, which reach the scan; a Python callable in their place cannot."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidelog.functions.values import LANES, Value, declared, literal, value


@dataclass(frozen=True)
class Predicate:
    """A test of one variable. ``test(column, constants)`` gets the constants as columns of its type."""

    test: Callable[..., Column]
    constants: tuple[Any, ...]

    def column(self, c: Column, tag: int | None) -> Column:
        """The test on a column of type ``tag``, or on a dynamic one (None), whose lane the constants choose.

        Constants of another type than the variable's never match.
        """
        vs = [declared(x, tag) if tag is not None else value(x) for x in self.constants]
        if tag is not None:
            return F.lit(False) if any(v.tag != tag for v in vs) else self.test(c, *map(literal, vs))
        tags = {v.tag for v in vs}
        if len(tags) != 1 or not tags <= set(LANES):
            return F.lit(False)
        (t,) = tags
        return (c["vt"] == t) & self.test(c[LANES[t]], *map(literal, vs))


def gt(x: Any) -> Predicate:
    return Predicate(lambda c, k: c > k, (x,))


def ge(x: Any) -> Predicate:
    return Predicate(lambda c, k: c >= k, (x,))


def lt(x: Any) -> Predicate:
    return Predicate(lambda c, k: c < k, (x,))


def le(x: Any) -> Predicate:
    return Predicate(lambda c, k: c <= k, (x,))


def eq(x: Any) -> Predicate:
    return Predicate(lambda c, k: c == k, (x,))


def ne(x: Any) -> Predicate:
    """Values of another type are not equal either, but are no match."""
    return Predicate(lambda c, k: c != k, (x,))


def between(low: Any, high: Any) -> Predicate:
    return Predicate(lambda c, a, b: c.between(a, b), (low, high))


def isin(*xs: Any) -> Predicate:
    return Predicate(lambda c, *ks: c.isin(*ks), xs)


def starts_with(x: str) -> Predicate:
    return Predicate(lambda c, k: c.startswith(k), (x,))

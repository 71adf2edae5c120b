"""Queries as data: what to find, pattern clauses, predicates."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from typing import Any

from tidelog.functions.predicates import Predicate


class QueryError(ValueError):
    """A query that cannot be planned."""


class InvalidFindVariable(QueryError):
    pass


@dataclass(frozen=True)
class Variable:
    name: str


@dataclass(frozen=True)
class Constant:
    """An id, an attribute name (in the attribute position), or a value (in the value position)."""

    content: Any


class Blank:
    def __repr__(self) -> str:
        return "_"


BLANK = Blank()
Pattern = Variable | Constant | Blank


def pattern(x: Any) -> Pattern:
    """Strings that begin with ? are variables, "_" and None are blanks, anything else is a constant."""
    if isinstance(x, (Variable, Constant, Blank)):
        return x
    if x is None or x == "_":
        return BLANK
    if isinstance(x, str) and x.startswith("?") and len(x) > 1:
        return Variable(x)
    return Constant(x)


@dataclass(frozen=True)
class Clause:
    """A data pattern over entity, attribute, value and transaction."""

    e: Pattern = BLANK
    a: Pattern = BLANK
    v: Pattern = BLANK
    tx: Pattern = BLANK

    @classmethod
    def of(cls, e: Any = None, a: Any = None, v: Any = None, tx: Any = None) -> Clause:
        return cls(*map(pattern, (e, a, v, tx)))

    def free_variables(self) -> list[str]:
        """Names of the variables, each once, in the order e, a, v, tx."""
        return list(dict.fromkeys(p.name for p in (self.e, self.a, self.v, self.tx) if isinstance(p, Variable)))


@dataclass(frozen=True)
class Aggregate:
    """kind is count, min, max, average, sum or count-distinct; only count has no variable."""

    kind: str
    variable: str | None = None
    name: str | None = None


def count(name: str | None = None) -> Aggregate:
    return Aggregate("count", None, name)


def minimum(variable: str, name: str | None = None) -> Aggregate:
    return Aggregate("min", variable, name)


def maximum(variable: str, name: str | None = None) -> Aggregate:
    return Aggregate("max", variable, name)


def average(variable: str, name: str | None = None) -> Aggregate:
    return Aggregate("average", variable, name)


def total(variable: str, name: str | None = None) -> Aggregate:
    return Aggregate("sum", variable, name)


def count_distinct(variable: str, name: str | None = None) -> Aggregate:
    return Aggregate("count-distinct", variable, name)


@dataclass(frozen=True)
class Test:
    """A condition on some variables: a Predicate on one, or a function of their columns or values."""

    variables: tuple[str, ...]
    condition: Predicate | Callable[..., Any]
    #: columns: ``condition`` maps columns to a column; values: it maps Value objects to a bool.
    on: str = "columns"


@dataclass
class Query:
    """find and where may be called again to add more; numeric lets min, max, average and sum work on U64 and Decimal too."""

    found: list[str | Aggregate] = field(default_factory=list)
    clauses: list[Clause] = field(default_factory=list)
    tests: list[Test] = field(default_factory=list)
    numeric: bool = False

    def find(self, *what: str | Aggregate) -> Query:
        self.found += what
        return self

    def where(self, e: Any = None, a: Any = None, v: Any = None, tx: Any = None) -> Query:
        self.clauses.append(e if isinstance(e, Clause) else Clause.of(e, a, v, tx))
        return self

    def value_pred(self, variable: str, condition: Predicate | Callable[[Any], bool]) -> Query:
        """A Predicate, or a Python function of the variable's Value (which runs row by row)."""
        self.tests.append(Test((variable,), condition, "columns" if isinstance(condition, Predicate) else "values"))
        return self

    def pred(self, variables: Sequence[str], condition: Callable[..., Any], on: str = "columns") -> Query:
        """A condition on complete solutions: a function of the variables' columns, or of their Values if ``on`` is "values"."""
        self.tests.append(Test(tuple(variables), condition, on))
        return self

"""Predicates that can be read as a Column, and as a test on a file's statistics.

``field("id") < 10`` and the like combine with ``&``, ``|`` and ``~``. Negation is pushed
to the comparisons before a test on statistics is made, since the negation of "may hold"
is not "may fail". Whatever the statistics can't decide may match.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

_NOT = {"<": ">=", "<=": ">", ">": "<=", ">=": "<", "==": "!=", "!=": "=="}
_SWAP = {"<": ">", "<=": ">=", ">": "<", ">=": "<=", "==": "==", "!=": "!="}


class Predicate:
    def __and__(self, other: Predicate) -> Predicate:
        return Both(self, other)

    def __or__(self, other: Predicate) -> Predicate:
        return Either(self, other)

    def __invert__(self) -> Predicate:
        return self.negated()

    def negated(self) -> Predicate:
        raise NotImplementedError

    def to_column(self) -> Column:
        raise NotImplementedError

    def may_match(self, keys: list[str]) -> Column | None:
        """A condition on _MIN_/_MAX_ columns that holds for each file with a match; None: nothing can be said."""
        raise NotImplementedError


@dataclass(frozen=True, eq=False)
class Field:
    name: str

    def _with(self, op: str, other: Any) -> Predicate:
        return Compare(op, self, other)

    def __lt__(self, other):
        return self._with("<", other)

    def __le__(self, other):
        return self._with("<=", other)

    def __gt__(self, other):
        return self._with(">", other)

    def __ge__(self, other):
        return self._with(">=", other)

    def __eq__(self, other):
        return self._with("==", other)

    def __ne__(self, other):
        return self._with("!=", other)

    __hash__ = None

    def isin(self, *values: Any) -> Predicate:
        return In(self, tuple(values[0] if len(values) == 1 and isinstance(values[0], (list, tuple, set)) else values), True)

    def is_null(self) -> Predicate:
        return Null(self, True)

    def is_not_null(self) -> Predicate:
        return Null(self, False)


def field(name: str) -> Field:
    return Field(name)


def _column(x: Any) -> Column:
    return F.col(f"`{x.name}`") if isinstance(x, Field) else F.lit(x)


def _test(op: str, a: Column, b: Column) -> Column:
    return {"<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b, "==": a == b, "!=": a != b}[op]


@dataclass(frozen=True, eq=False)
class Compare(Predicate):
    op: str
    left: Any
    right: Any

    def negated(self) -> Predicate:
        return Compare(_NOT[self.op], self.left, self.right)

    def to_column(self) -> Column:
        return _test(self.op, _column(self.left), _column(self.right))

    def may_match(self, keys: list[str]) -> Column | None:
        a, b, op = self.left, self.right, self.op
        if not isinstance(a, Field) and isinstance(b, Field):
            a, b, op = b, a, _SWAP[op]
        if not isinstance(a, Field) and not isinstance(b, Field):
            return F.coalesce(self.to_column(), F.lit(False))  # two values: it holds for all rows or for none
        if not isinstance(a, Field) or a.name not in keys or isinstance(b, Field) and b.name not in keys:
            return None
        lo, hi = F.col(f"`_MIN_{a.name}`"), F.col(f"`_MAX_{a.name}`")
        lo2, hi2 = (F.col(f"`_MIN_{b.name}`"), F.col(f"`_MAX_{b.name}`")) if isinstance(b, Field) else (F.lit(b), F.lit(b))
        found = {"<": lo < hi2, "<=": lo <= hi2, ">": hi > lo2, ">=": hi >= lo2, "==": (lo <= hi2) & (hi >= lo2), "!=": ~((lo == hi) & (lo2 == hi2) & (lo == lo2))}[op]
        return F.coalesce(found, F.lit(True))


def compare(op: str, left: Any, right: Any) -> Predicate:
    """A comparison of fields or values, on either side."""
    if op not in _NOT:
        raise ValueError(f"no comparison {op}")
    return Compare(op, left, right)


@dataclass(frozen=True, eq=False)
class In(Predicate):
    of: Field
    values: tuple
    inside: bool

    def negated(self) -> Predicate:
        return In(self.of, self.values, not self.inside)

    def to_column(self) -> Column:
        found = _column(self.of).isin(list(self.values))
        return found if self.inside else ~found

    def may_match(self, keys: list[str]) -> Column | None:
        if not self.inside or self.of.name not in keys:
            return None
        lo, hi = F.col(f"`_MIN_{self.of.name}`"), F.col(f"`_MAX_{self.of.name}`")
        found = F.lit(False)
        for v in self.values:
            found = found | (lo <= F.lit(v)) & (hi >= F.lit(v))
        return F.coalesce(found, F.lit(True))


@dataclass(frozen=True, eq=False)
class Null(Predicate):
    of: Field
    null: bool

    def negated(self) -> Predicate:
        return Null(self.of, not self.null)

    def to_column(self) -> Column:
        return _column(self.of).isNull() if self.null else _column(self.of).isNotNull()

    def may_match(self, keys: list[str]) -> Column | None:
        return None  # bounds leave nulls out


@dataclass(frozen=True, eq=False)
class Both(Predicate):
    left: Predicate
    right: Predicate

    def negated(self) -> Predicate:
        return Either(~self.left, ~self.right)

    def to_column(self) -> Column:
        return self.left.to_column() & self.right.to_column()

    def may_match(self, keys: list[str]) -> Column | None:
        a, b = self.left.may_match(keys), self.right.may_match(keys)
        return b if a is None else a if b is None else a & b


@dataclass(frozen=True, eq=False)
class Either(Predicate):
    left: Predicate
    right: Predicate

    def negated(self) -> Predicate:
        return Both(~self.left, ~self.right)

    def to_column(self) -> Column:
        return self.left.to_column() | self.right.to_column()

    def may_match(self, keys: list[str]) -> Column | None:
        a, b = self.left.may_match(keys), self.right.may_match(keys)
        return None if a is None or b is None else a | b


def as_column(p: Predicate | Column | str) -> Column:
    return p.to_column() if isinstance(p, Predicate) else F.expr(p) if isinstance(p, str) else p

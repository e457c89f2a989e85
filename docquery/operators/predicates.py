"""Predicates on members of documents: ``P.customer.name == "x"``, and conditions by name and operand."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.json_members import array_has, json_text, member
from ..functions.like import like
from ..functions.parameters import plain
from ..mapping import DocumentMap

_SQL_OF = {bool: "boolean", int: "bigint", float: "double", str: "string"}


@dataclass(frozen=True)
class Scope:
    """Where a member is looked for. quirks of the two entry points: an empty NOT IN is false on the builder, true on Queryable;
    nulls in lists are dropped on the builder; the builder's text tests take wildcards as they are."""

    map: DocumentMap | None
    alias: str | None = None
    builder: bool = True

    def column(self, name: str) -> Column:
        return F.col(f"`{self.alias}`.`{name}`" if self.alias else f"`{name}`")

    def json_path(self, path: tuple[str, ...]) -> str | None:
        """The JSON path of a member that isn't a column."""
        m = self.map
        if m is None or len(path) == 1 and (path[0].lower() == m.id.lower() or m.column(path[0]) or path[0] in m.stored_columns()):
            return None
        return ".".join(path) if not m.column(path[0]) and (m.json_format.has_text or m.json_format.has_blob) and path[0].lower() != m.id.lower() else None

    def resolve(self, path: tuple[str, ...], sql_type: str | None = None) -> Column:
        inner = self.json_path(path)
        if inner is not None:
            return member(json_text(self.map, self.column), inner, self.map.json.get(inner, sql_type))
        name = path[0]
        if self.map is not None:
            found = self.map.column(name)
            name = self.map.id if name.lower() == self.map.id.lower() else found.name if found else name
        return reduce(lambda c, part: c[part], path[1:], self.column(name))


class Predicate:
    """Combines by &, | and ~; Python's and, or, not can't be used."""

    def to_column(self, scope: Scope) -> Column:
        raise NotImplementedError

    def __and__(self, other: Predicate) -> Predicate:
        return _Made(lambda s: self.to_column(s) & other.to_column(s))

    def __or__(self, other: Predicate) -> Predicate:
        return _Made(lambda s: self.to_column(s) | other.to_column(s))

    def __invert__(self) -> Predicate:
        return _Made(lambda s: ~self.to_column(s))

    def __bool__(self) -> bool:
        raise TypeError("use &, | and ~ to combine predicates")


@dataclass(frozen=True)
class _Made(Predicate):
    make: Callable[[Scope], Column]

    def to_column(self, scope: Scope) -> Column:
        return self.make(scope)


def comparison(column: Column, operand: str, value: Any) -> Column:
    """=, <>, >, >=, <, <=, like, not like; equality with null tests for null."""
    value = plain(value)
    if value is None and operand in ("=", "<>"):
        return column.isNull() if operand == "=" else column.isNotNull()
    operand = operand.lower()
    if operand in ("like", "not like"):
        return like(column, value) if operand == "like" else ~like(column, value)
    tests = {"=": column.__eq__, "<>": column.__ne__, ">": column.__gt__, ">=": column.__ge__, "<": column.__lt__, "<=": column.__le__}
    if operand not in tests:
        raise ValueError(f"unknown operand {operand}")
    return tests[operand](F.lit(value))


def in_list(column: Column, values: Iterable[Any], negate: bool, builder: bool) -> Column:
    values = [plain(v) for v in values]
    if builder:
        values = [v for v in values if v is not None]
    if not values:
        return F.lit(negate and not builder)
    return ~column.isin(values) if negate else column.isin(values)


class Member(Predicate):
    """A member of a document. As a predicate by itself, it is a boolean member that is true."""

    def __init__(self, *path: str):
        self._path = path

    def __getattr__(self, name: str) -> Member:
        if name.startswith("__"):
            raise AttributeError(name)
        return Member(*self._path, name)

    def __getitem__(self, name: str) -> Member:
        return Member(*self._path, name)

    def to_column(self, scope: Scope) -> Column:
        return scope.resolve(self._path, "boolean") == F.lit(True)

    def value(self, scope: Scope, like_value: Any = None) -> Column:
        return scope.resolve(self._path, _SQL_OF.get(type(plain(like_value))))

    def _compare(self, operand: str, value: Any) -> Predicate:
        if isinstance(value, Member):
            return _Made(lambda s: getattr(self.value(s), {"=": "__eq__", "<>": "__ne__", ">": "__gt__", ">=": "__ge__", "<": "__lt__", "<=": "__le__"}[operand])(value.value(s)))
        return _Made(lambda s: comparison(self.value(s, value), operand, value))

    def __eq__(self, value: Any) -> Predicate:  # type: ignore[override]
        return self._compare("=", value)

    def __ne__(self, value: Any) -> Predicate:  # type: ignore[override]
        return self._compare("<>", value)

    def __gt__(self, value: Any) -> Predicate:
        return self._compare(">", value)

    def __ge__(self, value: Any) -> Predicate:
        return self._compare(">=", value)

    def __lt__(self, value: Any) -> Predicate:
        return self._compare("<", value)

    def __le__(self, value: Any) -> Predicate:
        return self._compare("<=", value)

    __hash__ = None  # type: ignore[assignment]

    def like(self, pattern: str) -> Predicate:
        return self._compare("like", pattern)

    def between(self, low: Any, high: Any) -> Predicate:
        return _Made(lambda s: self.value(s, low).between(F.lit(plain(low)), F.lit(plain(high))))

    def _text(self, test: str, pattern: str, value: str) -> Predicate:
        def make(s: Scope) -> Column:
            column = self.value(s)
            return like(column, pattern.format(value)) if s.builder else getattr(column, test)(F.lit(value))

        return _Made(make)

    def contains(self, value: str) -> Predicate:
        return self._text("contains", "%{}%", value)

    def startswith(self, value: str) -> Predicate:
        return self._text("startswith", "{}%", value)

    def endswith(self, value: str) -> Predicate:
        return self._text("endswith", "%{}", value)

    def isin(self, values: Iterable[Any]) -> Predicate:
        values = list(values)
        return _Made(lambda s: in_list(self.value(s, next((v for v in values if v is not None), None)), values, False, s.builder))

    def notin(self, values: Iterable[Any]) -> Predicate:
        values = list(values)
        return _Made(lambda s: in_list(self.value(s, next((v for v in values if v is not None), None)), values, True, s.builder))

    def has(self, value: Any) -> Predicate:
        """Whether a collection holds the value: a JSON array, or a column of |a|b| text."""

        def make(s: Scope) -> Column:
            inner = s.json_path(self._path)
            if inner is not None:
                return array_has(json_text(s.map, s.column), inner, _SQL_OF[type(plain(value))], plain(value))
            return F.contains(s.resolve(self._path), F.lit(f"|{plain(value)}|"))

        return _Made(make)

    def is_null(self) -> Predicate:
        return _Made(lambda s: s.resolve(self._path).isNull())

    def is_not_null(self) -> Predicate:
        return _Made(lambda s: s.resolve(self._path).isNotNull())


class _Root:
    def __getattr__(self, name: str) -> Member:
        if name.startswith("__"):
            raise AttributeError(name)
        return Member(name)

    def __getitem__(self, name: str) -> Member:
        return Member(name)


#: Start of member expressions.
P = _Root()


def condition(column: Column, operand: str, values: tuple, builder: bool = True) -> Column:
    """field operand value(s): comparisons, between, between or equal, in, not in."""
    operand = operand.lower()
    if operand in ("in", "not in"):
        return in_list(column, values[0], operand == "not in", builder)
    if operand == "between":
        return column.between(F.lit(plain(values[0])), F.lit(plain(values[1])))
    if operand == "between or equal":
        return (column >= F.lit(plain(values[0]))) & (column <= F.lit(plain(values[1])))
    return comparison(column, operand, values[0])


class ConditionGroup:
    """Nested AND and OR groups of predicates; empty groups count for nothing."""

    def __init__(self, any_of: bool = False):
        self._any, self._parts = any_of, []

    def add(self, *parts: Predicate | ConditionGroup) -> ConditionGroup:
        self._parts += parts
        return self

    def build(self) -> Predicate | None:
        found = [p.build() if isinstance(p, ConditionGroup) else p for p in self._parts]
        found = [p for p in found if p is not None]
        if not found:
            return None
        return reduce(lambda a, b: a | b if self._any else a & b, found)

"""The expression-based facade: filters first, then order, skip and take, in whatever order they are called."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from typing import TYPE_CHECKING, Any

from pyspark.sql import DataFrame

from ..operators.predicates import Member, Predicate

if TYPE_CHECKING:
    from .query import Query


@dataclass(frozen=True)
class Queryable:
    """No implicit order unless rows are skipped. A second order_by adds a key. count leaves skip and take aside, any leaves skip aside."""

    query: Query
    skipped: int = 0
    taken: int | None = None

    def __post_init__(self) -> None:
        if self.query.filters_by_name or self.query.implicit_order != (self.skipped > 0):
            object.__setattr__(self, "query", replace(self.query, filters_by_name=False, implicit_order=self.skipped > 0))

    def __getattr__(self, name: str):
        if name.startswith("_"):
            raise AttributeError(name)
        raise NotImplementedError(f"{name} can't be translated")

    def where(self, predicate: Predicate) -> Queryable:
        return replace(self, query=self.query.where(predicate))

    def where_custom(self, sql: str) -> Queryable:
        return replace(self, query=self.query.where(sql))

    def hint(self, text: str) -> Queryable:
        return replace(self, query=self.query.hint(text))

    def _sorted(self, member: Member | str, descending: bool) -> Queryable:
        member = Member(member) if isinstance(member, str) else member
        return replace(self, query=self.query._order(member, None, descending))

    def order_by(self, member: Member | str) -> Queryable:
        return self._sorted(member, False)

    def order_by_descending(self, member: Member | str) -> Queryable:
        return self._sorted(member, True)

    then_by, then_by_descending = order_by, order_by_descending

    def select(self, *members: Member | str, **named: Member | str) -> Queryable:
        """One member gives single values, several give tuples in that order."""
        query = self.query
        for member, name in [(m, None) for m in members] + [(m, n) for n, m in named.items()]:
            path = ".".join((member,) if isinstance(member, str) else member._path)
            query = query.member_column(path, name or path.rsplit(".", 1)[-1])
        return replace(self, query=query.as_type(None if len(members) + len(named) == 1 else tuple))

    def skip(self, n: int) -> Queryable:
        return replace(self, skipped=n)

    def take(self, n: int) -> Queryable:
        return replace(self, taken=n)

    def to_df(self) -> DataFrame:
        return self.query._lower(limit=self.taken, offset=self.skipped)

    def count_df(self, name: str = "count") -> DataFrame:
        return self.query.count_df(name)

    def to_list(self) -> list[Any]:
        rows = self.query._rows(self.to_df())
        return [r[0] for r in rows] if self.query.row_type is None and len(self.query.picks) == 1 else rows

    def stream(self) -> Iterator[Any]:
        return self.query._decoder().rows(self.to_df().toLocalIterator())

    def first_or_default(self, predicate: Predicate | None = None) -> Any:
        found = (self.where(predicate) if predicate is not None else self).take(1).to_list()
        return found[0] if found else None

    first = first_or_default

    def count(self, predicate: Predicate | None = None) -> int:
        return (self.where(predicate) if predicate is not None else self).query.count()

    def any(self, predicate: Predicate | None = None) -> bool:
        return (self.where(predicate) if predicate is not None else self).query.any()

    def raw_debug_view(self) -> str:
        return self.query.debug_view_raw_query()


"""Equi-joins of aliased sources."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

if TYPE_CHECKING:
    from ..plans.query import Query


@dataclass(frozen=True)
class Join:
    kind: str
    right: Query
    alias: str
    on: tuple[tuple[str, str, str], ...] = ()


@dataclass(frozen=True)
class JoinBuilder:
    """A join that needs its ``on``; then it is used as the joined query."""

    left: Query
    kind: str
    right: Query
    alias_name: str
    clauses: tuple[tuple[str, str, str], ...] = ()

    def on(self, *names: str) -> JoinBuilder:
        """on(left, right), where left is of the first source, or on(alias, left, right); several are AND-ed."""
        if self.kind == "cross":
            raise TypeError("a cross join takes no on")
        if len(names) not in (2, 3):
            raise TypeError("on takes two or three names")
        return replace(self, clauses=(*self.clauses, names if len(names) == 3 else (self.left.alias_name, *names)))

    def done(self) -> Query:
        if self.kind != "cross" and not self.clauses:
            raise ValueError("a join needs an on")
        return self.left.with_join(Join(self.kind, self.right, self.alias_name, self.clauses))

    def __getattr__(self, name: str):
        if name.startswith("_"):
            raise AttributeError(name)
        return getattr(self.done(), name)


def may_broadcast(df: DataFrame) -> bool:
    """Whether Spark's own estimate of the size is within its threshold for broadcasts."""
    session = df.sparkSession
    most = session._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) <= most


def join_all(left: DataFrame, left_alias: str, joins: tuple[Join, ...], hint: str | None = None) -> DataFrame:
    """Joins in order. The left hash join asks for a shuffled hash join unless its right side may be broadcast; Catalyst picks the rest."""
    for j in joins:
        right = j.right._lower(ordered=False).alias(j.alias)
        if j.kind == "cross":
            left = left.crossJoin(right)
            continue
        on = reduce(lambda a, b: a & b, [F.col(f"`{a}`.`{x}`") == F.col(f"`{j.alias}`.`{y}`") for a, x, y in j.on])
        asked = hint if j.kind != "left" else None if may_broadcast(right) else "shuffle_hash"
        left = left.join(right.hint(asked) if asked else right, on, j.kind)
    return left

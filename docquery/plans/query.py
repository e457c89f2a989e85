"""The query builder: an immutable description that lowers to one DataFrame."""

from __future__ import annotations

import asyncio
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace
from typing import TYPE_CHECKING, Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.parameters import Parameters, bind, like_piped_value, like_value, normalise, unique_name
from ..mapping import DocumentMap
from ..operators.joins import Join, JoinBuilder, join_all
from ..operators.predicates import Member, Predicate, Scope, condition
from ..streaming.rows import Decoder

if TYPE_CHECKING:
    from ..sources.store import ReadTransaction

_BOUND = "__bound_"
#: Hints of other engines that have a counterpart; all others only are kept for the debug view.
OPTIONS = {"hash join": "shuffle_hash", "merge join": "merge", "loop join": "shuffle_replicate_nl"}
HINTS = {"broadcast", "merge", "shuffle_hash", "shuffle_merge", "shuffle_replicate_nl", "coalesce", "repartition", "rebalance"}


@dataclass(frozen=True)
class Order:
    name: str
    alias: str | None = None
    descending: bool = False

    def column(self, default_alias: str | None) -> Column:
        alias = self.alias or default_alias
        c = F.col(f"`{alias}`.`{self.name}`" if alias else f"`{self.name}`")
        return c.desc() if self.descending else c.asc()


@dataclass(frozen=True)
class MemberOrder:
    """Order by a member, in a column or in JSON."""

    path: tuple[str, ...]
    map: DocumentMap | None
    descending: bool = False
    alias: str | None = None

    @property
    def name(self) -> str:
        return self.path[-1]

    def column(self, alias: str | None) -> Column:
        c = Scope(self.map, alias).resolve(self.path)
        return c.desc() if self.descending else c.asc()


@dataclass(frozen=True)
class Pick:
    """A selected column: a name, an expression, a row number or all columns (of an alias)."""

    kind: str
    text: str = ""
    alias: str | None = None
    table: str | None = None
    partition: tuple[tuple[str, str | None], ...] = ()
    orders: tuple[Order, ...] = ()


@dataclass(frozen=True)
class ParameterSlot:
    """A condition that waits for the values of its parameters."""

    query: Query
    column: str
    operand: str
    names: tuple[str, ...]

    def parameter_value(self, value: Any) -> Query:
        return self.parameter_values(value)

    def parameter_values(self, *values: Any) -> Query:
        many = self.operand in ("in", "not in")
        values = tuple(values[0]) if many and len(values) == 1 and isinstance(values[0], (list, tuple, set)) else values
        if len(values) != len(self.names):
            raise ValueError(f"{len(self.names)} values are needed, {len(values)} given")
        return self.query._bound(self, dict(zip(self.names, values, strict=True)))

    def parameter_default(self, *values: Any) -> Query:
        query = self.query._bound(self, {})
        return replace(query, defaults={**query.defaults, **dict(zip(self.names, values, strict=True))})


@dataclass(frozen=True, eq=False)
class Query:
    """A query over a table, a join, a sub-query or raw SQL. Methods return new queries; nothing runs before a terminal."""

    txn: ReadTransaction
    load: Callable[[], DataFrame]
    map: DocumentMap | None = None
    alias_name: str | None = None
    row_type: Any = None
    joins: tuple[Join, ...] = ()
    wheres: tuple[Callable[[Query], Column] | str, ...] = ()
    picks: tuple[Pick, ...] = ()
    groups: tuple[tuple[str, str | None], ...] = ()
    orders: tuple[Order, ...] = ()
    parameters: dict[str, Any] = field(default_factory=dict)
    defaults: dict[str, Any] = field(default_factory=dict)
    types: dict[str, str] = field(default_factory=dict)
    hints: tuple[str, ...] = ()
    options: tuple[str, ...] = ()
    timeout: float | None = None
    implicit_order: bool = True
    filters_by_name: bool = True

    # sources

    def table(self, name: str) -> Query:
        return replace(self, load=lambda: self.txn.table(name))

    view = table

    def alias(self, name: str) -> Query:
        return replace(self, alias_name=name)

    def hint(self, text: str) -> Query:
        return replace(self, hints=(*self.hints, text))

    def no_lock(self) -> Query:
        return self.hint("NOLOCK")

    def option(self, text: str) -> Query:
        return self if text in self.options else replace(self, options=(*self.options, text))

    def subquery(self, alias: str | None = None) -> Query:
        """This query as a derived table."""
        return Query(self.txn, lambda: self._lower(ordered=False), self.map, alias or "subquery", self.row_type, parameters=self.parameters, defaults=self.defaults)

    def union(self, other: Query, alias: str | None = None) -> Query:
        """Distinct rows of both, by position."""
        merged = Parameters(self.parameters).add_all({k: v for k, v in other.parameters.items() if self.parameters.get(k, _BOUND) is not v})
        return Query(self.txn, lambda: self._lower(ordered=False).union(other._lower(ordered=False)).distinct(), self.map, alias or "union", self.row_type, parameters=dict(merged), defaults={**self.defaults, **other.defaults})

    # filters

    def where(self, condition_: str | Predicate, operand: str | None = None, *values: Any) -> Query:
        """Raw SQL text, a predicate, or a column with an operand and values. Clauses are AND-ed; blank text counts for nothing."""
        if isinstance(condition_, Predicate):
            return replace(self, wheres=(*self.wheres, lambda q: condition_.to_column(q.scope())))
        if operand is None:
            return replace(self, wheres=(*self.wheres, condition_)) if condition_.strip() else self
        return replace(self, wheres=(*self.wheres, lambda q: condition(q.scope().column(condition_), operand, values)))

    def where_null(self, name: str) -> Query:
        return replace(self, wheres=(*self.wheres, lambda q: q.scope().column(name).isNull()))

    def where_not_null(self, name: str) -> Query:
        return replace(self, wheres=(*self.wheres, lambda q: q.scope().column(name).isNotNull()))

    def where_parameterized(self, column: str, operand: str, *names: str) -> ParameterSlot:
        taken: list[str] = list(self.parameters) + list(self.defaults)
        made = []
        for name in names:
            made.append(unique_name(name, taken))
            taken.append(made[-1])
        return ParameterSlot(self, column, operand.lower(), tuple(made))

    def _bound(self, slot: ParameterSlot, values: dict[str, Any]) -> Query:
        def make(q: Query) -> Column:
            known = {**q.defaults, **q.parameters}
            missing = [n for n in slot.names if n not in known]
            if missing:
                raise ValueError(f"parameter {missing[0]} has no value")
            found = tuple(known[n] for n in slot.names)
            return condition(q.scope().column(slot.column), slot.operand, (found,) if slot.operand in ("in", "not in") else found)

        return replace(self, wheres=(*self.wheres, make), parameters={**self.parameters, **values})

    # parameters

    def parameter(self, name: str, value: Any) -> Query:
        return replace(self, parameters=dict(Parameters(self.parameters).add(name, value)))

    def parameter_default(self, name: str, value: Any, sql_type: str | None = None) -> Query:
        return replace(self, defaults={**self.defaults, normalise(name): value}, types={**self.types, **({normalise(name): sql_type} if sql_type else {})})

    def declare(self, name: str, sql_type: str) -> Query:
        """The type of a parameter of a function or a procedure."""
        return replace(self, types={**self.types, normalise(name): sql_type})

    def like_parameter(self, name: str, text: str) -> Query:
        return self.parameter(name, like_value(text))

    def like_piped_parameter(self, name: str, text: str) -> Query:
        return self.parameter(name, like_piped_value(text))

    # projection, grouping, order

    def all_columns(self) -> Query:
        return replace(self, picks=(*self.picks, Pick("all")))

    def columns_of(self, alias: str) -> Query:
        return replace(self, picks=(*self.picks, Pick("all", table=alias)))

    def column(self, name: str | Member, alias: str | None = None, table_alias: str | None = None) -> Query:
        if isinstance(name, Member):
            return self.member_column(".".join(name._path), alias or name._path[-1])
        return replace(self, picks=(*self.picks, Pick("name", name, alias, table_alias)))

    def calculated_column(self, expression: str, alias: str) -> Query:
        return replace(self, picks=(*self.picks, Pick("expr", expression, alias)))

    def member_column(self, path: str, alias: str) -> Query:
        """A member by its path, in a column or in JSON, as the type that the map declares."""
        return replace(self, picks=(*self.picks, Pick("member", path, alias)))

    def add_row_number_column(self, alias: str, *partition_by: str | tuple[str, str]) -> Query:
        """Row numbers in the pending order, which they use up, else in the order of ids."""
        partition = tuple(p if isinstance(p, tuple) else (p, None) for p in partition_by)
        return replace(self, picks=(*self.picks, Pick("row", alias=alias, partition=partition, orders=self.orders)), orders=())

    def as_type(self, row_type: Any) -> Query:
        return replace(self, row_type=row_type)

    def group_by(self, name: str, table_alias: str | None = None) -> Query:
        return replace(self, groups=(*self.groups, (name, table_alias)))

    def _order(self, name: str | Member, table_alias: str | None, descending: bool) -> Query:
        made = MemberOrder(name._path, self.map, descending) if isinstance(name, Member) else Order(name, table_alias, descending)
        return replace(self, orders=(*self.orders, made))

    def order_by(self, name: str | Member, table_alias: str | None = None) -> Query:
        return self._order(name, table_alias, False)

    def order_by_descending(self, name: str | Member, table_alias: str | None = None) -> Query:
        return self._order(name, table_alias, True)

    then_by, then_by_descending = order_by, order_by_descending

    def with_timeout(self, seconds: float) -> Query:
        return replace(self, timeout=seconds)

    # joins

    def _join(self, kind: str, right: Query, alias: str | None) -> JoinBuilder:
        left = self if not (self.wheres or self.picks or self.groups) else self.subquery(self.alias_name or "t1")
        left = left if left.alias_name else left.alias("t1")
        name = alias or right.alias_name or f"t{len(left.joins) + 2}"
        if name in (left.alias_name, *(j.alias for j in left.joins)):
            name = f"t{len(left.joins) + 2}"
        return JoinBuilder(left, kind, right, name)

    def inner_join(self, right: Query, alias: str | None = None) -> JoinBuilder:
        return self._join("inner", right, alias)

    def left_hash_join(self, right: Query, alias: str | None = None) -> JoinBuilder:
        return self._join("left", right, alias)

    def cross_join(self, right: Query, alias: str | None = None) -> Query:
        return self._join("cross", right, alias).done()

    def with_join(self, join: Join) -> Query:
        return replace(self, joins=(*self.joins, join), parameters={**join.right.parameters, **self.parameters}, defaults={**join.right.defaults, **self.defaults})

    # lowering

    def scope(self) -> Scope:
        return Scope(self.map, self.alias_name if self.joins else None, self.filters_by_name)

    def _bind(self, df: DataFrame, text: str) -> tuple[DataFrame, Column]:
        text, used = bind(text, {**self.defaults, **self.parameters}, _BOUND)
        return df.withColumns({_BOUND + k: F.lit(v) for k, v in used.items()}) if used else df, F.expr(text)

    def _filtered(self) -> DataFrame:
        df = self.load()
        for text in self.hints:
            if text.lower() in HINTS:
                df = df.hint(text)
        df = df.alias(self.alias_name) if self.alias_name else df
        if self.joins:
            df = join_all(df, self.alias_name, self.joins, next((OPTIONS[o.lower()] for o in self.options if o.lower() in OPTIONS), None))
        for clause in self.wheres:
            if isinstance(clause, str):
                df, test = self._bind(df, clause)
                df = df.filter(test)
            else:
                df = df.filter(clause(self))
        return df

    def _id_order(self) -> tuple[Order, ...]:
        return (Order(self.map.id),) if self.map else ()

    def _pick(self, df: DataFrame, p: Pick) -> tuple[DataFrame, list[Column]]:
        scope = self.scope()
        if p.kind == "all":
            table = p.table or (self.alias_name if self.joins else None)
            return df, [F.col(f"`{table}`.*") if table else F.col("*")]
        if p.kind == "name":
            c = F.col(f"`{p.table}`.`{p.text}`") if p.table else scope.column(p.text) if self.joins and not p.table else F.col(f"`{p.text}`")
            return df, [c.alias(p.alias or p.text)]
        if p.kind == "member":
            return df, [scope.resolve(tuple(p.text.split("."))).alias(p.alias)]
        if p.kind == "row":
            w = Window.orderBy(*[o.column(scope.alias) for o in p.orders or self._id_order()] or [F.lit(1)])
            if p.partition:
                w = w.partitionBy(*[F.col(f"`{t}`.`{n}`") if t else scope.column(n) for n, t in p.partition])
            return df, [F.row_number().over(w).cast("bigint").alias(p.alias)]
        df, expression = self._bind(df, p.text)
        return df, [expression.alias(p.alias)]

    def _projected(self, df: DataFrame) -> DataFrame:
        picks = self.picks or (Pick("all"),)
        if self.groups:
            keys = [F.col(f"`{t}`.`{n}`") if t else self.scope().column(n) for n, t in self.groups]
            wanted = [p for p in picks if p.kind != "all"] or [Pick("name", n, None, t) for n, t in self.groups]
            columns: list[Column] = []
            for p in wanted:
                df, some = self._pick(df, p)
                columns += some
            made = df.groupBy(*[k.alias(f"__key{i}") for i, k in enumerate(keys)])
            calculated = [c for c, p in zip(columns, wanted, strict=True) if p.kind == "expr"]
            names = {(n, t): f"__key{i}" for i, (n, t) in enumerate(self.groups)}
            made = made.agg(*calculated) if calculated else made.agg(F.count(F.lit(1)).alias("__rows"))
            shown = []
            for p in wanted:
                if p.kind == "expr":
                    shown.append(F.col(f"`{p.alias}`"))
                else:
                    key = names.get((p.text, p.table)) or next((k for (n, _), k in names.items() if n == p.text), None)
                    if key is None:
                        raise ValueError(f"{p.text} is neither grouped by nor calculated")
                    shown.append(F.col(key).alias(p.alias or p.text))
            return made.select(*shown)
        columns = []
        for p in picks:
            df, some = self._pick(df, p)
            columns += some
        made = df.select(*columns)
        return made.drop(*[c for c in made.columns if c.startswith(_BOUND)])

    def _aggregates(self, df: DataFrame) -> bool:
        """Whether a calculated column makes one row of all, as the analyser sees it."""
        return any(self._pick_made(df, p)._jdf.queryExecution().analyzed().nodeName() == "Aggregate" for p in self.picks if p.kind == "expr" and "(" in p.text)

    def _pick_made(self, df: DataFrame, p: Pick) -> DataFrame:
        df, columns = self._pick(df, p)
        return df.select(*columns)

    def _lower(self, ordered: bool = True, limit: int | None = None, offset: int = 0, distinct: bool = False) -> DataFrame:
        df = self._filtered()
        orders = () if self.groups else self.orders or (self._id_order() if self.implicit_order and not distinct and not self._aggregates(df) else ())
        if orders and not self.orders and self.map.id not in df.columns:
            orders = ()  # a derived table without the id
        if ordered and orders and not distinct:
            df = df.orderBy(*[o.column(self.alias_name if self.joins else None) for o in orders])
        df = self._projected(df)
        if distinct:
            df = df.distinct()
            if ordered and self.orders:
                df = df.orderBy(*[Order(o.name, None, o.descending).column(None) for o in self.orders if o.name in df.columns])
        if offset:
            df = df.offset(offset)
        return df.limit(limit) if limit is not None else df

    # as DataFrames

    def to_df(self) -> DataFrame:
        return self._lower()

    def take_df(self, n: int) -> DataFrame:
        return self._lower(limit=n)

    def page_df(self, skip: int, take: int) -> DataFrame:
        return self._lower(limit=take, offset=skip)

    def distinct_df(self) -> DataFrame:
        return self._lower(distinct=True)

    def count_df(self, name: str = "count") -> DataFrame:
        return self._lower(ordered=False).agg(F.count(F.lit(1)).alias(name))

    def any_df(self, name: str = "any") -> DataFrame:
        return self._lower(ordered=False, limit=1).agg((F.count(F.lit(1)) > 0).alias(name))

    def page_with_count_df(self, skip: int, take: int, name: str = "CrossJoinCount") -> DataFrame:
        """A page with the number of all rows in each row; the count is one row, so the join moves nothing."""
        return self.page_df(skip, take).crossJoin(F.broadcast(self.count_df(name)))

    # terminals

    def _run(self, work: Callable[[], Any]) -> Any:
        return self.txn.run(work, self.timeout, self)

    def _decoder(self) -> Decoder:
        return Decoder(self.row_type, self.map)

    def _rows(self, df: DataFrame) -> list[Any]:
        return self._run(lambda: list(self._decoder().rows(df.collect())))

    def to_list(self, skip: int | None = None, take: int | None = None) -> list[Any]:
        return self._rows(self.to_df() if skip is None and take is None else self.page_df(skip or 0, take or 0))

    to_array = to_list

    def to_list_with_count(self, skip: int, take: int) -> tuple[list[Any], int]:
        """A page and the number of all rows; no page query if take is 0."""
        return (self.to_list(skip, take) if take else []), self.count()

    def stream(self) -> Iterator[Any]:
        return self._decoder().rows(self.to_df().toLocalIterator())

    def take(self, n: int) -> list[Any]:
        return self._rows(self.take_df(n))

    def distinct(self) -> list[Any]:
        return self._rows(self.distinct_df())

    def first_or_default(self) -> Any:
        return next(iter(self.take(1)), None)

    first = first_or_default

    def count(self) -> int:
        return self._run(lambda: self.count_df().first()[0])

    def any(self) -> bool:
        return self._run(lambda: not self._lower(ordered=False, limit=1).isEmpty())

    def to_dictionary(self, key: Callable[[Any], str]) -> dict[str, Any]:
        """By key without regard to case; a key that occurs twice is an error."""
        found: dict[str, Any] = {}
        for row in self.to_list():
            k = key(row)
            k = k.casefold() if isinstance(k, str) else k
            if k in found:
                raise KeyError(f"{k} occurs twice")
            found[k] = row
        return found

    def debug_view_raw_query(self) -> str:
        """The plan as text, with hints and options that have no effect here."""
        plan = self.to_df()._jdf.queryExecution().toString()
        noted = [*self.hints, *self.options]
        return plan + (f"\n-- noted: {', '.join(noted)}" if noted else "")

    async def run_async(self, terminal: str, *args: Any) -> Any:
        """Any terminal by name in a worker thread: ``await q.run_async("count")``."""
        return await asyncio.to_thread(getattr(self, terminal), *args)

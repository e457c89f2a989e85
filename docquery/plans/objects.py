"""Views, table functions and stored queries made of a query. A view has no implicit order."""

from __future__ import annotations

import datetime
import decimal
from dataclasses import replace
from typing import Any

from pyspark.sql import types as T

from ..functions.parameters import PART, bind, normalise
from .query import Query

_UNSET = object()


def as_view(query: Query, name: str) -> str:
    """A temporary view."""
    query._lower(ordered=bool(query.orders)).createOrReplaceTempView(name)
    query.txn.store.views.add(name)
    return name


def _declared(query: Query, name: str, text: str) -> tuple[str, dict[str, tuple[str, Any]]]:
    """The text with its @parameters as those of the function ``name``, and their types and defaults."""
    names = dict.fromkeys(normalise(m[2]) for m in PART.finditer(text) if m[2])
    found = {}
    for p in names:
        if p not in query.types:
            raise ValueError(f"parameter {p} needs a type")
        found[p] = (T.StructType.fromDDL(f"p {query.types[p]}")["p"].dataType.simpleString(), query.defaults.get(p, _UNSET))
    return bind(text, dict.fromkeys(names), f"{name}.")[0], found


def _literal(value: Any) -> str:
    """A value as SQL text."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).upper()
    if isinstance(value, datetime.datetime):
        return f"TIMESTAMP '{value.isoformat(' ')}'"
    if isinstance(value, datetime.date):
        return f"DATE '{value.isoformat()}'"
    if isinstance(value, decimal.Decimal):
        return f"{value:f}BD"
    if isinstance(value, float):
        return f"DOUBLE('{value!r}')"
    if isinstance(value, (bytes, bytearray)):
        return f"X'{value.hex()}'"
    return str(value) if isinstance(value, int) else "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"


def as_function(query: Query, name: str, condition: str | None = None, view: str | None = None) -> str:
    """A temporary table function: the rows of the query, by way of ``view``, where the condition on @parameters holds.

    Without a condition, the query's own text conditions that name parameters are it; they may use the columns that the query returns. Every parameter needs a
    declared type, any of Spark SQL; those with a default may be left out of a call if they come last.
    """
    spark = query.txn.spark
    if condition is None:
        own = [w for w in query.wheres if isinstance(w, str) and any(m[2] for m in PART.finditer(w))]
        condition = " AND ".join(f"({w})" for w in own) or "TRUE"
        query = replace(query, wheres=tuple(w for w in query.wheres if w not in own))
    view = as_view(query, view or f"{name}_rows")
    condition, declared = _declared(query, name, condition)
    head = ", ".join(f"{p} {t}" + ("" if d is _UNSET else f" DEFAULT {_literal(d)}") for p, (t, d) in declared.items())
    columns = spark.table(view).schema
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({head}) RETURNS TABLE({', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in columns)}) RETURN SELECT * FROM {view} WHERE {condition}")
    return name


def as_procedure(query: Query, name: str) -> str:
    """A stored query that ``txn.call(name, parameter=value)`` runs; parameters left out take their defaults."""

    def run(txn, **args: Any):
        known = {normalise(k): v for k, v in args.items()}
        return replace(query, txn=txn, parameters={**query.parameters, **known}).to_df()

    query.txn.store.procedures[name] = run
    return name

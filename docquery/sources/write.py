"""Write transactions: changes are kept beside the tables, seen by the transaction's own queries, and committed together."""

from __future__ import annotations

import dataclasses
import datetime
import json
from collections.abc import Iterable
from enum import Enum
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.parameters import normalise
from ..mapping import EDGE_SCHEMA, Direction, DocumentMap, JsonFormat
from ..operators.predicates import Predicate
from ..plans.query import Query
from .store import ReadTransaction, Store
from .tables import CommitConflictError


class StaleDataError(RuntimeError):
    """The document was changed or deleted since it was read."""


class StringTooLongError(ValueError):
    """A text is longer than its column."""


class UniqueConstraintError(ValueError):
    """Two documents break a unique rule."""


class NotAvailableError(TypeError):
    """The operation needs a versioned store."""


def _plain(value: Any) -> Any:
    if isinstance(value, Enum):
        return value.name
    if dataclasses.is_dataclass(value) and not isinstance(value, type):
        return {f.name: _plain(getattr(value, f.name)) for f in dataclasses.fields(value)}
    if isinstance(value, (list, tuple)):
        return [_plain(v) for v in value]
    if isinstance(value, dict):
        return {k: _plain(v) for k, v in value.items()}
    return value.isoformat() if isinstance(value, (datetime.date, datetime.datetime)) else value


class WriteTransaction(ReadTransaction):
    """Staged changes a table: rows to add and ids to delete, as DataFrames, so a bulk change needs no rows on the driver."""

    def __init__(self, store: Store, hooks: Iterable[Any] = ()):
        if not hasattr(store.tables, "commit"):
            raise NotAvailableError("this store is read-only")
        super().__init__(store)
        self._added: dict[str, list[Any]] = {}
        self._deleted: dict[str, list[DataFrame]] = {}
        self._ids: dict[str, str] = {}
        self._schemas: dict[str, Any] = {}
        self._touched: dict[str, DocumentMap] = {}
        self.hooks = [*store.hooks, *hooks]

    def __exit__(self, *error: Any) -> None:
        self.close()  # what isn't committed is dropped

    def share(self) -> SharedTransaction:
        """A transaction on the same staged changes that leaves the commit to this one."""
        return SharedTransaction(self)

    def _hook(self, name: str, *args: Any) -> None:
        for h in self.hooks:
            getattr(h, name, lambda *a: None)(*args)

    # the tables as this transaction sees them

    def table(self, name: str) -> DataFrame:
        if name in self.store.views:
            return super().table(name)
        known = self.store.tables.exists(name, self.version)
        rows = [super().table(name)] if known else []
        if known and name in self._deleted:
            gone = reduce(DataFrame.unionByName, self._deleted[name]).distinct()
            rows = [rows[0].join(gone, F.col(f"`{self._ids[name]}`") == F.col("__id"), "left_anti")]
        rows += self._staged(name)
        if not rows:
            raise KeyError(f"no table {name}")
        return reduce(DataFrame.unionByName, rows)

    def _delete_rows(self, name: str, id_: str, ids: DataFrame) -> None:
        ids = ids.select(F.col(ids.columns[0]).alias("__id")).distinct()
        self._ids[name] = id_
        self._added[name] = [d.join(ids, F.col(f"`{id_}`") == F.col("__id"), "left_anti") for d in self._staged(name)]
        self._deleted.setdefault(name, []).append(ids)

    def _add_rows(self, name: str, id_: str, rows: DataFrame | tuple[list[tuple], T.StructType]) -> None:
        """Stages a DataFrame, or tuples with their schema, which are added to those staged just before."""
        self._ids[name] = id_
        added = self._added.setdefault(name, [])
        if isinstance(rows, DataFrame):
            self._schemas.setdefault(name, rows.schema)
            added.append(rows)
            return
        self._schemas.setdefault(name, rows[1])
        if added and isinstance(added[-1], tuple) and added[-1][1] == rows[1]:
            added[-1][0].extend(rows[0])
        else:
            added.append((list(rows[0]), rows[1]))

    def _staged(self, name: str) -> list[DataFrame]:
        """What is staged, as DataFrames."""
        return [a if isinstance(a, DataFrame) else self.spark.createDataFrame(*a) for a in self._added.get(name, [])]

    # documents as rows

    def _values(self, m: DocumentMap, doc: Any, given: Any = None) -> dict[str, Any]:
        members = {f.name: getattr(doc, f.name) for f in dataclasses.fields(doc)} if dataclasses.is_dataclass(doc) else dict(doc) if isinstance(doc, dict) else vars(doc)
        by_name = {k.lower(): k for k in members}
        key = members.get(by_name.get(m.id.lower(), ""), None)
        if given is not None and key is not None and given != key:
            raise ValueError(f"the document's id is {key}, not {given}")
        out = {m.id: key if given is None else given}
        taken = {m.id.lower(), (m.row_version or "").lower()}
        for c in m.columns:
            taken.add(c.of.lower())
            value = members.get(by_name.get(c.of.lower(), ""), None)
            value = c.handler.encode(value) if c.handler else value.name if isinstance(value, Enum) else value
            if c.limit is not None and isinstance(value, str) and len(value) > c.limit:
                raise StringTooLongError(f"{m.name}.{c.name} takes {c.limit} characters, not {len(value)}")
            out[c.name] = None if c.direction is Direction.LOAD_ONLY else value
        if m.type_column and m.column(m.type_column) is None:
            out[m.type_column] = next((v for v, kind in m.types.items() if kind is type(doc)), None)
        rest = json.dumps({k: _plain(v) for k, v in members.items() if k.lower() not in taken}, ensure_ascii=False)
        if m.json_format.has_text:
            out["JSON"] = rest if m.json_format in (JsonFormat.TEXT_ONLY, JsonFormat.MIXED_PREFER_TEXT) else None
        if m.json_format.has_blob:
            import gzip

            out["JSONBlob"] = None if m.json_format is JsonFormat.MIXED_PREFER_TEXT else gzip.compress(rest.encode("utf-16-le"), mtime=0)
        return out

    def _put(self, doc: Any, name: str, value: Any) -> None:
        if isinstance(doc, dict):
            doc[name] = value
            return
        found = next((n for n in vars(doc) if n.lower() == name.lower()), name)
        object.__setattr__(doc, found, value)

    def _frame(self, m: DocumentMap, rows: list[dict[str, Any]]) -> tuple[list[tuple], T.StructType]:
        schema = m.stored_schema()
        return [tuple(r.get(n) for n in schema.names) for r in rows], schema

    def _map_of(self, doc: Any, wanted: Any) -> DocumentMap:
        return self.store.maps.of(wanted if wanted is not None else type(doc))

    # changes

    def insert(self, doc: Any, wanted: Any = None, **options: Any) -> None:
        self.insert_many([doc], wanted, **options)

    def insert_many(self, docs: Iterable[Any], wanted: Any = None, table: str | None = None, schema: str | None = None, custom_id: Any = None) -> None:
        """Adds documents; ids that are None are allocated, row versions set, related edges written."""
        docs = list(docs)
        by_map: dict[str, tuple[DocumentMap, list[Any]]] = {}
        for doc in docs:
            m = self._map_of(doc, wanted)
            by_map.setdefault(m.name, (m, []))[1].append(doc)
        for m, some in by_map.values():
            m = m.with_table(table, schema) if table or schema else m
            rows, top = [], None
            for doc in some:
                row = self._values(m, doc, custom_id)
                if row[m.id] is None:
                    if m.identity:
                        top = (self.table(m.table_name).agg(F.max(m.id)).first()[0] if self._known(m.table_name) else None) or 0 if top is None else top
                        top += 1
                        row[m.id] = top
                    else:
                        row[m.id] = self.allocate_id(m)
                self._put(doc, m.id, row[m.id])
                self._hook("before_insert", doc, m, self)
                row |= {k: v for k, v in self._values(m, doc, None).items() if k != m.id}
                if m.row_version:
                    row[m.row_version] = 1
                    self._put(doc, m.row_version, 1)
                rows.append(row)
            self._add_rows(m.table_name, m.id, self._frame(m, rows))
            self._touched[m.table_name] = m
            for doc, row in zip(some, rows, strict=True):
                self._edges(m, doc, row[m.id])
                self._hook("after_insert", doc, m, self)

    def insert_df(self, wanted: Any, rows: DataFrame) -> None:
        """Adds rows in the table's own columns, by name, and the edges of related documents whose map has ``pairs``, which may use any column of rows."""
        m = self.store.maps.of(wanted)
        for related in m.related:
            if related.pairs is None:
                continue
            edges = rows.select(F.col(f"`{m.id}`").cast("string").alias("Id"), F.lit(m.table_name).alias("Table"), F.explode(F.array_distinct(F.expr(related.pairs))).alias("e"))
            self._add_rows(related.table, "Id", edges.select("Id", "Table", F.col("e.id").cast("string").alias("RelatedDocumentId"), F.col("e.type").cast("string").alias("RelatedDocumentTable")).to(T.StructType.fromDDL(EDGE_SCHEMA)))
        self._add_rows(m.table_name, m.id, rows.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in m.stored_schema()]))
        self._touched[m.table_name] = m

    def update(self, doc: Any, wanted: Any = None) -> None:
        """Replaces the row of the document's id; without such a row nothing changes. With a row version, StaleDataError if it is another or the row is gone."""
        m = self._map_of(doc, wanted)
        self._hook("before_update", doc, m, self)
        row = self._values(m, doc)
        current = self.table(m.table_name).filter(F.col(f"`{m.id}`") == F.lit(row[m.id]))
        keep = [c.name for c in m.columns if c.direction is Direction.LOAD_ONLY]
        old = current.select(m.id, *keep, *([m.row_version] if m.row_version else [])).first()
        if m.row_version:
            mine = getattr(doc, m.row_version, None) if not isinstance(doc, dict) else doc.get(m.row_version)
            if old is None or old[m.row_version] != mine:
                raise StaleDataError(f"{m.name} {row[m.id]} was changed")
            row[m.row_version] = mine + 1
        if old is None:
            self._hook("after_update", doc, m, self)
            return
        row |= {c: old[c] for c in keep}
        ids = self.spark.createDataFrame([(row[m.id],)], f"id {m.id_type.simpleString()}")
        self._delete_rows(m.table_name, m.id, ids)
        self._add_rows(m.table_name, m.id, self._frame(m, [row]))
        self._touched[m.table_name] = m
        if m.row_version:
            self._put(doc, m.row_version, row[m.row_version])
        self._update_edges(m, doc, row[m.id], ids)
        self._hook("after_update", doc, m, self)

    def delete(self, doc_or_id: Any, wanted: Any = None) -> None:
        m = self._map_of(doc_or_id, wanted)
        is_doc = not isinstance(doc_or_id, (str, int))
        key = self._values(m, doc_or_id)[m.id] if is_doc else doc_or_id
        self._check_key(m, key)
        self._hook("before_delete", key, m, self)
        ids = self.spark.createDataFrame([(key,)], f"id {m.id_type.simpleString()}")
        self._delete_rows(m.table_name, m.id, ids)
        self._drop_edges(m, ids)
        self._hook("after_delete", key, m, self)

    def delete_query(self, wanted: Any) -> DeleteQuery:
        return DeleteQuery(self, self.query(wanted))

    # related documents

    def _edges(self, m: DocumentMap, doc: Any, key: Any) -> None:
        for related in m.related:
            pairs = list(dict.fromkeys(related.documents(doc)))
            self._hook("store_related", doc, pairs, self)
            if pairs:
                rows = [(str(key), m.table_name, str(i), t) for i, t in pairs]
                self._add_rows(related.table, "Id", (rows, T.StructType.fromDDL(EDGE_SCHEMA)))

    def _update_edges(self, m: DocumentMap, doc: Any, key: Any, ids: DataFrame) -> None:
        """Edges that the document still has stay; only where they differ are they written anew."""
        for related in m.related:
            wanted = {(str(i), t) for i, t in related.documents(doc)}
            found = self.table(related.table).where(F.col("Id") == str(key)).select("RelatedDocumentId", "RelatedDocumentTable").collect() if self._known(related.table) else []
            if {tuple(r) for r in found} != wanted:
                one = dataclasses.replace(m, related=(related,))
                self._drop_edges(one, ids)
                self._edges(one, doc, key)

    def _drop_edges(self, m: DocumentMap, ids: DataFrame) -> None:
        for related in m.related:
            if self._known(related.table):
                self._delete_rows(related.table, "Id", ids.select(F.col(ids.columns[0]).cast("string").alias("id")))

    def _known(self, name: str) -> bool:
        return name in self._added or self.store.tables.exists(name, self.version)

    # keys

    def allocate_id(self, wanted: Any) -> Any:
        m = self.store.maps.of(wanted)
        return self.store.key_handlers.make(m, lambda: self.store.keys.next(m.table_name))

    # commit

    def _check_unique(self, m: DocumentMap) -> None:
        for rule in m.unique:
            if not self._added.get(m.table_name):
                continue
            mine = reduce(DataFrame.unionByName, self._staged(m.table_name)).select(*rule.columns).distinct()
            mine = mine.toDF(*[f"__{c}" for c in rule.columns])
            same = reduce(lambda a, b: a & b, [F.col(f"`{c}`").eqNullSafe(F.col(f"`__{c}`")) for c in rule.columns])  # a rule lets one null key in
            twice = self.table(m.table_name).join(mine, same, "left_semi").groupBy(*rule.columns).count().where("count > 1")
            if not twice.isEmpty():
                raise UniqueConstraintError(rule.message)
        added = self._staged(m.table_name)
        if added:
            ids = reduce(DataFrame.unionByName, added).select(m.id)
            if not self.table(m.table_name).join(ids.distinct(), m.id, "left_semi").groupBy(m.id).count().where("count > 1").isEmpty():
                raise UniqueConstraintError(f"an id of {m.name} occurs twice")

    def commit(self) -> int:
        """Checks unique rules and makes all changes visible at once. Commits of other tables since the start are taken over."""
        self._hook("before_commit", self)
        for m in self._touched.values():
            self._check_unique(m)
        changes = {}
        for name in dict.fromkeys([*self._added, *self._deleted]):
            schema = self._schemas[name] if name in self._schemas else self.table(name).schema
            added = self._staged(name)
            changes[name] = {"id": self._ids[name], "schema": schema, "rows": reduce(DataFrame.unionByName, added) if added else None, "deleted": reduce(DataFrame.unionByName, self._deleted[name]).distinct() if name in self._deleted else None}
        if not changes:
            return self.version
        base = self.store.tables.latest()
        if base != self.version:
            then, now = self.store.tables.manifest(self.version), self.store.tables.manifest(base)
            if any(then.get(n) != now.get(n) for n in changes):
                raise CommitConflictError("a table of this transaction was changed by another")
        self.version = self.store.tables.commit(base, changes)
        self.rollback()
        self._hook("after_commit", self)
        return self.version

    def rollback(self) -> None:
        """Drops what is staged."""
        for staged in (self._added, self._deleted, self._touched):
            staged.clear()


class SharedTransaction(WriteTransaction):
    """Reads and changes what another transaction has staged; commit and rollback are the other's."""

    def __init__(self, owner: WriteTransaction):
        super().__init__(owner.store)
        self.__dict__.update({k: v for k, v in owner.__dict__.items() if k != "commands"})

    def commit(self) -> int:
        raise NotAvailableError("the transaction that this one shares in commits")

    def rollback(self) -> None:
        raise NotAvailableError("the transaction that this one shares in rolls back")


@dataclasses.dataclass(frozen=True)
class DeleteQuery:
    """Deletes what a query finds; rows for which the condition is unknown stay."""

    txn: WriteTransaction
    query: Query

    def where(self, *args: Any) -> DeleteQuery:
        return DeleteQuery(self.txn, self.query.where(*args))

    def where_predicate(self, predicate: Predicate) -> DeleteQuery:
        return DeleteQuery(self.txn, self.query.where(predicate))

    def parameter(self, name: str, value: Any) -> DeleteQuery:
        return DeleteQuery(self.txn, self.query.parameter(normalise(name), value))

    def delete(self) -> None:
        m = self.query.map
        ids = self.query._lower(ordered=False).select(F.col(f"`{m.id}`").alias("id"))
        self.txn._delete_rows(m.table_name, m.id, ids)
        self.txn._drop_edges(m, ids)

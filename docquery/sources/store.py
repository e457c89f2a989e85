"""Stores and read transactions."""

from __future__ import annotations

import asyncio
import logging
import re
import threading
import time
from collections.abc import Callable, Iterable, Iterator
from enum import Enum
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.parameters import Parameters, bind
from ..mapping import DocumentMap, MapRegistry
from ..plans.query import Query
from ..plans.queryable import Queryable
from ..streaming.rows import Decoder, MultiMap, multi_map
from .keys import KeyAllocator, KeyHandlers
from .tables import ParquetTables, VersionedTables

log = logging.getLogger("docquery")


class ResourceNotFoundError(LookupError):
    """A required document doesn't exist."""


#: A text literal, a table in braces, or another brace.
_BRACES = re.compile(r"'(?:[^'\\]|''|\\.)*'|\{([A-Za-z_]\w*)\}|[{}]", re.S)


class Concurrency(Enum):
    NO_LOCK = 0
    LOCK_ONLY = 1
    LOG_ONLY = 2
    LOCK_WITH_LOGGING = 3


class Store:
    """Maps, tables and defaults. ``procedures`` are Python functions or stored queries by name."""

    def __init__(self, spark: SparkSession, tables: ParquetTables | VersionedTables, maps: MapRegistry | None = None, slow_seconds: float = 0.3, concurrency: Concurrency = Concurrency.LOCK_ONLY, warn_commands: int = 100):
        self.spark, self.tables, self.maps = spark, tables, maps or MapRegistry()
        self.slow_seconds, self.concurrency, self.warn_commands = slow_seconds, concurrency, warn_commands
        self.procedures: dict[str, Callable[..., Any]] = {}
        self.hooks: list[Any] = []
        self.views: set[str] = set()
        self.key_handlers = KeyHandlers()
        self.keys = KeyAllocator(self._reserve)
        self.open_transactions: set[ReadTransaction] = set()
        self._key_lock = threading.Lock()

    @classmethod
    def of_parquet(cls, spark: SparkSession, root: str, *maps: DocumentMap, **options: Any) -> Store:
        return cls(spark, ParquetTables(spark, root), MapRegistry(*maps), **options)

    @classmethod
    def versioned(cls, spark: SparkSession, root: str, *maps: DocumentMap, **options: Any) -> Store:
        return cls(spark, VersionedTables(spark, root), MapRegistry(*maps), **options)

    def _reserve(self, table: str, block: int) -> int:
        """The end of a new block of numbers, kept as a table of its own and committed at once."""
        with self._key_lock:
            for _ in range(20):
                base = self.tables.latest()
                name = "KeyAllocation"
                known = {r[0]: r[1] for r in self.tables.read(name, base).collect()} if self.tables.exists(name, base) else {}
                known[table] = known.get(table, 0) + block
                rows = self.spark.createDataFrame(list(known.items()), "CollectionName string, Allocated bigint")
                try:
                    self.tables.commit(base, {name: {"id": "CollectionName", "schema": rows.schema, "rows": rows, "replace": True}})
                    return known[table]
                except RuntimeError:
                    continue
            raise RuntimeError("no block of keys could be reserved")

    def begin_read(self) -> ReadTransaction:
        return ReadTransaction(self)

    def begin_write(self, **options: Any):
        from .write import WriteTransaction

        return WriteTransaction(self, **options)


class ReadTransaction:
    """Queries of one version of the tables."""

    def __init__(self, store: Store, version: Any = None):
        self.store, self.spark = store, store.spark
        self.version = store.tables.latest() if version is None else version
        self.commands: list[tuple[str, float]] = []
        self._lock = threading.RLock()
        store.open_transactions.add(self)

    def __enter__(self):
        return self

    def __exit__(self, *error: Any) -> None:
        self.close()

    def close(self) -> None:
        self.store.open_transactions.discard(self)

    # running

    def run(self, work: Callable[[], Any], timeout: float | None = None, what: Any = None) -> Any:
        """Runs an action under the transaction's lock; after ``timeout`` seconds its jobs are cancelled."""
        mode = self.store.concurrency
        if mode in (Concurrency.LOG_ONLY, Concurrency.LOCK_WITH_LOGGING) and not self._lock.acquire(blocking=False):
            log.warning("a transaction is used by two threads at once")
        elif mode in (Concurrency.LOG_ONLY, Concurrency.LOCK_WITH_LOGGING):
            self._lock.release()
        if mode in (Concurrency.LOCK_ONLY, Concurrency.LOCK_WITH_LOGGING):
            with self._lock:
                return self._timed(work, timeout, what)
        return self._timed(work, timeout, what)

    def _timed(self, work: Callable[[], Any], timeout: float | None, what: Any) -> Any:
        context, timer, began = self.spark.sparkContext, None, time.monotonic()
        if timeout is not None:
            tag = f"docquery-{id(work)}"
            context.addJobTag(tag)
            timer = threading.Timer(timeout, lambda: context.cancelJobsWithTag(tag))
            timer.start()
        try:
            return work()
        finally:
            if timer:
                timer.cancel()
                context.removeJobTag(tag)
            took = time.monotonic() - began
            self.commands.append((type(what).__name__, took))
            log.log(logging.INFO if took >= self.store.slow_seconds else logging.DEBUG, "%s took %.3f s", type(what).__name__, took)
            if len(self.commands) == self.store.warn_commands:
                log.warning("%d commands in one transaction: is a query run for each row?", len(self.commands))

    # sources

    def table(self, name: str) -> DataFrame:
        """A table as of this transaction, or a view that as_view made."""
        return self.spark.table(name) if name in self.store.views else self.store.tables.read(name, self.version)

    def _mapped(self, wanted: Any) -> tuple[DocumentMap, Callable[[], DataFrame]]:
        m = self.store.maps.of(wanted)
        values = m.type_values(wanted if isinstance(wanted, type) else None)

        def load() -> DataFrame:
            df = self.table(m.table_name)
            return df if values is None else df.filter(F.col(f"`{m.type_column}`").isin(values))

        return m, load

    def query(self, wanted: Any) -> Query:
        """A query of a mapped class; of a subclass, its rows only."""
        m, load = self._mapped(wanted)
        return Query(self, load, m, row_type=wanted if isinstance(wanted, type) else m.document)

    def queryable(self, wanted: Any) -> Queryable:
        return Queryable(self.query(wanted))

    def from_table(self, name: str, alias: str | None = None) -> Query:
        """A query of a table without a map."""
        return Query(self, lambda: self.table(name), alias_name=alias)

    def raw_sql_query(self, sql: str, args: Any = None, row_type: Any = None) -> Query:
        """Raw SQL as a source; tables are named by {name} in the text."""
        values = Parameters(args)
        return Query(self, lambda: self.sql(sql, values), alias_name="raw", row_type=row_type)

    def from_rows(self, rows: Iterable[tuple], schema: str) -> Query:
        """A set of rows as a source, as a table-valued parameter."""
        rows = list(rows)
        return Query(self, lambda: self.spark.createDataFrame(rows, schema), alias_name="rows")

    def constant(self, value: Any, name: str = "value") -> Query:
        return Query(self, lambda: self.spark.range(1).select(F.lit(value).alias(name)))

    def sql(self, sql: str, args: Any = None) -> DataFrame:
        """SQL with @parameters; {name} is the table of that name, as this transaction sees it. Braces in text literals are text."""
        text, used = bind(sql, Parameters(args), ":")
        names: set[str] = set()

        def put(m: re.Match) -> str:
            if m[1]:
                names.add(m[1])
                return m[0]
            return m[0].replace("{", "{{").replace("}", "}}")

        text = _BRACES.sub(put, text)
        # without a table nothing is formatted, so braces stay single
        return self.spark.sql(text, args=used or None, **{n: self.table(n) for n in names}) if names else self.spark.sql(text.replace("{{", "{").replace("}}", "}"), args=used or None)

    def column_names(self, table: str, json_last: bool = False) -> list[str]:
        names = self.table(table).columns
        return sorted(names, key=lambda n: n in ("JSON", "JSONBlob")) if json_last else names

    # raw

    def stream(self, sql: str, args: Any = None, row_type: Any = None) -> Iterator[Any]:
        return Decoder(row_type).rows(self.sql(sql, args).toLocalIterator())

    def stream_mapped(self, sql: str, args: Any, make: Callable[[MultiMap], Any]) -> Iterator[Any]:
        return multi_map(self.sql(sql, args).toLocalIterator(), make)

    def execute_scalar(self, sql: str, args: Any = None) -> Any:
        row = self.run(lambda: self.sql(sql, args).first(), what="scalar")
        return None if row is None else row[0]

    def execute_reader(self, sql: str, args: Any = None) -> list[Any]:
        return self.run(lambda: self.sql(sql, args).collect(), what="reader")

    def execute_non_query(self, sql: str, args: Any = None) -> None:
        """Runs a statement; the rows of a query are computed where they are and go nowhere."""
        self.run(lambda: self.sql(sql, args).write.format("noop").mode("overwrite").save(), what="command")

    def call(self, procedure: str, **args: Any) -> Any:
        return self.store.procedures[procedure](self, **args)

    # keys

    def _check_key(self, m: DocumentMap, key: Any) -> None:
        fits = {"string": str, "int": int, "bigint": int, "smallint": int}.get(m.id_type.simpleString())
        if fits and (not isinstance(key, fits) or isinstance(key, bool)):
            raise TypeError(f"ids of {m.name} are {m.id_type.simpleString()}, not {type(key).__name__}")

    def load_df(self, wanted: Any, ids: Iterable[Any]) -> DataFrame:
        """Rows by id: distinct ids without nulls, joined; Spark broadcasts them by their size."""
        m, load = self._mapped(wanted)
        keys = list(dict.fromkeys(i for i in ids if i is not None))
        for k in keys:
            self._check_key(m, k)
        wanted_ids = self.spark.createDataFrame([(k,) for k in keys], f"`{m.id}` {m.id_type.simpleString()}")
        return load().join(wanted_ids, m.id, "left_semi")

    def missing_df(self, wanted: Any, ids: Iterable[Any]) -> DataFrame:
        m, load = self._mapped(wanted)
        keys = self.spark.createDataFrame([(k,) for k in dict.fromkeys(i for i in ids if i is not None)], f"`{m.id}` {m.id_type.simpleString()}")
        return keys.join(load(), m.id, "left_anti")

    def _decoded(self, wanted: Any, rows: Iterable[Any]) -> Iterator[Any]:
        m = self.store.maps.of(wanted)
        return Decoder(wanted if isinstance(wanted, type) else m.document, m).rows(rows)

    def load(self, wanted: Any, key: Any) -> Any:
        m, load = self._mapped(wanted)
        self._check_key(m, key)
        rows = self.run(lambda: load().filter(F.col(f"`{m.id}`") == F.lit(key)).limit(1).collect(), what="load")
        return next(self._decoded(wanted, rows), None)

    def load_required(self, wanted: Any, key: Any) -> Any:
        found = self.load(wanted, key)
        if found is None:
            raise ResourceNotFoundError(f"{self.store.maps.of(wanted).name} {key} doesn't exist")
        return found

    def load_many(self, wanted: Any, ids: Iterable[Any]) -> list[Any]:
        ids = list(ids)
        if not any(i is not None for i in ids):
            return []
        return list(self._decoded(wanted, self.run(lambda: self.load_df(wanted, ids).collect(), what="load")))

    def load_many_required(self, wanted: Any, ids: Iterable[Any]) -> list[Any]:
        ids = list(dict.fromkeys(ids))
        gone = {r[0] for r in self.run(lambda: self.missing_df(wanted, ids).collect(), what="load")} if ids else set()
        if gone:
            raise ResourceNotFoundError(f"{self.store.maps.of(wanted).name} {next(i for i in ids if i in gone)} doesn't exist")
        return self.load_many(wanted, ids)

    def load_stream(self, wanted: Any, ids: Iterable[Any]) -> Iterator[Any]:
        return self._decoded(wanted, self.load_df(wanted, ids).toLocalIterator())

    async def run_async(self, method: str, *args: Any, **named: Any) -> Any:
        """Any method by name in a worker thread: ``await txn.run_async("load", Order, 1)``."""
        return await asyncio.to_thread(getattr(self, method), *args, **named)

"""Rows as documents, tuples, single values or dataclasses."""

from __future__ import annotations

import dataclasses
import json
import typing
from collections.abc import Callable, Iterable, Iterator
from enum import Enum
from typing import Any

from pyspark.sql import Row

from ..mapping import Direction, DocumentMap, JsonFormat

_PLAIN = (int, float, str, bool, bytes, bytearray)
HIDDEN = object()


class ReaderError(ValueError):
    """A row that can't become what was asked for, with its number."""


def _enum(kind: type[Enum], value: Any) -> Any:
    if value is None or isinstance(value, kind):
        return value
    if isinstance(value, str) and not value.lstrip("-").isdigit():
        return next(e for e in kind if e.name.lower() == value.lower())
    return kind(int(value))


class Decoder:
    """row_type: None (Row), tuple, dict, a plain type, an Enum, a dataclass or any class with settable members; or the document of map."""

    def __init__(self, row_type: Any = None, map_: DocumentMap | None = None, wanted: type | None = None):
        self.type, self.map, self.wanted = row_type, map_, wanted

    def rows(self, rows: Iterable[Row]) -> Iterator[Any]:
        for i, row in enumerate(rows):
            try:
                made = self.one(row)
            except ReaderError:
                raise
            except Exception as error:
                raise ReaderError(f"row {i}: {error}") from error
            if made is not HIDDEN:
                yield made

    def one(self, row: Row) -> Any:
        kind = self.type
        if kind is None:
            return row
        if self.map is not None and (kind is self.map.document or kind in self.map.types.values()):
            return self.document(row, kind)
        if kind is tuple:
            return tuple(row)
        if kind is dict:
            return row.asDict(recursive=True)
        if isinstance(kind, type) and issubclass(kind, Enum):
            return _enum(kind, self._single(row))
        if kind in _PLAIN:
            value = self._single(row)
            return value if value is None else kind(value)
        return self._members(kind, row.asDict())

    @staticmethod
    def _single(row: Row) -> Any:
        if len(row) != 1:
            raise ReaderError(f"one column is needed, the row has {len(row)}")
        return row[0]

    @staticmethod
    def _members(kind: type, values: dict[str, Any]) -> Any:
        if dataclasses.is_dataclass(kind):
            names = {f.name.lower(): f for f in dataclasses.fields(kind)}
            unknown = [k for k in values if k.lower() not in names]
            if unknown:
                raise ReaderError(f"{kind.__name__} has no member {unknown[0]}")
            return kind(**{names[k.lower()].name: _typed(names[k.lower()].type, v) for k, v in values.items()})
        made = kind()
        for k, v in values.items():
            name = next((n for n in dir(made) if n.lower() == k.lower() and not n.startswith("_")), None)
            if name is None:
                raise ReaderError(f"{kind.__name__} has no member {k}")
            setattr(made, name, v)
        return made

    def document(self, row: Row, wanted: type) -> Any:
        """JSON first, then columns over it; the class by the type column. Rows of hidden or other classes are left out."""
        m = self.map
        values = {k.lower(): v for k, v in row.asDict().items()}
        if m.id.lower() not in values:
            raise ReaderError(f"the id column {m.id} is missing")
        kind = m.document
        if m.type_column:
            value = values.get(m.type_column.lower())
            if value is not None:
                if value not in m.types:
                    raise ReaderError(f"{m.name} has no type {value}")
                kind = m.types[value]
        if kind is None or not issubclass(kind, wanted):
            return HIDDEN
        members = json.loads(self._json(values) or "{}")
        members[m.id] = values[m.id.lower()]
        for c in m.columns:
            if c.direction is not Direction.SAVE_ONLY and c.name.lower() in values:
                value = values[c.name.lower()]
                members[c.of] = c.handler.decode(value) if c.handler else value
        if m.row_version and m.row_version.lower() in values:
            members[m.row_version] = values[m.row_version.lower()]
        if not dataclasses.is_dataclass(kind):
            return self._members(kind, members)
        names = {f.name.lower(): f for f in dataclasses.fields(kind)}
        return kind(**{names[k.lower()].name: _typed(names[k.lower()].type, v) for k, v in members.items() if k.lower() in names})

    def _json(self, values: dict[str, Any]) -> str | None:
        from gzip import decompress

        text, blob, f = values.get("json"), values.get("jsonblob"), self.map.json_format
        if f is JsonFormat.NO_JSON:
            return None
        if f.has_text and "json" not in values or f.has_blob and "jsonblob" not in values:
            raise ReaderError(f"{self.map.name} needs its JSON columns")
        unpacked = decompress(bytes(blob)).decode("utf-16-le") if blob is not None else None
        first, second = (text, unpacked) if f in (JsonFormat.TEXT_ONLY, JsonFormat.MIXED_PREFER_TEXT) else (unpacked, text)
        return first if first is not None else second


def _typed(kind: Any, value: Any) -> Any:
    """Enums of a member's type, also of an optional one."""
    found = next((k for k in (kind, *typing.get_args(kind)) if isinstance(k, type) and issubclass(k, Enum)), None)
    return value if found is None else _enum(found, value)


class MultiMap:
    """Several objects from one row, by prefix: ``m.map(Line, "line")`` takes the columns line_..., "" all."""

    def __init__(self, row: Row):
        self._values = row.asDict()

    def map(self, kind: Any, prefix: str = "") -> Any:
        head = f"{prefix}_".lower() if prefix else ""
        found = {k[len(head) :]: v for k, v in self._values.items() if k.lower().startswith(head)}
        if not found:
            raise ReaderError(f"no column begins with {prefix}_")
        return Decoder(kind).one(Row(**found))


def multi_map(rows: Iterable[Row], make: Callable[[MultiMap], Any]) -> Iterator[Any]:
    return (make(MultiMap(row)) for row in rows)

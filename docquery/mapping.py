"""Document maps: which members of a document are columns, and how the rest is stored as JSON."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from enum import Enum
from typing import Any

from pyspark.sql import types as T


class GuidType(T.StringType):
    """Ids that are made as GUIDs; kept as text."""

    @classmethod
    def typeName(cls) -> str:
        return "string"


class JsonFormat(Enum):
    TEXT_ONLY = 0
    COMPRESSED_ONLY = 1
    MIXED_PREFER_COMPRESSED = 2
    MIXED_PREFER_TEXT = 3
    NO_JSON = 4

    @property
    def has_text(self) -> bool:
        return self in (JsonFormat.TEXT_ONLY, JsonFormat.MIXED_PREFER_COMPRESSED, JsonFormat.MIXED_PREFER_TEXT)

    @property
    def has_blob(self) -> bool:
        return self in (JsonFormat.COMPRESSED_ONLY, JsonFormat.MIXED_PREFER_COMPRESSED, JsonFormat.MIXED_PREFER_TEXT)


class Direction(Enum):
    BOTH = "both"
    SAVE_ONLY = "save"
    LOAD_ONLY = "load"


class MappingError(ValueError):
    """A map that can't work, or a document without a single map."""


@dataclass(frozen=True)
class Column:
    """A member that is a column. Texts named ...Id have at most 50 characters unless told otherwise."""

    name: str
    type: T.DataType = field(default_factory=T.StringType)
    member: str | None = None
    direction: Direction = Direction.BOTH
    max_length: int | None = None
    handler: Any = None

    @property
    def of(self) -> str:
        return self.member or self.name

    @property
    def limit(self) -> int | None:
        if self.max_length is None and isinstance(self.type, T.StringType) and self.name.lower().endswith("id"):
            return 50
        return self.max_length


@dataclass(frozen=True)
class UniqueRule:
    name: str
    columns: tuple[str, ...]
    message: str


@dataclass(frozen=True)
class RelatedDocuments:
    """documents(doc) gives (id, table) pairs, kept as edges in ``table``; pairs is the same for rows in bulk, SQL text of an array of structs (id, type)."""

    table: str
    documents: Callable[[Any], list[tuple[Any, str]]]
    pairs: str | None = None


EDGE_SCHEMA = "Id string, `Table` string, RelatedDocumentId string, RelatedDocumentTable string"


@dataclass(frozen=True)
class DocumentMap:
    """One class hierarchy and its table.

    types maps values of the type column to classes; None as a class hides rows of that value. json lists the
    types of members in the JSON rest, by path ("a.b"). key_prefix makes ids of texts.
    """

    name: str
    columns: tuple[Column, ...] = ()
    id: str = "Id"
    id_type: T.DataType = field(default_factory=T.StringType)
    table: str | None = None
    schema: str | None = None
    json_format: JsonFormat = JsonFormat.TEXT_ONLY
    json: dict[str, str] = field(default_factory=dict)
    document: type | None = None
    type_column: str | None = None
    types: dict[Any, type | None] = field(default_factory=dict)
    unique: tuple[UniqueRule, ...] = ()
    related: tuple[RelatedDocuments, ...] = ()
    row_version: str | None = None
    identity: bool = False
    key_prefix: str | None = None

    def __post_init__(self) -> None:
        if not self.id:
            raise MappingError(f"{self.name} has no id")
        if self.type_column and self.json_format is JsonFormat.NO_JSON:
            raise MappingError(f"{self.name}: a type column needs JSON")
        names = [n.lower() for n in self.stored_columns()]
        if len(names) != len(set(names)):
            raise MappingError(f"{self.name} names a column twice")

    @property
    def table_name(self) -> str:
        base = self.table or self.name
        return f"{self.schema}.{base}" if self.schema else base

    def column(self, member: str) -> Column | None:
        return next((c for c in self.columns if c.of.lower() == member.lower() or c.name.lower() == member.lower()), None)

    def stored_columns(self) -> list[str]:
        """Columns in their order; what holds JSON comes last."""
        names = [self.id, *(c.name for c in self.columns)]
        names += [n for n in (self.type_column, self.row_version) if n and n not in names]
        return names + ["JSON"] * self.json_format.has_text + ["JSONBlob"] * self.json_format.has_blob

    def stored_schema(self) -> T.StructType:
        of = {self.id: T.StringType() if isinstance(self.id_type, GuidType) else self.id_type} | {c.name: c.type for c in self.columns} | {"JSON": T.StringType(), "JSONBlob": T.BinaryType()}
        if self.type_column:
            of.setdefault(self.type_column, T.StringType())
        if self.row_version:
            of[self.row_version] = T.LongType()
        return T.StructType([T.StructField(n, of[n], n != self.id or True) for n in self.stored_columns()])

    def with_table(self, table: str, schema: str | None = None) -> DocumentMap:
        return replace(self, table=table, schema=schema or self.schema)

    def type_values(self, wanted: type | None) -> list[Any] | None:
        """Values of the type column for a class and its subclasses; None: no filter."""
        if not self.type_column or wanted is None or wanted is self.document:
            return None
        return [v for v, c in self.types.items() if c is not None and issubclass(c, wanted)]


class MapRegistry:
    """Maps by class; a class without its own map uses that of a base class."""

    def __init__(self, *maps: DocumentMap):
        self._maps: list[DocumentMap] = []
        self.register(*maps)

    def register(self, *maps: DocumentMap) -> None:
        for m in maps:
            if any(m.document is not None and o.document is m.document for o in self._maps):
                raise MappingError(f"{m.name} is mapped twice")
            self._maps.append(m)

    def of(self, wanted: type | str | DocumentMap) -> DocumentMap:
        if isinstance(wanted, DocumentMap):
            return wanted
        if isinstance(wanted, str):
            found = [m for m in self._maps if m.name == wanted]
        else:
            found = next(([m for m in self._maps if m.document is base] for base in wanted.__mro__ if any(m.document is base for m in self._maps)), [])
        if len(found) != 1:
            raise MappingError(f"{wanted!r} has {'no map' if not found else 'several maps'}")
        return found[0]

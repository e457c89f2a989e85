"""Ids of new documents: blocks of numbers a table, and handlers that make keys of them."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import types as T

from ..mapping import DocumentMap, GuidType

BLOCK = 20


class KeyAllocator:
    """Numbers from blocks that are reserved in a state table. Reserved numbers are never handed out again, even after a rollback."""

    def __init__(self, reserve: Callable[[str, int], int], block: int = BLOCK):
        self._reserve, self._block = reserve, block
        self._lock, self._ranges = threading.Lock(), {}

    def next(self, table: str) -> int:
        with self._lock:
            at, end = self._ranges.get(table, (0, 0))
            if at >= end:
                end = self._reserve(table, self._block)
                at = end - self._block
            self._ranges[table] = (at + 1, end)
            return at + 1

    def reset(self) -> None:
        with self._lock:
            self._ranges.clear()


def _text(m: DocumentMap, number: Callable[[], int]) -> str:
    return f"{m.key_prefix or (m.table or m.name) + 's'}-{number()}"


class KeyHandlers:
    """Makers of keys by the type of the id; types without their own use that of a base type."""

    def __init__(self):
        self._made: dict[type, Callable[[DocumentMap, Callable[[], int]], Any]] = {
            GuidType: guid_key,
            T.StringType: _text,
            T.IntegerType: lambda m, number: int(number()),
            T.LongType: lambda m, number: int(number()),
        }

    def register(self, id_type: type, make: Callable[[DocumentMap, Callable[[], int]], Any]) -> None:
        self._made[id_type] = make

    def make(self, m: DocumentMap, number: Callable[[], int]) -> Any:
        handler = next((self._made[b] for b in type(m.id_type).__mro__ if b in self._made), None)
        if handler is None:
            raise TypeError(f"no key handler for {m.id_type}")
        return handler(m, number)


def guid_key(m: DocumentMap, number: Callable[[], int]) -> str:
    return str(uuid.uuid4())

"""Named parameters of raw SQL text: @name, bound as literals, never put into the text."""

from __future__ import annotations

import dataclasses
import re
from collections.abc import Iterable, Mapping
from enum import Enum
from typing import Any

from .like import escape

#: A text literal, a bracketed name or a parameter.
PART = re.compile(r"'(?:[^']|'')*'|\[([^\]\[]+)\]|@([A-Za-z_][\w-]*)")


class MissingParameterError(ValueError):
    """Text names a parameter that has no value."""


def normalise(name: str) -> str:
    return re.sub(r"[-\s]", "_", name).lstrip("@").lower()


def plain(value: Any) -> Any:
    """Enums are their names."""
    return value.name if isinstance(value, Enum) else value


def is_many(value: Any) -> bool:
    return isinstance(value, Iterable) and not isinstance(value, (str, bytes, bytearray, Mapping))


class Parameters(dict):
    """Values by normalised name. Adding a name twice is an error."""

    def __init__(self, values: Mapping[str, Any] | Any = None, **more: Any):
        super().__init__()
        if values is not None:
            if dataclasses.is_dataclass(values):
                values = {f.name: getattr(values, f.name) for f in dataclasses.fields(values)}
            elif not isinstance(values, Mapping):
                values = vars(values)
            self.add_all(values)
        self.add_all(more)

    def add(self, name: str, value: Any) -> Parameters:
        name = normalise(name)
        if name in self:
            raise ValueError(f"parameter {name} is given twice")
        self[name] = value
        return self

    def add_all(self, values: Mapping[str, Any]) -> Parameters:
        for name, value in values.items():
            self.add(name, value)
        return self


def unique_name(name: str, taken: Iterable[str]) -> str:
    """name, name_1, name_2, ...: the first that isn't taken."""
    name, taken = normalise(name), set(taken)
    return name if name not in taken else next(f"{name}_{i}" for i in range(1, len(taken) + 2) if f"{name}_{i}" not in taken)


def like_value(text: str) -> str:
    return f"%{escape(text)}%"


def like_piped_value(text: str) -> str:
    return f"%|{escape(text)}|%"


def bind(text: str, values: Mapping[str, Any], marker: str) -> tuple[str, dict[str, Any]]:
    """Text with @p as marker + p and [c] as a quoted name, and the values that it names.

    A collection becomes a list in brackets, an empty one a null. What isn't a parameter, a bracketed name or a text literal
    stays as it is: the rest of the text must be Spark SQL.
    """
    known, used = {normalise(k): v for k, v in values.items()}, {}

    def put(m: re.Match) -> str:
        if m[1]:
            return f"`{m[1]}`"
        if not m[2]:
            return m[0]
        name = normalise(m[2])
        if name not in known:
            raise MissingParameterError(f"@{m[2]} has no value")
        value = plain(known[name])
        if not is_many(value):
            used[name] = value
            return marker + name
        many = [plain(v) for v in value] or [None]
        used.update({f"{name}_{i}": v for i, v in enumerate(many, 1)})
        return "(" + ", ".join(f"{marker}{name}_{i}" for i in range(1, len(many) + 1)) + ")"

    return PART.sub(put, text), used

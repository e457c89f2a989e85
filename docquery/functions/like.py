"""LIKE with character classes, as a regular expression."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def escape(text: str) -> str:
    """Makes a text match itself inside a LIKE pattern."""
    return re.sub(r"([\[%_])", r"[\1]", text)


def to_regex(pattern: str) -> str:
    """% is any text, _ a character, [a-f] and [^a-f] classes; a class of one wildcard is that character."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        end = pattern.find("]", i + 2) if c == "[" else -1
        if c == "%":
            out.append(".*")
        elif c == "_":
            out.append(".")
        elif end > 0:
            body = pattern[i + 1 : end]
            negated = body.startswith("^") and len(body) > 1
            body = re.sub(r"([\\\[\]&~^])", r"\\\1", body[negated:])
            out.append(f"[{'^' * negated}{body}]")
            i = end
        else:
            out.append(re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", c))
        i += 1
    return "(?s)^" + "".join(out) + r"\z"


def like(column: Column, pattern: str) -> Column:
    """Plain prefixes, suffixes and infixes become string tests that a scan can push down."""
    pattern = re.sub("%%+", "%", pattern) if "[" not in pattern else pattern
    core = pattern.strip("%")
    if core and not re.search(r"[%_\[]", core):
        if pattern == core:
            return column == core
        if pattern == core + "%":
            return column.startswith(core)
        if pattern == "%" + core:
            return column.endswith(core)
        return F.contains(column, F.lit(core))
    return column.rlike(to_regex(pattern))

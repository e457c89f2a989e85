"""Members of the JSON rest of a document, and its compressed form."""

from __future__ import annotations

import gzip

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..mapping import DocumentMap, JsonFormat


def json_text(m: DocumentMap, qualify=F.col) -> Column:
    """The JSON text of a row, whatever holds it."""
    if m.json_format is JsonFormat.COMPRESSED_ONLY:
        return decompress(qualify("JSONBlob"))
    if m.json_format is JsonFormat.MIXED_PREFER_COMPRESSED:
        return F.coalesce(decompress(qualify("JSONBlob")), qualify("JSON"))
    if m.json_format is JsonFormat.MIXED_PREFER_TEXT:
        return F.coalesce(qualify("JSON"), decompress(qualify("JSONBlob")))
    return qualify("JSON")


def member(text: Column, path: str, sql_type: str | None) -> Column:
    """A member as its type; null where it is absent or no such value."""
    found = F.get_json_object(text, "$." + path)
    if sql_type is None or sql_type == "string":
        return found
    if sql_type.startswith(("array", "struct", "map")):
        return F.from_json(found, sql_type)
    return found.try_cast(sql_type)


def array_has(text: Column, path: str, sql_type: str, value) -> Column:
    """Whether a JSON array holds the value; false where there is no array, as for IN over no rows."""
    return F.coalesce(F.array_contains(F.from_json(F.get_json_object(text, "$." + path), f"array<{sql_type}>"), F.lit(value)), F.lit(False))


@F.pandas_udf(T.StringType())
def decompress(blobs: pd.Series) -> pd.Series:
    return blobs.map(lambda b: None if b is None else gzip.decompress(bytes(b)).decode("utf-16-le"))


@F.pandas_udf(T.BinaryType())
def compress(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else gzip.compress(t.encode("utf-16-le"), mtime=0))

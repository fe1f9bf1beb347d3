"""Schemas written as plain text, without a session at hand."""

from __future__ import annotations

from pyspark.sql import types as T

_KINDS = {
    "string": T.StringType(), "binary": T.BinaryType(), "bigint": T.LongType(), "int": T.IntegerType(), "boolean": T.BooleanType(),
}


def _kind(name: str) -> T.DataType:
    return T.ArrayType(_kind(name[6:-1])) if name.startswith("array<") else _KINDS[name]


def columns(text: str) -> T.StructType:
    """The schema of `name kind, name kind`; kinds are plain ones and arrays of them."""
    pairs = [field.split() for field in text.split(",")]
    return T.StructType([T.StructField(name, _kind(kind)) for name, kind in pairs])

"""Spark types from their short notation, without a session."""

from __future__ import annotations

from pyspark.sql import types as T

_PLAIN = {"string": T.StringType, "bigint": T.LongType, "int": T.IntegerType, "double": T.DoubleType, "float": T.FloatType, "boolean": T.BooleanType, "binary": T.BinaryType, "timestamp": T.TimestampType}


def _parts(text: str) -> list[str]:
    """At commas outside angle brackets."""
    out, depth, start = [], 0, 0
    for i, c in enumerate(text):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(text[start:i].strip())
            start = i + 1
    return [*out, text[start:].strip()]


def _fields(text: str) -> T.StructType:
    pairs = [part.replace(":", " ", 1).split(None, 1) for part in _parts(text)]
    return T.StructType([T.StructField(name, data_type(kind)) for name, kind in pairs])


def data_type(text: str) -> T.DataType:
    text = text.strip()
    head, _, rest = text.partition("<")
    if not rest:
        return _PLAIN[head]()
    inside = rest[: rest.rindex(">")]
    if head == "array":
        return T.ArrayType(data_type(inside))
    if head == "map":
        return T.MapType(*map(data_type, _parts(inside)))
    return _fields(inside)


def schema(text: str) -> T.StructType:
    """``name type, name type``, with array<>, map<> and struct<name: type> inside."""
    return _fields(text)

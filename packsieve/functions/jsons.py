"""JSON pointers, source operations and duplicate keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def path(pointer: str) -> str:
    """An RFC 6901 pointer as the path that Spark's functions take."""
    if pointer and not pointer.startswith("/"):
        raise ValueError(f"not a pointer: {pointer!r}")
    out = "$"
    for token in pointer.split("/")[1:]:
        token = token.replace("~1", "/").replace("~0", "~")
        out += f"[{token}]" if token.isdigit() else f"['{token}']"
    return out


def pointer(x: Column, where: str) -> Column:
    """F16: what the pointer leads to, as text; null where nothing is there."""
    return F.get_json_object(x, path(where))


def length(x: Column, where: str) -> Column:
    """the number of elements of an array at the pointer."""
    return F.json_array_length(pointer(x, where)).cast("long")


def total(x: Column, where: str) -> Column:
    """the sum of an array of numbers at the pointer."""
    return F.aggregate(F.from_json(pointer(x, where), "array<double>"), F.lit(0.0), lambda a, v: a + v)


def digest(x: Column) -> Column:
    """SHA-256 of a text's UTF-8."""
    return F.sha2(x.cast("binary"), 256)


def repeats_a_key(x: Column) -> Column:
    """JSON in which an object has a key twice: the strict reader refuses what the lenient one reads."""
    return F.try_parse_json(x).isNull() & F.get_json_object(x, "$").isNotNull()

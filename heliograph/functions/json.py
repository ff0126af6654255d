"""Strict JSON parsing into variants.

Spark's JSON functions stop at the end of the first value and accept whatever follows it. Parsing
the text as the first element of an array, with a marker as the second, rejects that: the marker is
in its place only if the text is exactly one JSON value.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_MARKER = "end of value"


def parse_strict(c: Column) -> Column:
    """A variant array [value, marker]; null where even the array does not parse."""
    return F.try_parse_json(F.concat(F.lit("["), c, F.lit(f',"{_MARKER}"]')))


def parsed_ok(parsed: Column) -> Column:
    """Whether `parse_strict` saw exactly one value; never null."""
    return F.coalesce(F.try_variant_get(parsed, "$[1]", "string") == _MARKER, F.lit(False))


def is_json(c: Column) -> Column:
    """Whether the text is one JSON value; never null."""
    return parsed_ok(parse_strict(c))


def parsed_field(parsed: Column, name: str) -> Column:
    """A field of a parsed object as text; null when absent."""
    return F.try_variant_get(parsed, f"$[0].{name}", "string")


def parsed_is_null(parsed: Column) -> Column:
    """Whether the value is the JSON null."""
    return F.coalesce(F.is_variant_null(F.try_variant_get(parsed, "$[0]", "variant")), F.lit(False))

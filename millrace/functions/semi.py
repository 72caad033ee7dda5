"""Semi-structured values: parsing JSON text, reading paths with casts, flattening arrays to rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parse(text: Column, strict: bool = True) -> Column:
    """JSON text as a variant; unless ``strict``, text that is no JSON is null."""
    return F.parse_json(text) if strict else F.try_parse_json(text)


def at(value: Column, path: str, kind: str = "string") -> Column:
    """What a dotted path leads to, as ``kind``: ``at(v, "a.b", "int")`` is ``v:a.b::int``. Null where the path ends early or
    the value does not fit."""
    return F.try_variant_get(value, "$." + path, kind)


def flatten(df: DataFrame, value: Column, path: str, name: str = "value", outer: bool = False) -> DataFrame:
    """A row for each element of the array at ``path``, with the element as variant column ``name``; ``outer`` keeps rows
    without elements."""
    items = F.try_variant_get(value, "$." + path, "array<variant>")
    return df.select("*", (F.explode_outer if outer else F.explode)(items).alias(name))

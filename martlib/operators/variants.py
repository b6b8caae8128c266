"""JSON texts whose fields come, go and change their types: parsed once to VARIANT, with the fields and their types an aggregate.

What a batch holds is known after one pass (`field_types`), columns are taken from the parsed value (`take_fields`), and the types of
several batches are merged by their few schemas (`merge_types`), without reading the texts again.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from martlib.functions import columns as C


def parse_object(value: str | Column = "value") -> Column:
    """A JSON object as VARIANT. Null for all else: malformed texts, lists and scalars, objects that have a key twice, nulls."""
    return F.when(C.col(value).rlike(r"^\s*\{"), F.try_parse_json(C.col(value)))


def field_types(parsed: str | Column) -> Column:
    """Aggregate: the type of all these objects together, as text for `as_fields`. Its state holds the names of fields, nested ones
    too, so it grows with them and not with the rows."""
    return F.schema_of_variant_agg(C.col(parsed))


def as_fields(types: str | None, most: int = 1000) -> T.StructType:
    """The fields of a type's text by name; none if there was no object. An error if there are more than `most`."""
    if types is None or not types.startswith("OBJECT<"):
        return T.StructType()
    # OBJECT is a keyword only outside of quoted names
    ddl = "".join(part if part.startswith("`") else part.replace("OBJECT<", "STRUCT<") for part in re.split(r"(`(?:[^`]|``)*`)", types))
    fields = T.DataType.fromDDL(ddl)
    if len(fields) > most:
        raise ValueError(f"more than {most} fields: the source sends keys that are values")
    return fields


def merge_types(a: T.DataType, b: T.DataType) -> T.DataType:
    """The type that holds both: nulls fit all, numbers widen, structs and lists merge by their parts; VARIANT where nothing else does."""
    if a == b or isinstance(b, T.NullType):
        return a
    if isinstance(a, T.NullType):
        return b
    if isinstance(a, T.StructType) and isinstance(b, T.StructType):
        kinds = lambda s: {f.name: f.dataType for f in s.fields}
        left, right = kinds(a), kinds(b)
        return T.StructType([T.StructField(n, merge_types(left.get(n, T.NullType()), right.get(n, T.NullType()))) for n in sorted(left | right)])
    if isinstance(a, T.ArrayType) and isinstance(b, T.ArrayType):
        return T.ArrayType(merge_types(a.elementType, b.elementType))
    exact = [T.DecimalType(19, 0) if isinstance(t, T.LongType) else t for t in (a, b)]
    if all(isinstance(t, T.DecimalType) for t in exact):
        scale = max(t.scale for t in exact)
        digits = max(t.precision - t.scale for t in exact) + scale
        return T.DecimalType(digits, scale) if digits <= 38 else T.DoubleType()
    if all(isinstance(t, (T.DecimalType, T.DoubleType)) for t in exact):
        return T.DoubleType()
    return T.VariantType()


def merge_fields(schemas: Iterable[T.StructType]) -> T.StructType:
    return reduce(merge_types, schemas, T.StructType())


def column_names(fields: Iterable[str], taken: Iterable[str]) -> dict[str, list[str]]:
    """Column -> the fields that it holds. Columns are found whatever their case, so spellings of one name share a column;
    a field that would take the place of another column gets `_field` after its name."""
    used, out = {t.lower() for t in taken}, {}
    for name in sorted(fields):
        column = name
        while not column or column.lower() in used:
            column += "_field"
        same = next((c for c in out if c.lower() == column.lower()), column)
        out.setdefault(same, []).append(name)
    return out


def field(parsed: str | Column, name: str, kind: str = "string") -> Column:
    """A top-level field of a parsed object; null if it is not there or not of that kind. Objects and lists as string: their JSON."""
    for quote in ("'", '"'):
        if quote not in name:
            return F.try_variant_get(C.col(parsed), f"$[{quote}{name}{quote}]", kind)
    whole = F.try_variant_get(C.col(parsed), "$", "map<string,variant>")  # a path cannot hold both quotes
    return F.try_variant_get(F.element_at(whole, F.lit(name)), "$", kind)


def take_fields(parsed: str | Column, columns: dict[str, list[str]]) -> list[Column]:
    """Fields as text columns: a text column holds whatever type a later batch sends. Of several spellings the first with a value."""
    return [F.coalesce(*[field(parsed, n) for n in names]).alias(c) for c, names in columns.items()]


def typed(df: DataFrame, fields: T.StructType) -> DataFrame:
    """Text columns of these names in their types. Structs and lists are parsed from their JSON; what is of no single type, or was
    null everywhere, stays text; so does a column that is not in fields."""

    def cast(f: T.StructField) -> Column:
        text = C.col(f"`{f.name.replace('`', '``')}`")
        if isinstance(f.dataType, (T.StructType, T.ArrayType)):
            return F.try_parse_json(text).try_cast(f.dataType)
        return text if isinstance(f.dataType, (T.VariantType, T.NullType, T.StringType)) else text.try_cast(f.dataType)

    have = {c.lower() for c in df.columns}
    return df.withColumns({f.name: cast(f) for f in fields.fields if f.name.lower() in have})

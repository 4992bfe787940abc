"""Payloads of any type as JSON that every reader takes: a walk over the schema gives one expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def envelope(raw: Column) -> Column:
    """Bytes as a struct that marks itself as base64."""
    text = F.regexp_replace(F.base64(raw), "[\r\n]", "")
    return F.when(raw.isNotNull(), F.struct(F.lit(True).alias("__bytes__"), F.lit("base64").alias("encoding"), text.alias("value")))


def json_safe(value: Column, kind: T.DataType, sets: tuple[str, ...] = (), path: str = "") -> Column:
    """A value whose JSON text is valid and says all: NaN and infinities are null, bytes an envelope, keys of maps text, and what
    JSON has no form for (times, decimals, intervals) text.  Arrays at the dotted paths ``sets`` (items of arrays and maps have none
    of their own) count as sets: each item once, sorted, nulls last."""
    below = lambda name: f"{path}.{name}" if path else name
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)
    if isinstance(kind, T.BinaryType):
        return envelope(value)
    if isinstance(kind, T.StructType):
        return F.when(value.isNotNull(), F.struct(*[json_safe(value[f.name], f.dataType, sets, below(f.name)).alias(f.name) for f in kind.fields]))
    if isinstance(kind, T.ArrayType):
        items = F.transform(value, lambda x: json_safe(x, kind.elementType, sets, path))
        return F.array_sort(F.array_distinct(items)) if path in sets else items
    if isinstance(kind, T.MapType):
        named = F.transform_keys(value, lambda k, _: k.cast("string"))
        return F.transform_values(named, lambda _, v: json_safe(v, kind.valueType, sets, path))
    if isinstance(kind, (T.StringType, T.BooleanType, T.IntegralType, T.NullType, T.VariantType)):
        return value
    return value.cast("string")


def payload_json(value: Column, kind: T.DataType, sets: tuple[str, ...] = ()) -> Column:
    """A payload's JSON text with all its fields, nulls too; a null payload has none."""
    text = F.to_json(F.array(json_safe(value, kind, sets)), {"ignoreNullFields": "false"})
    return F.when(value.isNotNull(), F.substring(text, F.lit(2), F.length(text) - 2))

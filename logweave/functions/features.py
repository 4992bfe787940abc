"""Features as columns: sources (paths, constants, metadata, concatenations, stacks), checks, and presence flags."""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logweave.functions.transforms import Transform, chain


def json_paths(path: str) -> list[str]:
    """``a.b.0.c`` as JSON paths: a whole number is the place in an array or, where there is none, the key of a struct."""
    forms = [(f"[{p}]", f"['{p}']") if p.isdigit() else (f".{p}",) for p in path.split(".")]
    return ["$" + "".join(x) for x in product(*forms)]


def path(payload: str, dotted: str, kind: str, present: Column | None = None) -> Column:
    """A value inside a JSON payload column; null where the path, the type or the message is missing."""
    value = F.coalesce(*[F.try_variant_get(F.try_parse_json(payload), p, kind) for p in json_paths(dotted)])
    return value if present is None else F.when(present == 1, value)


def constant(value) -> Column:
    """The same value in every row."""
    return F.array(*[F.lit(v) for v in value]) if isinstance(value, (list, tuple)) else F.lit(value)


def present_topics(presence: dict[str, str]) -> Column:
    """Sorted names of the topics whose presence column is 1."""
    return F.array_sort(F.filter(F.array(*[F.when(F.col(c) == 1, F.lit(t)) for t, c in presence.items()]), lambda x: x.isNotNull()))


def concat(*columns: Column, axis: int = 0) -> Column:
    """Strings, bytes or arrays joined; along axis 1 row by row, null when the rows don't fit."""
    if axis == 0:
        return F.concat(*columns)
    out = columns[0]
    for c in columns[1:]:
        out = F.when(F.size(out) == F.size(c), F.zip_with(out, c, lambda a, b: F.concat(a, b)))
    return out


def stack(*columns: Column, axis: int = 0, arrays: bool = True) -> Column:
    """Values side by side in a new axis; arrays of unequal sizes are null."""
    ok = F.lit(True)
    for c in columns[1:] if arrays else ():
        ok = ok & (F.size(c) == F.size(columns[0]))
    for c in columns:
        ok = ok & c.isNotNull()
    if axis == 0:
        return F.when(ok, F.array(*columns))
    return F.when(ok, F.transform(columns[0], lambda _, i: F.array(*[F.get(c, i) for c in columns])))


def has_shape(value: Column, shape: list[int]) -> Column:
    """Whether nested arrays have these sizes; -1 ends the check, an empty shape checks nothing."""
    if not shape or shape[0] == -1:
        return F.lit(True)
    ok = F.size(value) == shape[0]
    return ok & F.forall(value, lambda v: has_shape(v, shape[1:])) if len(shape) > 1 and shape[1] != -1 else ok


def has_dtype(variant: Column, dtype: str) -> Column:
    """Whether a variant scalar is of a feature type: booleans are no numbers, whole numbers pass as floats, ``1.0`` is no whole number."""
    kind = F.schema_of_variant(variant)
    whole, number = kind.rlike(r"^(BIGINT|INT|SMALLINT|TINYINT|DECIMAL\((19|[23]\d),0\))$"), kind.rlike(r"^(BIGINT|INT|SMALLINT|TINYINT|DECIMAL|FLOAT|DOUBLE)")
    return {"int64": whole, "float32": number, "float64": number, "bool": kind == "BOOLEAN", "bytes": kind == "BINARY", "json": F.lit(True)}[dtype]


def as_bytes(numbers: Column) -> Column:
    """An array of numbers from 0 to 255 as bytes; null when one is outside."""
    ok = F.forall(numbers, lambda v: v.between(0, 255))
    return F.when(ok, F.unhex(F.array_join(F.transform(numbers, lambda v: F.lpad(F.hex(v.cast("bigint")), 2, "0")), "")))


def bytes_coerced(value: Column, kind: T.DataType) -> tuple[Column, T.DataType]:
    """Whole numbers or truth values from 0 to 255 as bytes, an empty list as none; lists that hold anything else are null; other values stay."""
    if not (isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.IntegralType, T.BooleanType))):
        return value, kind
    numbers = F.transform(value, lambda v: v.cast("bigint"))
    return F.when(F.forall(numbers, lambda v: v.isNotNull() & v.between(0, 255)), as_bytes(numbers)), T.BinaryType()


def fits_dtype(value: Column, kind: T.DataType, dtype: str) -> Column:
    """Whether a value of a column type (each item of a list) is of a feature type; a variant is judged value by value."""
    if dtype == "json":
        return F.lit(True)
    if isinstance(kind, T.VariantType):
        return F.coalesce(has_dtype(value, dtype), F.lit(False))
    if isinstance(kind, T.ArrayType):
        return F.coalesce(F.forall(value, lambda v: v.isNotNull() & fits_dtype(v, kind.elementType, dtype)), F.lit(False))
    number = (T.IntegralType, T.FloatType, T.DoubleType)
    return F.lit(isinstance(kind, {"int64": T.IntegralType, "float32": number, "float64": number, "bool": T.BooleanType, "bytes": T.BinaryType}[dtype]))


@dataclass
class Feature:
    """A named feature: its source column, transforms, shape, type (None: any), and whether rows need it (``missing``: null or zeros)."""

    name: str
    source: Column
    transforms: list[Transform] = field(default_factory=list)
    shape: list[int] | None = None
    required: bool = False
    missing: str = "null"
    dtype: str | None = None


#: Steps of a build, in their order; a failure is named after the first that fails.
STEPS = ("source", "transform", "shape", "dtype")


def build(rows: DataFrame, features: list[Feature], *keep: str, failures: bool = False) -> DataFrame:
    """The kept columns, each feature, ``<feature>__present``, and with ``failures`` the step that failed in ``<feature>__failure``.

    Steps: source, transforms, shape, bytes coercion (of features of type bytes) and type check; whatever fails leaves the feature
    null and absent.
    """
    out = rows.select(*keep, *[f.source.alias(f"_{i}s") for i, f in enumerate(features)])
    out = out.select(*keep, *[c for i, f in enumerate(features) for c in (F.col(f"_{i}s").isNotNull().alias(f"_{i}g"), chain(*f.transforms)(F.col(f"_{i}s")).alias(f"_{i}t"))])
    columns = []
    for i, f in enumerate(features):
        value, kind = F.col(f"_{i}t"), out.schema[f"_{i}t"].dataType
        shaped = F.coalesce(has_shape(value, f.shape), F.lit(False)) if f.shape else F.lit(True)
        made, kind = bytes_coerced(value, kind) if f.dtype == "bytes" else (value, kind)
        typed = made.isNotNull() & fits_dtype(made, kind, f.dtype) if f.dtype else F.lit(True)
        held = F.struct(F.when(value.isNotNull() & shaped & typed, made).alias("value"), F.when(~F.col(f"_{i}g"), STEPS[0]).when(value.isNull(), STEPS[1]).when(~shaped, STEPS[2]).when(~typed, STEPS[3]).alias("failure"))
        columns.append(held.alias(f"_{i}"))
    out = out.select(*keep, *columns)
    ends = [c for i, f in enumerate(features) for c in (F.col(f"_{i}.value").alias(f.name), F.col(f"_{i}.failure").isNull().cast("int").alias(f"{f.name}__present"), *([F.col(f"_{i}.failure").alias(f"{f.name}__failure")] if failures else []))]
    return out.select(*keep, *ends)


def failure_counts(built: DataFrame, features: list[Feature], *keys: str) -> DataFrame:
    """``feature, step, n`` (for each of ``keys``): how many rows fail in which step; needs the failures of ``build``."""
    each = F.inline(F.array(*[F.struct(F.lit(f.name).alias("feature"), F.col(f"{f.name}__failure").alias("step")) for f in features]))
    return built.select(*keys, each).where("step IS NOT NULL").groupBy(*keys, "feature", "step").agg(F.count("*").alias("n"))

"""Feature transforms: each takes parameters and gives a Column-to-Column function; a failure is null, never an error."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

Transform = Callable[[Column], Column]
_TYPES = {"int64": "bigint", "float32": "float", "float64": "double", "bool": "boolean", "bytes": "binary", "json": None}


def _each(f: Transform, array: bool) -> Transform:
    return (lambda x: F.transform(x, f)) if array else f


def _all_or_null(x: Column) -> Column:
    """An array whose elements all succeeded, else null."""
    return F.when(F.forall(x, lambda v: v.isNotNull()), x)


def cast(dtype: str, array: bool = False, source: str = "number") -> Transform:
    """Numbers truncate to int64; strings parse; any non-empty string and any non-zero number is true."""
    kind = _TYPES[dtype]

    def one(x: Column) -> Column:
        if kind is None:
            return x
        if dtype == "bool":
            return F.length(x) > 0 if source == "string" else x.cast("double") != 0
        if dtype == "int64" and source == "string":
            return F.when(x.rlike(r"^\s*[+-]?[0-9]+(_[0-9]+)*\s*$"), F.regexp_replace(x, "_", "").try_cast("bigint"))
        return x.try_cast(kind)

    return (lambda x: _all_or_null(F.transform(x, one))) if array else one


def length(exact: int | None = None, pad_to: int | None = None, truncate_to: int | None = None, minimum: int | None = None, maximum: int | None = None, pad_value=0) -> Transform:
    """Exact, padded or truncated array lengths, and bounds; a violation is null."""

    def f(x: Column) -> Column:
        if exact is not None:
            return F.when(F.size(x) == exact, x)
        if pad_to is not None:
            pad = F.array_repeat(F.lit(pad_value), F.greatest(F.lit(pad_to) - F.size(x), F.lit(0)))
            x = F.slice(F.concat(x, pad), 1, pad_to)
        if truncate_to is not None:
            x = F.slice(x, 1, truncate_to)
        ok = F.lit(True)
        if minimum is not None:
            ok = ok & (F.size(x) >= minimum)
        if maximum is not None:
            ok = ok & (F.size(x) <= maximum)
        return F.when(ok, x)

    return f


def clamp(low: float | None = None, high: float | None = None, array: bool = False) -> Transform:
    """Numbers held between bounds."""

    def one(x: Column) -> Column:
        if low is not None:
            x = F.greatest(x, F.lit(low))
        return F.least(x, F.lit(high)) if high is not None else x

    return lambda x: F.when(x.isNotNull(), _each(one, array)(x))


def scale(factor: float = 1, offset: float = 0, array: bool = False) -> Transform:
    """``(x - offset) * factor``."""
    return _each(lambda x: (x - F.lit(offset)) * F.lit(factor), array)


def normalize(low: float | None = None, high: float | None = None, mean: float = 0, std: float | None = None, divisor: float | None = None, array: bool = False) -> Transform:
    """Min-max when both bounds are given (mean and deviation are then ignored), else centred and divided."""
    if low is not None and high is not None:
        if low == high:
            raise ValueError("min and max are equal")
        return _each(lambda x: (x - F.lit(low)) / F.lit(high - low), array)
    if std == 0:
        raise ValueError("the deviation is zero")

    def one(x: Column) -> Column:
        x = x - F.lit(mean)
        x = x / F.lit(std) if std is not None else x
        return x / F.lit(divisor) if divisor is not None else x

    return _each(one, array)


def one_hot(depth: int) -> Transform:
    """An index as a unit vector; out of range is null."""
    return lambda x: F.when(x.between(0, depth - 1), F.transform(F.sequence(F.lit(0), F.lit(depth - 1)), lambda i: (i == x).cast("int")))


def multi_hot(depth: int) -> Transform:
    """Indices as a vector of zeros and ones; any out of range is null."""
    return lambda x: F.when(F.forall(x, lambda v: v.between(0, depth - 1)), F.transform(F.sequence(F.lit(0), F.lit(depth - 1)), lambda i: F.exists(x, lambda v: v == i).cast("int")))


def chain(*steps: Transform) -> Transform:
    """Transforms from left to right."""
    return lambda x: reduce(lambda value, step: step(value), steps, x)

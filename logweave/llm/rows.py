"""Names of rows by what they hold."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def row_hash(*columns: str | Column) -> Column:
    """A 64-bit hash of the columns in which a null is a value of its own: (x, null) and (null, x) differ."""
    named = [F.col(c) if isinstance(c, str) else c for c in columns]
    return F.xxhash64(*[x for c in named for x in (c.isNull(), c)])

"""Token counts: batches of texts go to the tokenizer inside an Arrow function that returns lengths only.

Batches are balanced by bytes and long texts are cut at boundaries the tokenizer never merges across (see ``tokens``).
Defined results: a null text counts as an empty one (0 bytes, 0 tokens); repeated rows count each for itself; other
columns are kept, and columns named like the results are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.llm.tokens import encoder
from logweave.plans.session import ship_package


def with_token_counts(docs: DataFrame, tokenizer: str, text: str = "text", limit: int = 1024) -> DataFrame:
    """Add ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens) to the documents."""
    ship_package(docs.sparkSession)

    @F.arrow_udf("long")
    def lengths(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = encoder(tokenizer)
        for batch in texts:
            yield pa.array(own.counts(batch))

    frame = docs.withColumns({"n_bytes": F.coalesce(F.octet_length(text), F.lit(0)).cast("long"), "n_tokens": lengths(F.col(text))})
    return frame.withColumn("over_limit", F.col("n_tokens") > limit)

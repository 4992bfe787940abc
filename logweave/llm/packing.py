"""Best-fit packing by sums of squares: fills sequences of a fixed number of tokens with whole documents.

Only documents longer than a sequence are cut, into full pieces and a rest.  Each piece goes where the squared counts
of open bins per residual gap become smallest (Csirik et al.): with N(g) open bins of gap g, putting a piece of length
s into gap g changes the sum by 2(N(g-s) - N(g)) + 2, filling a bin exactly by 1 - 2N(g), opening a bin by 2N(C-s) + 1.

Placing is sequential, so pieces are written once and dealt by a hash of their place in the written table into shards of a
bounded number of pieces, however many rows share an id; each shard is packed on its own from lengths alone (other columns
pass through), and may end with a few open bins.

Defined results: a null or empty text is one piece that holds the end id only; repeated documents are packed each for
itself; an empty table gives no rows; clashing input columns are dropped.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.llm.tokens import binaries, encoder, ragged, with_end
from logweave.plans.session import ship_package, written

#: Pieces of a shard, at about which number the open bins at its end no longer matter.
SHARD_PIECES = 64_000


def token_pieces(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", end_id: int = 0, capacity: int = 2048) -> DataFrame:
    """``key, piece, start, length, ids``: the ids (little-endian unsigned 32-bit, end id last) cut after every ``capacity``."""
    ship_package(docs.sparkSession)

    def cut(batches):
        own = encoder(tokenizer)
        for batch in batches:
            first = 0
            for ids, ends in own.encoded(batch.column(1)):
                ids, ends = with_end(ids, ends, end_id)
                sizes = np.diff(ends, prepend=0)
                times = -(-sizes // capacity)
                row = np.repeat(np.arange(len(sizes)), times)
                piece = ragged(np.zeros(len(sizes), dtype=np.int64), times)
                length = np.minimum(sizes[row] - piece * capacity, capacity)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(first + row)), pa.array(piece.astype(np.int32)), pa.array(piece * capacity), pa.array(length), binaries(ids, length)], ["k", "piece", "start", "length", "ids"])
                first += len(sizes)

    shape = f"k {dict(docs.dtypes)[key]}, piece int, start long, length long, ids binary"
    return docs.select(F.col(key).alias("k"), F.col(text)).mapInArrow(cut, shape).withColumnRenamed("k", key)


def place(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece, placed in the given order by the least sum of squares; ties take the tightest gap."""
    open_bins: dict[int, list[int]] = defaultdict(list)
    counts = np.zeros(capacity + 1, dtype=np.int64)
    bins = np.empty(len(lengths), dtype=np.int64)
    offsets = np.empty(len(lengths), dtype=np.int64)
    n_bins = 0
    for i, s in enumerate(lengths.tolist()):
        change = 2 * counts[capacity - s] + 1 if s < capacity else 0
        gap = capacity
        if s < capacity:
            held = counts[s:capacity]
            places = np.flatnonzero(held)
            if len(places):
                costs = 2 * (counts[places] - held[places]) + 2
                if places[0] == 0:
                    costs[0] = 1 - 2 * held[0]
                best = int(costs.argmin())
                if costs[best] <= change:
                    gap = int(places[best]) + s
        if gap == capacity:
            bins[i], offsets[i] = n_bins, 0
            n_bins += 1
        else:
            bins[i], offsets[i] = open_bins[gap].pop(), capacity - gap
            counts[gap] -= 1
        if gap > s:
            open_bins[gap - s].append(int(bins[i]))
            counts[gap - s] += 1
    return bins, offsets


def pack(pieces: DataFrame, order: tuple[str, ...] = ("doc_id", "piece"), capacity: int = 2048, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces with a ``length`` of 1 to ``capacity``; ``order`` decides between equal lengths."""
    ship_package(pieces.sparkSession)
    pieces = written(pieces, "pieces")
    shards = max(1, -(-pieces.count() // shard_pieces))
    dealt = pieces.withColumn("_shard", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards)))
    names = pieces.columns

    def fill(rows: pa.Table) -> pa.Table:
        shard = rows.column("_shard")[0].as_py() if len(rows) else 0
        rows = rows.sort_by([("length", "descending"), *((c, "ascending") for c in order)])
        bins, offsets = place(rows.column("length").to_numpy(), capacity)
        return rows.select(names).append_column("sequence_id", pa.array(bins + (shard << 40), pa.int64())).append_column("offset", pa.array(offsets, pa.int64()))

    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"
    return dealt.groupBy("_shard").applyInArrow(fill, shape)

"""Token files: ids packed at the fewest whole bits of the vocabulary, in blocks with offsets.

Documents are range-partitioned and sorted by their id, encoded, and cut into blocks of whole documents.  A block is one
row of a Parquet file in the shared folder: ``part, block, local_start, n_ids, bits, doc_keys, doc_starts, payload``.
``payload`` holds ``n_ids`` numbers of ``bits`` bits each, first id in the lowest bits of little-endian 64-bit words, so
id i is at bit ``i * bits``: numpy unpacks a whole block, or any run of ids, without reading what is before it.
``local_start`` counts ids before the block within its part; ids before a part follow from one sum for each part.

Defined results: a null or empty text holds the end id only; null ids come first; rows that repeat an id follow each
other in any order; an empty table gives no blocks and no rows.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logweave.llm.tokens import binaries, encoder, with_end
from logweave.plans.session import shared_folder, ship_package

#: A block is closed after the document that brings it to so many ids.
BLOCK_IDS = 65_536


def bits_for(vocabulary: int) -> int:
    """The fewest bits that hold every id below ``vocabulary``."""
    return max(1, (vocabulary - 1).bit_length())


def packed(ids: np.ndarray, bits: int) -> bytes:
    """64 ids fill ``bits`` words; lane j of every group of 64 lies at the same place, so 64 vector steps pack all."""
    groups = -(-len(ids) // 64)
    lanes = np.zeros((groups, 64), dtype=np.uint64)
    lanes.reshape(-1)[: len(ids)] = ids
    words = np.zeros((groups, bits), dtype=np.uint64)
    for j in range(64):
        word, shift = divmod(j * bits, 64)
        words[:, word] |= lanes[:, j] << np.uint64(shift)
        if shift + bits > 64:
            words[:, word + 1] |= lanes[:, j] >> np.uint64(64 - shift)
    return words.astype("<u8").tobytes()[: -(-len(ids) * bits // 8)]


def unpacked(payload: bytes, bits: int, first: int, last: int) -> np.ndarray:
    """Ids ``first`` to ``last`` (exclusive) of a block, reading only the words that hold them."""
    group, groups = first // 64, -(-last // 64)
    raw = payload[8 * group * bits : 8 * groups * bits]
    words = np.zeros((groups - group) * bits, dtype="<u8")
    words.view(np.uint8)[: len(raw)] = np.frombuffer(raw, dtype=np.uint8)
    words = words.reshape(-1, bits)
    lanes = np.empty((groups - group, 64), dtype=np.uint64)
    mask = np.uint64((1 << bits) - 1)
    for j in range(64):
        word, shift = divmod(j * bits, 64)
        lane = words[:, word] >> np.uint64(shift)
        if shift + bits > 64:
            lane = lane | (words[:, word + 1] << np.uint64(64 - shift))
        lanes[:, j] = lane & mask
    return lanes.reshape(-1)[first - 64 * group : last - 64 * group].astype("<u4")


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int, vocabulary: int, key: str = "doc_id", text: str = "text", path: str | None = None) -> str:
    """Encode and write all documents in ascending order of ``key``; returns the folder."""
    spark = docs.sparkSession
    ship_package(spark)
    path = path or f"{shared_folder(spark).rstrip('/')}/tokens-{uuid.uuid4().hex}"
    bits = bits_for(max(vocabulary, end_id + 1))

    def blocks(batches):
        own, part = encoder(tokenizer), TaskContext.get().partitionId()
        block = local = n = 0
        keys: list = []
        starts: list[int] = []
        bodies: list[np.ndarray] = []

        def closed():
            ids = np.concatenate(bodies)
            if int(ids.max()) >> bits:
                raise ValueError(f"id {ids.max()} does not fit {bits} bits: the vocabulary has more than {vocabulary} ids")
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([local], pa.int64()), pa.array([n], pa.int64()), pa.array([bits], pa.int32()), pa.array([keys], pa.list_(kind)), pa.array([starts], pa.list_(pa.int64())), pa.array([packed(ids, bits)], pa.binary())],
                ["part", "block", "local_start", "n_ids", "bits", "doc_keys", "doc_starts", "payload"],
            )

        for batch in batches:
            kind = batch.column(0).type
            names = iter(batch.column(0).to_pylist())
            for ids, ends in own.encoded(batch.column(1)):
                ids, ends = with_end(ids, ends, end_id)
                for body in np.split(ids, ends[:-1]):
                    keys.append(next(names))
                    starts.append(n)
                    bodies.append(body)
                    n += len(body)
                    if n >= BLOCK_IDS:
                        yield closed()
                        block, local, n, keys, starts, bodies = block + 1, local + n, 0, [], [], []
        if keys:
            yield closed()

    kind = dict(docs.dtypes)[key]
    shape = f"part int, block int, local_start long, n_ids long, bits int, doc_keys array<{kind}>, doc_starts array<long>, payload binary"
    ordered = docs.select(F.col(key).alias("k"), F.col(text)).repartitionByRange("k").sortWithinPartitions("k")
    ordered.mapInArrow(blocks, shape).write.option("compression", "zstd").parquet(path)
    return path


def read_token_files(spark: SparkSession, path: str, key: str = "doc_id") -> DataFrame:
    """``part, key, local_start, n_tokens, ids`` of every document of the files; ids as little-endian unsigned 32-bit."""
    ship_package(spark)
    stored = spark.read.parquet(path)
    kind = dict(stored.dtypes)["doc_keys"][len("array<") : -1]

    def unpack(batches):
        for batch in batches:
            cols = {f: batch.column(i) for i, f in enumerate(batch.schema.names)}
            for i in range(batch.num_rows):
                n, starts = cols["n_ids"][i].as_py(), np.array(cols["doc_starts"][i].as_py(), dtype=np.int64)
                ids = unpacked(cols["payload"][i].as_py(), cols["bits"][i].as_py(), 0, n)
                ends = np.append(starts[1:], n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([cols["part"][i].as_py()] * len(starts), pa.int32()), cols["doc_keys"][i].values, pa.array(starts + cols["local_start"][i].as_py(), pa.int64()), pa.array(ends - starts, pa.int64()), binaries(ids, ends - starts)],
                    ["part", key, "local_start", "n_tokens", "ids"],
                )

    return stored.mapInArrow(unpack, f"part int, `{key}` {kind}, local_start long, n_tokens long, ids binary")


def part_starts(spark: SparkSession, path: str) -> DataFrame:
    """``part, part_start``: ids in all parts before it. One row for each written part, without payloads."""
    sums = spark.read.parquet(path).groupBy("part").agg(F.sum("n_ids").alias("n"))
    return sums.select("part", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("part_start"))


def token_slice(spark: SparkSession, path: str, start: int, count: int) -> DataFrame:
    """Random access: ``position, id`` for ids ``start`` to ``start + count`` of the whole corpus; other blocks aren't unpacked."""
    ship_package(spark)
    located = spark.read.parquet(path).join(part_starts(spark, path), "part").withColumn("at", F.col("part_start") + F.col("local_start"))
    held = located.where((F.col("at") < start + count) & (F.col("at") + F.col("n_ids") > start))

    def cut(batches):
        for batch in batches:
            for row in batch.to_pylist():
                a, b = max(0, start - row["at"]), min(row["n_ids"], start + count - row["at"])
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(row["at"] + a, row["at"] + b), pa.int64()), pa.array(unpacked(row["payload"], row["bits"], a, b).astype(np.int64))], ["position", "id"])

    return held.select("at", "n_ids", "bits", "payload").mapInArrow(cut, "position long, id long")

"""Benchmark decontamination by a prefix-filtered set join with exact containment.

An item's windows are runs of ``window`` consecutive words (a shorter item is one window).  A window's set is its
word shingles; since containment must be whole, the prefix that a matching document cannot avoid is one shingle, and
the rarest one of each window is taken: shingles are ordered by their document frequency over the whole corpus, which
a first pass counts.  The second pass joins document shingles with those prefixes; the shingle's place in the window
says where the window would have to start, positions that would leave the document are dropped (length and positional
bound), and what is left is verified word for word.

Both sides are tables: windows, frequencies, prefixes and what a document holds meet in joins that Spark broadcasts or
shuffles by their size.  Each pass reads the documents once, whatever the size of the benchmark; a bitmap of
``BITS`` bits (its size is fixed) tells which shingles of a document any prefix can hold, and with a benchmark that fills it
more shingles reach the join.

Defined results: null or empty texts have no words and no windows; an item with a null id still marks words but is
not listed; items that repeat an id count once; repeated documents are reported each for itself, and null document
ids stay null; other document columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.llm.rows import row_hash
from logweave.llm.text import alnum_text, gram_hashes, hashed_words, signed
from logweave.plans.session import scratch, ship_package, written

SHINGLE = 3
#: Bits of the bitmaps of shingles, 8 MB.
BITS = 1 << 26
_SPANS = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping or touching half-open spans joined, in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _windows(bench: DataFrame, window: int) -> DataFrame:
    """``w, n, shingles, items``: each different window, its number of words, the hashes of its shingles, and the items that hold it."""

    def rows(batches):
        for batch in batches:
            for item, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = alnum_text(body.as_py())
                words = text.split()
                if not words:
                    continue
                n = min(window, len(words))
                k = min(SHINGLE, n)
                grams = signed(gram_hashes(hashed_words(text), k))
                starts = range(len(words) - n + 1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([item] * len(starts), pa.string()), pa.array([b" ".join(words[a : a + n]) for a in starts], pa.binary()), pa.array([n] * len(starts), pa.int32()), pa.array([grams[a : a + n - k + 1] for a in starts], pa.list_(pa.int64()))],
                    ["item", "w", "n", "shingles"],
                )

    each = bench.mapInArrow(rows, "item string, w binary, n int, shingles array<long>")
    return each.groupBy("w").agg(F.first("n").alias("n"), F.first("shingles").alias("shingles"), F.collect_set("item").alias("items"))


def _bitmap(hashes: DataFrame) -> np.ndarray:
    """The bitmap of a column of hashes: at most ``BITS / 32768`` rows of 4 KB come to the driver."""
    cell = 1 + F.col(hashes.columns[0]).bitwiseAND(F.lit(BITS - 1))
    rows = hashes.groupBy(F.bitmap_bucket_number(cell).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(cell)).alias("bits"))
    out = np.zeros(BITS // 8, dtype=np.uint8)
    for row in rows.collect():
        out[4096 * (row["bucket"] - 1) : 4096 * row["bucket"]] = np.frombuffer(row["bits"], dtype=np.uint8)
    return out


def _held(bits: np.ndarray, grams: np.ndarray) -> np.ndarray:
    """Places of the shingles that are in a bitmap."""
    cells = (grams & np.uint64(8 * len(bits) - 1)).astype(np.int64)
    return np.flatnonzero((bits[cells >> 3] >> (cells & 7).astype(np.uint8)) & 1)


def _frequencies(source: DataFrame, sizes: list[int], bits: np.ndarray) -> DataFrame:
    """``h, df``: in how many documents each shingle of the bitmap stands."""
    shared = source.sparkSession.sparkContext.broadcast(bits)

    def rows(batches):
        for batch in batches:
            found = []
            for body in batch.column(0):
                words = hashed_words(alnum_text(body.as_py()))
                for k in sizes:
                    grams = gram_hashes(words, k)
                    found.append(np.unique(grams[_held(shared.value, grams)]))
            if found:
                values, n = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(signed(values)), pa.array(n.astype(np.int64))], ["h", "n"])

    return source.select("body").mapInArrow(rows, "h long, n long").groupBy("h").agg(F.sum("n").alias("df"))


def _prefixes(windows: DataFrame, frequencies: DataFrame) -> DataFrame:
    """``h, at, n, w, items``: the rarest shingle of each window and its place there."""
    each = windows.select("w", F.posexplode("shingles").alias("at", "h")).join(frequencies, "h", "left")
    rarest = each.groupBy("w").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "h", "at")).alias("x"))
    return rarest.select("w", "x.h", "x.at").join(windows.select("w", "n", "items"), "w")


def _probed(source: DataFrame, sizes: list[int], bits: np.ndarray, window: int) -> DataFrame:
    """``id, r, n_words, hits``: of each document, the shingles a prefix can hold: hash, place, words before it, and the words around it."""
    shared, kind = source.sparkSession.sparkContext.broadcast(bits), dict(source.dtypes)["id"]
    shape = pa.list_(pa.struct([("h", pa.int64()), ("i", pa.int32()), ("lead", pa.int32()), ("around", pa.string())]))

    def rows(batches):
        for batch in batches:
            counts, hits = [], []
            for body in batch.column(2):
                text = alnum_text(body.as_py())
                hashed, words, own = hashed_words(text), None, []
                for k in sizes:
                    grams = gram_hashes(hashed, k)
                    for i in _held(shared.value, grams).tolist():
                        words = text.split() if words is None else words
                        first = max(0, i - window + 1)
                        own.append({"h": int(grams[i : i + 1].view(np.int64)[0]), "i": i, "lead": i - first, "around": b" ".join(words[first : i + window]).decode()})
                counts.append(len(hashed))
                hits.append(own or None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.int64()), pa.array(hits, shape)], ["id", "r", "n_words", "hits"])

    return source.select("id", "r", "body").mapInArrow(rows, f"id {kind}, r long, n_words long, hits array<struct<h:long,i:int,lead:int,around:string>>")


def _found(probed: DataFrame, prefixes: DataFrame) -> DataFrame:
    """``own, spans, items``: verified windows of each document (``own``: its id and hash) that has any, as merged word spans."""
    hits = probed.where("hits is not null").select(F.struct("id", "r").alias("own"), F.explode("hits").alias("x")).select("own", "x.*")
    once = hits.groupBy("own", "h", "i").agg(F.first("lead").alias("lead"), F.first("around").alias("around"))  # equal rows hold the same
    start = F.col("i") - F.col("at")
    place = F.greatest(F.col("lead") - F.col("at"), F.lit(0)) + 1
    same = F.array_join(F.slice(F.split("around", " "), place, F.col("n")), " ").cast("binary") == F.col("w")
    met = once.join(prefixes, "h").where((start >= 0) & same)
    gathered = met.select("own", F.struct(start.alias("a"), (start + F.col("n")).alias("b")).alias("span"), "items").groupBy("own").agg(F.collect_set("span").alias("spans"), F.collect_set("items").alias("items"))

    def merge(batches):
        for batch in batches:
            spans = [[{"a": a, "b": b} for a, b in merged([(x["a"], x["b"]) for x in row])] for row in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, _SPANS), batch.column(2)], ["own", "spans", "items"])

    items = F.array_sort(F.array_distinct(F.flatten("items"))).alias("items")
    kind = dict(probed.dtypes)["id"]
    return gathered.select("own", "spans", items).mapInArrow(merge, f"own struct<id:{kind},r:long>, spans array<struct<a:int,b:int>>, items array<string>")


def contamination(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", window: int = 10) -> DataFrame:
    """One row per document: ``key, n_words, spans`` (covered word spans, half open, merged) and ``items`` (ids as strings, sorted)."""
    spark = docs.sparkSession
    ship_package(spark)
    bench = benchmark.select(F.col(item_key).cast("string").alias("item"), F.col(item_text).cast("binary").alias("body"))
    source = docs.select(F.col(key).alias("id"), row_hash(key, text).alias("r"), F.col(text).cast("binary").alias("body"))
    with scratch(spark) as folder:
        windows = written(_windows(bench, window), "windows", folder)
        sizes = sorted(windows.agg(F.collect_set(F.least("n", F.lit(SHINGLE))).alias("k")).first()["k"])
        frequencies = written(_frequencies(source, sizes, _bitmap(windows.select(F.explode("shingles")))), "frequencies", folder)
        prefixes = written(_prefixes(windows, frequencies), "prefixes", folder)
        probed = written(_probed(source, sizes, _bitmap(prefixes.select("h")), window), "probed", folder)
        found = written(_found(probed, prefixes), "found", folder)
        joined = probed.select("id", "n_words", F.struct("id", "r").alias("mine")).join(found, F.col("mine").eqNullSafe(F.col("own")), "left")
        spans, items = F.coalesce("spans", F.array().cast("array<struct<a:int,b:int>>")), F.coalesce("items", F.array().cast("array<string>"))
        return written(joined.select(F.col("id").alias(key), "n_words", spans.alias("spans"), items.alias("items")), "contamination")

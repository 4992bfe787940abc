"""Hard negatives from an inverted multi-index of two half-space codebooks.

Vectors are cut in two halves, each with a codebook of its own (k-means on a bounded sample); a pair of codewords is a cell, and
every row is put in its cell.  For an anchor, a half's score of a codeword plus the anchor's half norm times the codeword's
radius bounds the half scores of all its rows; the sums of two such bounds are visited from the largest on by a heap over the two
sorted lists (the multi-sequence walk).  A search ends once no cell that is left can change what it has found: for nearest rows when
the last one found lies above the next bound, for a window of scores when that holds or the next bound lies below the window.

Rows are dealt by hash into shards of a bounded number of rows, so copies of one vector or the rows of one cell spread evenly; a
shard holds its rows and the radii of its own cells, anchors stream past it in batches, and the best of every shard are merged.
Anchors meet all rows shard by shard; nothing but the sample and the codebooks is on the driver.

Defined results: rows with a null label, a null vector or a null or non-finite component take no part; a shorter vector counts
as if zeros followed; rows equal in id, label and vector count once; ties go to the smaller id, null ids last, then by a hash
of label and vector; a null id is never an anchor; scores are 64-bit integers; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logweave.plans.session import ship_package, shared_folder, written

#: Rows from which the codebooks are fitted at most (those of the smallest hashes); every row is indexed.
SAMPLE_ROWS = 8_192
#: Codewords of each half.
CODEWORDS = 16
#: Rows of a shard at about most: 16 bytes for each and 4 to 8 for each component are held by a task.
SHARD_ROWS = 131_072
#: Rows that are scored together.
CHUNK_ROWS = 4_096
#: Anchors whose products with a cell are made together.
BATCH_ANCHORS = 32
_LAST = np.iinfo(np.int64).max


def with_moved_labels(embeddings: DataFrame) -> DataFrame:
    """Labels of rows whose id is divisible by 7 become ``(label + 1) % 10``."""
    label = F.col("label").cast("long")
    return embeddings.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label))


def integer_vectors(embeddings: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``id, label, h, q``: rows that take part, once each, with components ``floor(256 x)`` and a hash of label and vector."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    q = F.transform(F.col(vector), lambda x: F.floor(F.lit(256.0) * x.cast("double")))
    rows = embeddings.where(F.col("label").isNotNull() & F.col(vector).isNotNull()).where(finite)
    rows = rows.select(F.col(key).cast("long").alias("id"), F.col("label").cast("long").alias("label"), q.alias("q"))
    return rows.distinct().withColumn("h", F.xxhash64("label", "q"))


@dataclass(frozen=True)
class Codebooks:
    """Codewords of the two halves of vectors of ``size`` components."""

    size: int
    first: np.ndarray
    second: np.ndarray

    def halves(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return q[:, : self.size // 2], q[:, self.size // 2 :]


def _means(rows: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Lloyd's k-means from evenly spaced rows; an empty cluster keeps its place."""
    means = rows[np.linspace(0, len(rows) - 1, min(k, len(rows))).astype(int)].astype(float)
    for _ in range(rounds):
        near, _ = _nearest(rows, means)
        for i in range(len(means)):
            own = rows[near == i]
            means[i] = own.mean(axis=0) if len(own) else means[i]
    return means


def _nearest(rows: np.ndarray, means: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest codeword of each row and its distance."""
    far = (means * means).sum(axis=1) - 2 * rows.astype(float) @ means.T
    near = far.argmin(axis=1)
    return near, np.linalg.norm(rows - means[near], axis=1)


def _matrix(lists: pa.Array, size: int) -> np.ndarray:
    """Lists of integers as rows of a matrix, filled up with zeros."""
    edges = lists.offsets.to_numpy()
    out = np.zeros((len(lists), size), dtype=np.int64)
    lengths = np.diff(edges)
    row = np.repeat(np.arange(len(lists)), lengths)
    out[row, np.arange(len(row)) - np.repeat(edges[:-1] - edges[0], lengths)] = lists.flatten().to_numpy()
    return out


def fit_codebooks(vectors: DataFrame, sample: int = SAMPLE_ROWS, codewords: int = CODEWORDS) -> Codebooks | None:
    """Codebooks from the ``sample`` rows of the smallest hashes; None where there are no rows."""
    size = vectors.agg(F.max(F.size("q"))).first()[0]
    if size is None:
        return None
    rows = vectors.orderBy(F.xxhash64("h"), "id").limit(sample).select("q").toArrow().column(0).combine_chunks()
    books = Codebooks(size, np.zeros((1, size // 2)), np.zeros((1, size - size // 2)))
    first, second = books.halves(_matrix(rows, size))
    return Codebooks(size, _means(first, codewords), _means(second, codewords))


def index(vectors: DataFrame, books: Codebooks, shards: int) -> DataFrame:
    """Every row with its shard, its codewords ``c1`` and ``c2``, and its distances ``d1`` and ``d2`` to them."""
    ship_package(vectors.sparkSession)

    def assign(batches):
        for batch in batches:
            first, second = books.halves(_matrix(batch.column("q"), books.size))
            (c1, d1), (c2, d2) = _nearest(first, books.first), _nearest(second, books.second)
            cells = [pa.array(c1.astype(np.int32)), pa.array(c2.astype(np.int32)), pa.array(d1), pa.array(d2)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *cells], [*batch.schema.names, "c1", "c2", "d1", "d2"])

    dealt = vectors.select(F.pmod(F.xxhash64("id", "h"), F.lit(shards)).cast("int").alias("shard"), "id", "label", "h", "q")
    return dealt.mapInArrow(assign, "shard int, id long, label long, h long, q array<long>, c1 int, c2 int, d1 double, d2 double")


class Shard:
    """The cells of some rows, with their radii, and searches over them."""

    def __init__(self, books: Codebooks, rows: pa.Table) -> None:
        self.books = books
        c1, c2 = rows.column("c1").to_numpy(), rows.column("c2").to_numpy()
        order = np.lexsort((c2, c1))
        q = _matrix(rows.column("q").combine_chunks(), books.size)[order]
        ids = rows.column("id")
        self.none = ids.is_null().to_numpy()[order]
        self.ids = ids.fill_null(_LAST).to_numpy()[order]
        self.labels, self.hashes = (rows.column(c).to_numpy()[order] for c in ("label", "h"))
        self.most = int(np.abs(q).max(initial=0))
        self.q = q
        self.exact: dict[str, np.ndarray] = {}
        cell = (c1.astype(np.int64) * len(books.second) + c2)[order]
        names, starts = np.unique(cell, return_index=True)
        self.cells = {int(n): (int(a), int(b)) for n, a, b in zip(names, starts, [*starts[1:], len(cell)], strict=True)}
        self.lists = []
        for words, c, d in ((books.first, c1, rows.column("d1").to_numpy()), (books.second, c2, rows.column("d2").to_numpy())):
            radius = np.full(len(words), -1.0)
            np.maximum.at(radius, c, d)
            self.lists.append((np.flatnonzero(radius >= 0), radius))

    def _held(self, anchors: np.ndarray) -> np.ndarray:
        """The rows in the smallest type that holds every sum; made once for a shard, not for each chunk of rows."""
        most = self.most * int(np.abs(anchors).max(initial=0)) * self.books.size
        kind = "float32" if most < 1 << 24 else "float64" if most < 1 << 53 else "int64"
        if kind not in self.exact:
            self.exact[kind] = self.q.astype(kind)
        return self.exact[kind]

    def _scores(self, rows: np.ndarray, anchor: np.ndarray) -> np.ndarray:
        """Exact products."""
        held = self._held(anchor)
        return (held[rows] @ anchor.astype(held.dtype)).astype(np.int64)

    def ahead(self, anchors: np.ndarray) -> None:
        """Anchors that come next: the first of them that opens a cell makes the exact products of all of them with its rows."""
        held = self._held(anchors)
        self.anchors, self.known = anchors.astype(held.dtype), {}

    def _known(self, span: tuple[int, int], place: int) -> np.ndarray:
        if span not in self.known:
            self.known[span] = self.anchors @ self._held(self.anchors)[slice(*span)].T
        return self.known[span][place]

    def visits(self, anchor: np.ndarray, place: int | None = None):
        """Chunks of rows (their places and scores) by falling bounds, each with the bound of all that come later; ``place``: of the anchor in ``ahead``."""
        bounds = []
        for part, words, (used, radius) in zip(self.books.halves(anchor[None, :].astype(float)), (self.books.first, self.books.second), self.lists, strict=True):
            bound = words[used] @ part[0] + np.linalg.norm(part[0]) * radius[used]
            order = np.argsort(-bound, kind="stable")
            bounds.append((bound[order].tolist(), used[order].tolist()))
        (u1, w1), (u2, w2) = bounds
        heap, held, n = [(-(u1[0] + u2[0]), 0, 0)] if u1 else [], [], 0
        while heap:
            _, i, j = heapq.heappop(heap)
            if j + 1 < len(u2):
                heapq.heappush(heap, (-(u1[i] + u2[j + 1]), i, j + 1))
            if j == 0 and i + 1 < len(u1):
                heapq.heappush(heap, (-(u1[i + 1] + u2[0]), i + 1, 0))
            span = self.cells.get(w1[i] * len(self.books.second) + w2[j])
            if span:
                held.append(span)
                n += span[1] - span[0]
            if held and (n >= CHUNK_ROWS or not heap):
                rows = np.concatenate([np.arange(*x) for x in held])
                scores = self._scores(rows, anchor) if place is None else np.concatenate([self._known(x, place) for x in held]).astype(np.int64)
                left = -heap[0][0] if heap else -np.inf
                yield rows, scores, left + 1e-6 * (1 + abs(left)) if heap else left
                held, n = [], 0

    def _best(self, rows: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        if len(rows) > 4 * k:
            least = np.partition(scores, len(scores) - k)[len(scores) - k]
            rows, scores = rows[scores >= least], scores[scores >= least]
        order = np.lexsort((self.hashes[rows], self.ids[rows], self.none[rows], -scores))[:k]
        return rows[order], scores[order]

    def positives(self, id_: int, h: int, label: int, anchor: np.ndarray, k: int, place: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The best ``k`` other rows of the label."""
        found, their = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        for rows, scores, left in self.visits(anchor, place):
            own = self.labels[rows] == label
            rows, scores = rows[own], scores[own]
            other = ~((self.ids[rows] == id_) & (self.hashes[rows] == h) & ~self.none[rows])
            found, their = self._best(np.concatenate([found, rows[other]]), np.concatenate([their, scores[other]]), k)
            if len(found) == k and their[-1] > left:
                break
        return found, their

    def windows(self, label: int, anchor: np.ndarray, windows: list[tuple[int, int]], k: int, place: int | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each window of scores, the best ``k`` rows of other labels inside."""
        out = [(np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)) for _ in windows]
        if all(low > high for low, high in windows):
            return out
        for rows, scores, left in self.visits(anchor, place):
            other = self.labels[rows] != label
            rows, scores = rows[other], scores[other]
            open_ = False
            for w, (low, high) in enumerate(windows):
                found, their = out[w]
                least = their[-1] if len(found) == k else low
                inside = (scores >= least) & (scores <= high)
                if inside.any():
                    found, their = out[w] = self._best(np.concatenate([found, rows[inside]]), np.concatenate([their, scores[inside]]), k)
                open_ |= low <= high and low <= left and not (len(found) == k and their[-1] > left)
            if not open_:
                break
        return out


_ROW = "shard int, kind int, id long, label long, h long, q array<long>, c1 int, c2 int, d1 double, d2 double, aims array<long>"


def _search(indexed: DataFrame, anchors: DataFrame, books: Codebooks, shards: int, k: int, wanted: bool) -> DataFrame:
    """``id, h`` of the anchor, ``aim`` (place among its windows), and rows found in each shard: ``found, score, found_h``.

    A shard's rows come before the anchors; these pass a batch at a time.
    """
    names = [x.split()[0] for x in _ROW.split(", ")]
    rows = indexed.withColumns({"kind": F.lit(0), "aims": F.lit(None).cast("array<long>")}).select(*names)
    every = anchors.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), "id", "label", "h", "q", "aims")
    every = every.withColumns({"kind": F.lit(1), "c1": F.lit(0), "c2": F.lit(0), "d1": F.lit(0.0), "d2": F.lit(0.0)}).select(*names)
    stream = rows.unionByName(every).repartition(shards, "shard").sortWithinPartitions("shard", "kind")

    def search(batches):
        held, own, at = [], None, None
        for batch in batches:
            shard, kind = batch.column("shard").to_numpy(), batch.column("kind").to_numpy()
            edges = [0, *(np.flatnonzero((np.diff(shard) != 0) | (np.diff(kind) != 0)) + 1).tolist(), batch.num_rows]
            for a, b in zip(edges, edges[1:], strict=False):
                if a == b:
                    continue
                part = batch.slice(a, b - a)
                if shard[a] != at:
                    held, own, at = [], None, shard[a]
                if kind[a] == 0:
                    held.append(part)
                    continue
                if held and own is None:
                    own, held = Shard(books, pa.Table.from_batches(held)), []
                if own is not None:
                    yield from _found(own, part, k, wanted)

    return stream.mapInArrow(search, "id long, h long, aim int, found long, found_h long, score long")


def _found(own: Shard, anchors: pa.RecordBatch, k: int, wanted: bool):
    q = _matrix(anchors.column("q"), own.books.size)
    heads, aims, rows, scores = [], [], [], []
    for n, (id_, label, h, own_aims) in enumerate(zip(*(anchors.column(c).to_pylist() for c in ("id", "label", "h", "aims")), strict=True)):
        place = n % BATCH_ANCHORS
        if place == 0:
            own.ahead(q[n : n + BATCH_ANCHORS])
        results = own.windows(label, q[n], [(-(-30 * s // 100), 90 * s // 100) for s in own_aims], k, place) if wanted else [own.positives(id_, h, label, q[n], k, place)]
        for aim, (found, their) in enumerate(results):
            heads.append(np.full(len(found), n))
            aims.append(np.full(len(found), aim, dtype=np.int32))
            rows.append(found)
            scores.append(their)
    if rows:
        head, row = np.concatenate(heads), np.concatenate(rows)
        ids = pa.array(own.ids[row], mask=own.none[row])
        yield pa.RecordBatch.from_arrays([anchors.column("id").take(pa.array(head)), anchors.column("h").take(pa.array(head)), pa.array(np.concatenate(aims)), ids, pa.array(own.hashes[row]), pa.array(np.concatenate(scores))], ["id", "h", "aim", "found", "found_h", "score"])


def hard_negatives(vectors: DataFrame, every: int = 100, positives: int = 5, negatives: int = 10, shard_rows: int = SHARD_ROWS, codewords: int = CODEWORDS) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` for the rows of ``integer_vectors`` whose id ``every`` divides.

    Positives are the best other rows of the label; negatives are the best rows of other labels whose score is 30 to 90 % of the positive's.
    """
    spark = vectors.sparkSession
    ship_package(spark)
    vectors = written(vectors, "vectors", shared_folder(spark))
    books = fit_codebooks(vectors, codewords=codewords)
    if books is None:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    shards = max(spark.sparkContext.defaultParallelism, -(-vectors.count() // shard_rows))
    indexed = written(index(vectors, books, shards), "cells")
    anchors = vectors.where(F.col("id") % every == 0)
    order = [F.desc("score"), F.asc_nulls_last("found"), F.asc("found_h")]
    place = F.row_number().over(Window.partitionBy("id", "h").orderBy(*order))
    near = _search(indexed, anchors.withColumn("aims", F.lit(None).cast("array<long>")), books, shards, positives, False).withColumn("place", place)
    best = F.sort_array(F.collect_list(F.struct("place", "score", "found")))
    near = near.where(F.col("place") <= positives).groupBy("id", "h").agg(best.alias("best"))
    near = written(near, "positives")
    aimed = anchors.join(near, ["id", "h"]).withColumn("aims", F.transform("best", lambda x: x["score"])).drop("best")
    rank = F.row_number().over(Window.partitionBy("id", "h", "aim").orderBy(*order))
    mined = _search(indexed, aimed, books, shards, negatives, True).withColumn("rank", rank).where(F.col("rank") <= negatives)
    target = F.element_at("best", F.col("aim") + 1)
    named = mined.join(near, ["id", "h"])
    return named.select(F.col("id").alias("anchor_id"), target["found"].alias("positive_id"), "rank", F.col("found").alias("negative_id"), target["score"].alias("positive_score"), F.col("score").alias("negative_score"))

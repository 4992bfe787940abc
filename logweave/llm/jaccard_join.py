"""N-gram Jaccard join through a token-group matrix, and the components of its links.

A document's set holds its distinct word shingles; equal sets are one class.  Two classes link when
``100 * |A and B| >= percent * |A or B|``.

1. A first pass sketches how common shingles are (a fixed number of counters, summed over all documents), which orders
   shingles from rare to common.  Any total order is exact; a good one keeps lists short.
2. Linked sets share a token among their first ``n - ceil(percent n) + 1`` in that order, the prefix; with its places i
   and j for the first shared one, their overlap is at most ``min(n - i, m - j)``.  Prefix tokens that two classes share
   are kept; the classes of a token are compared with one of them, its pivot (the one with the fewest rare tokens, which
   is the likeliest centre of near copies).  What links is joined into groups of similar documents.
3. The token-group matrix holds each group's union of prefix tokens, by set size, with the least place of each.  For
   every query and token it bounds the overlap with the group as above; only groups whose bound reaches the needed
   overlap are opened, and their members compared.  Members of one group need no further comparison, so a large group
   of near copies costs a row for each token and not one for each pair.
4. Before sets are sent, the shared prefix tokens of a pair are counted: with those behind the shorter prefix they must
   reach the needed overlap.

Comparisons are exact on sets of 64-bit shingle hashes, which go to the centre of a comparison once; centres whose partners
hold many shingles are split by salt. Nothing is collected but the sketch, whose size is fixed; its counters are summed in
rounds of ``FAN_IN`` tasks.

Defined results: null texts and texts without words have an empty set and link with nothing; fewer words than a shingle
are one shingle; null ids keep a row with a null component unless another document of the component has an id; repeated rows are given back
each for itself; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweave.llm.components import components
from logweave.llm.text import free_memory, gram_hashes, hashed_words, signed
from logweave.plans.session import scratch, ship_package, small, written

CELLS = 1 << 22
_BLOCKS = 64
#: Tasks whose counters are summed at once.
FAN_IN = 64
#: Shingles of partners that are compared with a centre in one run, and how many times its own set they hold at least.
SALT_SHINGLES = 20_000
SALT_TIMES = 16
#: Bytes of sets that are sent at once.
SEND_BYTES = 8_000_000


def shingle_set(text: bytes | None, k: int) -> np.ndarray:
    """Sorted distinct shingle hashes of a text."""
    words = hashed_words(text.lower()) if text else np.empty(0, dtype=np.uint64)
    return np.unique(gram_hashes(words, max(1, min(k, len(words)))))


def class_of(tokens: np.ndarray) -> int:
    """64-bit name of a set."""
    import xxhash

    return int(np.uint64(xxhash.xxh3_64_intdigest(tokens.tobytes())).view(np.int64))


def prefix_size(n: int, percent: int) -> int:
    """Tokens of which linked sets must share one: all but the least overlap with any linked set, and one more."""
    return n - -(-percent * n // 100) + 1


def _sketched(source: DataFrame, k: int) -> DataFrame:
    """One pass: a light row for each document, and each task's counters as compressed blocks."""

    def rows(batches):
        counters, task = np.zeros(CELLS, dtype=np.uint16), TaskContext.get().partitionId()
        for batch in batches:
            kind = batch.column(0).type
            n, names = [], []
            for body in batch.column(2):
                tokens = shingle_set(body.as_py(), k)
                n.append(len(tokens))
                names.append(class_of(tokens) if len(tokens) else None)
                if len(tokens):
                    cells, c = np.unique(tokens & np.uint64(CELLS - 1), return_counts=True)
                    counters[cells] = np.minimum(counters[cells].astype(np.int64) + c, 65_535)
            empty = pa.nulls(len(n), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(names, pa.int64()), empty, empty, pa.nulls(len(n), pa.binary())], ["k", "t", "n", "c", "task", "block", "counters"])
        if counters.any():
            parts = [zlib.compress(p.tobytes(), 1) for p in counters.reshape(_BLOCKS, -1)]
            yield pa.RecordBatch.from_arrays([pa.nulls(_BLOCKS, kind), *[pa.nulls(_BLOCKS, pa.int64())] * 3, pa.array([task] * _BLOCKS, pa.int32()), pa.array(range(_BLOCKS), pa.int32()), pa.array(parts, pa.binary())], ["k", "t", "n", "c", "task", "block", "counters"])

    return source.mapInArrow(rows, f"k {dict(source.dtypes)['k']}, t long, n long, c long, task int, block int, counters binary")


def _order(passed: DataFrame, folder: str) -> np.ndarray:
    """The summed sketch: ``CELLS`` counters, 16 bits each."""

    def add(rows: pa.Table) -> pa.Table:
        total = np.zeros(CELLS // _BLOCKS, dtype=np.int64)
        for part in rows.column("counters"):
            total += np.frombuffer(zlib.decompress(part.as_py()), dtype=np.uint16)
        return pa.table({"task": rows.column("task")[:1], "block": rows.column("block")[:1], "counters": pa.array([zlib.compress(np.minimum(total, 65_535).astype(np.uint16).tobytes(), 1)], pa.binary())})

    counted = passed.where("block is not null").select("task", "block", "counters")
    tasks = counted.agg(F.coalesce(F.max("task"), F.lit(0)).alias("n")).first()["n"] + 1
    while True:
        folded = counted.withColumn("task", F.expr(f"task div {FAN_IN}")).withColumn("task", F.col("task").cast("int"))
        counted, tasks = folded.groupBy("task", "block").applyInArrow(add, "task int, block int, counters binary"), -(-tasks // FAN_IN)
        if tasks == 1:
            break
        counted = written(counted, "counters", folder)
    out = np.zeros((_BLOCKS, CELLS // _BLOCKS), dtype=np.uint16)
    for row in counted.collect():  # one row for each block of the sketch
        out[row["block"]] = np.frombuffer(zlib.decompress(row["counters"]), dtype=np.uint16)
    return out.reshape(-1)


def _prefixes(source: DataFrame, k: int, percent: int, order: np.ndarray) -> DataFrame:
    """``token, c, n, at, last``: prefix tokens of each class (in a task once) with their places, ``last`` the order of the prefix's end."""
    held = source.sparkSession.sparkContext.broadcast(order)

    def rows(batches):
        seen: set[int] = set()
        for batch in batches:
            free_memory()
            tokens, names, sizes, places, lasts = [], [], [], [], []
            for body in batch.column(0):
                own = shingle_set(body.as_py(), k)
                n = len(own)
                if not n or (name := class_of(own)) in seen:
                    continue
                if len(seen) > 500_000:
                    seen.clear()
                seen.add(name)
                rank = (held.value[own & np.uint64(CELLS - 1)].astype(np.uint64) << np.uint64(47)) | (own >> np.uint64(17))
                p = prefix_size(n, percent)
                first = np.lexsort((own, rank))[:p]
                tokens.append(own[first])
                names.append(np.full(p, name, dtype=np.int64))
                sizes.append(np.full(p, n, dtype=np.int32))
                places.append(np.arange(p, dtype=np.int32))
                lasts.append(np.full(p, int(rank[first[-1]]), dtype=np.int64))
            if tokens:
                yield pa.RecordBatch.from_arrays([pa.array(signed(np.concatenate(tokens))), pa.array(np.concatenate(names)), pa.array(np.concatenate(sizes)), pa.array(np.concatenate(places)), pa.array(np.concatenate(lasts))], ["token", "c", "n", "at", "last"])

    return source.select("body").mapInArrow(rows, "token long, c long, n int, at int, last long")


def _linked(source: DataFrame, pairs: DataFrame, k: int, percent: int, folder: str) -> DataFrame:
    """Of the pairs ``(u, v, un, vn)`` of classes (``u`` the centre) and their sizes, those whose sets link. Each class sends its set from one document."""
    run = F.greatest(F.lit(SALT_SHINGLES), SALT_TIMES * F.first("un"))
    salts = pairs.groupBy("u").agg(F.ceil(F.sum("vn") / run).cast("int").alias("salts"))
    members = pairs.join(salts, "u").select(F.col("v").alias("c"), F.col("u").alias("centre"), F.pmod(F.xxhash64("v"), F.col("salts")).cast("int").alias("salt"), F.lit(1).alias("kind"))
    centres = salts.select(F.col("u").alias("c"), F.col("u").alias("centre"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("kind"))
    sends = members.unionByName(centres).groupBy("c").agg(F.collect_list(F.struct("centre", "salt", "kind")).alias("sends"))
    sent = source.join(small(written(sends, "sends", folder)), "c")

    def sets(batches):
        done: set[int] = set()  # equal rows send once for each task
        for batch in batches:
            out: dict[str, list] = {"centre": [], "salt": [], "kind": [], "c": [], "tokens": []}
            size = 0
            for body, name, to in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if name in done:
                    continue
                own = shingle_set(body.as_py(), k)
                if class_of(own) != name:  # another text with the same hash
                    continue
                done.add(name)
                tokens = own.tobytes()
                for x in to:
                    out["centre"].append(x["centre"])
                    out["salt"].append(x["salt"])
                    out["kind"].append(x["kind"])
                    out["c"].append(name)
                    out["tokens"].append(tokens)
                    size += len(tokens)
                    if size >= SEND_BYTES:
                        yield table(out)
                        out, size = {x: [] for x in out}, 0
            yield table(out)

    def table(out):
        return pa.RecordBatch.from_arrays([pa.array(out["centre"], pa.int64()), pa.array(out["salt"], pa.int32()), pa.array(out["kind"], pa.int32()), pa.array(out["c"], pa.int64()), pa.array(out["tokens"], pa.binary())], list(out))

    def compare(batches):
        at, centre = None, None
        for batch in batches:
            u, v = [], []
            for x, salt, kind, name, raw in zip(*(batch.column(i).to_pylist() for i in range(4)), batch.column(4), strict=True):
                tokens = np.frombuffer(raw.as_py(), dtype=np.uint64)
                if kind == 0:
                    at, centre = (x, salt), tokens
                    continue
                assert at == (x, salt), "a centre comes before its partners"
                near = np.searchsorted(centre, tokens)
                near[near == len(centre)] = 0
                same = int((centre[near] == tokens).sum())
                if 100 * same >= percent * (len(centre) + len(tokens) - same):
                    u.append(x)
                    v.append(name)
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    delivered = sent.select("body", "c", "sends").mapInArrow(sets, "centre long, salt int, kind int, c long, tokens binary")
    return delivered.repartition("centre", "salt").sortWithinPartitions("centre", "salt", "kind").mapInArrow(compare, "u long, v long")


def jaccard_components(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: ``key``, ``n_shingles``, ``class_id`` (equal sets) and ``component_id`` (smallest key reachable by links)."""
    ship_package(docs.sparkSession)
    with scratch(docs.sparkSession) as folder:
        return written(_components(docs, key, text, k, percent, folder), "classes")


def _components(docs: DataFrame, key: str, text: str, k: int, percent: int, folder: str) -> DataFrame:
    plain = docs.select(F.col(key).alias("k"), F.xxhash64(text).alias("t"), F.col(text).cast("binary").alias("body"))
    passed = written(_sketched(plain, k), "shingles", folder)
    light = passed.where("block is null").select("k", "t", "n", "c")
    prefixes = _prefixes(plain, k, percent, _order(passed, folder))
    ends = F.struct("last", "c")
    lists = prefixes.groupBy("token").agg(F.max(ends).alias("a"), F.min(ends).alias("b")).where("a <> b").select("token", F.col("a.c").alias("pivot"))
    lists = written(lists, "lists", folder)
    shared = written(prefixes.join(lists, "token").groupBy("token", "c").agg(*[F.first(x).alias(x) for x in ("n", "at", "last", "pivot")]), "shared", folder)
    heads = written(shared.groupBy("c").agg(F.first("n").alias("n"), F.first("last").alias("last"), F.collect_list("token").alias("tokens")), "heads", folder)

    # The text that sends a class's set: any of equal sets would do; the smallest id, then the hash of the text decides.
    senders = light.where("c is not null").groupBy("c").agg(F.min(F.struct("k", "t")).alias("by")).select("c", "by.k", "by.t")

    # Groups: each class of a token against the token's pivot.
    pivots = shared.where("c = pivot").select("token", F.col("c").alias("u"), F.col("n").alias("m"), F.col("at").alias("j"))
    near = shared.where("c <> pivot").select("token", F.col("c").alias("v"), "n", F.col("at").alias("i")).join(pivots, "token").where(_within("n", "i", "m", "j", percent))
    pairs = written(_promising(near.select("u", "v").distinct(), heads, percent), "pairs", folder)
    groups = written(components(_linked(_sources(plain, senders, pairs, folder), pairs, k, percent, folder), folder).withColumnRenamed("node", "c").withColumnRenamed("component", "g"), "groups", folder)

    # The matrix: a token, and the groups and set sizes whose union holds it.
    grouped = shared.join(groups, "c", "left").select("token", "c", "n", "at", F.coalesce("g", "c").alias("g"))
    matrix = grouped.groupBy("token", "g", F.col("n").alias("m")).agg(F.min("at").alias("j"))
    several = matrix.groupBy("token").agg(F.min("g").alias("a"), F.max("g").alias("b")).where("a < b").select("token")
    grouped = written(grouped.join(several, "token"), "grouped", folder)
    matrix = grouped.groupBy("token", F.col("g").alias("other"), F.col("n").alias("m")).agg(F.min("at").alias("j"))
    opened = grouped.join(matrix, "token").where(F.col("other") < F.col("g")).where(_within("n", "at", "m", "j", percent)).select("token", F.col("c").alias("v"), "n", F.col("at").alias("i"), "other", "m")
    members = grouped.select("token", F.col("g").alias("other"), F.col("n").alias("m"), F.col("c").alias("u"), F.col("at").alias("j"))
    met = opened.join(members, ["token", "other", "m"]).where(_within("n", "i", "m", "j", percent)).select("u", "v").distinct()
    more = written(_promising(met, heads, percent), "opened", folder)
    named = groups
    if not more.isEmpty():
        found = _linked(_sources(plain, senders, more, folder), more, k, percent, folder)
        old = groups.select("c", "g")
        ends = found.join(old.select(F.col("c").alias("u"), F.col("g").alias("gu")), "u", "left").join(old.select(F.col("c").alias("v"), F.col("g").alias("gv")), "v", "left")
        ends = ends.select(F.coalesce("gu", "u").alias("u"), F.coalesce("gv", "v").alias("v"))
        over = written(components(ends, folder), "over", folder)
        known = groups.join(over, F.col("g") == F.col("node"), "left").select("c", F.coalesce("component", "g").alias("g"))
        single = over.join(groups, F.col("node") == F.col("c"), "left_anti").select(F.col("node").alias("c"), F.col("component").alias("g"))
        named = known.unionByName(single).groupBy("c").agg(F.min("g").alias("g"))
    classes = light.where("c is not null").groupBy("c").agg(F.min("k").alias("first")).join(named, "c", "left").select("c", "first", F.coalesce("g", "c").alias("g"))
    classes = written(classes, "named", folder)
    roots = written(classes.groupBy("g").agg(F.min("first").alias("root")), "roots", folder)
    final = classes.join(small(roots), "g").select("c", "root")
    return light.join(final, "c", "left").select(F.col("k").alias(key), F.col("n").alias("n_shingles"), F.col("c").alias("class_id"), F.when(F.col("c").isNull(), F.col("k")).otherwise(F.col("root")).alias("component_id"))


def _overlap(n: Column, m: Column, percent: int) -> Column:
    """The least overlap of linked sets of these sizes."""
    return F.ceil(F.lit(percent) * (n + m) / F.lit(100 + percent))


def _within(n: str, i: str, m: str, j: str, percent: int) -> Column:
    """Whether sets of sizes n and m whose first shared token stands at places i and j can link."""
    fits = F.lit(100) * F.least(n, m) >= F.lit(percent) * F.greatest(n, m)
    return fits & (F.least(F.col(n) - F.col(i), F.col(m) - F.col(j)) >= _overlap(F.col(n), F.col(m), percent))


def _promising(pairs: DataFrame, heads: DataFrame, percent: int) -> DataFrame:
    """Pairs whose shared prefix tokens, with all that lies behind the prefix that ends first, reach the needed overlap."""
    ends = [heads.select(F.col("c").alias(x), F.col("n").alias(f"{x}n"), F.col("last").alias(f"{x}last"), F.col("tokens").alias(f"{x}tokens")) for x in ("u", "v")]
    rows = pairs.join(ends[0], "u").join(ends[1], "v")
    rest = lambda n: F.ceil(F.lit(percent) * F.col(n) / F.lit(100)) - 1
    tail = F.when(F.col("ulast") < F.col("vlast"), rest("un")).when(F.col("ulast") > F.col("vlast"), rest("vn")).otherwise(F.greatest(rest("un"), rest("vn")) + 1)
    return rows.where(F.size(F.array_intersect("utokens", "vtokens")) + tail >= _overlap(F.col("un"), F.col("vn"), percent)).select("u", "v", "un", "vn")


def _sources(plain: DataFrame, senders: DataFrame, pairs: DataFrame, folder: str) -> DataFrame:
    """``body, c`` of the documents with one id and text for each class in the pairs."""
    ids = pairs.select(F.col("u").alias("c")).unionByName(pairs.select(F.col("v").alias("c"))).distinct()
    wanted = small(written(senders.join(ids, "c"), "senders", folder))
    return plain.join(wanted, plain["k"].eqNullSafe(wanted["k"]) & (plain["t"] == wanted["t"])).select("body", "c")
